"""Associative scans along ordered rows, without gathering a group anywhere.

``segmented_scan`` gives every row the combination of all values of its group up to
it, for any associative ``combine`` on columns: sums, last values, affine products,
compositing. A group of at most ``BLOCK`` rows is one run, however far its places are
apart; it is scanned inside one row by a higher-order function, without a round.
The rows of a larger group are dealt into aligned runs of ``BLOCK`` places, the runs'
totals are scanned in the same way, and so on until every group is one run; then the
totals before a run are carried into it. Each round moves a fraction of the rows of
the one before, every key of a shuffle or join is a single run, and a group that
holds a third of all rows is as many runs as its rows ask for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.session import cut_lineage

#: Places of a run, and most rows of a group that are one run wherever their places are.
BLOCK = 512
Combine = Callable[[Column, Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let2(a: Column, b: Column, body: Combine) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: body(x["a"], x["b"]))


def large_groups(rows: DataFrame, by: list[str]) -> DataFrame | None:
    """The groups of more than ``BLOCK`` rows (fewer than one in ``BLOCK`` rows), or none."""
    many = cut_lineage(rows.groupBy(*by).count().where(F.col("count") > BLOCK).select(*by))
    return None if many.isEmpty() else many


def _in_runs(nodes: DataFrame, by: list[str], large: DataFrame | None) -> DataFrame:
    """``nodes`` with ``_block``: the run of a row's place, 0 in groups that are one run."""
    if large is None:
        return nodes.withColumn("_block", F.lit(0).cast("long"))
    marks = large.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(large.columns)], F.lit(True).alias("_large"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(large.columns)], F.lit(True))
    block = F.when(F.col("_large"), F.floor(F.col("_place") / BLOCK)).otherwise(0)
    return nodes.join(F.broadcast(marks), on, "left").withColumn("_block", block).drop("_large", *[f"_{i}" for i in range(len(large.columns))])


def _before(nodes: DataFrame, by: list[str], combine: Combine, large: DataFrame | None) -> DataFrame:
    """``nodes`` (by, place, item, value) with ``before``: the combination of all earlier values of the group, null for its first."""
    # the last of the array so far is what the next value is combined with
    onto = lambda held, v: F.concat(held, F.array(let2(F.get(held, F.size(held) - 1), v, lambda a, b: F.when(a.isNull(), b).otherwise(combine(a, b)))))
    held = F.sort_array(F.collect_list(F.struct("_place", "_value", "_item")))
    kind = nodes.schema["_value"].dataType.simpleString()
    runs = [] if large is None else ["_block"]
    blocks = _in_runs(nodes, by, large).groupBy(*by, *runs).agg(held.alias("_held"))
    blocks = blocks.withColumn("_sums", F.aggregate("_held._value", F.array().cast(f"array<{kind}>"), onto))
    if large is None:
        each = blocks.select(*by, "_sums", F.posexplode("_held").alias("_nth", "_x"))
        return each.select(*by, F.col("_x._place").alias("_place"), F.col("_x._item").alias("_item"), F.col("_x._value").alias("_value"), F.get("_sums", F.col("_nth") - 1).alias("_before"))
    blocks = cut_lineage(blocks)
    if (blocks.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > 1:
        totals = blocks.select(*by, F.col("_block").alias("_place"), F.col("_block").alias("_item"), F.element_at("_sums", -1).alias("_value"))
        carried = _before(totals, by, combine, large_groups(totals, by)).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_item").alias("_run"), F.col("_before").alias("_carry"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.col("_block") == F.col("_run"))
        blocks = blocks.join(carried, on, "left").drop("_run", *[f"_{i}" for i in range(len(by))])
    else:
        blocks = blocks.withColumn("_carry", F.lit(None).cast(kind))
    each = blocks.select(*by, "_carry", "_sums", F.posexplode("_held").alias("_nth", "_x"))
    own = F.get("_sums", F.col("_nth") - 1)
    before = F.when(own.isNull(), F.col("_carry")).when(F.col("_carry").isNull(), own).otherwise(let2(F.col("_carry"), own, combine))
    return each.select(*by, F.col("_x._place").alias("_place"), F.col("_x._item").alias("_item"), F.col("_x._value").alias("_value"), before.alias("_before"))


def segmented_scan(rows: DataFrame, by: list[str], order: str, value: Column, combine: Combine, name: str = "scanned", before: str | None = None, large: DataFrame | bool | None = True) -> DataFrame:
    """``rows`` with the combination of the values of their group up to and including them.

    ``by``: the group; null keys are a group of their own. ``order``: an integer
    column; rows of one place are taken in the order of their values, then of all
    their columns, which must be orderable (no maps). ``combine(earlier, later)`` is
    associative and is never given a null by this function; a row of null value
    leaves the scan as it is. ``before``: a column for the combination that leaves the
    row itself out, null where nothing comes before. ``large``: ``large_groups`` by
    some or all of ``by``; by default they are counted, which evaluates ``rows`` once more.
    """
    # the group's columns stay outside: what is dealt by them need not be dealt anew
    own = [c for c in rows.columns if c not in by]
    nodes = rows.select(*by, F.col(order).cast("long").alias("_place"), F.struct(*own).alias("_item"), value.alias("_value"))
    either = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))
    found = _before(nodes, by, either, large_groups(rows, by) if large is True else large)
    out = [let2(F.col("_before"), F.col("_value"), either).alias(name)] + ([F.col("_before").alias(before)] if before else [])
    return found.select(*[F.col(c) if c in by else F.col("_item")[c].alias(c) for c in rows.columns], *out)


def segmented_reduce(rows: DataFrame, by: list[str], order: str, value: Column, combine: Combine) -> DataFrame:
    """by and ``value``: the combination of all values of each group, in order; one row a group.

    The associative ``combine(earlier, later)`` runs inside groups of at most ``BLOCK``
    rows and, of larger ones, inside runs of ``BLOCK`` places, then over the runs'
    results, and so on, so a group of any size is as many rows as it asks for. Null
    values leave the result as it is. ``rows`` is evaluated once more to count them.
    """
    onto = lambda a, b: F.when(a.isNull(), b).otherwise(combine(a, b))
    nodes = rows.select(*by, F.col(order).cast("long").alias("_place"), value.alias("_value")).where("_value IS NOT NULL")
    held = F.sort_array(F.collect_list(F.struct("_place", "_value")))
    total = F.aggregate("_held._value", F.lit(None).cast(nodes.schema["_value"].dataType), lambda a, b: let2(a, b, onto))
    large = large_groups(rows, by)
    while large is not None:
        blocks = _in_runs(nodes, by, large).groupBy(*by, F.col("_block").alias("_place")).agg(held.alias("_held"))
        nodes = cut_lineage(blocks.select(*by, "_place", total.alias("_value")))
        large = large_groups(nodes, by)
    return nodes.groupBy(*by).agg(held.alias("_held")).select(*by, total.alias("value"))
