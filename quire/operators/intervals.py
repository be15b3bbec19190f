"""Points in ranges by equality of aligned tiles and blocks.

A closed range of integers reaches into the tiles of ``TILE`` values that its ends lie
in, and covers those between them whole. Points meet the ranges that end in their tile
by an equality join, and are compared with these only. What lies between the ends is
the union of at most two aligned power-of-two blocks of tiles a level; a tile lies in
exactly one block of each level, so it meets the ranges that cover it by equality of
(level, block), for as many levels as the ranges use. Of ranges that overlap, the one
declared last holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import let
from quire.plans.session import cut_lineage
from quire.plans import skew
from quire.plans.skew import lookup

#: Ranges lie between 0 and 2 ** BITS - 1.
BITS = 40
#: Values of a tile, as a power of two: most ranges of codes end within two tiles.
TILE = 6


def blocks_of(low: Column, high: Column) -> Column:
    """array of (level, block): the fewest aligned blocks that make up ``low`` to ``high``; none when ``high`` is less."""
    item = "array<struct<level:int,block:bigint>>"
    stop = high + 1

    def at(k: Column) -> Column:
        # at each level the range covers whole blocks a to b - 1; an odd end is in no larger block of the range
        def ends(x: Column) -> Column:
            one = lambda block, held: F.when(held, F.array(F.struct(k.alias("level"), block.alias("block")))).otherwise(F.array().cast(item))
            left, right = x["a"] % 2 == 1, x["b"] % 2 == 1
            return F.when(x["a"] < x["b"], F.concat(one(x["a"], left), one(x["b"] - 1, right & ~(left & (x["a"] + 1 == x["b"]))))).otherwise(F.array().cast(item))

        a = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k)
        return let(F.struct(a.alias("a"), F.call_function("shiftright", stop, k).alias("b")), ends)

    # no block is larger than the range
    return F.when(high >= low, F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(high - low + 1))), at))).otherwise(F.array().cast(item))


def _crowded(rows: DataFrame, by: list[str]) -> bool:
    """Whether some group holds more than ``HOT_ROWS`` rows, so that some tile may."""
    return not rows.groupBy(*by).count().where(F.col("count") > skew.HOT_ROWS).isEmpty()


def _covering(tiles: DataFrame, wide: DataFrame) -> DataFrame:
    """_tile, _by, range: the last declared of the ranges that cover a tile whole, of the ``tiles`` that are asked."""
    cut = wide.select("_by", F.explode(blocks_of(F.col("_first") + 1, F.col("_last") - 1)).alias("b"), "range")
    blocks = cut_lineage(cut.groupBy("_by", F.col("b.level").alias("level"), F.col("b.block").alias("block")).agg(F.max("range").alias("range")))
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())  # at most BITS + 1
    if not levels:
        return blocks.select(F.col("block").alias("_tile"), "_by", "range")
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_tile", k).alias("block")) for k in levels])
    asked = cut_lineage(tiles.distinct())
    found = lookup(asked.select("*", F.explode(places).alias("p")).select("_tile", "_by", "p.level", "p.block"), blocks, ["_by", "level", "block"])
    return found.where("range IS NOT NULL").groupBy("_tile", "_by").agg(F.max("range").alias("range"))


def values_in_intervals(points: DataFrame, ranges: DataFrame, by: list[str], value: str, low: str = "low", high: str = "high", order: str = "ord") -> DataFrame:
    """by, ``value`` (long), n (rows of ``points`` that have them), and the columns of the range that holds the value, or nulls.

    As ``in_intervals``, each distinct (key, value) being one row. Values and ranges are
    dealt by key and tile once; where a group holds very many rows, they are reduced
    before, values to distinct ones and ranges to the last declared of the same ends, so
    that a tile has at most ``2 ** TILE`` values, and ranges by the square of that.
    """
    extra = [c for c in ranges.columns if c not in by]
    kept = F.struct(order, *[c for c in extra if c != order])
    # null keys match each other in a struct, and rows dealt by it need not be dealt anew
    key, tile = F.struct(*by).alias("_by"), lambda c: F.shiftright(F.col(c).cast("long"), TILE)
    dealt = lambda df: df.repartition("_tile", "_by")
    cut = ranges.where((F.col(low) >= 0) & (F.col(high) < 1 << BITS) & (F.col(low) <= F.col(high))).select(key, tile(low).alias("_first"), tile(high).alias("_last"), kept.alias("range"))
    ends = cut.select(F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_tile"), "_by", "range")
    last = lambda df: df.groupBy("_tile", "_by", F.col("range")[low].alias("_low"), F.col("range")[high].alias("_high")).agg(F.max("range").alias("range")).select("_tile", "_by", "range")
    held = points.select(tile(value).alias("_tile"), key, F.col(value).cast("long").alias("_value"), F.lit(1).cast("long").alias("n"))
    counted = lambda df: df.groupBy("_tile", "_by", "_value").agg(F.sum("n").alias("n"))
    wide = cut.where(F.col("_last") - F.col("_first") > 1)
    if not wide.isEmpty():
        ends = ends.union(_covering(held.select("_tile", "_by").where("_tile IS NOT NULL"), wide))
    if _crowded(ranges, by):
        ends = last(ends)
    if _crowded(points, by):
        held = counted(held)
    near = last(dealt(ends)).withColumnsRenamed({"_tile": "_at", "_by": "_key"})
    on = (F.col("_tile") == F.col("_at")) & (F.col("_by") == F.col("_key")) & F.col("_value").between(F.col("range")[low].cast("long"), F.col("range")[high].cast("long"))
    # what is broadcast for its size on disk may be far larger
    met = counted(dealt(held)).join(near.hint("merge"), on, "left").groupBy("_tile", "_by", "_value").agg(F.first("n").alias("n"), F.max("range").alias("range"))
    return met.select("_by.*", F.col("_value").alias(value), "n", *[F.col("range")[c].alias(c) for c in extra])


def in_intervals(points: DataFrame, ranges: DataFrame, by: list[str], value: str, low: str = "low", high: str = "high", order: str = "ord") -> DataFrame:
    """``points`` with the columns of the range that holds their value, or nulls.

    ``ranges``: by, ``low`` and ``high`` (both included), ``order`` (the greatest holds
    where ranges overlap; equal ones are decided by their other columns) and what is to
    be looked up. A range whose ``high`` is less than ``low`` holds nothing; a null value,
    or one out of 0 to 2**40 - 1, lies in no range. Null keys match each other.

    Each distinct (key, value) is looked up once (``values_in_intervals``), and rows
    take its answer by ``lookup``, so frequent values are not gathered.
    """
    extra = [c for c in ranges.columns if c not in by]
    named = [f"_{i}" for i in range(len(extra))]
    answers = values_in_intervals(points, ranges, by, value, low, high, order).select(*by, F.col(value).alias("_value"), *[F.col(c).alias(n) for c, n in zip(extra, named, strict=True)])
    met = lookup(points.withColumn("_value", F.col(value).cast("long")), answers, [*by, "_value"])
    return met.select(*points.columns, *[F.col(n).alias(c) for c, n in zip(extra, named, strict=True)])
