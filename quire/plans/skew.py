"""Lookups that keep a frequent key from meeting in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.session import cut_lineage

#: A key is hot when more than one row in ``HOT_SHARE``, and more than ``HOT_ROWS`` rows, hold it.
HOT_SHARE = 1000
HOT_ROWS = 100_000


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold more than their share of ``rows``: fewer than ``HOT_SHARE``, whatever the rows."""
    many = cut_lineage(rows.groupBy(*keys).count().where(F.col("count") > HOT_ROWS))
    if many.isEmpty():
        return many.drop("count")
    total = rows.count()
    return many.where(F.col("count") > total // HOT_SHARE).drop("count")


def _on(left: list[str], right: list[str], sure: set[str]) -> Column:
    """Equality of keys; nulls match, but for the ``sure`` ones, which have none: a plain equality needs no further deal of what is dealt by the key."""
    return reduce(lambda a, b: a & b, [F.col(a) == F.col(b) if a in sure else F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key, or nulls; null keys match.

    Rows of hot keys stay where they are and get the table's few rows for them by
    broadcast; all others meet the table by shuffle, and all where no key is hot. ``hot``: the keys, where the
    caller has found them before (as for rows that are looked up round after round).
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    held = [c for c in table.columns if c not in keys]
    named = [f"_key{i}" for i in range(len(keys))]
    other = table.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], *held)
    order = [*rows.columns, *held]
    sure = {k for k in keys if not rows.schema[k].nullable and not table.schema[k].nullable}
    if hot.isEmpty():
        return rows.join(other, _on(keys, named, sure), "left").select(*order)
    marks = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)])
    few = other.join(F.broadcast(marks.select(*[F.col(n).alias(f"{n}_") for n in named])), _on(named, [f"{n}_" for n in named], set()), "left_semi")
    warm = rows.join(F.broadcast(marks), _on(keys, named, sure), "left_semi").join(F.broadcast(few), _on(keys, named, sure), "left").select(*order)
    cold = rows.join(F.broadcast(marks), _on(keys, named, sure), "left_anti").join(other, _on(keys, named, sure), "left").select(*order)
    return warm.union(cold)
