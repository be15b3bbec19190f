"""Joins that keep a frequent key from meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when more than one row in ``HOT_SHARE``, and more than ``HOT_ROWS`` rows, hold it.
HOT_SHARE = 1000
HOT_ROWS = 100_000


def join_keyed(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``n`` the key's number of rows.

    ``total``: rows of ``rows``. The counts of hot keys sum up to at most
    ``total``, so there are fewer than ``HOT_SHARE`` of them; they are broadcast
    and their rows stay where they are. All others meet by shuffle. With
    ``total`` at most ``HOT_ROWS`` no key can be hot and only the shuffle is
    planned. Rows without a match, and null keys, go.
    """
    order = [*rows.columns, *[c for c in table.columns if c not in (key, "n")]]
    if total <= HOT_ROWS:
        return rows.join(table, key).select(*order)
    hot = table.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).select(*order).union(cold.select(*order))


#: A table is broadcast up to this many bytes of values, as counted.
SMALL_BYTES = 8 << 20


def join_small(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a key and usually few; null keys match.

    The table's bytes are counted first. Up to ``SMALL_BYTES`` it is broadcast and
    the rows stay where they are; beyond, there are too many keys for that and the
    two meet by shuffle, where adaptive execution splits a key that is hot.
    """
    held = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    other = table.withColumnRenamed(key, "_key")
    met = rows.join(F.broadcast(other) if held <= SMALL_BYTES else other, rows[key].eqNullSafe(F.col("_key")))
    return met.drop("_key")
