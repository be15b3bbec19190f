"""Sharding by a Feistel permutation with cycle walking.

Every row gets its global number (ascending ``doc_id``, nulls first, ties by
content). A keyed Feistel network permutes ``[0, N)``; the permuted number
``p`` gives ``shard = p mod shards`` and ``slot = p div shards``, so shard counts
differ by at most one, slots are gapless, and either can be computed (or
inverted) for any row without a shuffle of the rows themselves.

Defined cases: a null text has no bytes; null ids are numbered first; repeated
rows are numbered separately; an empty table gives an empty result; extra
columns are ignored by ``assign_shards`` and may clash with nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.order import with_row_number

ROUNDS = 6
SEED = 20_240_501


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser used as the round function."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed & (2**63 - 1))
    return [int(k) for k in keys]


def _half_bits(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n)) / 2))


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of ``[0, n)`` applied to an array of row numbers.

    The network works on the smallest even number of bits that covers ``n``
    (fewer than 4 n values); a value outside ``[0, n)`` is walked along its
    cycle until it falls inside, which keeps the map one to one.
    """
    half = _half_bits(n)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = _round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, key) & low), left
            else:
                left, right = right, left ^ (_mix(right, key) & low)
        return (left << shift) | right

    out = once(rows.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def place_of(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number stored at (shard, slot)."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot for every row of ``docs``."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    numbered, n = with_row_number(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return (
        numbered.withColumn("_p", permuted("row"))
        .withColumn("shard", (F.col("_p") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_p div {int(shards)}"))
        .drop("_p")
    )
