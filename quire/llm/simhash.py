"""SimHash near-duplicates with pigeonring filtering.

A document's 64-bit fingerprint is a majority vote over the XXH64 hashes of its
three-word shingles. Fingerprints within ``MAX_BITS`` differing bits are linked;
linked fingerprints form components.

Pigeonring: cut the 64 bits into a ring of four segments. If two fingerprints
differ in at most 3 bits, some segment starts a chain whose cumulative
differences stay within the proportional budget ``floor(l * 3 / 4)`` at every
length l: none in the first segment, at most 1 in two, at most 2 in three, at
most 3 in four. The first two links of the chain are an equality: the index
holds (start, segment, next segment) and a probe asks for its own segment and
each of the 17 values within one bit of its next one, so only pairs that pass
both meet; longer chains are checked on the pair, then the Hamming distance.
Equal fingerprints were merged before, so copies never pair up. The index is
joined by shuffle; a partition that a frequent pair of segments makes large is
split by adaptive execution. Where all rows of a fingerprint, or all fingerprints
of a component, are given their group's values, frequent keys are broadcast
instead (see ``skew``).

Defined cases: a null or wordless text has fingerprint 0 and links like any
other; fewer than three words are one shingle; rows with a null ``doc_id`` are
fingerprinted, link others, take their component's id (null if it has none) and
are never dropped; rows of one id and different texts are told apart by their
text's hash; repeated rows fall into one component; an empty table gives an
empty result; extra columns of ``docs`` are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.graph import connected_components
from quire.llm.skew import join_keyed
from quire.plans.session import cut_lineage, shuffle_width

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 3
SEGMENTS, WIDTH = 4, 16
#: Shingles voted on at a time; bounds memory for very long texts.
BLOCK = 1 << 15


def _shingle_hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    n = max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        ends = ends[min(SHINGLE, len(part)) - 1 :].tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends, strict=False)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(words):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * votes > n).astype(np.uint8), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Column of fingerprints as signed 64-bit integers."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def as_hex(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _chain_holds(diff: Column, start: int) -> Column:
    """Do the cumulative differences from segment ``start`` keep within every budget?"""
    total, out = F.lit(0), F.lit(True)
    for length in range(1, SEGMENTS + 1):
        total = total + F.bit_count(_segment(diff, start + length - 1))
        out = out & (total <= length * MAX_BITS // SEGMENTS)
    return out


def hamming_links(distinct: DataFrame) -> DataFrame:
    """(a, b) for every two fingerprints of ``distinct`` (column ``fp``, no repeats) at 1 to 3 differing bits."""
    # every row becomes 72, so the few numbers are dealt out over all tasks first
    distinct = distinct.repartition(shuffle_width(distinct.sparkSession))
    key = lambda i, second: F.lit(i << 2 * WIDTH).bitwiseOR(F.shiftleft(_segment(F.col("fp"), i), WIDTH)).bitwiseOR(second)
    index = distinct.select(F.explode(F.array(*[key(i, _segment(F.col("fp"), i + 1)) for i in range(SEGMENTS)])).alias("k"), F.col("fp").alias("a"))
    flips = [0, *[1 << j for j in range(WIDTH)]]
    probes = distinct.select(
        F.explode(F.array(*[key(i, _segment(F.col("fp"), i + 1).bitwiseXOR(F.lit(f).cast("long"))) for i in range(SEGMENTS) for f in flips])).alias("k"),
        F.col("fp").alias("b"),
    )
    diff = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("k", 2 * WIDTH)
    chained = F.lit(False)
    for i in range(SEGMENTS):
        chained = chained | ((start == i) & _chain_holds(diff, i))
    # an explode is taken for as large as its input, so a side of 68 rows a number would seem small enough to broadcast
    return index.hint("merge").join(probes.hint("merge"), "k").where((F.col("a") < F.col("b")) & chained & (F.bit_count(diff) <= MAX_BITS)).select("a", "b").distinct()


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), fp, and first: the least (doc_id, tie) of the row's component, null if it has no id."""
    base = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("tie"), fingerprints(F.col("text")).alias("fp")))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie"))
    groups = cut_lineage(base.groupBy("fp").agg(F.min(own).alias("least"), F.count("*").alias("n")))
    rows, distinct = groups.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the nodes are fingerprints: one id may be on rows of several, and some have none
    components = connected_components(hamming_links(groups.select("fp"))).withColumnRenamed("node", "fp")
    linked = cut_lineage(groups.join(components, "fp").select("fp", "component", "least", F.col("n").alias("rows")))
    firsts = linked.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    of_group = join_keyed(linked, firsts, "component", distinct).select("fp", "first", F.col("rows").alias("n"))
    alone = groups.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("first"), "n")
    return join_keyed(base, of_group.union(alone), "fp", rows).select("doc_id", "tie", "fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row of ``docs``."""
    return _labelled(docs).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, that of the smallest id (of its texts the one of smallest hash), left of each component.

    Rows alike in id and text are reduced to one by a further aggregation, combined
    before its shuffle; it is planned only where there are such rows.
    """
    found = cut_lineage(_labelled(docs))
    key = ["doc_id", "tie"]
    dropped = found.where(F.col("doc_id").isNotNull() & (F.struct(*key) != F.col("first"))).select(*key).distinct()
    # whole rows travel as one struct, so no name of theirs can clash
    kept = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.struct("*").alias("doc")).join(dropped, key, "left_anti")
    if not found.where("doc_id IS NOT NULL").groupBy(*key).count().where("count > 1").isEmpty():
        kept = kept.where("doc_id IS NOT NULL").groupBy(*key).agg(F.first("doc").alias("doc")).union(kept.where("doc_id IS NULL"))
    return kept.select("doc.*")
