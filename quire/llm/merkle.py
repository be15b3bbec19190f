"""Merkle manifest of a table: a hash tree for each group, and one over the groups.

``H`` is lowercase hex SHA-256 of its inputs' concatenation, digests as hex text.
A row's leaf is ``H`` of its fields, each ``-`` if null, else its UTF-8 byte count,
``:`` and the value. A group's leaves ascend by key; while several nodes remain,
every two consecutive ones become their ``H`` (a last lone one becomes ``H`` of
itself). What remains is the group's subroot; the subroots, by group, likewise give
the root.

Levels are kept as concatenated strings. The nodes of a tree are dealt into aligned
blocks of ``2 ** BLOCK_BITS``; a block holds each of its levels as one string of
64-character digests, whose fixed-width substrings are hashed to the next level and
whose flanking substrings are the siblings. The blocks' last digests are the nodes
of the next round, ``BLOCK_BITS`` levels up, until every group is one block. A round
moves a fraction ``2 ** -BLOCK_BITS`` of the rows of the one before, so only the
first costs: a range shuffle of keys and digests for the places, and a shuffle into
blocks. Texts are never shuffled, no group meets in one task, whatever its share of
the rows, and the driver sees counts only.

Defined cases: a null group is a group of its own and comes first; null keys come
first in their group; rows of equal keys are ordered by leaf, equal leaves are
interchangeable, and every row is kept; a group of one row has its leaf as subroot,
a table of one group its subroot as root; an empty table gives an empty manifest;
texts of any length are hashed whole in the task that reads them; other columns,
whatever their names, are neither hashed nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.skew import join_small
from quire.llm.text import indexes, let
from quire.plans.order import with_row_number
from quire.plans.session import cut_lineage

BLOCK_BITS = 8
DIGEST = 64
SIBLINGS = "array<struct<side:string,digest:string>>"


def encoded(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _parents(level: Column) -> Column:
    """The level above a level: every two digests' ``H``, concatenated."""
    pairs = indexes(F.ceil(F.octet_length(level) / (2 * DIGEST)).cast("int"))
    return F.array_join(F.transform(pairs, lambda i: F.sha2(F.substring(level, i * 2 * DIGEST + 1, 2 * DIGEST), 256)), "").cast("binary")


def _levels(bottom: Column, steps: Column) -> Column:
    """The block's levels, lowest first."""
    above = lambda held, _: let(F.element_at(held, -1), lambda top: F.concat(held, F.array(_parents(top))))
    return F.aggregate(indexes(steps), F.array(bottom), above)


def _steps(n: Column) -> Column:
    """Levels above the bottom of a block of a tree of ``n`` nodes: all of them, or what ``n`` needs."""
    return F.when(n > 1 << BLOCK_BITS, BLOCK_BITS).when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _siblings(levels: Column, place: Column) -> Column:
    """The flanking digest at each level of a block, for the node at ``place`` of its bottom."""

    def flank(k: Column) -> Column:
        return let(
            F.call_function("shiftright", place, k),
            lambda mine: let(
                F.substring(F.element_at(levels, k + 1), mine.bitwiseXOR(F.lit(1)) * DIGEST + 1, F.lit(DIGEST)).cast("string"),
                lambda digest: F.struct(F.when(digest == "", "none").when(mine % 2 == 1, "left").otherwise("right").alias("side"), digest.alias("digest")),
            ),
        )

    return F.transform(indexes(F.size(levels) - 1), flank)


def _climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The trees over ``nodes`` (tree, n, pos, digest, load), of at most ``most`` nodes each.

    Returns (tree, root), one row a tree, and (tree, load, digest, siblings), one row a node.
    """
    size = 1 << BLOCK_BITS
    held = F.sort_array(F.collect_list(F.struct("pos", "digest", "load")))
    bottom = F.array_join(F.transform("nodes", lambda x: x["digest"]), "").cast("binary")
    blocks = cut_lineage(
        nodes.groupBy("tree", "n", F.shiftright("pos", BLOCK_BITS).alias("block"))
        .agg(held.alias("nodes"))
        .withColumn("levels", _levels(bottom, _steps(F.col("n"))))
    )
    top = F.element_at("levels", -1).cast("string")
    if most <= size:
        whole = blocks.select("tree", "block", "nodes", "levels", top.alias("root"), F.array().cast(SIBLINGS).alias("above"))
    else:
        next_round = blocks.where(F.col("n") > size).select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), top.alias("digest"), F.col("block").alias("load"))
        roots, above = _climb(next_round, -(-most // size))
        above = above.join(roots, "tree").select("tree", F.col("load").alias("block"), F.col("siblings").alias("above"), F.col("root").alias("above_root"))
        whole = blocks.join(above, ["tree", "block"], "left").select(
            "tree", "block", "nodes", "levels", F.coalesce("above_root", top).alias("root"), F.coalesce("above", F.array().cast(SIBLINGS)).alias("above")
        )
    place = F.col("node.pos").bitwiseAND(F.lit(size - 1)).cast("int")
    each = whole.select("tree", "levels", "above", F.explode("nodes").alias("node")).select(
        "tree", F.col("node.load").alias("load"), F.col("node.digest").alias("digest"), F.concat(_siblings(F.col("levels"), place), F.col("above")).alias("siblings")
    )
    return whole.where(F.col("block") == 0).select("tree", "root"), each


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(
        siblings,
        digest,
        lambda h, s: F.sha2(F.when(s["side"] == "left", F.concat(s["digest"], h)).when(s["side"] == "right", F.concat(h, s["digest"])).otherwise(h), 256),
    )


def proof(siblings: Column) -> Column:
    """The siblings' digests, from the leaf up, as one string."""
    return F.array_join(F.transform(siblings, lambda s: s["digest"]), "")


def manifest(rows: DataFrame, key: Column, fields: Sequence[Column], group: Column, kept: Column | None = None) -> DataFrame:
    """key, kept, leaf, subroot, root, siblings for every row; siblings run from the leaf to the root.

    ``kept``: a narrow value that travels with the row.
    """
    leaves = rows.select(group.alias("group"), key.alias("key"), leaf(fields).alias("leaf"), (F.lit(None).cast("string") if kept is None else kept).alias("kept"), F.monotonically_increasing_id().alias("tie"))
    placed, _ = with_row_number(leaves, ["group", "key", "leaf", "tie"])
    # a tree is named by the number of its first row, so trees are ordered as their groups are
    groups = placed.groupBy("group").agg(F.min("row").alias("tree"), F.count("*").alias("n"))
    most = groups.agg(F.max("n")).first()[0] or 0
    numbered = join_small(placed, groups, "group").select("tree", "n", (F.col("row") - F.col("tree")).alias("pos"), F.col("leaf").alias("digest"), F.struct("key", "kept").alias("load"))
    subroots, leaves_up = _climb(numbered, most)
    ordered, many = with_row_number(subroots, ["tree"])
    roots, subroots_up = _climb(ordered.select(F.lit(0).alias("tree"), F.lit(many).cast("long").alias("n"), F.col("row").alias("pos"), F.col("root").alias("digest"), F.struct("tree", "root").alias("load")), many)
    tops = subroots_up.join(F.broadcast(roots), "tree").select(F.col("load.tree").alias("tree"), F.col("load.root").alias("subroot"), "root", F.col("siblings").alias("beyond"))  # roots: one row
    found = join_small(leaves_up, tops, "tree")
    return found.select("load.key", "load.kept", F.col("digest").alias("leaf"), "subroot", "root", F.concat("siblings", "beyond").alias("siblings"))
