"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.skew import join_keyed
from quire.plans.session import cut_lineage

#: A guard against endless work; the star steps need about log(n) rounds.
MAX_ROUNDS = 60


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.select(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """a, b, m: every edge with the least neighbour of ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_keyed(edges, least, "a", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges have a > b."""
    moved = _with_least(edges, total).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(edges.groupBy("a").agg(F.min("b").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge ``(a, b)``; component is the least node.

    Alternates large-star and small-star steps; both are a grouped minimum
    (combined before the shuffle) and a join on the node. The nodes that hold
    many of all edges, such as the root of a large component, are joined by
    broadcast (see ``skew``), so their edges are spread over all tasks. Each
    round is cut by a checkpoint. Self-loops and null ends are ignored; an empty
    table gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    state = _state(pairs)
    for _ in range(MAX_ROUNDS):
        before, total = state, state[0]
        pairs = cut_lineage(_small_star(_large_star(pairs, total).distinct(), total).distinct())
        state = _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
