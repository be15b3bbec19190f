"""Fixpoints over the graph of references: equal objects, and flags that travel along references.

Both run in rounds of one lookup and one aggregation, keep no pairs, and end when
nothing changes. Rows of an object that very many refer to are not shuffled
(``lookup``); what a round leaves is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.session import cut_lineage, spent
from quire.plans.skew import hot_keys, lookup

NODE = ["doc_id", "num"]


#: Stands for the class of a missing target; as long as a class.
MISSING = b"missing".ljust(16, b"\0")


def _digest(text: Column) -> Column:
    """The first 128 bits of the SHA-256 of a text, never null."""
    return F.coalesce(F.unhex(F.substring(F.sha2(text, 256), 1, 32)), F.lit(b""))


def duplicate_classes(objects: DataFrame, references: DataFrame, across: bool = True, kept: bool = False) -> DataFrame:
    """doc_id, num, class, canonical (doc_id and num of the class's least member) of every object.

    Two objects are of one class when their ``shape`` is the same and, path by path,
    what they refer to is of one class; objects that refer to each other in cycles
    are of one class when no path tells them apart. ``objects``: doc_id, num, shape (a
    value without its references; null is a shape of its own kind) and optionally
    ``fixed`` (an object that is like no other). ``references``: doc_id, src_num, path,
    dst_num; a missing target is a class of its own. ``across``: whether objects of
    different documents can be of one class. ``kept``: whether both are cheap to read
    again and again, as columns of files or checkpoints are, so that no copy is written.

    This is partition refinement: a class is the digest of a shape, then of the
    class before and those referred to, in the order of paths, until a round gives no
    more classes than the one before. Classes only ever split, so that is the coarsest
    partition. Rounds are as many as the longest path it takes to tell two objects
    apart; a round moves digests only. An object is settled when all that it refers to
    is, after one more round: its class has then all that can be told of it, and it takes
    part in no further round. Equal objects are settled in the same round, so where no
    cycles are, every object is written once. An object's own references meet in one row,
    as they do in the object itself. An object that no other has the shape of stays alone,
    so rounds are only for the others and their references.
    """
    single, shared = refined(objects, references, across, kept)
    classes = single.union(shared)
    firsts = classes.groupBy("class").agg(F.min(F.struct(*NODE)).alias("canonical"))
    return lookup(classes, firsts, ["class"]).select(*NODE, F.hex("class").alias("class"), "canonical")


def refined(objects: DataFrame, references: DataFrame, across: bool = True, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, num, class as of ``duplicate_classes``, in binary: objects that are alone by their shape (where most are), and the others."""
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in objects.columns else F.lit(False)
    alone = F.concat_ws(":", F.lit("fixed"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("num").cast("string"))
    within = F.lit("") if across else F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    shape = F.when(fixed, alone).otherwise(F.concat(within, F.lit(":"), F.coalesce(F.concat(F.lit("s"), F.col("shape").cast("string")), F.lit("-"))))
    keep = (lambda df: df) if kept else cut_lineage
    classes = keep(objects.select(*NODE, _digest(shape).alias("class")))
    sizes = classes.groupBy("class").agg(F.count("*").alias("_n"))
    n, alone, total = (x or 0 for x in sizes.agg(F.count("*"), F.count_if(F.col("_n") == 1), F.sum("_n")).first())
    single = classes.where("false")
    edges = references.select("doc_id", F.col("src_num").alias("src"), "path", F.col("dst_num").alias("num"))
    if 2 * alone >= total:  # fewer would not pay for setting them apart
        counted = cut_lineage(lookup(classes, sizes, ["class"]))
        single, classes, n = counted.where("_n = 1").select(*NODE, "class"), counted.where("_n > 1").select(*NODE, "class"), n - alone
        if not n:
            return single, classes
        classes = cut_lineage(classes)
        held = classes.select(F.col("doc_id").alias("_doc"), F.col("num").alias("_num"))
        edges = cut_lineage(edges.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("src") == F.col("_num")), "left_semi"))
    else:
        edges = keep(edges)
    # keys are structs, which are never null: what is dealt by one need not be dealt anew for a join
    node, source, target = F.struct(*NODE).alias("node"), F.struct("doc_id", F.col("src").alias("num")).alias("src"), F.struct(*NODE).alias("node")
    edges = edges.select(source, "path", target)
    hot = cut_lineage(hot_keys(edges, ["node"]))
    leads = edges.select(F.col("src").alias("_src")).distinct()
    # what refers to nothing is settled from the start
    waiting = classes.select(node, "class").join(leads, F.col("node") == F.col("_src"), "left").select("node", "class", F.col("_src").isNull().alias("done"))
    alone, settled, apart = single.select(node, "class", F.lit(True).alias("done")), [], 0
    while True:
        asked = edges if not settled else edges.join(waiting.select(F.col("node").alias("_src")), F.col("src") == F.col("_src"), "left_semi")
        ref = F.struct("path", F.coalesce("class", F.lit(MISSING)).alias("class"))
        seen = lookup(asked, _union([alone, *settled, waiting]), ["node"], hot).select(F.col("src").alias("_src"), ref.alias("ref"), F.coalesce("done", F.lit(True)).alias("_done"))
        held = seen.groupBy("_src").agg(F.sort_array(F.collect_list("ref")).alias("refs"), F.bool_and("_done").alias("_done"))
        signed = F.transform("refs", lambda r: F.concat(F.length(r["path"]), F.lit(":"), r["path"], F.hex(r["class"])))
        met = waiting.join(held, F.col("node") == F.col("_src"), "left")
        again = F.when(F.col("refs").isNull(), F.col("class")).otherwise(_digest(F.concat(F.hex("class"), F.coalesce(F.array_join(signed, ""), F.lit("")))))
        after = _written(met.select("node.*", again.alias("class"), F.coalesce("_done", F.lit(True)).alias("done")))
        del asked, seen, held, met, waiting
        if kept:
            spent(after)
        of = after.groupBy("class").agg(F.bool_or("done").alias("done"))
        now, ended = of.agg(F.count("*"), F.count_if("done")).first()
        settled, waiting, before, n = [*settled, after.where("done")], after.where("NOT done"), n, apart + now
        apart += ended
        if n == before or waiting.isEmpty():
            break
        if len(settled) > MERGE:
            settled = [_written(_union(settled).select("node.*", "class", "done"))]
    return single, _union([*settled, waiting]).select("node.*", "class")


def _written(classes: DataFrame) -> DataFrame:
    """node, class, done of ``classes`` (doc_id, num, class, done), from the checkpoint folder, where no column is known not to be null."""
    return cut_lineage(classes).select(F.struct(*NODE).alias("node"), F.coalesce("class", F.lit(b"")).alias("class"), F.coalesce("done", F.lit(True)).alias("done"))


def aliases_of(classes: DataFrame) -> DataFrame:
    """doc_id, num, canonical_num of the objects that another of their document stands for."""
    firsts = classes.groupBy("doc_id", "class").agg(F.min("num").alias("canonical_num"))
    return lookup(classes.select(*NODE, "class"), firsts, ["doc_id", "class"]).where("num <> canonical_num").select(*NODE, "canonical_num")


def propagated(references: DataFrame, labels: DataFrame, limit: Column | None = None) -> DataFrame:
    """doc_id, num, flags, low of every object that a label reaches: bits are or-ed, the least number is kept.

    ``references``: doc_id, src_num, dst_num and optionally ``passes`` (the bits that the
    reference hands on; all by default). ``labels``: doc_id, num, flags (bits), low (a
    number or null); several labels of one object are merged first. ``limit``: a
    condition on a reference for the number to be handed on. Cycles end where nothing
    new arrives, since or and least only ever add.

    A round hands on only what changed in the round before. What is known is kept as
    one table and the changes since; the changes are merged into it when they are
    ``MERGE`` many, so a long chain does not read the whole table in every round.
    """
    passes = F.coalesce(F.col("passes"), F.lit(-1)).cast("long") if "passes" in references.columns else F.lit(-1).cast("long")
    edges = cut_lineage(references.select("doc_id", F.col("src_num").alias("num"), F.col("dst_num").alias("dst"), passes.alias("passes"), (F.lit(True) if limit is None else F.coalesce(limit, F.lit(False))).alias("hands")))
    merged = [F.bit_or("flags").alias("flags"), F.min("low").alias("low")]
    merge = lambda df: df.groupBy(*NODE).agg(*merged)
    hot = cut_lineage(hot_keys(edges, NODE))
    changed = cut_lineage(merge(labels.select(*NODE, F.coalesce(F.col("flags").cast("long"), F.lit(0)).alias("flags"), F.col("low").cast("double").alias("low"))))
    known = [changed]
    while not changed.isEmpty():
        handed = lookup(edges, changed, NODE, hot).where("flags IS NOT NULL")
        found = merge(handed.select("doc_id", F.col("dst").alias("num"), F.col("flags").bitwiseAND(F.col("passes")).alias("flags"), F.when(F.col("hands"), F.col("low")).alias("low")))
        held = known[0]
        for x in known[1:]:
            held = held.union(x)
        # of each object met: what it had, and what it has now
        marked = held.select("*", F.lit(False).alias("new")).union(found.select("*", F.lit(True).alias("new")))
        both = marked.groupBy(*NODE).agg(*merged, F.bool_or("new").alias("met"), F.bit_or(F.when(~F.col("new"), F.col("flags"))).alias("had"), F.min(F.when(~F.col("new"), F.col("low"))).alias("had_low"))
        news = (F.col("flags") != F.coalesce("had", F.lit(0))) | ~F.col("low").eqNullSafe(F.col("had_low"))
        changed = cut_lineage(both.where(F.col("met") & news).select(*NODE, "flags", "low"))
        known.append(changed)
        if len(known) > MERGE:
            known = [cut_lineage(merge(_union(known)))]
    return merge(_union(known))


#: Changes after which they are merged into what is known.
MERGE = 8


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def evaluated_expressions(nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, node, value of every node of And/Or/Not trees.

    ``nodes``: by, node, parent (null at a root), op (And, Or, Not, or null for a leaf)
    and state (a leaf's value; null counts as shown). Trees are contracted from their
    leaves: a round hands the values of all nodes that have theirs to their parents,
    one aggregation (all, any, how many), and keeps only nodes that still wait. A
    node need not wait for all: one false settles an And, one true an Or. Rounds are
    as many as the deepest tree has levels, and each handles only what is left. A Not
    has one operand; an operator without operands is an error, as is a tree that
    contains itself.
    """
    base = cut_lineage(nodes.select(*by, "node", "parent", "op", "state"))
    leaf, shown = F.col("op").isNull(), F.coalesce("state", F.lit(True))
    # leaves hand their values on as their parents' operands are counted, and take part in no round
    own = F.when(leaf, shown)
    kids = base.where("parent IS NOT NULL").groupBy(*by, F.col("parent").alias("_node")).agg(F.count("*").alias("n"), F.count(own).alias("had"), F.bool_and(own).alias("every"), F.bool_or(own).alias("some"))
    kids = kids.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_node", "n", "had", "every", "some")
    on = _same([*by, "node"], [*[f"_{i}" for i in range(len(by))], "_node"])
    waits, every, some = F.coalesce(F.col("n") - F.col("had"), F.lit(0)).alias("waits"), F.coalesce("every", F.lit(True)).alias("every"), F.coalesce("some", F.lit(False)).alias("some")
    left = cut_lineage(base.where(~leaf).join(kids, on, "left").select(*by, "node", "parent", "op", waits, every, some, F.coalesce("n", F.lit(0)).alias("n")))
    if not left.where("n = 0 OR (op = 'Not' AND n <> 1)").isEmpty():
        raise ValueError("an operator with a wrong number of operands")
    left, out = left.drop("n"), [base.where(leaf).select(*by, "node", shown.alias("value"))]
    while not left.isEmpty():
        op, waits = F.col("op"), F.col("waits") == 0
        value = (
            F.when((op == "And") & ~F.col("every"), False).when((op == "Or") & F.col("some"), True)
            .when(waits & (op == "And"), True).when(waits & (op == "Or"), False).when(waits & (op == "Not"), ~F.col("every"))
        )
        valued = left.withColumn("value", value)
        done = cut_lineage(valued.where("value IS NOT NULL").select(*by, "node", "parent", "value"))
        if done.isEmpty():
            raise ValueError("an expression contains itself")
        out.append(done.select(*by, "node", "value"))
        handed = done.where("parent IS NOT NULL").groupBy(*by, F.col("parent").alias("_node")).agg(F.count("*").alias("_n"), F.bool_and("value").alias("_every"), F.bool_or("value").alias("_some"))
        handed = handed.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_node", "_n", "_every", "_some")
        left = cut_lineage(
            valued.where("value IS NULL").drop("value").join(handed, on, "left").select(
                *by, "node", "parent", "op", (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"),
                (F.col("every") & F.coalesce("_every", F.lit(True))).alias("every"), (F.col("some") | F.coalesce("_some", F.lit(False))).alias("some"),
            )
        )
    return _union(out)


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out
