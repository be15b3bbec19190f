"""Mixing sources to target weights by entropy balancing, native.

Targets: the sources, by code point with null last, weigh 3, 1, 2, repeating,
and share ``RATIO`` times all words; a target stops at ``CAP`` times its
source's words and the excess is shared anew by weight until none is above.

Rates: among all document rates that meet a source's token constraint,
``sum(rate * size) = target``, the one nearest in relative entropy to taking
every document once is ``rate = exp(lambda * size)``, cut at ``CAP``; there is
one multiplier a source. A source that must grow leans to its longer documents,
one that must shrink to its shorter ones. The multipliers solve a convex dual:
each Newton step sums, in one distributed aggregation over the corpus' classes
(documents of one source and size), every source's tokens and their derivative.
Sizes are scaled by a source's token-weighted mean, so that multipliers are of
the order of one.

Rounding: within a source, classes go from the largest size to the smallest; a
class takes the number of copies nearest to what its rate and the words still
due from larger ones ask for, so the last error is about the size of a small
document. A class's copies are dealt evenly; the odd ones go to its documents of
least hash of (id, text), found as one threshold a class: rows are counted by
range of the hash and only the range that holds the threshold is ranked. A row's
copies therefore follow from its own columns and one row of the class table.

The class table has at most one row for each pair of source and text length; it
is broadcast up to ``MOST_BROADCAST`` rows, so that a frequent class never meets
in one task, and joined by shuffle beyond (adaptive execution splits such a class).

Defined cases: a null text has no words; documents without words are taken 0
times; null is a source of its own; repeated rows are separate documents, alike
in all but their number of copies; sources without words have target 0; an empty
table gives an empty result; other columns are untouched. ``repeat_mixed`` adds
a ranking of equal rows only where a threshold falls among them, so that the
numbers are exact; tables without repeated rows need none. A corpus whose
multipliers do not settle raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import let, words_of
from quire.plans.order import with_row_number
from quire.plans.session import cut_lineage

RATIO = 1.5
CAP = 2
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Relative error of a met target, decimals kept of a multiplier, and the guard against endless steps.
TOLERANCE, DECIMALS, MAX_STEPS = 1e-10, 8, 400
#: Rows ranked together, on average, to find a threshold.
BUCKET = 4096
#: Sizes whose copies are counted in one inner list.
BLOCK = 512
MOST_BROADCAST = 200_000


def _sources_equal(name: str = "s") -> Column:
    return F.col("source").eqNullSafe(F.col(name))


def targets(sizes: DataFrame, ratio: float = RATIO, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, source_size); one row per source.

    The level of the unfilled sources rises from round to round as full ones
    leave; each round gathers two sums. Sources are numbered by a range shuffle.
    """
    numbered, n = with_row_number(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row") % len(weights) + 1).cast("int"))
    known = numbered.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap))
    budget = known.select(F.sum("source_size")).first()[0]
    budget, full, level = (budget or 0) * ratio, -1, 0.0
    for _ in range(n + 1):
        is_full = F.col("limit") <= F.col("weight") * level
        limits, left, count = known.select(F.sum(F.when(is_full, F.col("limit"))), F.sum(F.when(~is_full, F.col("weight"))), F.count_if(is_full)).first()
        if count == full or not left:
            break
        full, level = count, (budget - (limits or 0.0)) / left
    full_or_level = F.col("limit") if n and not left else F.least("limit", F.col("weight") * level)
    return known.select("source", "source_size", full_or_level.alias("target"))


def multipliers(classes: DataFrame, aims: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target, scale, lam: Newton on the dual, one aggregation a step.

    ``classes``: source, size, n. A document's rate is ``least(cap, exp(lam *
    size / scale))``. A step that leaves the bracket known to hold the solution
    is replaced by the bracket's middle; its ends are where the smallest
    document's rate vanishes and where it reaches the cap.
    """
    worded = classes.where("size > 0")
    spread = worded.groupBy("source").agg((F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"), F.min("size").alias("least")).withColumnRenamed("source", "s")
    start = aims.join(spread, _sources_equal(), "left").withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "least": F.coalesce("least", F.lit(1))})
    ends = {"lo": -745.0 * F.col("scale") / F.col("least"), "hi": F.log(F.lit(float(cap))) * F.col("scale") / F.col("least")}
    full = F.col("target") >= cap * F.col("source_size")
    now = start.withColumns(ends).select("source", "source_size", "target", "scale", F.when(full, F.col("hi")).otherwise(F.lit(0.0)).alias("lam"), "lo", "hi", full.alias("settled"))
    now = cut_lineage(now)
    words, rate = F.col("size") * F.col("n"), F.exp(F.col("lam") * F.col("size") / F.col("scale"))
    for _ in range(MAX_STEPS):
        open_ = now.where("NOT settled")
        if open_.isEmpty():
            return now.select("source", "source_size", "target", "scale", F.when(full, F.col("lam")).otherwise(F.round("lam", DECIMALS)).alias("lam"))
        met = (
            worded.join(open_.select(F.col("source").alias("s"), "lam", "scale"), _sources_equal())
            .groupBy("s")
            .agg(F.sum(words * F.least(rate, F.lit(float(cap)))).alias("got"), F.sum(F.when(rate <= cap, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        )
        after = now.join(met, _sources_equal(), "left")
        gap = F.col("target") - F.col("got")
        close = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target"), F.lit(True)) | (F.col("hi") - F.col("lo") <= 1e-15 * F.abs("lam"))
        after = after.withColumns({"settled": F.col("settled") | close, "lo": F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))})
        # the dual's gradient is taken as a logarithm: it is nearly straight where the rates are far from the cap
        newton = F.col("lam") + F.try_divide(F.log(F.try_divide(F.col("target"), F.col("got"))) * F.col("got"), F.col("slope"))
        inside = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = cut_lineage(after.select("source", "source_size", "target", "scale", F.when(F.col("settled"), F.col("lam")).otherwise(inside).alias("lam"), "lo", "hi", "settled"))
    raise RuntimeError(f"the multipliers did not settle in {MAX_STEPS} steps")


def _counts(cap: int) -> Column:
    """Copies of each class of ``classes``, from the largest size down, carrying what is due.

    The list is walked in blocks, so that lists grow by whole blocks.
    """

    def take(state: Column, c: Column) -> Column:
        return let(
            state["due"] + F.least(F.exp(F.col("lam") * c["size"] / F.col("scale")), F.lit(float(cap))) * c["size"] * c["n"],
            lambda want: let(
                F.when(c["size"] == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(c["n"] * cap, F.round(want / F.greatest(c["size"], F.lit(1))).cast("long")))),
                lambda k: F.struct((want - k * c["size"]).alias("due"), F.concat(state["out"], F.array(k)).alias("out")),
            ),
        )

    empty = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(classes) - 1) div {BLOCK}")), lambda i: F.slice("classes", i * BLOCK + 1, BLOCK))

    def walk(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["due"].alias("due"), empty.alias("out")), take)
        return let(inner, lambda s: F.struct(s["due"].alias("due"), F.concat(state["out"], s["out"]).alias("out")))

    return F.aggregate(blocks, F.struct(F.lit(0.0).alias("due"), empty.alias("out")), walk, lambda s: s["out"])


def _hash_range(ranges: Column) -> Column:
    """Which of ``ranges`` equal parts of the hashes' span holds column ``h``."""
    place = (F.shiftright("h", 1).cast("double") + 2.0**62) / 2.0**63
    return F.least(F.floor(place * ranges), ranges - 1).cast("long")


def _thresholds(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """s, z, edge, share, rows: the hash up to which a class's rows take an odd copy, and how many of the ``rows`` rows at it do.

    ``keys``: source, size, h, m (rows of that hash). ``plan``: source, size, n, odd.
    """
    side = F.broadcast if plan.count() <= MOST_BROADCAST else lambda df: df
    wanted = plan.where("odd > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("odd"), F.ceil(F.col("n") / BUCKET).alias("ranges"))
    same = _sources_equal() & (F.col("size") == F.col("z"))
    dealt = keys.join(side(wanted), same).withColumn("range", _hash_range(F.col("ranges")))
    ranges = dealt.groupBy("s", "z", "odd", "ranges", "range").agg(F.sum("m").alias("count"))
    reached = F.sum("count").over(Window.partitionBy("s", "z").orderBy("range"))
    held = ranges.withColumn("reached", reached).where("reached >= odd AND reached - count < odd").select("s", "z", "ranges", "range", (F.col("odd") - F.col("reached") + F.col("count")).alias("rest"))
    named = held.select("s", "z", "ranges", F.col("range").alias("wanted_range"), "rest")
    near = keys.join(side(named), same).where(_hash_range(F.col("ranges")) == F.col("wanted_range"))
    # rows of one hash are one key, so this ranks about BUCKET keys, however often a row is repeated
    upto = F.sum("m").over(Window.partitionBy("s", "z").orderBy("h"))
    found = near.groupBy("s", "z", "rest", "h").agg(F.sum("m").alias("m")).withColumn("upto", upto).where("upto >= rest AND upto - m < rest")
    return found.select("s", "z", F.col("h").alias("edge"), (F.col("rest") - F.col("upto") + F.col("m")).alias("share"), F.col("m").alias("rows"))


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def plan_mix(docs: DataFrame, ratio: float = RATIO, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The distinct rows (source, size, h, doc_id, m) and the class table.

    Class table: source, size, source_size, target, rate, each, edge, share, rows.
    """
    size = F.size(words_of(F.col("text"))).cast("long")
    keys = cut_lineage(docs.select("doc_id", "source", size.alias("size"), _row_hash().alias("h")).groupBy("source", "size", "h", "doc_id").agg(F.count("*").alias("m")))
    classes = cut_lineage(keys.groupBy("source", "size").agg(F.sum("m").alias("n")))
    aims = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), ratio, cap, weights)
    solved = multipliers(classes, aims, cap)
    # one row a source: as many entries as there are lengths of text, however many documents
    lists = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("classes")).withColumnRenamed("source", "s")
    plan = (
        solved.join(lists, _sources_equal())
        .withColumn("count", _counts(cap))
        .select("source", "source_size", "target", "lam", "scale", F.inline(F.arrays_zip("classes", "count")))
        .select("source", "source_size", "target", F.least(F.exp(F.col("lam") * F.col("classes.size") / F.col("scale")), F.lit(float(cap))).alias("rate"), F.col("classes.size").alias("size"), F.col("classes.n").alias("n"), "count")
    )
    plan = cut_lineage(plan.withColumn("each", F.expr("count div n")).withColumn("odd", F.expr("count % n")))
    edges = _thresholds(keys, plan)
    table = plan.join(edges, _sources_equal() & (F.col("size") == F.col("z")), "left")
    return keys, cut_lineage(table.select("source", "size", "source_size", "target", "rate", "each", "edge", "share", "rows"))


def _with_class(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (source, size, ...) with the columns of their class."""
    named = table.withColumnRenamed("source", "s").withColumnRenamed("size", "z")
    side = F.broadcast(named) if table.count() <= MOST_BROADCAST else named
    return rows.join(side, _sources_equal() & (F.col("size") == F.col("z"))).drop("s", "z")


def mix(docs: DataFrame, ratio: float = RATIO, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for every row of ``docs``."""
    keys, table = plan_mix(docs, ratio, cap, weights)
    odd = F.when(F.col("h") < F.col("edge"), F.col("m")).when(F.col("h") == F.col("edge"), F.least("share", "m")).otherwise(F.lit(0))
    each_row = _with_class(keys, table).withColumn("odd", odd).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each_row.select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("each") + (F.col("nth") <= F.col("odd")).cast("long")).alias("copies"))


def repeat_mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows it does not take go.

    Rows do not travel: each reads its copies off its class. Only equal rows
    among which a threshold falls are ranked, within their partition and by the
    partitions' counts.
    """
    _, table = plan_mix(docs)
    # whole rows travel as one struct, so no name of theirs can clash
    rows = docs.select(F.struct("*").alias("doc"), "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _row_hash().alias("h"))
    known = _with_class(rows, table)
    at_edge = F.coalesce((F.col("h") == F.col("edge")) & (F.col("share") < F.col("rows")), F.lit(False))
    below = F.coalesce(F.col("h") <= F.col("edge"), F.lit(False)).cast("long")
    out = known.where(~at_edge).select("doc", (F.col("each") + below).alias("copies"))
    if not table.where("share < rows").isEmpty():
        split = cut_lineage(known.where(at_edge).select("doc", "each", "share", "h", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
        ahead = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        starts = split.groupBy(F.col("h").alias("k"), F.col("part").alias("p")).count().withColumn("start", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
        nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("at"))
        ranked = split.withColumn("nth", nth).join(starts, (F.col("h") == F.col("k")) & (F.col("part") == F.col("p")))
        out = out.union(ranked.select("doc", F.col("each") + (F.col("start") + F.col("nth") <= F.col("share")).cast("long")))
    return out.where("copies > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
