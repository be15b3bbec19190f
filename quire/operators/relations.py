"""Relational forms of document algorithms: graphs, trees, ranges, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.session import cut_lineage

MAX_DEPTH = 8192
#: Fronts of a search that are kept as tables of their own.
FRONTS = 8


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (``doc_id``, ``num``) that ``roots`` lead to, with their least distance.

    ``edges``: doc_id, src, dst. Breadth first; each round joins only the
    nodes met last, removes those known before, and writes what is new. Fronts are
    put into one table after every ``FRONTS`` rounds, so that a long way does not
    read ever more of them.
    """
    fronts = [cut_lineage(roots.select("doc_id", "num").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, MAX_DEPTH):
        met = fronts[-1].select("doc_id", F.col("num").alias("src")).join(edges, ["doc_id", "src"]).select("doc_id", F.col("dst").alias("num")).distinct()
        known = reduce(DataFrame.union, fronts).select("doc_id", "num")
        front = cut_lineage(met.join(known, ["doc_id", "num"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return reduce(DataFrame.union, fronts)
        if len(fronts) >= FRONTS:
            fronts = [cut_lineage(reduce(DataFrame.union, fronts))]
        fronts.append(front)
    raise RuntimeError(f"nodes beyond depth {MAX_DEPTH}")


def newest_entries(xref: DataFrame, keys: list[str], revision: Column) -> DataFrame:
    """Of each key the row of the newest revision (``revision`` least)."""
    rest = [c for c in xref.columns if c not in keys]
    return xref.groupBy(*keys).agg(F.min_by(F.struct(*rest), revision).alias("_e")).select(*keys, "_e.*")


def canonical(objects: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each object's ``order`` with that of the first of its equals in ``canonical``."""
    firsts = objects.groupBy(*keys).agg(F.min(order).alias("canonical"))
    return objects.join(firsts, keys).select(*[c for c in objects.columns], "canonical")


def reference_counts(refs: DataFrame, target: list[str]) -> DataFrame:
    return refs.groupBy(*target).agg(F.count("*").alias("n_refs"))


def ranges_of(starts: DataFrame, by: list[str], start: str) -> DataFrame:
    """Half-open ranges: ``stop`` is the next start, null for the last."""
    return starts.withColumn("stop", F.lead(start).over(Window.partitionBy(*by).orderBy(start)))


def in_range(rows: DataFrame, ranges: DataFrame, by: list[str], value: str, start: str) -> DataFrame:
    """Rows with the columns of the range that holds ``value``.

    The starts are merged into the rows and the last one before each row is
    carried forward, so no row meets more than one range.
    """
    extra = [c for c in ranges.columns if c not in by]
    names = [c for c in rows.columns if c not in by]
    marks = ranges.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(*extra).alias("_range"), F.lit(None).cast(rows.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("_row"))
    items = rows.select(*by, F.col(value).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_range"].dataType).alias("_range"), F.struct(*names).alias("_row"))
    carried = F.last("_range", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return marks.unionByName(items).withColumn("_range", carried).where("_kind = 1").select(*by, "_row.*", "_range.*")


def nearest_ancestor(levels: list[Column]) -> Column:
    """The first non-null value from the node upwards."""
    return F.coalesce(*levels)


def replaced_by_parent(has_parent: Column, own: Column, parent: Column) -> Column:
    """A parent's field stands in for the child's even when it is absent."""
    return F.when(has_parent, parent).otherwise(own)


def resolved_chain(items: DataFrame, key: str, start: str, mapping: DataFrame, source: str, target: str, accepted: Column | None = None) -> DataFrame:
    """Where ``mapping`` leads from ``start``: to what it does not map, or to what ``accepted`` takes; column ``resolved``.

    A mapped value is mapped before it is looked at. ``accepted`` is a condition on
    the column ``value``. A chain that meets itself, or ends unaccepted, has no
    answer (null). The map is followed by doubling: after k rounds every value
    knows where 2^k steps lead, so a chain of any length takes the logarithm of
    its length in rounds; one that is still open after as many steps as there
    are mappings is a cycle.
    """
    one = mapping.select(F.col(source).alias("value"), F.col(target).alias("to")).where("value IS NOT NULL AND to IS NOT NULL").dropDuplicates(["value"])
    total = one.count()
    mapped = one.select(F.col("value").alias("held"))
    stops = lambda c: F.col("held").isNull() if accepted is None else F.coalesce(c, F.lit(False))

    def settled(hops: DataFrame) -> DataFrame:
        """value, to, done: a hop is done where it has arrived at an answer or has nowhere to go."""
        ends = hops.select(F.col("to").alias("value")).distinct().join(mapped, F.col("value") == F.col("held"), "left")
        ends = ends.select(F.col("value").alias("end"), stops(accepted).alias("good"), F.col("held").isNull().alias("last"))
        return hops.join(ends, F.col("to") == F.col("end")).select("value", "to", "good", (F.col("good") | F.col("last")).alias("done"))

    hops = cut_lineage(settled(one))
    reach = 1
    while reach <= total and not hops.where("NOT done").isEmpty():
        after = hops.select(F.col("value").alias("v"), F.col("to").alias("t"), F.col("good").alias("g"), F.col("done").alias("d"))
        going = hops.where("NOT done").join(after, F.col("to") == F.col("v")).select("value", F.col("t").alias("to"), F.col("g").alias("good"), F.col("d").alias("done"))
        hops = cut_lineage(hops.where("done").union(going))
        reach *= 2
    answer = hops.select("value", F.when(F.col("done") & F.col("good"), F.col("to")).alias("found"), F.lit(True).alias("in_map"))
    own = F.col(start) if accepted is None else None
    joined = items.select(key, F.col(start)).join(answer, F.col(start) == F.col("value"), "left")
    if accepted is not None:
        plain = items.select(F.col(start).alias("value")).distinct().select(F.col("value").alias("plain"), F.coalesce(accepted, F.lit(False)).alias("plain_good"))
        joined = joined.drop("value").join(plain, F.col(start) == F.col("plain"), "left")
        own = F.when(F.col("plain_good"), F.col(start))
    return joined.select(key, F.when(F.col("in_map"), F.col("found")).otherwise(own).alias("resolved"))


def policy_visible(policy: Column, states: Column) -> Column:
    """Membership policies over an array of group states; no states: visible."""
    every, some = F.forall(states, lambda s: s), F.exists(states, lambda s: s)
    by_policy = F.when(policy == "AllOn", every).when(policy == "AnyOff", ~every).when(policy == "AllOff", ~some).otherwise(some)
    return F.when(F.size(states) == 0, F.lit(True)).otherwise(by_policy)


def group_state(intent_met: Column, base_on: Column, in_on: Column, in_off: Column) -> Column:
    """Intent, then base state, then the ON list, then the OFF list."""
    return F.when(~intent_met, True).when(in_off, False).when(in_on, True).otherwise(base_on)


def balanced_parents(index: Column, degree: int, level: int) -> Column:
    """The node of a balanced tree that holds a leaf, ``level`` levels up."""
    return F.floor(index / degree**level).cast("long")


def preorder(levels: list[tuple[str, Column]]) -> Column:
    """A sortable path of a node from its ancestors' positions."""
    return F.array(*[c.cast("long") for _, c in levels])


def percent_encoded(uri: Column) -> Column:
    """Unreserved, reserved and ``%`` characters stay; every other byte is encoded in upper case."""
    pairs = F.regexp_extract_all(F.hex(F.encode(uri, "UTF-8")), F.lit("(..)"), F.lit(1))
    keep = r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]"
    shown = lambda h: F.decode(F.unhex(h), "ISO-8859-1")
    return F.array_join(F.transform(pairs, lambda h: F.when(shown(h).rlike(keep), shown(h)).otherwise(F.concat(F.lit("%"), h))), "")


def image_bounds(placements: DataFrame, by: list[str]) -> DataFrame:
    """Largest shown size of each image; any unsafe use makes it 0."""
    unsafe = F.bool_or("unsafe")
    size = lambda c: F.when(unsafe, F.lit(0.0)).otherwise(F.max(c))
    return placements.groupBy(*by).agg(size("width").alias("max_width"), size("height").alias("max_height"))


#: The annotation subtypes of the standard.
ANNOTATIONS = (
    "Text", "Link", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Caret", "Ink", "Stamp", "Popup", "FileAttachment",
    "Sound", "Movie", "Widget", "Screen", "PrinterMark", "TrapNet", "Watermark", "3D", "Redact", "RichMedia", "Projection",
)


def is_standard(subtype: Column) -> Column:
    """Is an annotation's subtype one of the standard's?"""
    return subtype.isin(*ANNOTATIONS)


def annotation_drawn(subtype: Column, flags: Column, rect: Column, visible: Column) -> Column:
    """Whether an annotation has a place to be drawn in: not an unknown kind marked invisible, not in a hidden group, not of an empty rectangle."""
    empty = (F.get(rect, F.lit(0)) == F.get(rect, F.lit(2))) | (F.get(rect, F.lit(1)) == F.get(rect, F.lit(3)))
    return (is_standard(subtype) | (flags.bitwiseAND(F.lit(1)) == 0)) & visible & ~F.coalesce(empty, F.lit(True))


def out_of_order(rows: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Rows whose key does not exceed that of the row before."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("before", before).where(F.col(key) <= F.col("before"))


def merged_sizes(sizes: DataFrame, alias: DataFrame, by: list[str], num: str) -> DataFrame:
    """Sizes of objects under the number they are merged into: any zero makes zero, otherwise the largest; flags are or-ed."""
    to = alias.select(*by, F.col(num), F.col("canonical"))
    known = sizes.join(to, [*by, num], "left").withColumn("canonical", F.coalesce("canonical", F.col(num)))
    zero = F.min(F.least("width", "height")) == 0
    size = lambda c: F.when(zero, F.lit(0.0)).otherwise(F.max(c))
    return known.groupBy(*by, F.col("canonical").alias(num)).agg(size("width").alias("width"), size("height").alias("height"), F.bool_or("protected").alias("protected"))


def overridden(rows: DataFrame, named: DataFrame, name: str, value: str) -> DataFrame:
    """``rows`` whose ``value`` is replaced where ``named`` has one of that name."""
    own = named.select(F.col(name), F.col(value).alias("_own"))
    return rows.join(own, name, "left").withColumn(value, F.coalesce("_own", F.col(value))).drop("_own")


def inherited(nodes: DataFrame, value: str) -> DataFrame:
    """doc_id, num, ``value``: each node's own value or that of the nearest ancestor with one.

    ``nodes``: doc_id, num, parent (null at the root) and ``value``. Ancestors are
    skipped by doubling, so a tree of any depth takes the logarithm of its depth
    in rounds; one still open after as many steps as there are nodes is cyclic.
    """
    now = cut_lineage(nodes.select("doc_id", "num", "parent", value))
    total, reach = now.count(), 1
    while not now.where(F.col(value).isNull() & F.col("parent").isNotNull()).isEmpty():
        if reach > total:
            raise RuntimeError("a tree contains itself")
        above = now.select("doc_id", F.col("num").alias("parent"), F.col(value).alias("_value"), F.col("parent").alias("_above"))
        open_ = F.col(value).isNull()
        now = cut_lineage(
            now.join(above, ["doc_id", "parent"], "left").select("doc_id", "num", F.when(open_, F.col("_above")).otherwise(F.col("parent")).alias("parent"), F.coalesce(value, "_value").alias(value))
        )
        reach *= 2
    return now.select("doc_id", "num", value)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
