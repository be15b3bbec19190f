"""Transparent painting as an ordered, associative aggregate.

What a paint does to what lies below it is an affine map of the premultiplied
backdrop, wherever the blend mode is linear in the backdrop (``LINEAR``): with
colour C and opacity A below, the result is ``p C + q A + r`` in each component and
``s A + t`` in opacity. Affine maps compose, so the paints of a place may be merged in
any grouping, across tasks, as long as their order is kept. Groups are maps too: an
isolated group is what its map makes of nothing, painted as one; another is its map,
faded towards the identity by the group's opacity. In a knockout group every
element starts from what lay below the group, so a second weight (``k``, what is left of the
elements before) travels along. Overprinting leaves the components that are not
painted as they are.

Modes that are not linear in the backdrop depend on the order of evaluation and are
refused here; ``quire.functions.blend`` has them for single paints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import let, segmented_reduce

#: Blend modes as ``u b + v`` of the backdrop ``b``, for a source ``s``.
LINEAR = {
    "Normal": lambda s: (F.lit(0.0), s),
    "Compatible": lambda s: (F.lit(0.0), s),
    "Multiply": lambda s: (s, F.lit(0.0)),
    "Screen": lambda s: (1 - s, s),
    "HardLight": lambda s: (F.when(s <= 0.5, 2 * s).otherwise(2 - 2 * s), F.when(s <= 0.5, 0.0).otherwise(2 * s - 1)),
    "Exclusion": lambda s: (1 - 2 * s, s),
}
PAINT = "struct<k:double,c:array<struct<p:double,q:double,r:double>>,s:double,t:double>"


def _component(p: Column, q: Column, r: Column) -> Column:
    return F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"), r.cast("double").alias("r"))


def _map(k: Column, c: Column, s: Column, t: Column) -> Column:
    return F.struct(k.cast("double").alias("k"), c.alias("c"), s.cast("double").alias("s"), t.cast("double").alias("t"))


def paint(colors: Column, alpha: Column, mode: Column, knockout: Column | None = None, shape: Column | None = None, painted: Column | None = None) -> Column:
    """A paint as a map. ``colors``: components from 0 to 1; ``alpha``: opacity with coverage;
    ``shape``: coverage, for knockout groups (1 by default); ``painted``: which components are
    painted (all by default; the others keep what lies below). A mode that is not linear is an error."""
    knockout = F.lit(False) if knockout is None else F.coalesce(knockout, F.lit(False))
    shape = F.lit(1.0) if shape is None else shape
    whole = F.transform(colors, lambda _: F.lit(True)) if painted is None else painted

    def component(s: Column, on: Column) -> Column:
        u, v = F.raise_error(F.concat(F.lit("a blend mode that is not linear: "), F.coalesce(mode, F.lit("null")))).cast("double"), F.lit(0.0)
        for name, form in LINEAR.items():
            a, b = form(s)
            u, v = F.when(mode == name, a).otherwise(u), F.when(mode == name, b).otherwise(v)
        source = F.struct(F.when(on, u).otherwise(1.0).alias("u"), F.when(on, v).otherwise(0.0).alias("v"), F.when(on, s).otherwise(0.0).alias("s"))
        return let(source, lambda x: _component((1 - alpha) + alpha * x["u"], alpha * (x["v"] - x["s"]), alpha * x["s"]))

    own = F.transform(F.arrays_zip(colors.alias("s"), whole.alias("on")), lambda x: component(x["s"], x["on"]))
    # outside its shape an element of a knockout group leaves what is there; inside, what was below the group
    own_shape = lambda m: F.transform(m, lambda x: _component(x["p"] - (1 - shape), x["q"], x["r"]))
    plain = _map(F.lit(0.0), own, 1 - alpha, alpha)
    knocked = _map(1 - shape, own_shape(own), shape - alpha, alpha)
    return F.when(knockout, knocked).otherwise(plain)


def stacked(below: Column, above: Column) -> Column:
    """The map of ``below``, then ``above``, in a group that is not of the knockout kind."""
    both = F.arrays_zip(below["c"].alias("x"), above["c"].alias("y"))
    each = F.transform(both, lambda z: _component(z["y"]["p"] * z["x"]["p"], z["y"]["p"] * z["x"]["q"] + z["y"]["q"] * below["s"], z["y"]["p"] * z["x"]["r"] + z["y"]["q"] * below["t"] + z["y"]["r"]))
    return _map(F.lit(0.0), each, above["s"] * below["s"], above["s"] * below["t"] + above["t"])


def knocked_out(below: Column, above: Column) -> Column:
    """The map of ``below``, then ``above``, each starting from what lay below the group."""
    both, k = F.arrays_zip(below["c"].alias("x"), above["c"].alias("y")), above["k"]
    each = F.transform(both, lambda z: _component(k * z["x"]["p"] + z["y"]["p"], k * z["x"]["q"] + z["y"]["q"], k * z["x"]["r"] + z["y"]["r"]))
    return _map(k * below["k"], each, k * below["s"] + above["s"], k * below["t"] + above["t"])


def _whole(m: Column) -> Column:
    """A knockout group's map of what lay below it."""
    return _map(F.lit(0.0), F.transform(m["c"], lambda x: _component(m["k"] + x["p"], x["q"], x["r"])), m["k"] + m["s"], m["t"])


def applied(m: Column, backdrop: Column, alpha: Column) -> Column:
    """struct(colors, alpha): what a map makes of a backdrop's colours and opacity; colours of nothing are 0."""
    opacity = m["s"] * alpha + m["t"]
    over = lambda o: F.transform(F.arrays_zip(m["c"].alias("m"), backdrop.alias("b")), lambda z: F.when(o > 0, (z["m"]["p"] * z["b"] * alpha + z["m"]["q"] * alpha + z["m"]["r"]) / o).otherwise(0.0))
    return let(opacity, lambda o: F.struct(over(o).alias("colors"), o.alias("alpha")))


def composited(paints: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """by, paint: the map of all that is painted at a place, groups included; one row a place.

    ``paints``: by, grp (null: the page), ord, colors, alpha, mode and optionally shape and
    painted. ``groups``: grp, parent (null: the page), ord (its place in the parent),
    isolated, knockout, alpha, mode: one row a group. Groups are folded from the
    innermost outwards, one ordered aggregation a level of nesting, so rounds are as many as
    groups are nested. Paints of one place and group have different ``ord``.
    """
    optional = [F.col(c) if c in paints.columns else F.lit(None).cast(t).alias(c) for c, t in (("shape", "double"), ("painted", "array<boolean>"))]
    ruled = groups.select(F.col("grp").alias("_grp"), F.col("parent").alias("_parent"), F.col("ord").alias("_ord"), "isolated", "knockout", F.col("alpha").cast("double").alias("_alpha"), F.col("mode").alias("_mode"))
    front, depth = ruled.where("_parent IS NULL").select("_grp"), 0
    levels = [front]
    while not front.isEmpty():
        depth += 1
        front = ruled.join(front.select(F.col("_grp").alias("_above")), F.col("_parent") == F.col("_above"), "left_semi").select("_grp")
        levels.append(front)
        if depth > MOST_NESTED:
            raise ValueError("groups contain each other, or are nested too deep")
    depths = levels[0].withColumn("_level", F.lit(1))
    for i, level in enumerate(levels[1:], 2):
        depths = depths.union(level.withColumn("_level", F.lit(i)))
    rules = ruled.join(depths, "_grp")
    own = paints.select(*by, "grp", "ord", "colors", F.col("alpha").cast("double").alias("alpha"), "mode", *optional)
    held = own.join(rules.select("_grp", "knockout", "_level"), F.col("grp") == F.col("_grp"), "left")
    painted = F.coalesce("painted", F.transform("colors", lambda _: F.lit(True)))
    elements = held.select(*by, "grp", F.coalesce("_level", F.lit(0)).alias("level"), "ord", paint(F.col("colors"), F.col("alpha"), F.col("mode"), F.col("knockout"), F.coalesce("shape", F.lit(1.0)), painted).alias("m"))
    for level in range(depth, 0, -1):
        inner = elements.where(F.col("level") == level).join(rules.select("_grp", F.col("knockout").alias("_k")), F.col("grp") == F.col("_grp"))
        merge = lambda a, b: F.struct(F.when(a["knock"], knocked_out(a["m"], b["m"])).otherwise(stacked(a["m"], b["m"])).alias("m"), a["knock"].alias("knock"))
        value = F.struct(F.col("m"), F.coalesce("_k", F.lit(False)).alias("knock"))
        done = segmented_reduce(inner, [*by, "grp"], "ord", value, merge)
        whole = F.when(F.col("value.knock"), _whole(F.col("value.m"))).otherwise(F.col("value.m"))
        made = done.withColumn("g", whole).join(rules, F.col("grp") == F.col("_grp")).join(ruled.select(F.col("_grp").alias("_outer"), F.col("knockout").alias("_outer_k")), F.col("_parent") == F.col("_outer"), "left")
        # an isolated group is one paint of what it makes of nothing
        alone = F.struct(F.transform("g.c", lambda x: F.when(F.col("g.t") > 0, x["r"] / F.col("g.t")).otherwise(0.0)).alias("colors"), F.col("g.t").alias("alpha"))
        as_paint = let(alone, lambda a: paint(a["colors"], a["alpha"] * F.col("_alpha"), F.col("_mode"), F.col("_outer_k"), F.when(a["alpha"] > 0, 1.0).otherwise(0.0)))
        fade = F.col("_alpha")
        faded = _map(F.lit(0.0), F.transform("g.c", lambda x: _component(1 - fade + fade * x["p"], fade * x["q"], fade * x["r"])), 1 - fade + fade * F.col("g.s"), fade * F.col("g.t"))
        other = F.when(F.coalesce("_outer_k", F.lit(False)) | (F.col("_mode") != "Normal"), F.raise_error("a group that is not isolated is painted in mode Normal, outside knockout groups").cast(PAINT)).otherwise(faded)
        outer = made.select(*by, F.col("_parent").alias("grp"), (F.col("_level") - 1).alias("level"), F.col("_ord").alias("ord"), F.when(F.col("isolated"), as_paint).otherwise(other).alias("m"))
        elements = elements.where(F.col("level") < level).union(outer)
    return segmented_reduce(elements, by, "ord", F.col("m"), stacked).withColumnRenamed("value", "paint")


#: Groups within groups.
MOST_NESTED = 256
