"""Shaded meshes: vertices to triangles by scans, triangles to points by tiles.

What a vertex or a patch takes over from the one before it is a choice of the
former's places, and choices compose, so inheritance runs as a ``segmented_scan`` of
slots: a slot is either one of the places of what came before (-1, -2, ...) or a
vertex or point of the mesh itself. Patches become lattices of their surface, lattices
and free triangles become triangles.

A triangle lies in the tiles of the level at which it is about one tile wide, so it
is in at most nine of them, however large it is; a point lies in one tile of each level that
is in use. Points and triangles meet by equality of (mesh, level, tile); the triangle
painted last that holds a point gives its colour, linear between the corners.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import let, let2, segmented_scan

#: Places of a patch's boundary points that an inherited edge is made of, and of its corners' colours, by flag.
EDGE_POINTS = {1: (3, 4, 5, 6), 2: (6, 7, 8, 9), 3: (9, 10, 11, 0)}
EDGE_COLORS = {1: (1, 2), 2: (2, 3), 3: (3, 0)}
# Where the twelve boundary points and the four inner ones lie in the four by four net, as (column, row).
BOUNDARY = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (3, 3), (3, 2), (3, 1), (3, 0), (2, 0), (1, 0))
INNER = ((1, 1), (1, 2), (2, 2), (2, 1))
VERTEX = "struct<x:double,y:double,color:array<double>>"


def _chosen(earlier: Column, later: Column) -> Column:
    """Slots after ``earlier``, then ``later``: those that name a place of what came before are looked up there."""
    return F.transform(later, lambda s: F.when(s < 0, F.get(earlier, (-s - 1).cast("int"))).otherwise(s))


def _slots(*values: Column | int) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values])


def free_triangles(vertices: DataFrame, by: list[str]) -> DataFrame:
    """by, ord, corners (array of three x, y, color): the triangles of free-form meshes.

    ``vertices``: by, ord (from 0, without gaps), flag, x, y, color. Flag 0 begins a
    triangle with the two vertices after it, whose flags do not count; 1 goes on from
    the last triangle's second side, 2 from its third. A vertex that goes on from nothing
    is left out, as is a triangle that is not finished.
    """
    # how far a begun triangle is, as a map from where it was (0: none, 1 and 2: vertices so far, 3: whole)
    moves = F.when(F.col("flag") == 0, _slots(1, 2, 3, 1)).otherwise(_slots(0, 2, 3, 3))
    follow = lambda a, b: F.transform(a, lambda s: F.get(b, s.cast("int")))
    counted = segmented_scan(vertices.select(*by, "ord", "flag", "x", "y", "color"), by, "ord", moves, follow, "_now", "_then")
    was = F.coalesce(F.get("_then", F.lit(0)), F.lit(0))
    known = counted.select(*by, "ord", "flag", "x", "y", "color", was.alias("was"), F.get("_now", F.lit(0)).alias("now"))
    # the last three vertices; the second side goes on from the last two, the third from the first and the last
    shift = F.when((F.col("was") == 3) & (F.col("flag") == 2), _slots(-1, -3, F.col("ord"))).otherwise(_slots(-2, -3, F.col("ord")))
    held = segmented_scan(known.where("now > 0"), by, "ord", shift, _chosen, "slots")
    whole = held.where("now = 3").select(*by, "ord", "slots")
    return _with_corners(whole, vertices.select(*by, F.col("ord").cast("long").alias("_at"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("color").cast("array<double>").alias("color")).alias("_v")), by)


def _with_corners(triangles: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """Triangles whose ``slots`` are numbers of vertices, with those vertices, in order."""
    each = triangles.select(*by, "ord", F.posexplode("slots").alias("_nth", "_slot"))
    named = places.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_at", "_v")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.col("_slot") == F.col("_at"))
    met = each.join(named, on).groupBy(*by, "ord").agg(F.sort_array(F.collect_list(F.struct("_nth", "_v"))).alias("_c"))
    return met.select(*by, "ord", F.col("_c._v").alias("corners"))


def lattice_triangles(vertices: DataFrame, by: list[str], width: Column) -> DataFrame:
    """by, ord, corners: two triangles for each cell of lattices of ``width`` vertices a row.

    ``vertices``: by, ord (from 0, row by row), x, y, color. Cells of a row that is not whole are left out.
    """
    held = vertices.select(*by, F.col("ord").cast("long").alias("_n"), width.cast("long").alias("_w"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("color").cast("array<double>").alias("color")).alias("_v"))
    # a vertex is a corner of up to four cells, each named by its first vertex
    column, cells = F.col("_n") % F.col("_w"), []
    for nth, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        inside = (column >= dx) & (column - dx < F.col("_w") - 1) & (F.col("_n") >= dx + dy * F.col("_w"))
        cells.append(F.when(inside, F.struct((F.col("_n") - dx - dy * F.col("_w")).alias("cell"), F.lit(nth).alias("nth"))))
    each = held.select(*by, "_v", F.explode(F.array_compact(F.array(*cells))).alias("_c"))
    met = each.groupBy(*by, F.col("_c.cell").alias("_cell")).agg(F.sort_array(F.collect_list(F.struct("_c.nth", "_v"))).alias("_q")).where(F.size("_q") == 4)
    q = F.col("_q._v")
    two = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.get(q, F.lit(i)) for i in three]).alias("corners")) for n, three in enumerate(((0, 1, 2), (1, 2, 3)))])
    return met.select(*by, "_cell", F.explode(two).alias("_t")).select(*by, (F.col("_cell") * 2 + F.col("_t.n")).alias("ord"), F.col("_t.corners").alias("corners"))


def whole_patches(patches: DataFrame, by: list[str]) -> DataFrame:
    """by, ord, net (array of sixteen x, y: row by row from the first corner), colors (of the four corners).

    ``patches``: by, ord, flag, points (array of x, y as they are stored) and colors. A patch
    of flag 1, 2 or 3 has four points and two colours of the edge of the patch before;
    one that follows nothing is left out. Twelve points are completed to sixteen as a Coons surface.
    """
    own, at = F.col("ord").cast("long"), lambda k: F.col("ord").cast("long") * 32 + k
    # the seventeenth slot is where the run of patches began: what follows nothing has none
    fresh = _slots(*[at(k) for k in range(12)], *[at(16 + k) for k in range(4)], at(31))
    slots = F.when(F.col("flag") == 0, fresh)
    for flag, edge in EDGE_POINTS.items():
        held = [F.lit(-(p + 1)) for p in edge] + [at(k) for k in range(8)]
        colors = [F.lit(-(12 + c + 1)) for c in EDGE_COLORS[flag]] + [at(16 + k) for k in range(2)]
        slots = slots.when(F.col("flag") == flag, _slots(*held, *colors, -17))
    rows = patches.select(*by, "ord", "flag", "points", "colors")
    found = segmented_scan(rows, by, "ord", slots, _chosen, "slots").where(~F.exists("slots", lambda s: F.coalesce(s < 0, F.lit(True))))
    # every slot brings its point or colour from the patch that stores it
    stored = F.concat(
        F.transform("points", lambda p, k: F.struct((own * 32 + k).alias("at"), p.alias("p"), F.lit(None).cast("array<double>").alias("c"))),
        F.transform("colors", lambda c, k: F.struct((own * 32 + 16 + k).alias("at"), F.lit(None).cast("array<double>").alias("p"), c.alias("c"))),
    )
    places = rows.select(*by, F.explode(stored).alias("s")).select(*by, F.col("s.at").alias("_at"), F.struct("s.p", "s.c").alias("_v"))
    inner = F.when(F.size("points") > 12 - F.when(F.col("flag") == 0, 0).otherwise(4), F.slice("points", F.size("points") - 3, 4))
    seen = _with_corners(found.select(*by, "ord", F.slice("slots", 1, 16).alias("slots")), places, by)
    kept = found.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("ord").alias("_ord"), inner.alias("_inner"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.col("ord") == F.col("_ord"))
    b = F.slice(F.col("corners.p"), 1, 12)
    return seen.join(kept, on).select(*by, "ord", let2(b, F.col("_inner"), _net).alias("net"), F.slice(F.col("corners.c"), 13, 4).alias("colors"))


def _net(boundary: Column, inner: Column) -> Column:
    place = {cell: F.get(boundary, F.lit(i)) for i, cell in enumerate(BOUNDARY)}
    p = lambda i, j, z: F.get(place[i, j], F.lit(z))

    def coons(i: int, j: int) -> Column:
        """The inner point nearest to corner (a, b) of a surface that its boundary makes."""
        a, b = (0 if i == 1 else 3), (0 if j == 1 else 3)
        far, wide = 3 - a, 3 - b
        one = lambda z: (-4 * p(a, b, z) + 6 * (p(a, j, z) + p(i, b, z)) - 2 * (p(a, wide, z) + p(far, b, z)) + 3 * (p(far, j, z) + p(i, wide, z)) - p(far, wide, z)) / 9
        return F.array(one(0), one(1))

    for k, (i, j) in enumerate(INNER):
        place[i, j] = F.coalesce(F.get(inner, F.lit(k)), coons(i, j))
    return F.array(*[place[i, j] for j in range(4) for i in range(4)])


def patch_lattices(patches: DataFrame, by: list[str], steps: int = 8) -> DataFrame:
    """by, ord, x, y, color: each whole patch as a lattice of ``steps`` + 1 vertices a side; ``by`` and the patch's ``patch`` name the lattice."""
    side = F.sequence(F.lit(0), F.lit(steps))
    grid = patches.select(*by, F.col("ord").alias("patch"), "net", "colors", F.explode(side).alias("_j")).select("*", F.explode(side).alias("_i"))
    u, v = F.col("_i") / steps, F.col("_j") / steps
    basis = lambda t: [(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3]
    coordinate = lambda z: reduce(lambda a, b: a + b, [bu * bv * F.get(F.get("net", F.lit(4 * j + i)), F.lit(z)) for j, bv in enumerate(basis(v)) for i, bu in enumerate(basis(u))])
    # corners round the patch: (0, 0), (0, 1), (1, 1), (1, 0) in (u, v)
    corner = [F.get("colors", F.lit(k)) for k in range(4)]
    zipped = F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(corner)])
    color = F.transform(zipped, lambda c: (1 - u) * (1 - v) * c["c0"] + (1 - u) * v * c["c1"] + u * v * c["c2"] + u * (1 - v) * c["c3"])
    return grid.select(*by, "patch", (F.col("_j") * (steps + 1) + F.col("_i")).alias("ord"), coordinate(0).alias("x"), coordinate(1).alias("y"), color.alias("color"))


def _level(size: Column) -> Column:
    """The power of two that is at least a triangle's larger side; the least level for points and lines."""
    return F.when(size > 0, F.greatest(F.ceil(F.log2(size)), F.lit(-20))).otherwise(F.lit(-20)).cast("int")


def _weights(c: Column, x: Column, y: Column) -> Column:
    """Barycentric weights of a point in a triangle, null for a triangle without area."""
    p = [F.get(c, F.lit(i)) for i in range(3)]
    area = (p[1]["x"] - p[0]["x"]) * (p[2]["y"] - p[0]["y"]) - (p[2]["x"] - p[0]["x"]) * (p[1]["y"] - p[0]["y"])
    part = lambda a, b: (a["x"] - x) * (b["y"] - y) - (b["x"] - x) * (a["y"] - y)
    return F.when(area != 0, F.array(part(p[1], p[2]) / area, part(p[2], p[0]) / area, part(p[0], p[1]) / area))


def painted_points(points: DataFrame, triangles: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """``points`` with ``color``: of the last triangle (greatest ``ord``) of their mesh that holds them, or null.

    ``points``: by, ``key`` (which tells points apart), x, y. ``triangles``: by, ord, corners. A point on a
    side is inside. Triangles without area hold nothing.
    """
    xs, ys = F.col("corners.x"), F.col("corners.y")
    sized = triangles.select(*by, "ord", "corners", F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"), F.array_min(ys).alias("_y0"), F.array_max(ys).alias("_y1"))
    sized = sized.withColumn("_level", _level(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))))
    tile = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")
    span = lambda a, b: F.sequence(tile(F.col(a), F.col("_level")), tile(F.col(b), F.col("_level")))
    filed = sized.select(*by, "ord", "corners", "_level", F.explode(span("_x0", "_x1")).alias("_tx"), "_y0", "_y1").select(*by, "ord", "corners", "_level", "_tx", F.explode(span("_y0", "_y1")).alias("_ty"))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # powers of two between the least and the largest triangle
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    asked = points.select(*by, *key, x.alias("_x"), y.alias("_y"), F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("_level"))
    asked = asked.select("*", tile(F.col("_x"), F.col("_level")).alias("_tx"), tile(F.col("_y"), F.col("_level")).alias("_ty"))
    names = [*by, "_level", "_tx", "_ty"]
    other = filed.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(names)], "ord", "corners")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(names)])
    met = asked.join(other, on).withColumn("_w", _weights(F.col("corners"), F.col("_x"), F.col("_y"))).where(F.forall("_w", lambda w: w >= -1e-9))
    colors = F.arrays_zip(*[F.get("corners", F.lit(i))["color"].alias(f"c{i}") for i in range(3)])
    mixed = let(F.col("_w"), lambda w: F.transform(colors, lambda c: F.get(w, F.lit(0)) * c["c0"] + F.get(w, F.lit(1)) * c["c1"] + F.get(w, F.lit(2)) * c["c2"]))
    last = met.groupBy(*by, *key).agg(F.max(F.struct("ord", mixed.alias("color")))["color"].alias("color"))
    keyed = [*by, *key]
    found = last.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keyed)], "color")
    return points.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(keyed)]), "left").select(*points.columns, "color")
