"""Paths of annotations without a stored appearance, as column expressions over the ``annotations`` table.

Covered: links, ink, the four text markups, squares, circles, polygons, open
polygons and plain lines, in page space. Borders come from ``BS`` or ``Border``; relief,
clouds, line endings, free text, icons, stamps and widgets are not drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import let

#: What is read of an annotation's dictionary, in one pass.
HELD = "AP string, BS struct<W:double,S:struct<`$n`:string>>, Border array<double>, IC array<double>, QuadPoints array<double>, Vertices array<double>, L array<double>, InkList array<array<double>>"
PATH = "struct<segments:array<struct<op:string,points:array<double>>>,fill:boolean,stroke:boolean,width:double>"
#: Distance of a Bezier curve's inner points that makes it a quarter of a circle, by radius.
ROUND = 4 / 3 * (math.sqrt(2) - 1)
MARKUPS = ("Highlight", "Underline", "StrikeOut", "Squiggly")


def _step(op: str, *values: Column) -> Column:
    points = F.array(*[v.cast("double") for v in values]) if values else F.array().cast("array<double>")
    return F.struct(F.lit(op).alias("op"), points.alias("points"))


def _path(segments: Column, fill: Column, stroke: Column, width: Column) -> Column:
    return F.struct(segments.alias("segments"), fill.alias("fill"), stroke.alias("stroke"), width.cast("double").alias("width"))


def _joined(points: Column) -> Column:
    """A line through x, y, x, y ..., an odd last number left out."""
    places = F.sequence(F.lit(0), F.expr("0") + F.floor(F.size(points) / 2).cast("int") - 1)
    step = lambda i: F.struct(F.when(i == 0, "M").otherwise("L").alias("op"), F.slice(points, 2 * i + 1, 2).alias("points"))
    return F.when(F.size(points) >= 2, F.transform(places, step))


def _box(rect: Column, width: Column) -> Column:
    """x0, y0, x1, y1 of the rectangle, half a border inside."""
    x0, y0, x1, y1 = (F.get(rect, F.lit(i)) for i in range(4))
    inset = F.struct(F.least(width / 2, (x1 - x0) / 2).alias("x"), F.least(width / 2, (y1 - y0) / 2).alias("y"))
    return let(inset, lambda d: F.struct((x0 + d["x"]).alias("x0"), (y0 + d["y"]).alias("y0"), (x1 - d["x"]).alias("x1"), (y1 - d["y"]).alias("y1")))


def _rectangle(box: Column) -> Column:
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    return F.array(_step("M", x0, y0), _step("L", x1, y0), _step("L", x1, y1), _step("L", x0, y1), _step("Z"))


def _ellipse(box: Column) -> Column:
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    held = F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), ((x1 - x0) / 2 * ROUND).alias("kx"), ((y1 - y0) / 2 * ROUND).alias("ky"))

    def curves(m: Column) -> Column:
        cx, cy, kx, ky = (m[c] for c in ("cx", "cy", "kx", "ky"))
        return F.array(
            _step("M", x1, cy), _step("C", x1, cy + ky, cx + kx, y1, cx, y1), _step("C", cx - kx, y1, x0, cy + ky, x0, cy),
            _step("C", x0, cy - ky, cx - kx, y0, cx, y0), _step("C", cx + kx, y0, x1, cy - ky, x1, cy), _step("Z"),
        )

    return let(held, curves)


def _corners(q: Column) -> Column:
    """The corners a to d of a quadrilateral from its lower left round, given so or row by row from its upper left."""
    p = [(F.get(q, F.lit(2 * i)), F.get(q, F.lit(2 * i + 1))) for i in range(4)]
    by_rows = (p[1][0] - p[0][0]) * (p[3][0] - p[2][0]) + (p[1][1] - p[0][1]) * (p[3][1] - p[2][1]) > 0
    put = lambda order: F.struct(*[p[at][i].alias(f"{n}{'xy'[i]}") for n, at in zip("abcd", order, strict=True) for i in (0, 1)])
    return F.when(by_rows, put((2, 3, 1, 0))).otherwise(put((0, 1, 2, 3)))


# A markup's line is a twelfth of its height and at most 1 wide; a wave's step is two widths along and two off.
LINE_SHARE, LINE_MOST, WAVE = 12, 1.0, 2


def _markup(kind: Column, c: Column) -> Column:
    """The path of one quadrilateral by its corners."""
    ax, ay, bx, by, cx, cy, dx, dy = (c[f"{n}{z}"] for n in "abcd" for z in "xy")
    lift = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    length = F.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
    measured = let(length, lambda n: F.struct(n.alias("length"), F.least(F.lit(LINE_MOST), (lift(cx, cy) + lift(dx, dy)) / (2 * n) / LINE_SHARE).alias("width")))
    none = F.array().cast("array<struct<op:string,points:array<double>>>")

    def path(m: Column) -> Column:
        length, width = m["length"], m["width"]
        steps = F.ceil(length / (WAVE * width)).cast("int")

        def wave(n: Column) -> Column:
            def at(j: Column) -> Column:
                off = (j % 2) * WAVE * width
                return let(F.struct((j * length / n).alias("along"), off.alias("off")), lambda w: _step("L", ax + (w["along"] * (bx - ax) - w["off"] * (by - ay)) / length, ay + (w["along"] * (by - ay) + w["off"] * (bx - ax)) / length))

            return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), at)).otherwise(none)

        segments = (
            F.when(kind == "Highlight", F.array(_step("M", ax, ay), _step("L", bx, by), _step("L", cx, cy), _step("L", dx, dy), _step("Z")))
            .when(kind == "Underline", F.array(_step("M", ax, ay), _step("L", bx, by)))
            .when(kind == "StrikeOut", F.array(_step("M", (ax + dx) / 2, (ay + dy) / 2), _step("L", (bx + cx) / 2, (by + cy) / 2)))
            .otherwise(F.concat(F.array(_step("M", ax, ay)), let(steps, wave), F.array(_step("L", bx, by))))
        )
        high = kind == "Highlight"
        return _path(segments, high, ~high, F.when(~high, width))

    return let(measured, path)


def drawn_annotations(annotations: DataFrame) -> DataFrame:
    """doc_id, page_index, index, part, segments, fill, stroke, width: the paths of annotations of the covered kinds without ``AP``.

    The border is ``BS.W``, else the third number of ``Border``, else 1 wide. An
    annotation's dictionary is parsed once; width and box are columns of their own,
    and corners are bound before they are used, so the plan does not grow with the
    number of uses. Defined cases: missing or too few points give no path; a border
    of no width and no interior colour gives none; other kinds give none.
    """
    kind = F.col("subtype")
    read = annotations.where(kind.isin("Link", "Square", "Circle", "Polygon", "PolyLine", "Line", "Ink", *MARKUPS)).select("doc_id", "page_index", "index", "subtype", "rect", F.from_json("dict_json", HELD).alias("d"))
    sized = read.where("d.AP IS NULL").withColumn("width", F.coalesce("d.BS.W", F.get("d.Border", F.lit(2)), F.lit(1.0)))
    boxed = sized.withColumn("box", _box(F.col("rect"), F.col("width")))
    width, box = F.col("width"), F.col("box")
    stroke, inside = width > 0, F.coalesce(F.size("d.IC") > 0, F.lit(False))
    one = lambda segments, fill: F.array(_path(segments, fill, stroke, width))
    none, closed = F.lit(False), F.array(_step("Z"))
    underlined = F.array(_step("M", box["x0"], box["y0"]), _step("L", box["x1"], box["y0"]))
    quads, vertices = F.col("d.QuadPoints"), F.col("d.Vertices")
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size(quads) / 8).cast("int") - 1), lambda i: let(_corners(F.slice(quads, 8 * i + 1, 8)), lambda c: _markup(kind, c)))
    paths = (
        F.when(kind == "Link", one(F.when(F.col("d.BS.S.$n") == "U", underlined).otherwise(_rectangle(box)), none))
        .when(kind == "Square", one(_rectangle(box), inside))
        .when(kind == "Circle", one(_ellipse(box), inside))
        .when((kind == "Polygon") & (F.size(vertices) >= 6), one(F.concat(_joined(vertices), closed), inside))
        .when((kind == "PolyLine") & (F.size(vertices) >= 4), one(_joined(vertices), none))
        .when((kind == "Line") & (F.size("d.L") == 4), one(_joined(F.col("d.L")), none))
        .when(kind == "Ink", F.transform("d.InkList", lambda p: _path(_joined(p), none, stroke, width)))
        .when(kind.isin(*MARKUPS) & (F.size(quads) >= 8), each)
    )
    out = boxed.select("doc_id", "page_index", "index", F.posexplode(paths).alias("part", "path")).select("doc_id", "page_index", "index", "part", "path.*")
    return out.where("(fill OR stroke) AND segments IS NOT NULL")
