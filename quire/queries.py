"""Queries of the document engine on the star-schema and text tables, with their oracles.

The tables hold no PDF bytes, so each query derives its input: numbers become
matrices and colours, texts become streams, content or whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import blend as B
from quire.functions import calculator, filters, geometry, labels, shading, views
from quire.functions.dates import format_date, parse_date
from quire.functions.spot import SPOTS, spot
from quire.operators import relations as R
from quire.plans.session import SPREAD_BYTES, cut_lineage, spread
from quire.sources.pdf.fonts import HELVETICA
from quire.sources.tables import from_text, rewritten, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + 0.0


def steady(c: Column, digits: int) -> Column:
    """Rounding whose ties do not hang on the last bit of a sum."""
    return F.floor(c * float(10**digits) + 0.5001) / float(10**digits)


def _matrix() -> geometry.Matrix:
    return tuple(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"))


_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_quantity * l_extendedprice + l_tax * l_quantity + l_partkey, 4) + 0.0 AS x,
  round(l_discount * l_extendedprice + l_linenumber * l_quantity + l_suppkey, 4) + 0.0 AS y FROM lineitem""")
def matrix_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.apply(_matrix(), F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(*_KEY, (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_quantity * l_discount + l_tax * l_tax, 6) + 0.0 AS a, round(l_discount * l_discount + l_linenumber * l_tax, 6) + 0.0 AS b,
  round(l_quantity * 2 + l_tax * 3, 6) + 0.0 AS c, round(l_discount * 2 + l_linenumber * 3, 6) + 0.0 AS d,
  round(l_quantity * 5 + l_tax * 7 + l_partkey, 6) + 0.0 AS e, round(l_discount * 5 + l_linenumber * 7 + l_suppkey, 6) + 0.0 AS f FROM lineitem""")
def matrix_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("l_discount"), F.col("l_tax"), *[F.lit(float(v)) for v in (2, 3, 5, 7)])
    product = geometry.multiply(_matrix(), n)
    return table(spark, sf_dir, "lineitem").select(*_KEY, *[r6(c).alias(k) for k, c in zip("abcdef", product, strict=True)])


@query("""WITH m AS (SELECT *, l_quantity * l_linenumber - l_discount * l_tax AS det FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_linenumber / det, 6) + 0.0 AS a, round(-l_discount / det, 6) + 0.0 AS b,
  round(-l_tax / det, 6) + 0.0 AS c, round(l_quantity / det, 6) + 0.0 AS d FROM m""")
def matrix_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    inverse = geometry.inverse(_matrix())
    return table(spark, sf_dir, "lineitem").select(*_KEY, *[r6(c).alias(k) for k, c in zip("abcd", inverse[:4], strict=True)])


@query("""WITH m AS (SELECT *, (l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax + l_linenumber * l_linenumber) / 2 AS h,
  l_quantity * l_linenumber - l_discount * l_tax AS det FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(h + sqrt(greatest(0.0, h * h - det * det))), 5) AS max_scale FROM m""")
def matrix_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_KEY, F.round(geometry.max_scale(_matrix()), 5).alias("max_scale"))


@query("""WITH c AS (SELECT p_partkey, unnest([0.0, p_size]) AS x, p_size FROM part),
q AS (SELECT p_partkey, x, unnest([0.0, 2.0 * p_size]) AS y FROM c),
t AS (SELECT p_partkey, 0.6::DOUBLE * x - 0.8::DOUBLE * y + 10 AS tx, 0.8::DOUBLE * x + 0.6::DOUBLE * y - 5 AS ty FROM q)
SELECT p_partkey, round(min(tx), 6) + 0.0 AS x0, round(min(ty), 6) + 0.0 AS y0, round(max(tx), 6) + 0.0 AS x1, round(max(ty), 6) + 0.0 AS y1 FROM t GROUP BY p_partkey""")
def transformed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tuple(F.lit(float(v)) for v in (0.6, 0.8, -0.8, 0.6, 10, -5))
    box = geometry.bounds(m, F.lit(0.0), F.lit(0.0), F.col("p_size") * 1.0, F.col("p_size") * 2.0)
    return table(spark, sf_dir, "part").select("p_partkey", *[r6(c).alias(k) for k, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)])


_B, _S = "(round(l_discount * 10, 4))", "(round(l_tax * 12.5, 4))"


def _colors() -> tuple[Column, Column]:
    return F.round(F.col("l_discount") * 10, 4), F.round(F.col("l_tax") * 12.5, 4)


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_B} AS b, {_S} AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b * s, 6) AS multiply, round(b + s - b * s, 6) AS screen,
  round(CASE WHEN b <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END, 6) + 0.0 AS overlay, least(b, s) AS darken, greatest(b, s) AS lighten,
  round(CASE WHEN b = 0 THEN 0.0 WHEN s = 1 THEN 1.0 ELSE least(1.0, b / (1 - s)) END, 6) AS dodge,
  round(CASE WHEN b = 1 THEN 1.0 WHEN s = 0 THEN 0.0 ELSE 1 - least(1.0, (1 - b) / s) END, 6) + 0.0 AS burn,
  round(CASE WHEN s <= 0.5 THEN 2 * b * s ELSE 1 - 2 * (1 - b) * (1 - s) END, 6) + 0.0 AS hard_light,
  round(CASE WHEN s <= 0.5 THEN b - (1 - 2 * s) * b * (1 - b) ELSE b + (2 * s - 1) * ((CASE WHEN b <= 0.25 THEN ((16 * b - 12) * b + 4) * b ELSE sqrt(b) END) - b) END, 6) AS soft_light,
  round(abs(b - s), 6) AS difference, round(b + s - 2 * b * s, 6) AS exclusion FROM v""")
def blend_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s = F.col("b"), F.col("s")
    modes = {"multiply": "Multiply", "screen": "Screen", "overlay": "Overlay", "dodge": "ColorDodge", "burn": "ColorBurn", "hard_light": "HardLight", "soft_light": "SoftLight", "difference": "Difference", "exclusion": "Exclusion"}
    colors = _colors()
    values = table(spark, sf_dir, "lineitem").select(*_KEY, colors[0].alias("b"), colors[1].alias("s"))
    return values.select(*_KEY, *[r6(B.blend(m, b, s)).alias(k) for k, m in modes.items()], B.blend("Darken", b, s).alias("darken"), B.blend("Lighten", b, s).alias("lighten"))



def _nonseparable_sql(mode: str) -> str:
    lum = lambda p: f"(0.3 * {p}r + 0.59 * {p}g + 0.11 * {p}b)"
    sat = lambda p: f"(greatest({p}r, {p}g, {p}b) - least({p}r, {p}g, {p}b))"
    base, target_lum, target_sat = {"Hue": ("s", lum("b"), sat("b")), "Saturation": ("b", lum("b"), sat("s")), "Color": ("s", lum("b"), None), "Luminosity": ("b", lum("s"), None)}[mode]
    low, spread = f"least({base}r, {base}g, {base}b)", sat(base)
    part = lambda c: f"{base}{c}" if target_sat is None else f"(CASE WHEN {spread} = 0 THEN 0.0 ELSE ({base}{c} - {low}) * {target_sat} / {spread} END)"
    return f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_B} AS br, {_S} AS bg, round(l_quantity / 50, 4) AS bb,
  {_S} AS sr, round(1 - l_quantity / 50, 4) AS sg, {_B} AS sb FROM lineitem),
t AS (SELECT *, {part("r")} AS tr, {part("g")} AS tg, {part("b")} AS tb, {target_lum} AS l FROM v),
m AS (SELECT *, tr + (l - (0.3 * tr + 0.59 * tg + 0.11 * tb)) AS cr, tg + (l - (0.3 * tr + 0.59 * tg + 0.11 * tb)) AS cg, tb + (l - (0.3 * tr + 0.59 * tg + 0.11 * tb)) AS cb FROM t),
n AS (SELECT *, (0.3 * cr + 0.59 * cg + 0.11 * cb) AS cl, least(cr, cg, cb) AS lo, greatest(cr, cg, cb) AS hi FROM m),
o AS (SELECT *, CASE WHEN lo < 0 THEN cl + (cr - cl) * cl / (cl - lo) ELSE cr END AS er, CASE WHEN lo < 0 THEN cl + (cg - cl) * cl / (cl - lo) ELSE cg END AS eg, CASE WHEN lo < 0 THEN cl + (cb - cl) * cl / (cl - lo) ELSE cb END AS eb FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {", ".join(f"floor((CASE WHEN hi > 1 THEN cl + (e{c} - cl) * (1 - cl) / (hi - cl) ELSE e{c} END) * 1e5 + 0.5001) / 1e5 AS {c}" for c in "rgb")} FROM o"""


def _nonseparable(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, s = _colors()
        q = F.round(F.col("l_quantity") / 50, 4)
        names = ("br", "bg", "bb", "sr", "sg", "sb")
        values = table(spark, sf_dir, "lineitem").select(*_KEY, *[c.alias(n) for n, c in zip(names, (b, s, q, s, F.round(1 - F.col("l_quantity") / 50, 4), b), strict=True)])
        out = B.NONSEPARABLE[mode](tuple(map(F.col, names[:3])), tuple(map(F.col, names[3:])))
        return values.select(*_KEY, *[steady(c, 5).alias(k) for k, c in zip("rgb", out, strict=True)])

    return run


for _mode in B.NONSEPARABLE:
    QUERIES[f"blend_{_mode.lower()}"] = _nonseparable(_mode)
    ORACLES[f"blend_{_mode.lower()}"] = _nonseparable_sql(_mode)


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_B} AS b, {_S} AS s, round(l_quantity / 50, 4) AS ab, 0.5 AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + ab * (1 - a), 6) AS alpha,
  round(greatest(0.0, least(1.0, ((1 - a) * ab * b + a * ((1 - ab) * s + ab * (b * s))) / (a + ab * (1 - a)))), 6) AS value FROM v""")
def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s = _colors()
    values = table(spark, sf_dir, "lineitem").select(*_KEY, b.alias("b"), s.alias("s"), F.round(F.col("l_quantity") / 50, 4).alias("ab"))
    alpha, half = F.col("ab"), F.lit(0.5)
    return values.select(*_KEY, r6(B.union_alpha(alpha, half)).alias("alpha"), r6(B.composite("Multiply", F.col("b"), alpha, F.col("s"), half)).alias("value"))


@query("""WITH v AS (SELECT p_partkey, round(p_size / 50.0, 4) AS r, round((p_retailprice % 100) / 100, 4) AS g, round((p_partkey % 97) / 97.0, 4) AS b FROM part)
SELECT p_partkey, floor((0.3 * r + 0.59 * g + 0.11 * b) * 1e5 + 0.5001) / 1e5 AS gray, floor((greatest(r, g, b) - r) * 1e5 + 0.5001) / 1e5 AS c, floor((greatest(r, g, b) - g) * 1e5 + 0.5001) / 1e5 AS m,
  floor((greatest(r, g, b) - b) * 1e5 + 0.5001) / 1e5 AS y, floor((1 - greatest(r, g, b)) * 1e5 + 0.5001) / 1e5 AS k,
  floor((0.3 * (1 - r) + 0.59 * (1 - g) + 0.11 * (1 - b)) * 0.75 * 1e5 + 0.5001) / 1e5 AS cmyk_luminosity FROM v""")
def rgb_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_size") / 50, 4).alias("r"), F.round((F.col("p_retailprice") % 100) / 100, 4).alias("g"), F.round((F.col("p_partkey") % 97) / 97, 4).alias("b"))
    rgb = tuple(map(F.col, "rgb"))
    c, m, y, k = B.rgb_to_cmyk(rgb)
    lum = B.luminosity_cmyk(*rgb, F.lit(0.25))
    values = {"gray": B.rgb_to_gray(rgb), "c": c, "m": m, "y": y, "k": k, "cmyk_luminosity": lum}
    return v.select("p_partkey", *[steady(x, 5).alias(n) for n, x in values.items()])


_SPOT_SQL = {
    "SimpleDot": "1 - x*x - y*y", "InvertedSimpleDot": "x*x + y*y - 1", "DoubleDot": "(sin(2*pi()*x) + sin(2*pi()*y)) / 2", "InvertedDoubleDot": "-(sin(2*pi()*x) + sin(2*pi()*y)) / 2",
    "CosineDot": "(cos(pi()*x) + cos(pi()*y)) / 2", "Double": "(sin(pi()*x) + sin(2*pi()*y)) / 2", "InvertedDouble": "-(sin(pi()*x) + sin(2*pi()*y)) / 2", "Line": "-abs(y)", "LineX": "x", "LineY": "y",
    "Round": "CASE WHEN abs(x)+abs(y) <= 1 THEN 1 - x*x - y*y ELSE (abs(x)-1)*(abs(x)-1) + (abs(y)-1)*(abs(y)-1) - 1 END",
    "Ellipse": "CASE WHEN 3*abs(x)+4*abs(y)-3 < 0 THEN 1 - (x*x + y*y/0.5625)/4 WHEN 3*abs(x)+4*abs(y)-3 > 1 THEN ((1-abs(x))*(1-abs(x)) + (1-abs(y))*(1-abs(y))/0.5625)/4 - 1 ELSE 0.5 - (3*abs(x)+4*abs(y)-3) END",
    "EllipseA": "1 - x*x - 0.9*y*y", "InvertedEllipseA": "x*x + 0.9*y*y - 1", "EllipseB": "1 - sqrt(x*x + 5*y*y/8)", "EllipseC": "1 - 0.9*x*x - y*y", "InvertedEllipseC": "0.9*x*x + y*y - 1",
    "Square": "-greatest(abs(x), abs(y))", "Cross": "-least(abs(x), abs(y))", "Rhomboid": "(0.9*abs(x) + abs(y)) / 2",
    "Diamond": "CASE WHEN abs(x)+abs(y) <= 0.75 THEN 1 - x*x - y*y WHEN abs(x)+abs(y) <= 1.23 THEN 1 - 0.85*abs(x) - abs(y) ELSE (abs(x)-1)*(abs(x)-1) + (abs(y)-1)*(abs(y)-1) - 1 END",
}


@query(f"""WITH g AS (SELECT n_nationkey, r_regionkey, (n_nationkey - 12) / 11.7 AS rx, (r_regionkey - 2) / 2.3 AS ry FROM nation, region),
c AS (SELECT n_nationkey, r_regionkey, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, rx)) AS x, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ry)) AS y FROM g)
SELECT n_nationkey, r_regionkey, {", ".join(f"round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {e})), 6) + 0.0 AS {n}" for n, e in _SPOT_SQL.items())} FROM c""")
def spot_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey"))
    grid = grid.join(table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey")
    x, y = (F.col("n_nationkey") - 12) / 11.7, (F.col("r_regionkey") - 2) / 2.3
    return grid.select("n_nationkey", "r_regionkey", *[r6(spot(n, x, y)).alias(n) for n in SPOTS])


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice > 150000 THEN sqrt(o_totalprice) ELSE o_totalprice / 1000 END, 5) AS f,
  floor(o_totalprice + 0.5) + (o_orderkey % 7) AS g,
  round(CASE WHEN degrees(atan2(sin(radians(o_totalprice % 360)), 0.5)) < 0 THEN degrees(atan2(sin(radians(o_totalprice % 360)), 0.5)) + 360 ELSE degrees(atan2(sin(radians(o_totalprice % 360)), 0.5)) END, 5) AS h FROM orders""")
def calculator_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    run = lambda text, *inputs: calculator.compile_columns(calculator.parse(text), list(inputs))[0]
    f = run("{ dup 150000 gt { sqrt } { 1000 div } ifelse }", price)
    g = run("{ cvi 7 mod exch round add }", price, key)
    h = run("{ sin 0.5 atan }", price)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(f, 5).alias("f"), g.alias("g"), F.round(h, 5).alias("h"))


@query("""SELECT o_orderkey, o_orderdate AS ts, 0 AS offset_seconds, o_orderdate - INTERVAL 90 MINUTE AS shifted, 5400 AS shifted_offset, NULL::TIMESTAMP AS invalid FROM orders""")
def parse_pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    zulu, east, bad = parse_date(F.concat(F.lit("D:"), stamp, F.lit("Z"))), parse_date(F.concat(F.lit("D:"), stamp, F.lit("+01'30'"))), parse_date(F.concat(F.lit("D:"), F.substring(stamp, 1, 4), F.lit("1332")))
    return table(spark, sf_dir, "orders").select("o_orderkey", zulu["ts"].alias("ts"), zulu["offset_seconds"].alias("offset_seconds"), east["ts"].alias("shifted"), east["offset_seconds"].alias("shifted_offset"), bad["ts"].alias("invalid"))


@query("SELECT event_id, 'D:' || strftime(ts, '%Y%m%d%H%M%S') || 'Z' AS pdf_date FROM events")
def format_pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", format_date(F.col("ts")).alias("pdf_date"))


_LABEL_SQL = """WITH r AS (SELECT n_nationkey * 40 AS start, (['D','R','r','A','a',NULL])[n_nationkey % 6 + 1] AS style, substr(n_name, 1, 2) || '-' AS prefix, n_nationkey % 5 + 1 AS first FROM nation),
g AS (SELECT *, lead(start) OVER (ORDER BY start) AS stop FROM r)"""


@query(_LABEL_SQL + " SELECT start, stop, style, prefix, first FROM g")
def page_label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranges_of(_label_starts(spark, sf_dir), ["doc"], "start").select("start", "stop", "style", "prefix", "first")


def _label_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.array(*map(F.lit, ("D", "R", "r", "A", "a", None)))
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.lit(0).alias("doc"), (key * 40).alias("start"), F.get(styles, (key % 6).cast("int")).alias("style"),
        F.concat(F.substring("n_name", 1, 2), F.lit("-")).alias("prefix"), (key % 5 + 1).alias("first"),
    )


@query(_LABEL_SQL + """, p AS (SELECT c_custkey AS page, ((c_custkey * 7) % 1000) AS idx FROM customer),
n AS (SELECT page, idx, style, prefix, first + idx - start AS n FROM p JOIN g ON idx >= start AND (stop IS NULL OR idx < stop))
SELECT page, idx, prefix || CASE style WHEN 'D' THEN n::VARCHAR
  WHEN 'R' THEN repeat('M', n // 1000) || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[n // 100 % 10 + 1] || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[n // 10 % 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[n % 10 + 1]
  WHEN 'r' THEN lower(repeat('M', n // 1000) || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[n // 100 % 10 + 1] || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[n // 10 % 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[n % 10 + 1])
  WHEN 'A' THEN repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::BIGINT) WHEN 'a' THEN repeat(chr((97 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::BIGINT) ELSE '' END AS label FROM n""")
def page_label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages of 40 documents' worth of labels: the page number's block of 1000 is its document
    starts = _label_starts(spark, sf_dir).withColumn("doc", F.explode(F.sequence(F.lit(0), F.lit(63))))
    pages = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 64).cast("int").alias("doc"), F.col("c_custkey").alias("page"), ((F.col("c_custkey") * 7) % 1000).alias("idx"))
    found = R.in_range(pages, starts, ["doc"], "idx", "start")
    return found.select("page", "idx", labels.page_label(F.col("style"), F.col("prefix"), F.col("first") + F.col("idx") - F.col("start")).alias("label"))


_TEXT_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query(_TEXT_SQL)
def ascii_hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "documents").select("doc_id", filters.ascii_hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))
    return coded.select("doc_id", F.decode(filters.from_ascii_hex(F.col("h")), "UTF-8").alias("text"))


def _roundtrip(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        encode, decode = filters.CODECS[name]
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
        return docs.select("doc_id", F.decode(decode(encode("b")), "UTF-8").alias("text"))

    return run


for _name in filters.CODECS:
    QUERIES[f"{_name}_roundtrip"] = _roundtrip(_name)
    ORACLES[f"{_name}_roundtrip"] = _TEXT_SQL


@query(_TEXT_SQL)
def text_string_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filters.text_string_value(filters.text_string_bytes(F.coalesce("text", F.lit("")))).alias("text"))


@query("SELECT vec_id, list_transform(embedding, lambda x: (floor((x::DOUBLE + 1) * 100))::INT % 256) AS samples FROM embeddings")
def predictor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def through(values):
        import pandas as pd

        out = []
        for v in values:
            data = bytes(int(x) % 256 for x in v)
            out.append(list(filters.undo_predictor(filters.apply_up_predictor(data, 4), 12, 1, 8, 4)))
        return pd.Series(out)

    samples = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", through(samples).alias("samples"))


def _pdfs(spark: SparkSession, sf_dir: str, size: int = SPREAD_BYTES) -> DataFrame:
    return from_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), size=size))


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), p AS (SELECT doc_id, n, (n + 59) // 60 AS pages FROM n)"


@query(_LINES + """, o AS (SELECT doc_id, unnest(['BT', 'Tf', 'TL', 'Tm', '''', 'ET']) AS operator, unnest([pages, pages, pages, pages, n, pages]) AS n_ops FROM p)
SELECT doc_id, operator, n_ops::BIGINT AS n_ops FROM o""")
def content_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_pdfs(spark, sf_dir), "operations", "FAILFAST").groupBy("doc_id", "operator").agg(F.count("*").alias("n_ops"))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l)
SELECT doc_id, (i // 60)::INT AS page_index, count(*) FILTER (WHERE line <> '') AS n_marks, sum(length(line))::BIGINT AS n_glyphs FROM e GROUP BY ALL HAVING sum(length(line)) > 0""")
def text_extract_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDF and read back: shown lines and glyphs of each page."""
    marks = scan(_pdfs(spark, sf_dir), "text_marks", "FAILFAST")
    return marks.groupBy("doc_id", "page_index").agg(F.count("*").alias("n_marks"), F.sum(F.length("text")).alias("n_glyphs"))


def _placed_lines(files: DataFrame) -> DataFrame:
    marks = scan(files, "text_marks", "FAILFAST")
    y = F.get("matrix", F.lit(5))
    return marks.select("doc_id", "page_index", F.round((768 - y) / 12).cast("int").alias("line_index"), "text", y.alias("y"))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l),
s AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '[\\x00-\\x1F]', '', 'g'), '[^\\x20-\\x7F\\x{A0}-\\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g') AS text FROM e)
SELECT doc_id, (i // 60)::INT AS page_index, (i % 60)::INT AS line_index, text, (768 - 12 * (i % 60))::DOUBLE AS y FROM s WHERE line <> ''""")
def text_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shown line of all texts with its place on the page, as read back from WinAnsiEncoding.

    A character outside the encoding becomes ``?``; a control character below
    U+0020 has no text, and a line of nothing else has the empty text.
    """
    return _placed_lines(_pdfs(spark, sf_dir))


@query("SELECT doc_id, ((len(string_split(coalesce(text, ''), chr(10))) + 59) // 60)::INT AS n_pages, '1.7' AS version, false AS encrypted FROM documents")
def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_pdfs(spark, sf_dir), "documents", "FAILFAST").select("doc_id", "n_pages", "version", "encrypted")


@query("SELECT doc_id, ((len(string_split(coalesce(text, ''), chr(10))) + 59) // 60)::BIGINT AS n_pages, 0::BIGINT AS n_faults, true AS smaller FROM documents")
def optimised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written, optimised and read again."""
    # written once, then read for its counters and for its pages
    out = cut_lineage(rewritten(_pdfs(spark, sf_dir)))
    pages = scan(out, "pages", "FAILFAST").groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    told = out.select("doc_id", F.col("fault").isNotNull().cast("long").alias("n_faults"), (F.col("bytes_out") <= F.col("bytes_in") + 64).alias("smaller"))
    return told.join(pages, "doc_id").select("doc_id", "n_pages", "n_faults", "smaller")


@query(f"""WITH w(c, width) AS (SELECT chr(i::INT), w FROM (SELECT unnest(range(32, 127)) AS i, unnest({list(HELVETICA)}) AS w)),
g AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part)
SELECT p_partkey, round(sum(width) / 1000 * 10, 6) AS advance FROM g JOIN w USING (c) GROUP BY p_partkey""")
def glyph_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every part is a document of its own, so few bytes are much work
    docs = from_text(spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), rows=2500))
    return scan(docs, "glyphs", "FAILFAST").groupBy(F.col("doc_id").alias("p_partkey")).agg(r6(F.sum("width") * 10).alias("advance"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def page_tree_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = R.nearest_ancestor([F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.col("r_name")])
    return tree.select("c_custkey", value.alias("value"))


@query("SELECT o_custkey AS num, o_orderkey AS position, o_orderstatus AS kind FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def xref_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("num"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("kind"), "o_orderdate")
    age = F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("position"))
    return R.newest_entries(entries, ["num"], age).select("num", "position", "kind")


def _reached(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda t, a, b: table(spark, sf_dir, t).select(F.lit(0).alias("doc_id"), a.alias("src"), b.alias("dst"))
    edges = edge("orders", name("c", "o_custkey"), name("o", "o_orderkey")).union(edge("lineitem", name("o", "l_orderkey"), name("p", "l_partkey")))
    roots = customers.select(F.lit(0).alias("doc_id"), name("c", "c_custkey").alias("num"))
    return R.reachable(edges, roots).select("num", "depth")


@query("""WITH o AS (SELECT DISTINCT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT 'c' || c_custkey AS num, 0 AS depth FROM customer UNION ALL SELECT 'o' || o_orderkey, 1 FROM o UNION ALL SELECT 'p' || l_partkey, 2 FROM p""")
def object_reachability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts that any customer leads to; every customer is a root."""
    return _reached(spark, sf_dir, table(spark, sf_dir, "customer"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS canonical FROM documents")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return R.canonical(hashed, ["sha256"], "doc_id").select("doc_id", "canonical")


@query("SELECT l_partkey AS num, count(*) AS n_refs FROM lineitem GROUP BY l_partkey")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reference_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("num")), ["num"])


@query("""SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber = 7) THEN 0.0 ELSE max(l_quantity) END AS max_width,
  CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber = 7) THEN 0.0 ELSE max(l_extendedprice) END AS max_height FROM lineitem GROUP BY l_partkey""")
def image_max_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    unsafe = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    return R.image_bounds(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("height"), unsafe.alias("unsafe")), ["l_partkey"])


@query("SELECT lang, list_sort(list(DISTINCT c)) AS glyphs FROM (SELECT lang, ord(unnest(string_split(text, ''))) AS c FROM documents WHERE text <> '') GROUP BY lang")
def glyph_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("text <> ''").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''")
    return own.select("lang", F.ascii("c").alias("c")).groupBy("lang").agg(F.array_sort(F.collect_set("c")).alias("glyphs"))


@query("""WITH RECURSIVE m AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey - 1 END AS t FROM nation),
w AS (SELECT k, k AS now FROM m UNION ALL SELECT w.k, m.t FROM w JOIN m ON w.now = m.k WHERE m.t IS NOT NULL)
SELECT k AS n_nationkey, min(now) AS resolved FROM w GROUP BY k""")
def role_map_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    roles = table(spark, sf_dir, "nation").select("n_nationkey", F.when(key % 4 != 0, key - 1).alias("to"))
    mapping = roles.where("to IS NOT NULL").select(F.col("n_nationkey").alias("a"), F.col("to").alias("b"))
    items = roles.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("role"))
    return R.resolved_chain(items, "id", "role", mapping, "a", "b").select(F.col("id").alias("n_nationkey"), "resolved")


@query("""WITH t AS (SELECT r_regionkey AS a, -1 AS b, -1 AS c, r_name AS title, 0 AS level FROM region
UNION ALL SELECT n_regionkey, n_nationkey, -1, n_name, 1 FROM nation
UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT title, level, (row_number() OVER (PARTITION BY a ORDER BY b, c))::INT AS ord, a AS doc FROM t""")
def outline_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    node = lambda df, a, b, c, title, level: df.select(a.alias("doc"), R.preorder([("b", b), ("c", c)]).alias("path"), title.alias("title"), F.lit(level).alias("level"))
    none = F.lit(-1)
    items = node(table(spark, sf_dir, "region"), F.col("r_regionkey"), none, none, F.col("r_name"), 0)
    items = items.union(node(nation, F.col("n_regionkey"), F.col("n_nationkey"), none, F.col("n_name"), 1))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    items = items.union(node(customers, F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_custkey"), F.col("c_name"), 2))
    return items.select("title", "level", F.row_number().over(Window.partitionBy("doc").orderBy("path")).alias("ord"), "doc")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS target FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def name_tree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("target"))
    return table(spark, sf_dir, "lineitem").join(names, "l_partkey", "left").select(*_KEY, "target")


@query("""SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NOT NULL THEN b.text ELSE a.text END AS contents, CASE WHEN b.turn IS NOT NULL THEN b.role ELSE a.role END AS author
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.turn % 2 = 1""")
def popup_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    parent = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("found"), F.col("text").alias("p_text"), F.col("role").alias("p_role")).where("turn % 2 = 1")
    both = own.join(parent, ["conv_id", "turn"], "left")
    has = F.col("found").isNotNull()
    return both.select("conv_id", "turn", R.replaced_by_parent(has, F.col("text"), F.col("p_text")).alias("contents"), R.replaced_by_parent(has, F.col("role"), F.col("p_role")).alias("author"))


@query("""WITH s AS (SELECT user_id, user_id % 4 AS p, bool_and(value > 10) AS ev, bool_or(value > 10) AS so FROM events GROUP BY user_id)
SELECT user_id, (['AnyOn','AllOn','AnyOff','AllOff'])[p + 1] AS policy, CASE p WHEN 1 THEN ev WHEN 2 THEN NOT ev WHEN 3 THEN NOT so ELSE so END AS visible FROM s""")
def ocg_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.col("value") > 10).alias("states"))
    policy = F.get(F.array(*map(F.lit, ("AnyOn", "AllOn", "AnyOff", "AllOff"))), (F.col("user_id") % 4).cast("int"))
    return states.select("user_id", policy.alias("policy"), R.policy_visible(policy, F.col("states")).alias("visible"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 3 = 0 THEN false WHEN event_id % 2 = 0 THEN true ELSE user_id % 2 = 0 END AS visible FROM events""")
def ocg_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", R.group_state(e % 5 != 0, F.col("user_id") % 2 == 0, e % 2 == 0, e % 3 == 0).alias("visible"))


@query("SELECT o_orderkey, (o_orderkey // 64)::BIGINT AS parent, (o_orderkey // 4096)::BIGINT AS grandparent FROM orders")
def balanced_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.balanced_parents(i, 64, 1).alias("parent"), R.balanced_parents(i, 64, 2).alias("grandparent"))


@query("SELECT page_id, replace(replace(replace(coalesce(url, '') || ' \"<', ' ', '%20'), '\"', '%22'), '<', '%3C') AS uri FROM pages")
def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", R.percent_encoded(F.concat(F.coalesce("url", F.lit("")), F.lit(' "<'))).alias("uri"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.2 + pow(l_quantity / 50, 2) * 0.6, 6) AS tint,
  round(CASE WHEN l_discount < 0.04 THEN l_discount / 0.04 ELSE 1 - (l_discount - 0.04) / 0.96 END, 6) AS stitched FROM lineitem""")
def tint_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tint = shading.exponential(F.col("l_quantity") / 50, [0.2], [0.8], 2)[0]
    stitched = shading.stitching(F.col("l_discount"), [0.04], [(0.0, 1.0), (1.0, 0.0)], [lambda x: x, lambda x: x])
    return table(spark, sf_dir, "lineitem").select(*_KEY, r6(tint).alias("tint"), r6(stitched).alias("stitched"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 1) / 49 * 3 AS pos FROM lineitem),
k AS (SELECT *, least(floor(pos), 2)::INT AS lo FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((([0, 64, 200, 255])[lo + 1] + (([0, 64, 200, 255])[lo + 2] - ([0, 64, 200, 255])[lo + 1]) * (pos - lo)) / 255, 6) AS value FROM k""")
def sampled_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = shading.sampled(F.col("l_quantity"), [0, 64, 200, 255], domain=(1.0, 50.0))
    return table(spark, sf_dir, "lineitem").select(*_KEY, r6(value).alias("value"))


def _gradients(points: DataFrame) -> DataFrame:
    x, y = F.col("p_size") * 1.0, (F.col("p_partkey") % 50) * 1.0
    return points.select("p_partkey", r6(shading.axial_position(x, y, 0, 0, 3, 4)).alias("axial"), r6(shading.radial_position(x, y, (0, 0, 5), (0, 0, 100))).alias("radial"))


@query("""WITH d AS (SELECT p_partkey, p_size * 3.0 + (p_partkey % 50) * 4.0 AS along, p_size * p_size + (p_partkey % 50) * (p_partkey % 50) AS square FROM part)
SELECT p_partkey, round(along / 25, 6) AS axial, CASE WHEN square BETWEEN 25 AND 10000 THEN round((sqrt(square) - 5) / 95, 6) + 0.0 END AS radial FROM d""")
def gradient_positions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of every part; the radial one is null inside the start circle and outside the end circle, where nothing is painted without extension."""
    return _gradients(table(spark, sf_dir, "part"))


@query("""WITH c AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY 1 - ((n_nationkey % 5) / 5.0) * ((n_nationkey % 5) / 5.0), n_nationkey) - 1 AS rank, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT n_nationkey, ceil((rank + 1) * 65535 / n)::BIGINT AS threshold FROM c""")
def spot_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = spot("SimpleDot", (F.col("n_nationkey") % 5) / 5, F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(value, "n_nationkey")) - 1
    n = F.count("*").over(Window.partitionBy("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", shading.screen_threshold(rank, n).alias("threshold"))


@query("""SELECT event_id, (sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS depth,
  (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS text_object FROM events""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running depth of marked content and ordinal of text objects, by document order."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    return table(spark, sf_dir, "events").select("event_id", F.sum(step).over(order).alias("depth"), F.sum((F.col("event_type") == "click").cast("int")).over(order).alias("text_object"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS paeth
FROM (SELECT *, l_partkey % 256 AS a, l_suppkey % 256 AS b, l_orderkey % 256 AS c FROM lineitem)""")
def paeth_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.col(c) % 256
    return table(spark, sf_dir, "lineitem").select(*_KEY, shading.predictor_paeth(byte("l_partkey"), byte("l_suppkey"), byte("l_orderkey")).alias("paeth"))


@query("SELECT s_suppkey, ascii(substr(s_name, 1, 1)) // 16 AS high, ascii(substr(s_name, 1, 1)) % 16 AS low, ascii(substr(s_name, 2, 1)) // 64 AS two FROM supplier")
def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("s_name", "UTF-8")
    return table(spark, sf_dir, "supplier").select("s_suppkey", shading.packed_sample(data, F.lit(0), 4).alias("high"), shading.packed_sample(data, F.lit(1), 4).alias("low"), shading.packed_sample(data, F.lit(4), 2).alias("two"))


@query("""WITH v AS (SELECT p_partkey, (['XYZ','Fit','FitH','FitV','FitR','FitB','FitBH','FitBV'])[p_partkey % 8 + 1] AS mode, p_size * 3.0 AS l, p_size * 5.0 AS t FROM part),
b AS (SELECT *, CASE WHEN mode LIKE 'FitB%' THEN 20.0 WHEN mode = 'FitR' THEN l ELSE 0.0 END AS x0, CASE WHEN mode LIKE 'FitB%' THEN 30.0 WHEN mode = 'FitR' THEN t ELSE 0.0 END AS y0,
  CASE WHEN mode LIKE 'FitB%' THEN 520.0 WHEN mode = 'FitR' THEN l + 100 ELSE 600.0 END AS x1, CASE WHEN mode LIKE 'FitB%' THEN 700.0 WHEN mode = 'FitR' THEN t + 50 ELSE 800.0 END AS y1 FROM v),
z AS (SELECT *, least(300 / (x1 - x0), 400 / (y1 - y0)) AS fit FROM b)
SELECT p_partkey, mode, round(CASE WHEN mode IN ('XYZ', 'FitV', 'FitBV') THEN l WHEN mode IN ('FitH', 'FitBH') THEN x0 ELSE x0 + ((x1 - x0) - 300 / fit) / 2 END, 5) + 0.0 AS l,
  round(CASE WHEN mode IN ('XYZ', 'FitH', 'FitBH') THEN t WHEN mode IN ('FitV', 'FitBV') THEN y0 ELSE y0 + ((y1 - y0) - 400 / fit) / 2 END, 5) + 0.0 AS t,
  round(CASE WHEN mode = 'XYZ' THEN 1.5::DOUBLE WHEN mode IN ('FitH', 'FitBH') THEN 300 / (x1 - x0) WHEN mode IN ('FitV', 'FitBV') THEN 400 / (y1 - y0) ELSE fit END, 5) AS zoom FROM z""")
def destination_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.array(*map(F.lit, ("XYZ", "Fit", "FitH", "FitV", "FitR", "FitB", "FitBH", "FitBV")))
    number = lambda v: F.lit(float(v))
    left, top = F.col("p_size") * 3.0, F.col("p_size") * 5.0
    target = {"left": left, "top": top, "right": left + 100, "bottom": top + 50, "zoom": F.lit(None).cast("double")}
    page, content = tuple(map(number, (0, 0, 600, 800))), tuple(map(number, (20, 30, 520, 700)))
    parts = table(spark, sf_dir, "part").withColumn("mode", F.get(modes, (F.col("p_partkey") % 8).cast("int")))
    shown = views.view(F.col("mode"), target, page, content, number(300), number(400), {"left": number(0), "top": number(0), "zoom": number(1.5)})
    seen = parts.withColumn("v", shown)
    return seen.select("p_partkey", "mode", *[(F.round(F.col("v")[k], 5) + 0.0).alias(n) for k, n in (("left", "l"), ("top", "t"), ("zoom", "zoom"))])


@query("""WITH v AS (SELECT c_custkey, (c_custkey % 101)::DOUBLE AS l FROM customer), y AS (SELECT *, CASE WHEN (l + 16) / 116 >= 6.0::DOUBLE / 29 THEN pow((l + 16) / 116, 3) ELSE ((l + 16) / 116 - 4.0::DOUBLE / 29) * 108 / 841 END AS lum FROM v)
SELECT c_custkey, round(least(1.0, greatest(0.0, CASE WHEN lum <= 0.0031308 THEN 12.92 * lum ELSE 1.055 * pow(lum, 1 / 2.4::DOUBLE) - 0.055 END)), 3) AS gray FROM y""")
def lab_gray_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neutral axis of Lab, where all three components are the gamma-coded luminance."""
    rgb = views.lab((F.col("c_custkey") % 101) * 1.0, F.lit(0.0), F.lit(0.0), (0.95047, 1.0, 1.08883))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(rgb[1], 3).alias("gray"))
