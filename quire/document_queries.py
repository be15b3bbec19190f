"""Queries of the document tables over sample documents, one document a supplier, with their oracles.

Every document is written from a supplier's key and name (``quire.sources.samples``),
read back, and compared with what plain SQL says of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import calculator, labels
from quire.operators import relations as R
from quire.operators.appearances import drawn_annotations
from quire.plans.session import cut_lineage, spread
from quire.queries import ORACLES, QUERIES, query, r6, table
from quire.sources.pdf import fonts
from quire.sources.samples import sample_documents
from quire.sources.tables import edited, scan, scan_together

#: Pages of the structured samples: k is the key, i the page, n the pages of its document.
_PAGES = "WITH d AS (SELECT s_suppkey AS k, s_name AS s, s_suppkey % 4 + 1 AS n FROM supplier), p AS (SELECT *, unnest(range(n)) AS i FROM d)"


def _samples(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("name"))
    # every supplier is a document of its own, so few bytes are much work
    return sample_documents(spread(rows, rows=200), kind)


def _told(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(F.col("doc_id").alias("s_suppkey"), *columns)


def _shown(numbers: Column) -> Column:
    """Numbers without decimals, joined by spaces."""
    return F.array_join(F.transform(numbers, lambda x: x.cast("long").cast("string")), " ")


def _json(path: str, c: str = "style_json") -> Column:
    return F.get_json_object(c, path)


def _nth(*by: str) -> Column:
    """Ordinal of a mark among those of its kind."""
    return F.row_number().over(Window.partitionBy("doc_id").orderBy(*by)) - 1


@query(_PAGES + """SELECT k AS s_suppkey, i::INT AS page_index, '0 0 600 800' AS media, CASE WHEN i % 2 = 1 THEN '10 20 ' || (300 + k % 50) || ' 400' ELSE '0 0 600 800' END AS crop, (90 * (i // 2))::INT AS rotation FROM p""")
def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that pages inherit through two levels of the page tree."""
    return _told(scan(_samples(spark, sf_dir, "structured"), "pages", "FAILFAST"), "page_index", _shown(F.col("media_box")).alias("media"), _shown(F.col("crop_box")).alias("crop"), "rotation")


@query(_PAGES + """SELECT k AS s_suppkey, i::INT AS page_index, CASE i WHEN 0 THEN 'i' WHEN 1 THEN 'ii' ELSE 'p-' || (k % 7 + 1 + i - 2) END AS label FROM p""")
def sample_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label ranges joined with the pages they cover."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["pages", "page_label_ranges"], "FAILFAST")
    pages = held["pages"].select("doc_id", "page_index")
    known = R.in_range(pages, R.ranges_of(held["page_label_ranges"], ["doc_id"], "start"), ["doc_id"], "page_index", "start")
    return _told(known, "page_index", labels.page_label(F.col("style"), F.col("prefix"), F.col("first") + F.col("page_index") - F.col("start")).alias("label"))


@query(_PAGES + """, o AS (SELECT k, 0 AS ord, 0 AS level, s || ' one' AS title, true AS bold, k % 3 > 0 AS expanded, 0 AS page_index FROM d
UNION ALL SELECT k, c + 1, 1, 'child ' || c, false, false, 0 FROM (SELECT k, unnest(range(k % 3)) AS c FROM d)
UNION ALL SELECT k, k % 3 + 1, 0, 'two', false, false, n - 1 FROM d)
SELECT k AS s_suppkey, ord::INT AS ord, level::INT AS level, title, bold, expanded, page_index::INT AS page_index FROM o""")
def sample_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline items in order, their destinations joined with the pages."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["outlines", "pages"], "FAILFAST")
    target = held["outlines"].withColumn("num", F.regexp_extract("destination_json", r'^\[\{"\$r":\[(\d+)', 1).cast("long"))
    return _told(target.join(held["pages"].select("doc_id", "num", "page_index"), ["doc_id", "num"]), "ord", "level", "title", "bold", "expanded", "page_index")


@query(_PAGES + """SELECT k AS s_suppkey, 'string' AS kind, 'd' || i AS name, i::INT AS page_index, 'FitH' AS mode, (100 + i)::DOUBLE AS top FROM p UNION ALL SELECT k, 'name', 'old', 0, 'Fit', NULL FROM d""")
def sample_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named destinations of both kinds, the name tree split over two leaves."""
    found = scan(_samples(spark, sf_dir, "structured"), "named_destinations", "FAILFAST")
    return _told(found, "kind", F.col("name").cast("string").alias("name"), "page_index", "mode", F.get("parameters", F.lit(0)).alias("top"))


@query(_PAGES + """SELECT k AS s_suppkey, (['A', 'X', 'H1', 'B'])[i + 1] AS tag, (['P', 'X', 'H1', 'P'])[i + 1] AS type, (['P', NULL, 'H1', 'P'])[i + 1] AS resolved, i AS mcid, (20 + i)::BIGINT AS page_num, 'id' || i AS id FROM p""")
def sample_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure elements with their content, parent tree and identifiers; roles by the scan and by joins (a cycle has no answer)."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["structure_items", "structure_parents", "structure_ids", "objects"], "FAILFAST")
    items = held["structure_items"]
    elements = items.where("tag IS NOT NULL").select("doc_id", "num", "tag", "type", "page_num")
    content = items.where("type = 'MCID'").select("doc_id", F.col("parent_num").alias("num"), "mcid")
    parents = held["structure_parents"].select("doc_id", F.col("key").alias("mcid"), F.col("element_num").alias("num"))
    ids = held["structure_ids"].select("doc_id", F.col("element_num").alias("num"), F.col("id").cast("string").alias("id"))
    roles = F.from_json(F.regexp_extract("value_json", r'"RoleMap":(\{(?:[^{}]|\{[^{}]*\})*\})', 1), "map<string,map<string,string>>")
    mapping = held["objects"].where("type = 'StructTreeRoot'").select(F.explode(roles).alias("role", "to")).select("role", F.col("to")["$n"].alias("to")).distinct()
    tags = elements.select("tag").distinct().select("tag", F.col("tag").alias("start"))
    resolved = R.resolved_chain(tags, "tag", "start", mapping, "role", "to")
    return _told(elements.join(content, ["doc_id", "num"]).join(parents, ["doc_id", "num", "mcid"]).join(ids, ["doc_id", "num"]).join(resolved, "tag"), "tag", "type", "resolved", "mcid", "page_num", "id")


@query(_PAGES + """SELECT k AS s_suppkey, i::INT AS page_index, j::INT AS index, (['Text', 'Popup'])[j + 1] AS subtype, 'note ' || i AS contents, CASE j WHEN 0 THEN i ELSE 0 END AS flags FROM p, range(2) r(j)""")
def sample_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations; a popup shows its parent's text, not its own."""
    return _told(scan(_samples(spark, sf_dir, "structured"), "annotations", "FAILFAST"), "page_index", "index", "subtype", "contents", "flags")


@query("""SELECT s_suppkey, 'form.first' AS name, 'Tx' AS type, s_name AS value, s_suppkey % 8 AS flags FROM supplier UNION ALL SELECT s_suppkey, 'form.second', 'Ch', NULL, 1 FROM supplier""")
def sample_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields with inherited types and flags and full names."""
    return _told(scan(_samples(spark, sf_dir, "structured"), "fields", "FAILFAST"), "name", "type", "value", "flags")


@query(_PAGES + """SELECT k AS s_suppkey, 'open' AS source, i::INT AS ord, (['URI', 'GoTo', 'Named'])[i + 1] AS type, CASE i WHEN 0 THEN 'http://x/' || k END AS uri FROM d, range(3) r(i)
UNION ALL SELECT k, 'outline ' || (k % 3 + 1), 0, 'GoTo', NULL FROM d""")
def sample_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of actions with a shared branch and a cycle; each action once."""
    return _told(scan(_samples(spark, sf_dir, "structured"), "actions", "FAILFAST"), "source", "ord", "type", "uri")


@query("""SELECT s_suppkey, s_name || '.txt' AS file_name, 'd' AS description, sha256(s_name) AS sha256, s_name || ' title' AS title, 'own' AS custom, (s_suppkey % 4 + 1)::INT AS n_pages,
  sha256('<x>' || s_suppkey || '</x>') AS metadata, 'C' || (s_suppkey % 5) AS intent, 4 AS components FROM supplier""")
def sample_document_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information, metadata, output intents and attachments, joined by document."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["documents", "metadata", "output_intents", "embedded_files", "streams"], "FAILFAST")
    files = held["embedded_files"].join(held["streams"].select("doc_id", F.col("num").alias("stream_num"), "sha256"), ["doc_id", "stream_num"])
    own = held["documents"].select("doc_id", "title", F.col("custom")["Custom"].alias("custom"), "n_pages")
    meta = held["metadata"].select("doc_id", F.col("sha256").alias("metadata"))
    intents = held["output_intents"].select("doc_id", F.col("identifier").alias("intent"), "components")
    return _told(files.join(own, "doc_id").join(meta, "doc_id").join(intents, "doc_id"), "file_name", "description", "sha256", "title", "custom", "n_pages", "metadata", "intent", "components")


@query("""SELECT s_suppkey, unnest([8, 9] || CASE s_suppkey % 2 WHEN 1 THEN [96] ELSE [] END)::BIGINT AS num FROM supplier""")
def sample_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the trailer does not lead to: two lost ones, and the cross-reference stream where there is one."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["objects", "object_refs"], "FAILFAST")
    refs = held["object_refs"]
    edges = refs.where("src_num > 0").select("doc_id", F.col("src_num").alias("src"), F.col("dst_num").alias("dst"))
    reached = R.reachable(edges, refs.where("src_num = 0").select("doc_id", F.col("dst_num").alias("num")))
    return _told(held["objects"].select("doc_id", "num").join(reached, ["doc_id", "num"], "left_anti"), "num")


@query(_PAGES + """SELECT k AS s_suppkey, 20 + i AS num, 3 + (i = 0)::BIGINT + (i = n - 1)::BIGINT AS n_refs FROM p""")
def sample_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each page is referred to: by its node, its element, its name, and by outlines and old names."""
    refs = scan(_samples(spark, sf_dir, "structured"), "object_refs", "FAILFAST")
    return _told(R.reference_counts(refs.where("dst_num BETWEEN 20 AND 23"), ["doc_id", "dst_num"]), F.col("dst_num").alias("num"), "n_refs")


@query("""SELECT s_suppkey, s_name || ' ' || (s_suppkey % 3) AS title, s_suppkey % 3 + 1 AS n_revisions, (s_suppkey % 3 > 0)::BIGINT AS n_changed, 6::BIGINT AS n_entries FROM supplier""")
def sample_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the newest revision that names them; the title is the last one's."""
    held = scan_together(_samples(spark, sf_dir, "revised"), ["documents", "xref"], "FAILFAST")
    newest = R.newest_entries(held["xref"].where("kind = 1"), ["doc_id", "num"], F.col("rev"))
    last = held["xref"].groupBy("doc_id").agg((F.max("rev") + 1).cast("long").alias("n_revisions"))
    # of more than one revision, only the title's object is newer than the first
    counts = newest.join(last, "doc_id").groupBy("doc_id", "n_revisions").agg(F.count_if(F.expr("rev < n_revisions - 1")).alias("n_changed"), F.count("*").alias("n_entries"))
    return _told(counts.join(held["documents"].select("doc_id", "title"), "doc_id"), "title", "n_revisions", "n_changed", "n_entries")


@query("""SELECT s_suppkey, s_name AS text, s_suppkey % 4 < 3 AS told FROM supplier""")
def sample_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut short or shifted, read leniently, with what was told of them."""
    held = scan_together(_samples(spark, sf_dir, "damaged"), ["text_marks", "diagnostics", "documents"])
    notes = held["diagnostics"].groupBy("doc_id").count()
    known = held["documents"].select("doc_id").join(held["text_marks"].select("doc_id", "text"), "doc_id", "left").join(notes, "doc_id", "left")
    return _told(known, "text", F.col("count").isNotNull().alias("told"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 10 AS k FROM supplier),
m(nth, ops, fill, stroke, even_odd, a, b) AS (VALUES (0, 'MLCCCZ', false, true, false, 128, 11), (1, 'MLLLZ', true, false, true, 42, 4), (2, 'MLZ', false, true, false, 10, 0), (3, 'MLZ', true, true, false, 10, 0),
  (4, 'MLZ', true, true, true, 10, 0), (5, 'ML', true, true, false, 10, 0), (6, 'ML', true, true, true, 10, 0), (7, 'ML', true, false, false, 10, 0), (8, 'MLLLZ', false, true, false, 4, 0), (9, 'MLLLZ', true, true, false, 4, 0),
  (10, 'MLLLZ', true, false, false, 4, 0), (11, 'MLLLZ', true, false, false, 4, 0), (12, 'MLLLZ', true, false, false, 4, 0), (13, 'MLLLZ', true, false, false, 4, 0), (14, 'MLLLZ', true, false, false, 4, 0),
  (15, 'MLLLZ', true, false, false, 4, 0), (16, 'MLLLZ', true, false, false, 4, 0), (17, 'MLLLZ', true, false, false, 4, 0), (18, 'MLLLZ', true, false, false, 4, 0), (19, 'MLLLZ', true, false, false, 4, 0), (20, 'ML', false, true, false, 4, 0))
SELECT s_suppkey, nth::INT AS nth, ops, fill, stroke, even_odd, (a + b * k)::DOUBLE AS total FROM s, m""")
def sample_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path construction and painting operator under matrices and in a form; what a separation named None fills is absent."""
    marks = scan(_samples(spark, sf_dir, "graphic"), "path_marks", "FAILFAST")
    ops = F.array_join(F.transform("segments", lambda s: s["op"]), "")
    total = F.aggregate(F.flatten(F.transform("segments", lambda s: s["points"])), F.lit(0.0), lambda a, x: a + x)
    return _told(marks, _nth("ord").alias("nth"), ops.alias("ops"), "fill", "stroke", "even_odd", r6(total).alias("total"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS f FROM supplier),
m AS (SELECT s_suppkey, f, i FROM s, range(21) r(i))
SELECT s_suppkey, i::INT AS nth,
  round((CASE i WHEN 10 THEN 0.25 WHEN 11 THEN 1 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 14 THEN 1 WHEN 15 THEN 60 * f / 255.0 WHEN 16 THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS red,
  round((CASE i WHEN 10 THEN 0.25 WHEN 11 THEN 0 WHEN 12 THEN 0.5 WHEN 13 THEN 0 WHEN 14 THEN 0.5 WHEN 15 THEN (60 * f + 20) / 255.0 WHEN 16 THEN 0.25 ELSE 0 END)::DOUBLE, 6) AS green,
  round((CASE i WHEN 10 THEN 0.25 WHEN 11 THEN 0.5 WHEN 12 THEN 0 WHEN 13 THEN 0.5 WHEN 14 THEN 0.75 WHEN 15 THEN (60 * f + 40) / 255.0 WHEN 16 THEN 1 ELSE 0 END)::DOUBLE, 6) AS blue FROM m""")
def sample_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills in gray, RGB, CMYK, a separation, a palette and a profile's space."""
    marks = scan(_samples(spark, sf_dir, "graphic"), "path_marks", "FAILFAST")
    return _told(marks, _nth("ord").alias("nth"), *[r6(F.get("fill_rgb", F.lit(i))).alias(n) for i, n in enumerate(("red", "green", "blue"))])


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 10 AS k FROM supplier)
SELECT s_suppkey, 8 AS nth, k::DOUBLE AS line_width, '1' AS cap, '2' AS line_join, '5' AS miter, '[[' || (k + 1) || '.0,3.0],0.0]' AS dash, 'Saturation' AS intent, k::DOUBLE AS flatness, '1.0' AS fill_alpha, '1.0' AS stroke_alpha, 'Normal' AS blend,
  NULL AS stroke_adjust, NULL AS overprint_fill, NULL AS overprint_stroke, NULL AS overprint_mode, NULL AS smoothness, NULL AS text_knockout, NULL AS alpha_is_shape FROM s
UNION ALL SELECT s_suppkey, 9, k, '0', '0', '10.0', '[[' || (k + 1) || '.0,2.0],1.0]', 'Perceptual', k, '0.5', '0.25', 'Multiply', 'true', 'true', 'true', '1', '0.5', 'false', 'true' FROM s""")
def sample_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line styles, dashes, intents and flatness by operator (mark 8) and the keys of a graphics state dictionary (mark 9)."""
    marks = scan(_samples(spark, sf_dir, "graphic"), "path_marks", "FAILFAST").withColumn("nth", _nth("ord")).where("nth IN (8, 9)")
    plain = {"cap": "cap", "join": "line_join", "miter": "miter", "dash": "dash", "intent": "intent", "fill_alpha": "fill_alpha", "stroke_alpha": "stroke_alpha", "blend": "blend"}
    plain |= {k: k for k in ("stroke_adjust", "overprint_fill", "overprint_stroke", "overprint_mode", "smoothness", "text_knockout", "alpha_is_shape")}
    return _told(marks, "nth", _json("$.line_width").cast("double").alias("line_width"), *[_json(f"$.{k}").alias(n) for k, n in plain.items()], _json("$.flatness").cast("double").alias("flatness"))


@query("""SELECT s_suppkey, c::INT AS nth, (['MLLLZ', 'MLLLZ'])[c + 1] AS ops, c = 1 AS even_odd, ([200, 160])[c + 1]::DOUBLE AS total, 1::BIGINT AS n_marks FROM supplier, range(2) r(c)""")
def sample_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip paths joined with the marks that they clip."""
    held = scan_together(_samples(spark, sf_dir, "graphic"), ["path_marks", "clip_paths"], "FAILFAST")
    used = held["path_marks"].select("doc_id", F.explode("clips").alias("ord")).groupBy("doc_id", "ord").agg(F.count("*").alias("n_marks"))
    ops = F.array_join(F.transform("segments", lambda s: s["op"]), "")
    total = F.aggregate(F.flatten(F.transform("segments", lambda s: s["points"])), F.lit(0.0), lambda a, x: a + x)
    clips = held["clip_paths"].withColumn("nth", _nth("ord")).withColumns({"ops": ops, "total": total})
    return _told(clips.join(used, ["doc_id", "ord"]), "nth", "ops", "even_odd", "total", "n_marks")


@query("""WITH m(nth, operator, tag, depth) AS (VALUES (0, 'BMC', 'Span', 1), (1, 'BDC', 'T', 2), (2, 'EMC', 'T', 1), (3, 'EMC', 'Span', 0), (4, 'MP', 'MP0', 0))
SELECT s_suppkey, nth::INT AS nth, operator, tag, depth::INT AS depth, CASE nth WHEN 1 THEN s_suppkey % 10 END AS mcid FROM supplier, m""")
def sample_marked_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked content with its depth; the path inside carries the identifier of its properties."""
    held = scan_together(_samples(spark, sf_dir, "graphic"), ["marked_content", "path_marks"], "FAILFAST")
    inside = held["path_marks"].where("mcid IS NOT NULL").select("doc_id", "mcid", (F.col("ord") - 1).alias("ord"))
    return _told(held["marked_content"].withColumn("nth", _nth("ord")).join(inside, ["doc_id", "ord"], "left"), "nth", "operator", "tag", "depth", "mcid")


@query("""SELECT s_suppkey, 'X' AS kind, 10::BIGINT AS num, NULL::BIGINT AS width, '2 0 0 2 0 0' AS matrix FROM supplier
UNION ALL SELECT s_suppkey, 'Y', 11, s_suppkey % 10 + 1, '1 0 0 1 0 0' FROM supplier UNION ALL SELECT s_suppkey, 'BI', NULL, 2, '1 0 0 1 0 0' FROM supplier""")
def sample_external_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form, an image and an inline image, as they are placed."""
    held = scan_together(_samples(spark, sf_dir, "graphic"), ["group_marks", "image_marks"], "FAILFAST")
    forms = held["group_marks"].select("doc_id", F.lit("X").alias("kind"), F.col("form_num").alias("num"), F.lit(None).cast("long").alias("width"), "matrix")
    images = held["image_marks"].select("doc_id", F.when(F.col("image_num").isNull(), "BI").otherwise("Y").alias("kind"), F.col("image_num").alias("num"), "width", "matrix")
    return _told(forms.union(images), "kind", "num", "width", _shown(F.col("matrix")).alias("matrix"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 10 AS k FROM supplier),
m(nth, text, x0, xk, y0, yk, l0, lk) AS (VALUES (0, 'ab', 0, 1, 0, 2, 6, 0), (1, 'a b', 0, 0, 0, 0, 12, 4), (2, 'ab', 0, 0, 0, 0, 3, 0), (3, 'c', 6, 0, 0, 0, 0, 0), (4, 'a', 5, 0, 100, 0, 0, 0), (5, 'b', 5, 0, 88, 0, 0, 0), (6, 'c', 5, 0, 76, 0, 0, 0),
  (7, 'd', 5, 0, 64, 0, 0, 0), (8, 'e', 7, 0, -1, -1, 0, 0), (9, 'f', 7, 0, -2, -2, 0, 0), (10, 'g', 0, 0, 0, 1, 0, 0), (11, 'hi', 6, 0, 0, 0, 6, 1), (12, 'j', 1, 0, 1, 0, 0, 0), (13, 'k', 0, 0, 0, 0, 0, 0))
SELECT s_suppkey, nth::INT AS nth, text, (x0 + xk * k)::DOUBLE AS x, (y0 + yk * k)::DOUBLE AS y, (l0 + lk * k)::DOUBLE AS last_x, CASE nth WHEN 12 THEN 3 ELSE 0 END AS mode, CASE nth WHEN 12 THEN 2.0::DOUBLE ELSE 1.0 END AS scale,
  CASE nth WHEN 13 THEN 'real' END AS replacement, CASE nth WHEN 13 THEN k END AS mcid FROM s, m""")
def sample_text_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text operator: where each string begins and its last glyph stands."""
    held = scan_together(_samples(spark, sf_dir, "typeset"), ["text_marks", "glyphs"], "FAILFAST")
    last = held["glyphs"].groupBy("doc_id", "ord").agg(F.max_by("x", "i").alias("last_x"))
    marks = held["text_marks"].withColumn("nth", _nth("ord")).join(last, ["doc_id", "ord"])
    at = lambda i: r6(F.get("matrix", F.lit(i)))
    return _told(marks, "nth", "text", at(4).alias("x"), at(5).alias("y"), r6(F.col("last_x")).alias("last_x"), "mode", at(0).alias("scale"), "replacement", "mcid")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS a, s_suppkey % 3 <> 0 AS b FROM supplier),
v AS (SELECT s_suppkey, unnest(range(10, 17)) AS g, unnest([a, b, a OR b, a AND b, NOT (a AND b), NOT (a OR b), a AND NOT b]) AS shown FROM s) SELECT s_suppkey, 'g' || g AS text FROM v WHERE shown""")
def sample_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that optional groups, membership policies and an expression leave visible."""
    return _told(scan(_samples(spark, sf_dir, "layered"), "text_marks", "FAILFAST"), "text")


@query("""WITH s AS (SELECT s_suppkey, rpad(repeat(s_name, 50), ((length(s_name) * 50 + 7) // 8 * 8)::INT, ' ') AS data FROM supplier)
SELECT s_suppkey, unnest([10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 25, 26, 27, 30, 31])::BIGINT AS num, sha256(data) AS sha256 FROM s""")
def sample_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams through every chain of filters and every predictor."""
    return _told(scan(_samples(spark, sf_dir, "filtered"), "streams", "FAILFAST").where("num >= 10"), "num", "sha256")


@query("""SELECT s_suppkey, n::BIGINT AS num, CASE n WHEN 30 THEN 10 ELSE n END::BIGINT AS canonical FROM supplier, (SELECT unnest([4, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 25, 26, 27, 30, 31]) AS n)""")
def sample_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal streams of a document; one that the structure refers to is kept apart."""
    streams = scan(_samples(spark, sf_dir, "filtered"), "streams", "FAILFAST")
    own = F.when(F.col("dict_json").rlike('"(StructParents?|ID|OPI|F|Ref)":'), F.col("num")).otherwise(-1)
    # the keys are read more than once, the documents only here
    keyed = cut_lineage(streams.select("doc_id", "num", "dict_json", F.sha2("raw", 256).alias("content"), own.alias("own")))
    return _told(R.canonical(keyed, ["doc_id", "dict_json", "content", "own"], "num"), "num", "canonical")


@query("""SELECT s_suppkey, s_name AS text, s_name AS title, true AS encrypted, ([3, 4, 5])[s_suppkey % 3 + 1]::INT AS revision, false AS owner, -4::BIGINT AS permissions FROM supplier""")
def sample_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RC4, AES-128 and AES-256, opened with the user's password."""
    held = scan_together(_samples(spark, sf_dir, "sealed"), ["documents", "text_marks"], "FAILFAST", "open")
    return _told(held["documents"].join(held["text_marks"].select("doc_id", "text"), "doc_id"), "text", "title", "encrypted", "revision", "owner", "permissions")


_FACES = {
    "Helvetica": fonts.HELVETICA, "Helvetica-Bold": fonts.HELVETICA_BOLD, "Times-Roman": fonts.TIMES, "Times-Bold": fonts.TIMES_BOLD, "Times-Italic": fonts.TIMES_ITALIC, "Times-BoldItalic": fonts.TIMES_BOLD_ITALIC, "Courier": (600,) * 95,
}


@query("WITH w AS (SELECT font, chr(31 + g::INT) AS c, widths[g] AS width FROM (VALUES " + ", ".join(f"('{f}', {list(w)})" for f, w in _FACES.items()) + """) v(font, widths), range(1, 96) r(g)),
g AS (SELECT s_suppkey, unnest(string_split(s_name, '')) AS c FROM supplier)
SELECT s_suppkey, font, round(sum(width) / 1000, 6) AS advance FROM g JOIN w USING (c) GROUP BY s_suppkey, font""")
def sample_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advances in the standard text faces."""
    held = scan_together(_samples(spark, sf_dir, "faced"), ["text_marks", "glyphs"], "FAILFAST")
    sums = held["glyphs"].groupBy("doc_id", "ord").agg(r6(F.sum("width")).alias("advance"))
    return _told(held["text_marks"].join(sums, ["doc_id", "ord"]), "font", "advance")


@query("""WITH a(i, subtype, standard, stream) AS (VALUES (0, 'Text', true, true), (1, 'Own', false, false), (2, 'Square', true, false), (3, 'Link', true, true), (4, 'Widget', true, true))
SELECT s_suppkey, i::INT AS index, subtype, standard, CASE i WHEN 1 THEN s_suppkey % 2 = 0 WHEN 2 THEN false WHEN 3 THEN s_suppkey % 3 <> 0 ELSE true END AS drawn,
  CASE i WHEN 4 THEN CASE s_suppkey % 2 WHEN 1 THEN 'On' ELSE 'Off' END END AS state, CASE i WHEN 0 THEN 20 WHEN 3 THEN 21 WHEN 4 THEN 21 - s_suppkey % 2 END::BIGINT AS stream_num,
  CASE i WHEN 0 THEN round((20 + s_suppkey % 10) / 20.0::DOUBLE, 6) WHEN 3 THEN 1.0 WHEN 4 THEN 2.0 END AS x_scale, CASE i WHEN 0 THEN round(100 + (20 + s_suppkey % 10)::DOUBLE, 6) WHEN 3 THEN 20.0 WHEN 4 THEN 40.0 END AS x_move FROM supplier, a""")
def sample_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which annotations are drawn, and where their stored appearances, turned by 90 degrees, are put."""
    held = scan_together(_samples(spark, sf_dir, "annotated"), ["annotations", "appearances", "objects"], "FAILFAST")
    looks = held["appearances"].select("doc_id", "index", "state", "stream_num", "matrix", "visible")
    known = held["annotations"].join(looks, ["doc_id", "index"], "left")
    drawn = R.annotation_drawn(F.col("subtype"), F.col("flags"), F.col("rect"), F.coalesce("visible", F.lit(True)))
    at = lambda i: r6(F.get("matrix", F.lit(i)))
    return _told(known, "index", "subtype", R.is_standard(F.col("subtype")).alias("standard"), drawn.alias("drawn"), "state", "stream_num", at(0).alias("x_scale"), at(4).alias("x_move"))


@query(_PAGES + """SELECT k AS s_suppkey, i::INT AS page_index, CASE i WHEN 0 THEN s || ' read' ELSE s || ' ' || i END AS text, s || ' new' AS title, 'A' || (i + 5) AS label, n AS n_files FROM p""")
def sample_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten with edits that come as rows: a title, attachments, page labels, the text that a text object stands for, and keys left out."""
    files = _samples(spark, sf_dir, "structured")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("s"), (F.col("s_suppkey") % 4 + 1).alias("n"))
    edit = lambda kind, page, index, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(page).alias("page"), F.lit(index).alias("index"), F.lit(name).cast("string").alias("name"), value.cast("string").alias("value"))
    fixed = [edit("info", 0, 0, "Title", F.concat("s", F.lit(" new"))), edit("label", 0, 5, "D", F.lit("A")), edit("text", 0, 0, None, F.concat("s", F.lit(" read"))), edit("drop", 0, 0, "OpenAction", F.lit(None))]
    files_added = rows.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).select("doc_id", F.lit("attachment").alias("kind"), F.lit(0).alias("page"), F.lit(0).alias("index"), F.concat(F.lit("f"), "i").alias("name"), F.col("i").cast("string").alias("value"))
    edits = rows.select("doc_id", F.explode(F.array(*fixed)).alias("e")).select("doc_id", "e.*").unionByName(files_added)
    held = scan_together(edited(files, edits), ["documents", "pages", "page_label_ranges", "text_marks", "embedded_files", "actions"], "FAILFAST")
    known = R.in_range(held["pages"].select("doc_id", "page_index"), R.ranges_of(held["page_label_ranges"], ["doc_id"], "start"), ["doc_id"], "page_index", "start")
    label = labels.page_label(F.col("style"), F.col("prefix"), F.col("first") + F.col("page_index") - F.col("start"))
    count = held["embedded_files"].groupBy("doc_id").agg(F.count("*").alias("n_files"))
    texts = held["text_marks"].select("doc_id", "page_index", F.coalesce("replacement", "text").alias("text"))
    opened = held["actions"].where("source = 'open'").select("doc_id")
    out = texts.join(known.withColumn("label", label).select("doc_id", "page_index", "label"), ["doc_id", "page_index"]).join(held["documents"].select("doc_id", "title"), "doc_id").join(count, "doc_id")
    return _told(out.join(opened, "doc_id", "left_anti"), "page_index", "text", "title", "label", "n_files")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 10 AS k FROM supplier),
m(i, part, ops, fill, stroke, w0, wk, a, b) AS (VALUES (0, 0, 'MLLLZ', false, true, 0, 1, 300, 0), (1, 0, 'ML', false, true, 2, 0, 102, 0), (2, 0, 'MLLLZ', true, true, 4, 0, 300, 0), (3, 0, 'MCCCCZ', true, false, 0, 0, 1025, 0), (4, 0, 'MLLZ', false, true, 1, 0, 5, 2), (5, 0, 'ML', false, true, 1, 0, 5, 1),
  (6, 0, 'ML', false, true, 1, 0, 6, 1), (7, 0, 'MLL', false, true, 1, 0, 9, 1), (7, 1, 'ML', false, true, 1, 0, 18, 0), (8, 0, 'MLLLZ', true, false, NULL, NULL, 264, 4), (9, 0, 'ML', false, true, 1, 0, 120, 2), (10, 0, 'ML', false, true, 1, 0, 132, 2), (10, 1, 'ML', false, true, 1, 0, 132, 2),
  (11, 0, 'M' || repeat('L', 40), false, true, 1, 0, 41 * 60 + 40, 41))
SELECT s_suppkey, i::INT AS index, part::INT AS part, ops, fill, stroke, (w0 + wk * k)::DOUBLE AS width, (a + b * k)::DOUBLE AS total FROM s, m WHERE NOT (i = 0 AND k = 0)""")
def sample_drawn_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of annotations without an appearance of their own, by column expressions."""
    found = drawn_annotations(scan(_samples(spark, sf_dir, "drawn"), "annotations", "FAILFAST"))
    ops = F.array_join(F.transform("segments", lambda s: s["op"]), "")
    total = F.aggregate(F.flatten(F.transform("segments", lambda s: s["points"])), F.lit(0.0), lambda a, x: a + x)
    return _told(found, "index", "part", ops.alias("ops"), "fill", "stroke", "width", r6(total).alias("total"))


@query("""WITH f AS (SELECT unnest(['Helvetica', 'Helvetica-Bold', 'Times-Roman', 'Times-Bold', 'Times-Italic', 'Times-BoldItalic', 'Courier']) AS font), c AS (SELECT s_suppkey, ord(unnest(string_split(s_name, ''))) AS c FROM supplier)
SELECT s_suppkey, font, list_aggregate(list_sort(list(DISTINCT c)), 'string_agg', ' ') AS codes FROM c, f GROUP BY s_suppkey, font""")
def sample_glyph_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct codes that each font of a document shows, in order."""
    held = scan_together(_samples(spark, sf_dir, "faced"), ["text_marks", "glyphs"], "FAILFAST")
    # a mark's codes become one row where they are read; a join by size on disk would send all glyphs to the driver
    shown = held["glyphs"].groupBy("doc_id", "page_index", "ord").agg(F.collect_set("code").alias("shown"))
    used = held["text_marks"].select("doc_id", "page_index", "ord", "font").join(shown.hint("merge"), ["doc_id", "page_index", "ord"]).select("doc_id", "font", F.explode("shown").alias("code"))
    return _told(used.groupBy("doc_id", "font").agg(F.array_join(F.transform(F.array_sort(F.collect_set("code")), lambda c: c.cast("string")), " ").alias("codes")), "font", "codes")


@query("SELECT s_suppkey, 8::BIGINT AS n_objects, 1::BIGINT AS n_joined, 1::BIGINT AS depth FROM supplier")
def sample_text_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text objects numbered by a running sum, places where one could be joined to the next by a look ahead, and the depth of marked content."""
    ops = scan(_samples(spark, sf_dir, "typeset"), "operations", "FAILFAST")
    order = Window.partitionBy("doc_id", "page_index").orderBy("ord")
    ahead = lambda n: F.lead("operator", n).over(order)
    nth = F.sum((F.col("operator") == "BT").cast("long")).over(order)
    depth = F.sum(F.when(F.col("operator").isin("BMC", "BDC"), 1).when(F.col("operator") == "EMC", -1).otherwise(0)).over(order)
    joined = ((F.col("operator") == "ET") & (ahead(1) == "BT") & (ahead(2) == "Tm")).cast("long")
    seen = ops.withColumns({"nth": nth, "joined": joined, "depth": depth})
    return _told(seen.groupBy("doc_id").agg(F.max("nth").alias("n_objects"), F.sum("joined").alias("n_joined"), F.max("depth").alias("depth")), "n_objects", "n_joined", "depth")


@query(_PAGES + "SELECT k AS s_suppkey, 0::BIGINT AS n_wrong, n + CASE WHEN n > 2 THEN 2 ELSE 1 END AS n_keys, n AS n_matching FROM d")
def sample_trees_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number trees whose keys rise, and structure identifiers that their elements bear."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["number_tree", "structure_ids", "objects"], "FAILFAST")
    keys = held["number_tree"].groupBy("doc_id").agg(F.count("*").alias("n_keys"))
    wrong = R.out_of_order(held["number_tree"], ["doc_id", "tree"], "ord", "key").groupBy("doc_id").agg(F.count("*").alias("n_wrong"))
    own = held["objects"].where("type = 'StructElem'").select("doc_id", F.col("num").alias("element_num"), F.unhex(_json("$.ID.$s", "value_json")).alias("own"))
    same = held["structure_ids"].join(own, ["doc_id", "element_num"]).where(F.col("id") == F.col("own")).groupBy("doc_id").agg(F.count("*").alias("n_matching"))
    return _told(keys.join(wrong, "doc_id", "left").join(same, "doc_id"), F.coalesce("n_wrong", F.lit(0).cast("long")).alias("n_wrong"), "n_keys", "n_matching")


@query(_PAGES + "SELECT k AS s_suppkey, i::INT AS page_index, (90 * (i // 2))::INT AS rotation, '0 800 600 0' AS media FROM p")
def sample_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page attributes by joins over the objects: the nearest ancestor's value, skipping by doubling."""
    held = scan_together(_samples(spark, sf_dir, "structured"), ["objects", "pages"], "FAILFAST")
    nodes = held["objects"].where("type IN ('Page', 'Pages')")
    tree = nodes.select("doc_id", "num", F.regexp_extract("value_json", r'"Parent":\{"\$r":\[(\d+)', 1).alias("p"), _json("$.Rotate", "value_json").cast("int").alias("rotation"), _json("$.MediaBox", "value_json").alias("media"))
    tree = cut_lineage(tree.withColumn("parent", F.when(F.col("p") != "", F.col("p").cast("long"))))
    turned, boxed = (R.inherited(tree.select("doc_id", "num", "parent", c), c) for c in ("rotation", "media"))
    known = held["pages"].select("doc_id", "num", "page_index").join(turned, ["doc_id", "num"]).join(boxed, ["doc_id", "num"])
    return _told(known, "page_index", "rotation", F.regexp_replace(F.regexp_replace("media", r"[\[\]]", ""), ",", " ").alias("media"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 10 AS k FROM supplier),
m(nth, type, space) AS (VALUES (0, 1, 'DeviceGray'), (1, 2, 'DeviceRGB'), (2, 3, 'DeviceRGB'), (3, 4, 'DeviceGray'), (4, 5, 'DeviceGray'), (5, 6, 'DeviceGray'), (6, 7, 'DeviceGray'), (7, 2, 'DeviceRGB'))
SELECT s_suppkey, nth::INT AS nth, type::INT AS type, space AS color_space, CASE nth WHEN 1 THEN k + 1 WHEN 2 THEN 12 + k WHEN 7 THEN k + 1 END::DOUBLE AS coords,
  CASE WHEN type IN (2, 3) THEN round(k / 20.0::DOUBLE, 6) END AS blue, CASE type WHEN 4 THEN 3 * (k + 21) WHEN 5 THEN 4 * k WHEN 6 THEN 24 * k + 2 WHEN 7 THEN 32 * k + 2 END::DOUBLE AS vertices,
  CASE nth WHEN 7 THEN 2.0::DOUBLE ELSE 1 END AS scale, type = 2 AS extends FROM s, m""")
def sample_shadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadings of every type, by operator and by pattern: geometry, colours half way, mesh data (flags, points and colours summed)."""
    marks = scan(_samples(spark, sf_dir, "patterned"), "shading_marks", "FAILFAST")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    summed = F.when(F.col("type") == 4, total(F.flatten(F.transform("vertices", lambda v: F.slice(v, 2, 3))))).when(F.col("type") == 5, total(F.flatten(F.transform("vertices", lambda v: F.slice(v, 2, 1))))).otherwise(total(F.flatten("vertices")))
    return _told(marks, _nth("ord").alias("nth"), "type", "color_space", total(F.col("coords")).alias("coords"), r6(F.get(F.get("colors", F.lit(2)), F.lit(2))).alias("blue"), r6(summed).alias("vertices"), F.get("matrix", F.lit(0)).alias("scale"), F.get("extend", F.lit(0)).alias("extends"))


@query("""SELECT s_suppkey, 1 AS type, 2 AS paint_type, (s_suppkey % 10 + 5)::DOUBLE AS x_step, 6.0::DOUBLE AS y_step, 0.25::DOUBLE AS color FROM supplier UNION ALL SELECT s_suppkey, 2, NULL, NULL, NULL, NULL FROM supplier""")
def sample_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiling and shading patterns as they are set."""
    return _told(scan(_samples(spark, sf_dir, "patterned"), "pattern_marks", "FAILFAST"), "type", "paint_type", "x_step", "y_step", F.get("colors", F.lit(0)).alias("color"))


@query("""WITH m(i, dx, size, green, blue) AS (VALUES (0, 0.0, 4.0, 1.0, 0.0), (1, 5.0, 4.0, 1.0, 0.0), (2, 10.0, 1.0, 0.0, 1.0))
SELECT s_suppkey, i::INT AS nth, (s_suppkey % 10 + dx)::DOUBLE AS x, size::DOUBLE AS size, green::DOUBLE AS green, blue::DOUBLE AS blue FROM supplier, m""")
def sample_drawn_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the glyphs of a Type 3 font draw: uncoloured ones in the text's colour, coloured ones in their own."""
    marks = scan(_samples(spark, sf_dir, "patterned"), "path_marks", "FAILFAST").where("size(segments) > 0").withColumn("n", _nth("ord")).where("n >= 2")
    first, second = F.col("segments")[0]["points"], F.col("segments")[1]["points"]
    return _told(marks, (F.col("n") - 2).alias("nth"), r6(first[0]).alias("x"), r6(second[0] - first[0]).alias("size"), F.get("fill_rgb", F.lit(1)).alias("green"), F.get("fill_rgb", F.lit(2)).alias("blue"))


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 16)::INT AS k FROM supplier), h AS (SELECT *, printf('%02X', k) AS a, printf('%02X', k * 17) AS b, printf('%02X', (15 - k) * 17) AS c, printf('%02X', 85 * (k % 4)) AS d, printf('%02X', 255 - k) AS e FROM s)
SELECT s_suppkey, unnest([10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23])::BIGINT AS num, unnest([a || a || a || 'FFFFFFFFFF', b || b || b || 'FF' || c || c || c || 'FF', '000000FFFFFFFFFF', d || d || d || 'FFFFFFFFFF', a || a || a || 'FFFFFFFFFF',
  a || '0102FF030405FF', a || 'FFFFFF000000FF', a || '0506FF010203FF', a || '00' || a || 'FF' || 'FF00FFFF', e || e || e || 'FF000000FF', '000000FF00000000', a || a || a || '00FFFFFFFF', a || a || a || a || 'FFFFFFFF', a || '0102FF030405FF']) AS rgba FROM h""")
def sample_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images in every space and depth, with decode arrays, stencil, key and soft masks."""
    return _told(scan(_samples(spark, sf_dir, "pictured"), "image_pixels", "FAILFAST"), "num", F.hex("rgba").alias("rgba"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (sum(l_partkey % 256) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS value FROM lineitem""")
def tiff_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal differences undone by a running sum within each row."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.sum(F.col("l_partkey") % 256).over(order) % 256).alias("value"))


@query("""WITH a AS (SELECT p_partkey AS num, CASE WHEN p_size > 25 THEN p_partkey - p_partkey % 10 END AS c FROM part), s AS (SELECT coalesce(c, p_partkey) AS num, p_size % 7 AS w, p_size % 5 + 1 AS h, p_brand LIKE '%1' AS f FROM part JOIN a ON num = p_partkey)
SELECT num, CASE WHEN min(least(w, h)) = 0 THEN 0 ELSE max(w) END::DOUBLE AS width, CASE WHEN min(least(w, h)) = 0 THEN 0 ELSE max(h) END::DOUBLE AS height, bool_or(f) AS protected FROM s GROUP BY num""")
def alias_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and protection of merged objects."""
    parts = table(spark, sf_dir, "part").withColumn("doc_id", F.lit(0))
    size = F.col("p_size")
    sizes = parts.select("doc_id", F.col("p_partkey").alias("num"), (size % 7).cast("double").alias("width"), (size % 5 + 1).cast("double").alias("height"), F.col("p_brand").endswith("1").alias("protected"))
    alias = parts.where(size > 25).select("doc_id", F.col("p_partkey").alias("num"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("canonical"))
    return R.merged_sizes(sizes, alias, ["doc_id"], "num").select("num", "width", "height", "protected")


@query("SELECT c_custkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN (100 - n_nationkey)::DOUBLE ELSE c_acctbal END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def screen_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a document that named ones of the device replace."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    own = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "name", F.col("c_acctbal").alias("value"))
    named = nation.where("n_nationkey % 2 = 0").select("name", (100 - F.col("n_nationkey")).cast("double").alias("value"))
    return R.overridden(own, named, "name", "value").select("c_custkey", "name", "value")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_discount AS d, l_partkey % 1000 AS p, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(q), 6) AS root, round(ln(q), 6) AS nat, round(log10(q), 6) AS dec, round(sin(radians(q)), 6) + 0.0 AS sine, round(cos(radians(q)), 6) + 0.0 AS cosine,
  round(degrees(atan2(q, n)), 6) AS angle, round(q * q, 6) AS square, ceil(q / 4)::DOUBLE AS up, floor(q / 4)::DOUBLE AS down, floor(q / 4 + 0.5)::DOUBLE AS near, trunc(-q / 4) + 0.0 AS cut, round(abs(d - 0.05), 6) AS away,
  (p // n)::DOUBLE AS whole, (p % n)::DOUBLE AS rest, (p & 12)::DOUBLE AS both, (p | 12)::DOUBLE AS either, xor(p, 12)::DOUBLE AS one, (-p - 1)::DOUBLE AS flipped, (p * 8)::DOUBLE AS left_3, (p // 4)::DOUBLE AS right_2,
  CASE WHEN q > 10 AND d <> 0 OR NOT (n >= 3) THEN 1.0::DOUBLE ELSE 0.0 END AS test, CASE WHEN p < 500 THEN q ELSE CASE WHEN p <= 700 THEN d ELSE n END END::DOUBLE AS branch, round(n + q * 10 + d * 100, 6) AS rolled FROM v""")
def calculator_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculator operators compiled to columns."""
    q, d, p, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_partkey") % 1000, F.col("l_linenumber")
    programs = {
        "root": ("{ sqrt }", q), "nat": ("{ ln }", q), "dec": ("{ log }", q), "sine": ("{ sin }", q), "cosine": ("{ cos }", q), "angle": ("{ atan }", q, n), "square": ("{ 2 exp }", q),
        "up": ("{ 4 div ceiling }", q), "down": ("{ 4 div floor }", q), "near": ("{ 4 div round }", q), "cut": ("{ neg 4 div truncate }", q), "away": ("{ 0.05 sub abs }", d),
        "whole": ("{ cvi exch cvi exch idiv }", p, n), "rest": ("{ cvi exch cvi exch mod }", p, n), "both": ("{ cvi 12 and }", p), "either": ("{ cvi 12 or }", p), "one": ("{ cvi 12 xor }", p), "flipped": ("{ cvi not cvr }", p),
        "left_3": ("{ cvi 3 bitshift }", p), "right_2": ("{ cvi -2 bitshift }", p), "test": ("{ 3 ge not 3 1 roll 0 ne exch 10 gt and or true false or and { 1.0 } { 0.0 } ifelse }", q, d, n),
        "branch": ("{ dup 500 lt { pop pop pop } { dup 700 le { pop pop exch pop } { pop 3 1 roll pop pop } ifelse } ifelse }", q, d, n, p),
        "rolled": ("{ 3 1 roll 100 mul exch 10 mul add add 0 index exch pop }", q, d, n),
    }
    parsed = {k: (calculator.parse(text), list(inputs)) for k, (text, *inputs) in programs.items()}
    found = calculator.with_programs(spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")), parsed)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r6(F.col(k)).alias(k) for k in programs])


__all__ = ["ORACLES", "QUERIES"]
