"""Work grows with the input in tasks and rows, not in the length of one task."""

from pyspark.sql import functions as F

from quire.plans.session import spread


def test_spread_deals_out_by_rows_and_bytes(spark):
    one = spark.range(1000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 8
    assert spread(one, rows=50).rdd.getNumPartitions() == 20
    texts = one.select("id", F.repeat(F.lit("x"), 100).alias("text"))
    many = spread(texts, size=5000)
    assert many.rdd.getNumPartitions() == 20 and many.distinct().count() == 1000
    # what is dealt so already stays, and so does nothing
    even = spark.range(0, 1000, 1, 20)
    assert spread(even, rows=50).rdd.getNumPartitions() == 20
    assert spread(texts.where("id < 0")).count() == 0


def test_every_part_is_work_for_some_task(spark, tmp_path):
    from quire.queries import glyph_advance

    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = glyph_advance(spark, str(tmp_path))
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().toString()


def test_probes_are_not_broadcast(spark):
    from quire.llm.simhash import hamming_links
    from quire.plans.session import cut_lineage

    distinct = cut_lineage(spark.range(100_000).select(F.xxhash64("id").alias("fp")))
    plan = hamming_links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sampled_functions_run_by_batches(spark):
    from quire.functions.samples import sampled

    x = F.col("id") / 99
    (value,) = sampled([x, x, F.when(F.col("id") != 7, x)], [4, 4, 4], [k * k % 256 for k in range(64)], 1, [0.0, 1.0] * 3, [0.0, 1.0], order=3)
    found = spark.range(100).select("id", value.alias("v"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in found.where("v IS NULL").collect()] == [7]


def test_small_rows_do_not_run_by_diagonals(monkeypatch):
    from quire.functions import filters

    monkeypatch.setattr(filters, "_undo_wave", None)
    assert len(filters.undo_predictor(bytes([4, *range(8)]) * 100, 14, columns=8)) == 800


def test_the_documents_of_duplicates_are_read_once(spark, tmp_path):
    from quire.document_queries import sample_duplicates

    spark.createDataFrame([(1, "a")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    plan = sample_duplicates(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_documents_are_optimised_once(spark, tmp_path):
    from quire.queries import optimised_documents

    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = optimised_documents(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_lookup_without_hot_keys_reads_its_rows_once(spark):
    from quire.plans.skew import lookup

    rows = spark.range(1000).select((F.col("id") % 10).alias("k"))
    found = lookup(rows, spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"])
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("v = 2 * k").count() == 1000


def test_small_groups_of_sparse_places_take_no_rounds(spark, monkeypatch):
    from quire.operators import scans

    cuts = []
    monkeypatch.setattr(scans, "cut_lineage", lambda df: cuts.append(1) or df)
    df = spark.range(600).select((F.col("id") % 50).alias("g"), (F.col("id") * 10**12).alias("at"), F.lit(1).alias("v"))
    assert {tuple(r) for r in scans.segmented_reduce(df, ["g"], "at", F.col("v"), lambda a, b: a + b).collect()} == {(g, 12) for g in range(50)}
    found = scans.segmented_scan(df, ["g"], "at", F.col("v"), lambda a, b: a + b, "n").where("n <> floor(at / 50e12) + 1")
    assert found.count() == 0 and len(cuts) == 2  # the groups are counted, nothing else is written


def test_large_groups_of_sparse_places_beside_small_ones(spark, monkeypatch):
    from quire.operators import scans

    monkeypatch.setattr(scans, "BLOCK", 8)
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, -1).otherwise(F.col("id") % 100).alias("g"), (F.col("id") * 1000).alias("at"), F.format_string("%03d", "id").alias("v"))
    whole = {r["g"]: r["value"] for r in scans.segmented_reduce(df, ["g"], "at", F.col("v"), lambda a, b: F.concat(a, b)).collect()}
    for g in {i % 100 for i in range(0, 400, 4)} | {-1}:
        assert whole[g] == "".join(f"{i:03d}" for i in range(400) if (i % 4 > 0) == (g < 0) and (g < 0 or i % 100 == g))


def test_objects_alone_by_shape_take_no_rounds(spark, monkeypatch):
    from quire.operators import graphs

    cuts = []
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: cuts.append(1) or df)
    objects = spark.range(40).select(F.lit(1).alias("doc_id"), F.col("id").alias("num"), F.col("id").cast("string").alias("shape"))
    refs = spark.range(39).select(F.lit(1).alias("doc_id"), F.col("id").alias("src_num"), F.lit("/K").alias("path"), (F.col("id") + 1).alias("dst_num"))
    found = graphs.duplicate_classes(objects, refs).collect()
    assert len(found) == 40 and all(r["canonical"]["num"] == r["num"] for r in found) and len(cuts) == 2
    # two of a shape, told apart by what objects without an equal are
    twins = objects.withColumn("shape", F.when(F.col("num").isin(3, 4), "twin").when(F.col("num").isin(8, 9), "like").otherwise(F.col("shape")))
    same = refs.withColumn("dst_num", F.when(F.col("src_num").isin(8, 9), 20).otherwise(F.col("dst_num")))
    assert {r["num"]: r["canonical"]["num"] for r in graphs.duplicate_classes(twins, same).where("num <> canonical.num").collect()} == {9: 8}


def test_rewritten_objects_are_dealt_by_rows(spark, monkeypatch):
    from quire.operators import serialise
    from quire.sources.tables import from_text, scan_together

    monkeypatch.setattr(serialise, "OBJECTS", 10)
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    held = scan_together(from_text(texts), serialise.TABLES)
    objects = serialise.kept_objects(held).localCheckpoint().coalesce(1)
    none = objects.select("doc_id", "num", F.col("num").alias("canonical_num")).where("false")
    assert serialise.coded(objects, none, held["object_refs"]).rdd.getNumPartitions() >= objects.count() // 10


def test_font_tables_are_made_without_glyphs(monkeypatch):
    from quire.sources.pdf import fonts
    from quire.sources.pdf.document import Document
    from quire.sources.pdf.objects import Name
    from quire.sources.pdf.write import text_document

    doc = Document(text_document([["a"]]), "", False)
    for own in ({"BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}, {"BaseFont": Name("Times-Bold"), "Encoding": {"Differences": [65, Name("eacute"), Name("zero")]}}, {"BaseFont": Name("Courier")}):
        font = fonts.Font(doc, own | {"Subtype": Name("Type1")})
        glyphs = [font.decode(bytes([c]))[0] for c in range(256)]
        monkeypatch.setattr(fonts.Font, "decode", lambda *_: 1 / 0)
        assert font.quick() == ([g.text for g in glyphs], [g.width for g in glyphs])
        monkeypatch.undo()


def test_leaves_of_expressions_take_no_round(spark, monkeypatch):
    from quire.operators import graphs

    sizes = []
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: sizes.append((df.columns, df.count())) or df)
    rows = [(1, "r", None, "And", None), (1, "a", "r", "Or", None), (1, "b", "r", "Not", None)] + [(1, f"l{i}", "a", None, i == 7) for i in range(30)] + [(1, "x", "b", None, False), (None, "y", None, None, None)]
    nodes = spark.createDataFrame(rows, "tree int, node string, parent string, op string, state boolean")
    found = {(r["tree"], r["node"]): r["value"] for r in graphs.evaluated_expressions(nodes, ["tree"]).collect()}
    assert len(found) == len(rows) and found[1, "r"] and found[1, "a"] and found[1, "b"] and found[None, "y"] and found[1, "l7"] and not found[1, "l8"]
    assert [n for _, n in sizes if n > 3] == [35]  # the nodes are kept once, rounds hold operators only


def test_documents_of_some_megabytes_a_partition_are_not_moved(spark, tmp_path):
    from quire.llm import queries

    rows = spark.range(0, 80, numPartitions=8).select(F.col("id").alias("doc_id"), F.expr("repeat('a few words ', 50000)").alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries._documents(spark, str(tmp_path))
    assert "Exchange" not in docs._jdf.queryExecution().toString() and docs.count() == 80


def test_new_words_are_encoded_as_one_text(monkeypatch):
    from quire.llm import packing

    cache = packing.WordCache(packing.vocabulary_path(), packing.vocabulary_path(packing.RANKS))
    calls, quick = [], cache.quick
    cache.quick = lambda text: calls.append(text) or quick(text)
    words = [f" w{i}é{i * i}" for i in range(300)] + [" ", " don't", " a\nb", " x.y", " 12345678", " Ünï"]
    assert cache._encode_words(words) == cache._encode(words) and len(calls) == 1
    odd = [" a\n", " ", " \nb", " <|im_end|>", " 漢字", " \n", " "]
    assert cache._encode_words(odd) == cache._encode(odd)
    assert cache._encode_words([]) == [] and cache._encode_words(["first"]) == cache._encode(["first"])


def test_pages_without_frames_take_no_scans(spark, monkeypatch):
    import json
    import random

    from quire.operators import placement
    from test_relations import content, folded

    monkeypatch.setattr(placement, "segmented_scan", None)
    rng = random.Random(7)
    pages = {(d, p): [x for x in content(rng, 90) if x[0] not in ("q", "Q", "cm")] for d, p in [(1, 0), (1, 1), (2, 0), (None, 0)]}
    rows = [(*key, i, op, json.dumps(args)) for key, ops in pages.items() for i, (op, args) in enumerate(ops)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, ord int, operator string, operands_json string").repartition(3)
    for advance in (0.5, None):
        got = {(r["doc_id"], r["page_index"], r["ord"]): r for r in placement.placed_operations(df, advance=advance and F.lit(advance)).collect()}
        assert len(got) == len(rows)
        for key, ops in pages.items():
            for i, (depth, ctm, line, tm, state) in enumerate(folded(ops, advance or 0)):
                r = got[*key, i]
                assert (r["depth"], tuple(r["ctm"]), r["line"] and tuple(r["line"]), r["text_matrix"] and tuple(r["text_matrix"])) == (depth, ctm, line, tm), (key, i, ops[i])
                assert tuple(r[k] for k in ("leading", "char_space", "word_space", "h_scale", "rise", "mode", "size")) == state, (key, i, ops[i])


def test_shown_strings_are_not_dealt_by_page(spark, monkeypatch):
    from quire.operators import placement

    kept = []
    monkeypatch.setattr(placement, "cut_lineage", lambda df: kept.append(df) or df)
    rows = [(1, 0, "BT", "[]"), (1, 1, "TL", "[12]"), (1, 2, "'", '[{"$s":"' + "61" * 5000 + '"}]')]
    ops = spark.createDataFrame(rows, "doc_id long, ord int, operator string, operands_json string")
    (last,) = [r for r in placement.placed_operations(ops, ("doc_id",)).collect() if r["operator"] == "'"]
    assert last["line"]["f"] == -12 and max(len(str(r)) for r in kept[0].collect()) < 200


def test_plain_content_takes_no_parser(monkeypatch):
    from quire.sources.pdf import document

    data = b"BT\n/F1 10 Tf 1 0 0 1 -50 7.5 Tm\n(a b) ' <6162> Tj T* ET"
    whole = list(document.operators(data))
    monkeypatch.setattr(document.Parser, "value", lambda *_: 1 / 0)
    assert list(document.operators(data)) == whole and [x[0] for x in whole] == ["BT", "Tf", "Tm", "'", "Tj", "T*", "ET"]
    assert whole[1][1:] == (["F1", 10], 10) and whole[2][1] == [1, 0, 0, 1, -50, 7.5] and whole[4][1] == [b"ab"]


def test_made_documents_come_in_batches(spark, monkeypatch):
    from quire.sources import tables

    made = []
    monkeypatch.setattr(tables, "MADE_BYTES", 3000, raising=False)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, _: made.extend(f(iter(self.toArrow().to_batches()))) or self)
    tables.from_text(df)
    assert sum(b.num_rows for b in made) == 20 and 1 < len(made) < 20 and [i for b in made for i in b.column(0).to_pylist()] == list(range(20))


def test_ranges_that_end_within_two_tiles_are_dealt_once(spark, monkeypatch):
    from quire.operators import intervals
    from quire.plans import skew

    cuts = []
    monkeypatch.setattr(intervals, "cut_lineage", lambda df: cuts.append(1) or df)
    points = spark.range(3000).select((F.col("id") % 3).alias("font"), (F.col("id") % 700 - 20).alias("code"))
    ranges = spark.range(300).select((F.col("id") % 2).alias("font"), (F.col("id") * 2).alias("low"), (F.col("id") * 2 + F.col("id") % 60).alias("high"), (F.col("id") * 7 % 300).alias("ord"))
    found = intervals.values_in_intervals(points, ranges, ["font"], "code")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Broadcast" not in plan and not cuts
    spans = [tuple(r) for r in ranges.collect()]
    want = {}
    for font, code in points.collect():
        held = max((s for s in spans if s[0] == font and s[1] <= code <= s[2]), key=lambda s: s[3], default=(font, None, None, None))
        want[font, code] = (want.get((font, code), (0,))[0] + 1, *held[1:])
    assert {(r["font"], r["code"]): (r["n"], r["low"], r["high"], r["ord"]) for r in found.collect()} == want
    # a group of many rows is reduced before it is dealt by tile
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    many = intervals.values_in_intervals(points, ranges, ["font"], "code")
    assert {(r["font"], r["code"]): (r["n"], r["low"], r["high"], r["ord"]) for r in many.collect()} == want


def test_glyphs_are_not_sent_to_the_driver(spark, tmp_path):
    from quire.document_queries import sample_glyph_usage

    spark.createDataFrame([(1, "ba b"), (2, "c")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    found = sample_glyph_usage(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r["s_suppkey"], r["font"]): r["codes"] for r in found.collect()}
    assert len(rows) == 14 and rows[1, "Courier"] == "32 97 98" and rows[2, "Times-Roman"] == "99"


def test_lines_of_a_page_are_measured_and_shown_by_whole_strings(monkeypatch):
    from quire.sources import tables
    from quire.sources.pdf import fonts
    from quire.sources.pdf.document import Document, operators
    from quire.sources.pdf.write import text_document

    shown, made = [], []
    monkeypatch.setattr(tables, "to_json", lambda v, f=tables.to_json: shown.append(1) or f(v))
    monkeypatch.setattr(fonts, "_quick_of", lambda *a, f=fonts._quick_of: made.append(1) or f(*a))
    fonts._standard_quick.cache_clear()
    lines = ["é\x01b " * n for n in (1, 15, 16, 40, 200)]
    for _ in range(3):
        doc = Document(text_document([lines]))
        rows = [row for _, row in tables.rows_of(doc, ["text_marks"])]
        assert [r[2] for r in rows] == ["éb " * n for n in (1, 15, 16, 40, 200)]
    assert len(shown) == 3 and len(made) == 1
    # long strings come to the same place as glyph by glyph
    moves = {}
    for wanted in (["text_marks"], ["text_marks", "glyphs"]):
        content = b"BT /F1 7.3 Tf 0.31 Tc 1.7 Tw 83 Tz 1 0 0 1 5 5 Tm (" + b"a bc" * 50 + b") Tj (x) Tj ET"
        doc = Document(text_document([[""]], compress=False))
        doc.content = lambda p, data=content: data
        moves[len(wanted)] = [row[5] for name, row in tables.rows_of(doc, wanted) if name == "text_marks"]
    assert moves[1] == moves[2] and len(moves[1]) == 2
    # an odd hexadecimal string is left to the parser, and no string is gone through twice
    assert [args for _, args, _ in operators(b"<414> Tj <4142> Tj (a\\)b) Tj (c(d)) Tj")] == [[b"A@"], [b"AB"], [b"a)b"], [b"c(d)"]]


def test_rewritten_objects_come_in_batches(spark, monkeypatch):
    import pyarrow as pa
    from quire.operators import serialise

    runs = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, *a: runs.append(run) or self)
    objects = spark.range(3).select(F.lit(1).alias("doc_id"), F.col("id").alias("num"), F.lit('{"a":1}').alias("value_json"), F.lit(None).cast("binary").alias("raw"), F.lit(False).alias("is_stream"))
    serialise.coded(objects, objects.select("doc_id", "num", F.col("num").alias("canonical_num")).where("false"), objects.select("doc_id", F.col("num").alias("src_num"), F.col("num").alias("dst_num")))
    given = pa.RecordBatch.from_pylist([{"doc_id": 1, "num": n, "value_json": '{"a":{"$r":[3,0]}}', "raw": None, "alias": [{"a": 3, "b": n}] if n % 2 else None} for n in range(10)])
    (batch,) = runs[0](iter([given]))
    assert batch.column(1).to_pylist() == [*range(10)] and batch.column(2)[5].as_py() == b"5 0 obj\n<</a 5 0 R>>\nendobj\n" and batch.column(3).to_pylist() == [len(x) for x in batch.column(2).to_pylist()]
    monkeypatch.setattr(serialise, "MADE_BYTES", 60)
    cut = [b.column(1).to_pylist() for b in runs[0](iter([given]))]
    assert sum(cut, []) == [*range(10)] and len(cut) > 1


def test_settled_objects_take_no_further_rounds(spark, monkeypatch):
    from quire.operators import graphs

    cuts = []
    monkeypatch.setattr(graphs, "cut_lineage", lambda df, cut=graphs.cut_lineage: cuts.append((cut(df), "class" in df.columns)) or cuts[-1][0])
    # 40 leaves in 2 classes, 20 nodes over two of them, 10 tops over two of these
    level = lambda low, high, shape: spark.range(low, high).select(F.lit(1).alias("doc_id"), F.col("id").alias("num"), shape.alias("shape"))
    objects = level(0, 40, (F.col("id") % 2).cast("string")).union(level(100, 120, F.lit("n"))).union(level(200, 210, F.lit("t")))
    refs = spark.createDataFrame([(1, 100 + i, f"/{k}", 2 * i + k * (i % 2)) for i in range(20) for k in (0, 1)] + [(1, 200 + i, f"/{k}", 100 + 2 * i + k * (i % 2)) for i in range(10) for k in (0, 1)], "doc_id int, src_num long, path string, dst_num long")
    found = {r["num"]: r["canonical"]["num"] for r in graphs.duplicate_classes(objects, refs).collect()}
    assert all(found[i] == i % 2 and found[100 + i % 20] == 100 + i % 2 for i in range(40)) and all(found[200 + i] == 200 + i % 2 for i in range(10))
    # the shapes, then everything once, then what was not settled
    assert [df.count() for df, classes in cuts if classes] == [70, 70, 10]
    # two equal chains beside objects that are alone: one place of each is settled a round
    monkeypatch.setattr(graphs, "MERGE", 2)
    chains = spark.range(24).select(F.lit(None).cast("int").alias("doc_id"), F.col("id").alias("num"), F.lit("c").alias("shape")).union(spark.range(30, 60).select(F.lit(None).cast("int"), "id", F.col("id").cast("string")))
    steps = spark.range(24).select(F.lit(None).cast("int").alias("doc_id"), F.col("id").alias("src_num"), F.lit("/N").alias("path"), F.when(F.col("id") % 12 == 11, 30).otherwise(F.col("id") + 1).alias("dst_num"))
    rows = graphs.duplicate_classes(chains, steps).collect()
    assert len(rows) == 54 and {r["num"]: r["canonical"]["num"] for r in rows} == {i: i % 12 if i < 24 else i for i in [*range(24), *range(30, 60)]}


def test_rewriting_is_dealt_by_its_own_size_and_read_back_narrow(spark, tmp_path, monkeypatch):
    from quire import relation_queries
    from quire.operators import serialise
    from quire.sources.tables import from_text, scan

    texts = spark.range(8).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb "), F.col("id").cast("string"), F.repeat(F.lit("x"), 1 << 20)).alias("text"))
    texts.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    parts, read, held = [], [], {}
    monkeypatch.setattr(relation_queries, "scan_together", lambda files, tables, columns, f=relation_queries.scan_together: parts.append(files.rdd.getNumPartitions()) or held.update(f(files, tables, columns=columns)) or held)
    monkeypatch.setattr(relation_queries, "scan", lambda *a, f=scan, **b: read.append(f(*a, **b)) or read[-1])
    monkeypatch.setattr(serialise, "TASK_BYTES", 1 << 19)
    found = relation_queries.rewritten_text_by_page(spark, str(tmp_path))
    assert held["streams"].columns == ["doc_id", "num", "dict_json", "raw"]
    assert parts[0] > 16 and read[0].columns == ["doc_id", "page_index", "text"]
    assert {(r["doc_id"], r["page_index"], r["n_marks"], r["n_glyphs"]) for r in found.collect()} == {(i, 0, 2, 4 + (1 << 20)) for i in range(8)}
    few = from_text(texts.where("doc_id = 3").withColumn("text", F.lit("p\nq")))
    assert [tuple(r) for r in scan(few, "text_marks", columns=["text", "ord"]).collect()] == [(3, "p", 0), (3, "q", 1)]
