"""Tables over corpora, relational operators, streaming, and the driver's contract."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import relations as R
from quire.plans.order import with_row_number
from quire.sources.pdf.write import text_document
from quire.sources.tables import TABLES, from_text, read_files, rewritten, scan
from quire.streaming.ingest import stream_files, stream_table

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pdfs")
    (at / "a.pdf").write_bytes(text_document([["one", "two"], ["three"]], Title="A"))
    (at / "b.pdf").write_bytes(text_document([["four"]]))
    (at / "bad.pdf").write_bytes(b"nothing here")
    (at / "hurt.pdf").write_bytes(text_document([["five"]]).replace(b"startxref", b"startxxxx"))
    (at / "other.txt").write_bytes(b"not read")
    return at


def test_every_table_of_a_folder(spark, folder):
    files = read_files(spark, str(folder))
    assert files.count() == 4
    for name in TABLES:
        assert scan(files, name).columns[0] == "doc_id"
        scan(files, name).count()
    marks = scan(files, "text_marks").select("text").collect()
    assert sorted(r[0] for r in marks) == ["five", "four", "one", "three", "two"]
    told = {r["message"] for r in scan(files, "diagnostics").collect()}
    assert told == {"no document header", "cross-references rebuilt: no startxref"}
    assert scan(files, "documents").where("title = 'A'").first()["n_pages"] == 2
    with pytest.raises(Exception, match="no document header|no startxref"):
        scan(files, "pages", "FAILFAST").collect()


def test_rewritten_documents_read_alike(spark, folder):
    files = read_files(spark, str(folder))
    out = rewritten(files)
    before, after = (sorted(r[0] for r in scan(f, "text_marks").select("text").collect()) for f in (files, out))
    assert before == after and out.where("fault IS NOT NULL").count() == 1


def test_text_to_documents_and_back(spark):
    docs = spark.createDataFrame([(1, "a\n\nb" * 50), (2, None), (3, "")], "doc_id long, text string")
    pages = scan(from_text(docs), "pages", "FAILFAST").groupBy("doc_id").count()
    assert dict(pages.collect()) == {1: 2, 2: 1, 3: 1}


def test_a_folder_as_a_stream(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_table(stream_files(spark, str(folder)), "pages", out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    (folder / "c.pdf").write_bytes(text_document([["late"]]))
    stream_table(stream_files(spark, str(folder)), "pages", out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 50 if i else None,) for i in range(100)], "v int").repartition(7)
    out, n = with_row_number(df, ["v"])
    rows = sorted((r["row"], r["v"]) for r in out.collect())
    assert n == 100 and [r for r, _ in rows] == list(range(100))
    values = [v for _, v in rows]
    assert values[0] is None and values[1:] == sorted(values[1:])
    assert with_row_number(df.limit(0), ["v"])[1] == 0


def test_reachability_with_cycles(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "x", "y"), (2, "a", "z")], "doc_id int, src string, dst string")
    roots = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id int, num string")
    got = {(r["doc_id"], r["num"]): r["depth"] for r in R.reachable(edges, roots).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "a"): 0, (2, "z"): 1}


def test_ranges_and_chains(spark):
    starts = spark.createDataFrame([(1, 0, "i"), (1, 5, "ii"), (2, 3, "x")], "doc int, start int, style string")
    rows = spark.createDataFrame([(1, i) for i in (0, 4, 5, 99)] + [(2, 1), (2, 3)], "doc int, page int")
    got = {(r["doc"], r["page"]): r["style"] for r in R.in_range(rows, starts, ["doc"], "page", "start").collect()}
    assert got == {(1, 0): "i", (1, 4): "i", (1, 5): "ii", (1, 99): "ii", (2, 1): None, (2, 3): "x"}
    items = spark.createDataFrame([(1, "a"), (2, "x"), (3, "q")], "id int, role string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "f string, t string")
    assert dict(R.resolved_chain(items, "id", "role", mapping, "f", "t").collect()) == {1: "c", 2: None, 3: "q"}
    accepted = F.col("value").isin("b", "x", "q")
    assert dict(R.resolved_chain(items, "id", "role", mapping, "f", "t", accepted).collect()) == {1: "b", 2: "x", 3: "q"}
    assert dict(R.resolved_chain(items, "id", "role", mapping, "f", "t", F.col("value") == "a").collect()) == {1: None, 2: None, 3: None}
    long = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(300)], "f string, t string")
    ends = spark.createDataFrame([(0, "r0"), (1, "r299"), (2, "r300")], "id int, role string")
    assert dict(R.resolved_chain(ends, "id", "role", long, "f", "t").collect()) == {0: "r300", 1: "r300", 2: "r300"}


def test_visibility_and_links(spark):
    states = F.array(F.lit(True), F.lit(False))
    row = spark.range(1).select(*[R.policy_visible(F.lit(p), states) for p in ("AnyOn", "AllOn", "AnyOff", "AllOff")], R.group_state(F.lit(True), F.lit(True), F.lit(True), F.lit(True)), R.percent_encoded(F.lit("http://é/a b%20<"))).first()
    assert row[:] == (True, False, True, False, False, "http://%C3%A9/a%20b%20%3C")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_oracles(spark):
    import duckdb

    from quire.document_queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        quoted = ", ".join(f'"{c}"' for c in columns)
        got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
        found = con.execute(f"SELECT {quoted} FROM ({sql})").fetchall()
        assert got == sorted(str([plain(v) for v in r]) for r in found), name


def test_tables_scanned_together_equal_single_scans(spark):
    from quire.sources.samples import sample_documents
    from quire.sources.tables import TABLES, scan, scan_together

    files = sample_documents(spark.createDataFrame([(i, f"n{i}") for i in range(4)], "doc_id long, name string"), "structured").unionByName(
        sample_documents(spark.createDataFrame([(10, "g"), (11, "h")], "doc_id long, name string"), "graphic")
    )
    held = scan_together(files, list(TABLES) + ["diagnostics"])
    for t in ("documents", "pages", "text_marks", "path_marks", "glyphs", "fields", "output_intents", "diagnostics", "marked_content"):
        assert sorted(map(str, held[t].collect())) == sorted(map(str, scan(files, t).collect())), t
    with pytest.raises(ValueError):
        scan(files, "no such table")


def test_calculator_columns_equal_the_evaluator(spark):
    import random

    from quire.functions import calculator

    rng = random.Random(4)
    texts = ["{ sqrt exch abs add }", "{ cvi exch cvi 2 copy idiv 3 1 roll mod add }", "{ mul neg round }", "{ 2 copy gt { exch } if pop ceiling }", "{ atan }", "{ exch truncate exch floor sub }", "{ cvi 5 bitshift exch cvi -1 bitshift xor }", "{ div }", "{ cvi exch cvi and not }", "{ 1.5 exp exch pop }", "{ cvi 100000 mul exch cvi 100000 mul mul }", "{ cvi 2147483647 add exch pop }", "{ cvi 2147483647 add exch cvi idiv }", "{ 200 exp exch 200 exp mul }", "{ sub sqrt }", "{ sub ln }", "{ cvi exch cvi sub 0 idiv }"]
    rows = [(rng.uniform(0.5, 90), rng.uniform(0.5, 90)) for _ in range(40)]
    frame = spark.createDataFrame(rows, "a double, b double")
    for text in texts:
        program = calculator.parse(text)
        got = frame.select("a", "b", *[c.alias(f"r{i}") for i, c in enumerate(calculator.compile_columns(program, [F.col("a"), F.col("b")]))]).collect()
        for r in got:
            try:
                calculator.evaluate(program, [r["a"], r["b"]])
            except calculator.CalculatorError:
                assert None in r[2:], text
                continue
            assert list(r[2:]) == pytest.approx(calculator.evaluate(program, [r["a"], r["b"]]), rel=1e-6, abs=1e-6), text


def test_lines_of_all_texts(spark, tmp_path):
    import duckdb

    from quire.queries import ORACLES, QUERIES

    rows = [(1, "déjà vu €\nœuvre\n\nplain"), (2, "日本 x😀\x81\x85\xa0\xff\x7f"), (3, "tab\there\n\t\nß"), (4, None), (5, "x\n" * 60 + "Größe")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["text_lines_all"](spark, str(tmp_path)).where("doc_id < 5 OR page_index = 1").collect())
    assert got == [
        (1, 0, 0, "déjà vu €", 768.0), (1, 0, 1, "œuvre", 756.0), (1, 0, 3, "plain", 732.0),
        (2, 0, 0, "?? x???\xa0\xff\x7f", 768.0),
        (3, 0, 0, "tabhere", 768.0), (3, 0, 1, "", 756.0), (3, 0, 2, "ß", 744.0),
        (5, 1, 0, "Größe", 768.0),
    ]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT * FROM ({ORACLES['text_lines_all']}) WHERE doc_id < 5 OR page_index = 1").fetchall())


def test_every_customer_is_a_root(spark, tmp_path):
    from quire.queries import QUERIES

    for t, rows, columns in (
        ("customer", [(1,), (2,), (10,)], "c_custkey long"),
        ("orders", [(5, 1), (6, 10), (7, 99)], "o_orderkey long, o_custkey long"),
        ("lineitem", [(5, 3), (6, 4), (7, 8)], "l_orderkey long, l_partkey long"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = {tuple(r) for r in QUERIES["object_reachability_all"](spark, str(tmp_path)).collect()}
    assert got == {("c1", 0), ("c2", 0), ("c10", 0), ("o5", 1), ("o6", 1), ("p3", 2), ("p4", 2)}


def test_gradient_positions_of_every_part(spark, tmp_path):
    from quire.queries import QUERIES

    rows = [(50, 0), (51, 2), (54, 3), (50, 5), (50, 100), (50, 101)]
    spark.createDataFrame([(k + 100 * i, size) for i, (k, size) in enumerate(rows)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_partkey"]: (r["axial"], r["radial"]) for r in QUERIES["gradient_positions_all"](spark, str(tmp_path)).collect()}
    assert got == {50: (0.0, None), 151: (0.4, None), 254: (1.0, 0.0), 350: (0.6, 0.0), 450: (12.0, 1.0), 550: (12.12, None)}


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
