"""The data source against the scans it stands for."""

import pytest

from quire.sources.pdf.write import text_document
from quire.sources.tables import TABLES, read_files, scan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pdf")
    for i in range(7):
        (root / f"f{i}.pdf").write_bytes(text_document([[f"doc {i}", "naïve"], [f"page two of {i}"], ["three"]]))
    (root / "deep").mkdir()
    (root / "deep" / "broken.pdf").write_bytes(b"%PDF-1.4 nothing here")
    (root / "other.txt").write_text("no document")
    return root


def table(spark, folder, name, **options):
    from quire.sources.datasource import PdfDataSource

    spark.dataSource.register(PdfDataSource)
    return spark.read.format("quire_pdf").options(table=name, **options).load(folder.as_uri())


@pytest.mark.parametrize("name", ["documents", "pages", "text_marks", "operations", "objects", "diagnostics"])
def test_rows_equal_those_of_scans(spark, folder, name):
    files = read_files(spark, str(folder))
    want = scan(files, name)
    got = table(spark, folder, name)
    columns = [c for c in want.columns if c not in ("doc_id", "custom")]
    assert got.columns == ["path", *want.columns[1:]]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_conditions_reach_the_source(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        marks = table(spark, folder, "text_marks", mode="FAILFAST", pattern="f*.pdf", partition_bytes=3 << 20, pushdown="true")
        one = marks.where("page_index = 1 AND text LIKE '%two%'")
        assert sorted(r["text"] for r in one.collect()) == [f"page two of {i}" for i in range(7)]
        assert "PythonScan" in one._jdf.queryExecution().toString() or "BatchScan" in one._jdf.queryExecution().toString()
        path = marks.select("path").where("path LIKE '%f3%'").first()[0]
        assert {r["text"] for r in marks.where(marks["path"] == path).collect()} == {"doc 3", "naïve", "page two of 3", "three"}
        assert marks.where("page_index >= 1 AND page_index < 2").count() == 7 and marks.where("page_index IN (0, 2)").count() == 21
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pushed_conditions_skip_files_and_pages(folder):
    from pyspark.sql.datasource import EqualTo, IsNull
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    from quire.sources.datasource import PushedPdfReader, dealt

    schema = StructType([StructField("path", StringType()), StructField("page_index", IntegerType()), StructField("text", StringType())])
    reader = PushedPdfReader({"path": folder.as_uri(), "table": "text_marks"}, schema)
    assert sum(len(p.paths) for p in reader.partitions()) == 8
    wanted = str(folder / "f2.pdf")
    left = list(reader.pushFilters([EqualTo(("path",), wanted), EqualTo(("page_index",), 1), IsNull(("text",))]))
    assert left == [IsNull(("text",))] and [p.paths for p in reader.partitions()] == [(wanted,)]
    batches = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert batches == [[{"path": wanted, "page_index": 1, "text": "page two of 2"}]]
    sizes = [("a", 5 << 20), ("b", 1), ("c", 1), ("d", 90 << 20), ("e", 1)]
    assert [p.paths for p in dealt(sizes, 8 << 20)] == [("a", "b"), ("c",), ("d",), ("e",)]


def test_columns_of_every_table(spark, folder):
    from quire.sources.datasource import _names

    for name in TABLES:
        assert ["path", *_names(name)] == table(spark, folder, name).columns
    few = spark.read.format("quire_pdf").options(table="pages").schema("page_index int, path string").load(folder.as_uri())
    assert few.columns == ["page_index", "path"] and few.count() == 21
