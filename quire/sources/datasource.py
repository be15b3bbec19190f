"""The tables of PDF documents as a data source of Spark's own: ``spark.read.format("quire_pdf")``.

    spark.dataSource.register(PdfDataSource)
    spark.read.format("quire_pdf").option("table", "text_marks").load("file:///corpus").where("page_index = 0")

Files are dealt into partitions by bytes, so many small documents share a task and
a large one has its own. With ``pushdown`` (and Spark's own switch for it,
``spark.sql.python.filterPushdown.enabled``) conditions on ``path`` choose files before any is opened and
those on ``page_index`` choose pages before their content is run; all others are Spark's. A ``schema`` of
some of the table's columns gives those alone. ``scan`` over ``read_files`` gives the same rows
from any file system that Spark reads; this source lists and opens files through
Arrow's file systems (local, HDFS, S3, GCS).

Options: ``table`` (of ``TABLES``, or ``diagnostics``), ``mode`` (``PERMISSIVE`` or ``FAILFAST``),
``password``, ``pattern`` (of file names), ``partition_bytes``, ``pushdown``.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.pdf.document import Document
from quire.sources.tables import BATCH_BYTES, BATCH_ROWS, DIAGNOSTICS, FAULTS, TABLES, _batch, _size, rows_of

PARTITION_BYTES = 64 << 20
OPENING_BYTES = 1 << 20  # what opening a file costs, in bytes read


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def dealt(files: Iterable[tuple[str, int]], most: int) -> list[Files]:
    """Files in order, as many together as have ``most`` bytes, each with what opening it costs."""
    out, held, size = [], [], 0
    for path, n in files:
        if held and size + n + OPENING_BYTES > most:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += n + OPENING_BYTES
    return [*out, Files(tuple(held))] if held else out


_ORDERS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
}


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema
        self.table = options.get("table", "documents")
        self.conditions: list[tuple[str, type, object]] = []

    def _holds(self, name: str, value: object) -> bool:
        return all(_ORDERS[kind](value, other) for n, kind, other in self.conditions if n == name)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.options["path"])
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        pattern = self.options.get("pattern", "*.pdf")
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern))
        return dealt([f for f in files if self._holds("path", f[0])], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.options["path"])
        lenient = self.options.get("mode", "PERMISSIVE").upper() == "PERMISSIVE"
        names = ["path", *_names(self.table)]
        places = [names.index(c) for c in self.schema.fieldNames()]
        page = names.index("page_index") if "page_index" in names else None
        schema = to_arrow_schema(self.schema)
        out, size = [], 0
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                data = file.read()
            for row in self._rows(data, lenient):
                row = (path, *row)
                if page is not None and not self._holds("page_index", row[page]):
                    continue
                out.append(tuple(row[i] for i in places))
                size += _size(out[-1])
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    def _rows(self, data: bytes, lenient: bool) -> Iterator[tuple]:
        try:
            doc = Document(data, self.options.get("password", ""), lenient)
        except FAULTS as e:
            if not lenient:
                raise
            if self.table == "diagnostics":
                yield -1, getattr(e, "offset", -1), str(e) or type(e).__name__
            return
        if self.table != "diagnostics":
            doc.wanted_page = lambda index: self._holds("page_index", index)
        for name, row in rows_of(doc, [self.table]):
            if name == self.table:
                yield row


class PushedPdfReader(PdfReader):
    """Takes conditions on files and pages upon itself; Spark refuses it where its pushdown is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {"path", "page_index"} & set(self.schema.fieldNames())
        for f in filters:
            name = f.attribute[0] if type(f) in _ORDERS and len(f.attribute) == 1 else None
            if name in known:
                self.conditions.append((name, type(f), f.value))
            else:
                yield f


def _names(table: str) -> list[str]:
    return [c.split(" ", 1)[0] for c in _split(DIAGNOSTICS if table == "diagnostics" else TABLES[table][0])]


def _split(columns: str) -> list[str]:
    """The columns of a DDL string; commas inside brackets are of a type."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        table = self.options.get("table", "documents")
        if table != "diagnostics" and table not in TABLES:
            raise ValueError(f"no table {table}")
        return "path string, " + (DIAGNOSTICS if table == "diagnostics" else TABLES[table][0])

    def reader(self, schema: StructType) -> PdfReader:
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (PushedPdfReader if pushed else PdfReader)(dict(self.options), schema)
