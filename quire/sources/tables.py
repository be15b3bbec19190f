"""PDF corpora as relations: one table per abstraction, keyed by ``doc_id``.

``files`` is any frame with ``doc_id`` and ``content`` (the bytes). A document
is read whole by one task; its rows come out in order and carry that order in
their own columns. With ``mode="PERMISSIVE"`` repairs are made and told in the
``diagnostics`` table, and a document that cannot be read at all gives one
diagnostic and no other rows; ``mode="FAILFAST"`` raises. ``scan`` gives one
table; ``scan_together`` reads and parses every document once for several, and
runs a page's content once for all kinds of marks. Arrow batches are cut by rows
and by bytes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.filters import FilterError, decode_text
from quire.plans.session import cut_lineage
from quire.sources.pdf.document import Document, Page, operators
from quire.sources.pdf.interpret import Interpreter
from quire.sources.pdf.objects import Name, PdfError, Ref, Stream, references_in, to_json

#: Rows put into one Arrow batch.
BATCH_ROWS = 4096
#: Bytes of values after which a batch is cut; a single row may be larger.
BATCH_BYTES = 16 << 20
#: Bytes of documents made from texts after which a batch is cut.
MADE_BYTES = 1 << 20
FAULTS = (PdfError, FilterError, KeyError, TypeError, IndexError, ValueError, RecursionError, AttributeError)


class CustomMap(dict):
    """A value of a map column."""


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, content and doc_id (a hash of the path) of every file under ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def _documents(doc: Document) -> Iterator[tuple]:
    info = doc.info()
    standard = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")
    s = doc.security
    yield (
        len(doc.data), doc.version, s is not None, s.r if s else None, s.permissions if s else None, s.owner if s else None,
        *(info.get(k) for k in standard), CustomMap({k: v for k, v in info.items() if k not in standard}) or None, to_json(doc.trailer), sum(1 for _ in doc.pages()),
    )


def _xref(doc: Document) -> Iterator[tuple]:
    for rev, section in enumerate(doc.sections):
        for num, e in sorted(section.items()):
            yield rev, num, e.kind, e.position, e.gen


def _isolated(doc: Document, where: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """``rows`` up to a fault, which is told; in strict mode it goes on."""
    try:
        yield from rows
    except FAULTS as e:
        if not doc.lenient:
            raise
        doc.note(f"{where}: {str(e) or type(e).__name__}", getattr(e, "offset", -1))


def _numbers(doc: Document) -> Iterator[tuple[int, int, object]]:
    for num, e in sorted(doc.xref.items()):
        if e.kind:
            yield from _isolated(doc, f"object {num}", ((num, e.gen if e.kind == 1 else 0, doc.object(n)) for n in (num,)))


@dataclass(frozen=True)
class ByPage:
    """Rows of a table that is read page by page; a page's fault leaves the others."""

    rows: Callable[[Document, Page], Iterator[tuple]]

    def __call__(self, doc: Document) -> Iterator[tuple]:
        for p in doc.pages():
            if doc.wanted_page(p.index):
                yield from _isolated(doc, f"page {p.index}", self.rows(doc, p))


def _objects(doc: Document) -> Iterator[tuple]:
    for num, gen, v in _numbers(doc):
        own = v.dict if isinstance(v, Stream) else v
        kind = own.get("Type") if isinstance(own, dict) else None
        yield num, gen, type(v).__name__.lower(), str(kind) if isinstance(kind, Name) else None, to_json(v)


def _object_refs(doc: Document) -> Iterator[tuple]:
    for path, r in references_in({k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "Encrypt")}):
        yield 0, 0, path, r.num, r.gen
    for num, gen, v in _numbers(doc):
        for path, r in references_in(v):
            yield num, gen, path, r.num, r.gen


def _streams(doc: Document) -> Iterator[tuple]:
    for num, gen, v in _numbers(doc):
        if isinstance(v, Stream):
            try:
                data, image = doc.decoded_image(v)
            except FilterError as e:
                doc.fault(f"stream {num}: {e}")
                data, image = None, None
            yield num, gen, to_json({k: x for k, x in v.dict.items() if k != "Length"}), doc.filters_of(v)[0], image, v.raw, data, None if data is None else hashlib.sha256(data).hexdigest()


def _pages(doc: Document) -> Iterator[tuple]:
    for p in doc.pages():
        yield p.index, p.ref.num if p.ref else None, p.media_box, p.crop_box, p.rotation, p.user_unit, doc.get(p.dict, "StructParents", int)


@ByPage
def _operations(doc: Document, p: Page) -> Iterator[tuple]:
    for i, (op, args, at) in enumerate(operators(doc.content(p), doc.lenient)):
        yield p.index, i, op, to_json(args), at


@dataclass(frozen=True)
class Marks:
    """Rows of a table of marks: what one mark of ``kind`` gives after page and order."""

    kind: str
    rows: Callable[[dict], Iterator[tuple]]

    def __call__(self, doc: Document) -> Iterator[tuple]:
        for _, row in marks_of(doc, {"": self}):
            yield row


def marks_of(doc: Document, wanted: dict[str, Marks]) -> Iterator[tuple[str, tuple]]:
    """(table, row) of all wanted tables of marks, running every page once."""
    kinds = frozenset(m.kind for m in wanted.values())
    detailed = any(m is _glyphs for m in wanted.values())
    for p in doc.pages():
        if not doc.wanted_page(p.index):
            continue
        done = dict.fromkeys(kinds, 0)
        try:
            for kind, mark in Interpreter(doc, p, kinds, detailed).run():
                done[kind] += 1
                yield from _mark_rows(doc, p, kind, mark, wanted)
        except FAULTS:
            if not doc.lenient:
                raise
            # what one kind of marks stumbles over must not cost the others theirs: each goes on alone
            for kind in sorted(kinds):
                rest = itertools.islice(Interpreter(doc, p, frozenset({kind}), detailed).run(), done[kind], None)
                yield from _isolated(doc, f"page {p.index}, {kind} marks", (row for k, mark in rest for row in _mark_rows(doc, p, k, mark, wanted)))


def _mark_rows(doc: Document, p: Page, kind: str, mark: dict, wanted: dict[str, Marks]) -> Iterator[tuple[str, tuple]]:
    for name, table in wanted.items():
        if table.kind == kind:
            yield from _isolated(doc, f"page {p.index}, {name}", ((name, (p.index, mark["ord"], *row)) for row in table.rows(mark)))


def _marks(kind: str, row: Callable[[dict], tuple]) -> Marks:
    return Marks(kind, lambda m: iter((row(m),)))


#: The last style shown, and how; styles are replaced, never changed, so marks that follow each other mostly have the same.
_SHOWN: list = [None, ""]


def _style(m: dict) -> str:
    if (style := m["style"]) is not _SHOWN[0]:
        _SHOWN[:] = style, to_json(style)
    return _SHOWN[1]


def _segments(m: dict) -> list[dict]:
    return [{"op": o, "points": list(q)} for o, q in m["segments"]]


_glyphs = Marks("text", lambda m: ((i, g["code"], g["text"], g["cid"], g["gid"], g["width"], g["x"], g["y"], g["word_space"]) for i, g in enumerate(m["glyphs"])))


def _outlines(doc: Document) -> Iterator[tuple]:
    for i, o in enumerate(doc.outlines()):
        target = doc.destination(o["destination"])
        yield i, o["level"], o["title"], o["expanded"], o["bold"], o["italic"], o["color"], None if target is None else to_json(target)


def _tree(kinds: tuple[str, ...]) -> Callable[[Document], Iterator[tuple]]:
    def scan(doc: Document) -> Iterator[tuple]:
        for kind in kinds:
            for i, (key, value) in enumerate(doc.names(kind)):
                yield kind, i, key, to_json(value)

    return scan


def _labels(doc: Document) -> Iterator[tuple]:
    for r in doc.page_labels():
        yield r["start"], r["style"], r["prefix"], r["first"]


def _structure(doc: Document) -> Iterator[tuple]:
    for i, s in enumerate(doc.structure()):
        yield i, s["level"], s["type"], s["tag"], s["num"], s["parent"], s["page"], s["mcid"]


@ByPage
def _annotations(doc: Document, p: Page) -> Iterator[tuple]:
    for a in doc.annotations(p):
        yield p.index, a["index"], a["num"], a["subtype"], a["rect"], a["flags"], a["contents"], to_json(a["dict"])


@ByPage
def _appearances(doc: Document, p: Page) -> Iterator[tuple]:
    for a in doc.annotations(p):
        if found := doc.appearance(a):
            visible = "OC" not in a["dict"] or doc.content_visible(a["dict"]["OC"])
            yield p.index, a["index"], found["state"], found["num"], found["matrix"], visible


def _image_pixels(doc: Document) -> Iterator[tuple]:
    from quire.sources.pdf.images import CodedImage, image_bands

    for num, _, v in _numbers(doc):
        if isinstance(v, Stream) and v.dict.get("Subtype") == "Image":
            try:
                for first, band in image_bands(doc, v):
                    for i, row in enumerate(band):
                        yield num, first + i, row.tobytes()
            except CodedImage:
                continue
            except (PdfError, FilterError) as e:
                doc.fault(f"image {num}: {e}")


def _actions(doc: Document) -> Iterator[tuple]:
    sources = [("open", doc.catalog.get("OpenAction"))]
    sources += [(f"annotation {p.index} {a['index']}", a["dict"].get("A")) for p in doc.pages() for a in doc.annotations(p)]
    sources += [(f"outline {i}", o["dict"].get("A")) for i, o in enumerate(doc.outlines())]
    for source, first in sources:
        for i, a in enumerate(doc.actions(first)):
            uri = doc.get(a["dict"], "URI", bytes)
            yield source, i, a["type"], None if uri is None else decode_text(uri), to_json(a["dict"])


def _fields(doc: Document) -> Iterator[tuple]:
    form = doc.get(doc.catalog, "AcroForm", dict, {})
    pending, i = list(reversed(doc.get(form, "Fields", list, []))), 0
    while pending:
        ref = pending.pop()
        node = doc.resolve(ref)
        if not isinstance(node, dict):
            continue
        kids = doc.get(node, "Kids", list, [])
        if kids and any("T" in (doc.resolve(k) or {}) for k in kids):
            pending += reversed(kids)
            continue
        own = doc.field(node)
        value = own.get("V")
        yield i, ref.num if isinstance(ref, Ref) else None, own["name"], None if own.get("FT") is None else str(own["FT"]), decode_text(value) if isinstance(value, bytes) else None if value is None else to_json(value), own.get("Ff", 0)
        i += 1


def _fonts(doc: Document) -> Iterator[tuple]:
    from quire.sources.pdf.fonts import Font

    for num, _, v in _numbers(doc):
        if isinstance(v, dict) and v.get("Type") == "Font" and not str(v.get("Subtype", "")).startswith("CIDFont"):
            f = Font(doc, v, num)
            yield num, f.name, f.subtype, f.vertical, f.to_unicode is not None, f.default


def _images(doc: Document) -> Iterator[tuple]:
    for num, _, v in _numbers(doc):
        if isinstance(v, Stream) and v.dict.get("Subtype") == "Image":
            space = doc.get(v, "ColorSpace", (Name, list))
            yield num, doc.get(v, "Width", int), doc.get(v, "Height", int), doc.get(v, "BitsPerComponent", int), to_json(space), doc.get(v, "ImageMask", bool, False), doc.filters_of(v)[0], len(v.raw)


def _image_files(doc: Document) -> Iterator[tuple]:
    from quire.sources.pdf.images import CodedImage, decode_image, encode_png, is_photographic

    for num, _, v in _numbers(doc):
        if isinstance(v, Stream) and v.dict.get("Subtype") == "Image":
            try:
                pixels = decode_image(doc, v)
                yield num, pixels.shape[1], pixels.shape[0], "png", encode_png(pixels), is_photographic(pixels)
            except CodedImage as e:
                yield num, doc.get(v, "Width", int), doc.get(v, "Height", int), e.coding, doc.decoded(v), None
            except (PdfError, FilterError) as e:
                doc.fault(f"image {num}: {e}")


def _metadata(doc: Document) -> Iterator[tuple]:
    if (data := doc.metadata()) is not None:
        yield data, hashlib.sha256(data).hexdigest()


def _number_tree(doc: Document) -> Iterator[tuple]:
    for tree, root in (("PageLabels", doc.catalog.get("PageLabels")), ("ParentTree", doc.get(doc.get(doc.catalog, "StructTreeRoot", dict, {}), "ParentTree", dict))):
        for i, (key, value) in enumerate(doc.number_tree(root)):
            yield tree, i, key, to_json(value)


def _structure_attributes(doc: Document) -> Iterator[tuple]:
    """Attributes of the classes first, then the element's own, without merging."""
    classes = doc.get(doc.get(doc.catalog, "StructTreeRoot", dict, {}), "ClassMap", dict, {})
    for num, _, v in _numbers(doc):
        if not isinstance(v, dict) or "S" not in v or not (v.get("Type") == "StructElem" or "P" in v):
            continue
        listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        held = [(str(doc.resolve(c)), a) for c in listed(doc.resolve(v.get("C"))) if not isinstance(c, int) for a in listed(doc.resolve(classes.get(str(doc.resolve(c)))))]
        held += [(None, a) for a in listed(doc.resolve(v.get("A")))]
        for i, (name, a) in enumerate((n, own) for n, own in ((n, doc.resolve(a)) for n, a in held) if isinstance(own, dict)):
            yield num, i, str(doc.get(a, "O", Name, "")), name, doc.get(v, "R", int, 0), to_json(a)


def _destinations(doc: Document) -> Iterator[tuple]:
    pages = {p.ref: p.index for p in doc.pages() if p.ref}
    for kind, name, held in doc.named_destinations():
        if held is None:
            doc.fault("a destination is not found")
            continue
        numbers = [doc.resolve(v) for v in held[2:]]
        yield kind, name, pages.get(held[0]), str(doc.resolve(held[1])), [float(v) if isinstance(v, (int, float)) else None for v in numbers]


def _links(doc: Document) -> Iterator[tuple]:
    pages = {p.ref: p.index for p in doc.pages() if p.ref}

    def on_page(doc: Document, p: Page) -> Iterator[tuple]:
        for a in doc.annotations(p):
            if a["subtype"] != "Link":
                continue
            action = doc.get(a["dict"], "A", dict, {})
            held = doc.destination(a["dict"].get("Dest", action.get("D") if action.get("S") == "GoTo" else None))
            uri = doc.get(action, "URI", bytes)
            yield p.index, a["index"], a["rect"], pages.get(held[0]) if held else None, None if uri is None else decode_text(uri), str(action.get("S")) if action else None

    yield from ByPage(on_page)(doc)


def _renditions(doc: Document) -> Iterator[tuple]:
    for kind, own in [("tree", v) for _, v in doc.names("Renditions")] + [("action", v.get("R")) for _, _, v in _numbers(doc) if isinstance(v, dict) and v.get("S") == "Rendition"]:
        pending = [(doc.rendition(own), 0)]
        i = 0
        while pending:
            r, depth = pending.pop()
            if r:
                file = r["file"] or {}
                yield kind, i, depth, r["subtype"], r["name"], r["clip"], r["content_type"], file.get("file_name"), file["stream"].num if file.get("stream") else None
                pending += [(x, depth + 1) for x in reversed(r["alternatives"])]
                i += 1


_MATRIX = "matrix array<double>"
#: Table name: (columns after doc_id, generator of rows).
TABLES: dict[str, tuple[str, Callable[[Document], Iterator[tuple]]]] = {
    "documents": ("length long, version string, encrypted boolean, revision int, permissions long, owner boolean, title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string, trapped string, custom map<string,string>, trailer_json string, n_pages int", _documents),
    "xref": ("rev int, num long, kind int, position long, gen long", _xref),
    "objects": ("num long, gen long, kind string, type string, value_json string", _objects),
    "object_refs": ("src_num long, src_gen long, path string, dst_num long, dst_gen long", _object_refs),
    "streams": ("num long, gen long, dict_json string, filters array<string>, image_filter string, raw binary, decoded binary, sha256 string", _streams),
    "pages": ("page_index int, num long, media_box array<double>, crop_box array<double>, rotation int, user_unit double, struct_parents long", _pages),
    "operations": ("page_index int, ord int, operator string, operands_json string, offset long", _operations),
    "text_marks": (f"page_index int, ord int, text string, font_num long, font string, {_MATRIX}, size double, h_scale double, mode int, replacement string, mcid long, style_json string", _marks("text", lambda m: (m["text"], m["font_num"], m["font"], m["matrix"], m["size"], m["h_scale"], m["mode"], m["replacement"], m["mcid"], _style(m)))),
    "glyphs": ("page_index int, ord int, i int, code long, text string, cid int, gid int, width double, x double, y double, word_space boolean", _glyphs),
    "path_marks": ("page_index int, ord int, segments array<struct<op:string,points:array<double>>>, even_odd boolean, fill boolean, stroke boolean, mcid long, style_json string, fill_rgb array<double>, stroke_rgb array<double>, clips array<int>", _marks("path", lambda m: (_segments(m), m["even_odd"], m["fill"], m["stroke"], m["mcid"], _style(m), m["fill_rgb"], m["stroke_rgb"], m["clips"]))),
    "clip_paths": ("page_index int, ord int, segments array<struct<op:string,points:array<double>>>, even_odd boolean, text_ords array<int>, clips array<int>", _marks("clip", lambda m: (_segments(m), m["even_odd"], m["text_ords"], m["clips"]))),
    "shading_marks": (f"page_index int, ord int, num long, type int, color_space string, {_MATRIX}, coords array<double>, domain array<double>, extend array<boolean>, bbox array<double>, background array<double>, colors array<array<double>>, vertices array<array<double>>", _marks("shading", lambda m: (m["num"], m["kind"], m["space"], m["matrix"], m["coords"], m["domain"], m["extend"], m["bbox"], m["background"], m["colors"], m["vertices"]))),
    "pattern_marks": (f"page_index int, ord int, num long, type int, fill boolean, paint_type int, {_MATRIX}, bbox array<double>, x_step double, y_step double, colors array<double>", _marks("pattern", lambda m: (m["num"], m["kind"], m["fill"], m["paint_type"], m["matrix"], m["bbox"], m["x_step"], m["y_step"], m["colors"]))),
    "image_marks": (f"page_index int, ord int, image_num long, {_MATRIX}, width long, height long, mcid long, style_json string, clips array<int>", _marks("image", lambda m: (m["num"], m["matrix"], m["width"], m["height"], m["mcid"], _style(m), m["clips"]))),
    "group_marks": (f"page_index int, ord int, form_num long, kind string, {_MATRIX}, style_json string", _marks("group", lambda m: (m["num"], m["group"], m["matrix"], _style(m)))),
    "marked_content": ("page_index int, ord int, operator string, tag string, properties_json string, depth int, hidden boolean", _marks("content", lambda m: (m["operator"], m["tag"], None if m["properties"] is None else to_json(m["properties"]), m["depth"], m["hidden"]))),
    "outlines": ("ord int, level int, title string, expanded boolean, bold boolean, italic boolean, color array<double>, destination_json string", _outlines),
    "name_tree": ("tree string, ord int, key binary, value_json string", _tree(("Dests", "EmbeddedFiles", "JavaScript", "AP", "Pages", "Templates", "IDS", "URLS", "Renditions"))),
    "page_label_ranges": ("start long, style string, prefix string, first long", _labels),
    "structure_items": ("ord int, level int, type string, tag string, num long, parent_num long, page_num long, mcid long", _structure),
    "number_tree": ("tree string, ord int, key long, value_json string", _number_tree),
    "metadata": ("data binary, sha256 string", _metadata),
    "output_intents": ("subtype string, condition string, identifier string, registry string, info string, profile_num long, components int", lambda doc: (tuple(v.values()) for v in doc.output_intents())),
    "structure_ids": ("id binary, element_num long", lambda doc: doc.structure_ids()),
    "structure_parents": ("key long, mcid long, element_num long", lambda doc: doc.structure_parents()),
    "annotations": ("page_index int, index int, num long, subtype string, rect array<double>, flags long, contents string, dict_json string", _annotations),
    "appearances": (f"page_index int, index int, state string, stream_num long, {_MATRIX}, visible boolean", _appearances),
    "actions": ("source string, ord int, type string, uri string, dict_json string", _actions),
    "fields": ("ord int, num long, name string, type string, value string, flags long", _fields),
    "fonts": ("num long, name string, subtype string, vertical boolean, has_unicode_map boolean, default_width double", _fonts),
    "images": ("num long, width long, height long, bits long, color_space_json string, mask boolean, filters array<string>, bytes long", _images),
    "image_files": ("num long, width long, height long, coding string, data binary, photographic boolean", _image_files),
    "image_pixels": ("num long, row int, rgba binary", _image_pixels),
    "structure_attributes": ("element_num long, ord int, owner string, class string, revision int, dict_json string", _structure_attributes),
    "named_destinations": ("kind string, name binary, page_index int, mode string, parameters array<double>", _destinations),
    "links": ("page_index int, index int, rect array<double>, target_page int, uri string, action string", _links),
    "renditions": ("source string, ord int, depth int, subtype string, name string, clip string, content_type string, file_name string, stream_num long", _renditions),
    "embedded_files": ("name binary, file_name string, description string, stream_num long", lambda doc: ((e["name"], e["file_name"], e["description"], e["stream"].num if e["stream"] else None) for e in doc.embedded_files())),
}


DIAGNOSTICS = "page int, offset long, message string"


def _columns(table: str) -> str:
    if table != "diagnostics" and table not in TABLES:
        raise ValueError(f"no table {table}; there are diagnostics, {', '.join(TABLES)}")
    return DIAGNOSTICS if table == "diagnostics" else TABLES[table][0]


def rows_of(doc: Document, tables: list[str]) -> Iterator[tuple[str, tuple]]:
    """(table, row) of a document; diagnostics come last and tell of every table.

    A fault ends only the table, page or object it is met in, and is told by that
    name, so a table's rows are the same whichever tables are read with it.
    """
    told = "diagnostics" in tables
    wanted = list(TABLES) if told else tables
    marks = {t: TABLES[t][1] for t in wanted if isinstance(TABLES[t][1], Marks)}
    for name in wanted:
        if name not in marks:
            for row in _isolated(doc, name, TABLES[name][1](doc)):
                if name in tables:
                    yield name, row
    if marks:
        for name, row in _isolated(doc, "marks", marks_of(doc, marks)):
            if name in tables:
                yield name, row
    if told:
        for note in dict.fromkeys(doc.notes):
            yield "diagnostics", note


def _size(v: object) -> int:
    """About how many bytes a value takes."""
    if isinstance(v, (bytes, str)):
        return len(v)
    held, size = v.items() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else (), 8
    for x in held:
        kind = type(x)
        size += len(x) if kind is str or kind is bytes else 8 if kind is int or kind is float or x is None else _size(x)
    return size


def _read(files: DataFrame, tables: list[str], ddl: str, row_of: Callable[[str, tuple], tuple | list], mode: str, password: str) -> DataFrame:
    lenient = mode.upper() == "PERMISSIVE"
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], ddl).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for name, row in rows_of(Document(content.as_py() or b"", password, lenient), tables):
                        out.append((doc_id, *row_of(name, row)))
                        size += _size(row)
                        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(out, schema)
                            out, size = [], 0
                except FAULTS as e:
                    if not lenient:
                        raise
                    if "diagnostics" in tables:
                        out.append((doc_id, *row_of("diagnostics", (-1, getattr(e, "offset", -1), str(e) or type(e).__name__))))
        if out:
            yield _batch(out, schema)

    return files.select("doc_id", "content").mapInArrow(read, ddl)


def scan(files: DataFrame, table: str, mode: str = "PERMISSIVE", password: str = "", columns: list[str] | None = None) -> DataFrame:
    """One of ``TABLES``, or ``diagnostics`` (page, offset, message), over all files; ``columns``: of those after doc_id, the ones to hand over, in order."""
    own = files.sparkSession.createDataFrame([], _columns(table)).schema
    wanted = own.names if columns is None else columns
    at = [own.names.index(c) for c in wanted]
    ddl = ", ".join([f"doc_id {files.schema['doc_id'].dataType.simpleString()}", *[f"`{c}` {own[c].dataType.simpleString()}" for c in wanted]])
    return _read(files, [table], ddl, (lambda _, row: row) if columns is None else lambda _, row: [row[i] for i in at], mode, password)


def scan_together(files: DataFrame, tables: list[str], mode: str = "PERMISSIVE", password: str = "", columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Several tables from one reading of the files, each document parsed and each page run once.

    The rows of all tables are written to the checkpoint folder together, each in
    the column of its table; a table is then a filter and a projection. ``columns``: by
    table, those after doc_id that are written, in order; all where it is not named.
    """
    whole = {t: files.sparkSession.createDataFrame([], _columns(t)).schema for t in tables}
    names = {t: (columns or {}).get(t, whole[t].names) for t in tables}
    at = {t: [whole[t].names.index(c) for c in names[t]] for t in tables}
    ddl = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{t}` struct<{', '.join(f'`{c}`: {whole[t][c].dataType.simpleString()}' for c in names[t])}>" for t in tables)
    place = {t: i for i, t in enumerate(tables)}

    def row_of(name: str, row: tuple) -> list:
        out: list = [None] * len(tables)
        out[place[name]] = {c: _arrow(row[i]) for c, i in zip(names[name], at[name], strict=True)}
        return out

    held = cut_lineage(_read(files, tables, ddl, row_of, mode, password))
    return {t: held.where(F.col(t).isNotNull()).select("doc_id", f"{t}.*") for t in tables}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    # numbers and bytes need no look at each value
    plain = [pa.types.is_primitive(f.type) or pa.types.is_binary(f.type) for f in schema]
    columns = zip(schema, plain, zip(*rows, strict=True), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(column if same else [_arrow(v) for v in column], f.type) for f, same, column in columns], schema=schema)


def _arrow(v: object) -> object:
    kind = type(v)
    if kind is str or kind is int or kind is bytes or v is None:
        return v
    return str(v) if isinstance(v, Name) else list(v.items()) if isinstance(v, CustomMap) else v


def from_text(docs: DataFrame, lines_per_page: int = 60) -> DataFrame:
    """doc_id and content: a document that shows each row's text, line by line."""
    from quire.sources.pdf.write import text_document

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size, first = [], 0, 0
            for at in range(batch.num_rows):
                lines = (batch.column(1)[at].as_py() or "").split("\n")
                made.append(text_document([lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)]))
                size += len(made[-1])
                if size >= MADE_BYTES or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), pa.array(made, pa.binary())], names=["doc_id", "content"])
                    made, size, first = [], 0, at + 1

    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {id_type}, content binary")


def rewritten(files: DataFrame, optimise: bool = True, password: str = "") -> DataFrame:
    """doc_id, content, and the counters of rewriting; documents that cannot be read keep their bytes."""
    from quire.sources.pdf.write import rewrite

    id_type = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    out, r = rewrite(Document(data, password, True), optimise=optimise)
                    row = (out, r.objects, r.removed, r.merged, r.compressed, len(data), len(out), None)
                except FAULTS as e:
                    row = (data, 0, 0, 0, 0, len(data), len(data), str(e) or type(e).__name__)
                names = ("content", "objects", "removed", "merged", "compressed", "bytes_in", "bytes_out", "fault")
                types = (pa.binary(), *[pa.int64()] * 6, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], batch.schema.field(0).type), *[pa.array([v], t) for v, t in zip(row, types, strict=True)]], names=["doc_id", *names])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {id_type}, content binary, objects long, removed long, merged long, compressed long, bytes_in long, bytes_out long, fault string")


EDIT_KINDS = ("info", "attachment", "outline_title", "content", "link", "remove_link", "text", "label", "drop", "compact")


def edited(files: DataFrame, edits: DataFrame, password: str = "", mode: str = "FAILFAST") -> DataFrame:
    """doc_id, content and fault of every file, rewritten with the edits of its document.

    ``edits``: doc_id, kind (of ``EDIT_KINDS``), page, index, name, value: ``info``
    and ``attachment`` by name, ``outline_title`` by index, ``content`` by page,
    ``link`` and ``remove_link`` by page and index, ``text`` by page and the text
    object's index, ``label`` by first page with ``name`` as style, ``value`` as
    prefix and ``index`` as first number, ``drop`` by name, ``compact`` for the whole
    document. The edits of a document
    are gathered beside it, in order. Documents without edits keep their bytes.
    With ``mode="PERMISSIVE"`` a document whose edits do not apply keeps its
    bytes and tells why in ``fault``.
    """
    from quire.sources.pdf.write import Edits, rewrite

    id_type = files.schema["doc_id"].dataType.simpleString()
    item = F.struct("kind", "page", "index", "name", "value")
    gathered = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("edits"))

    def made(rows: list[dict]) -> Edits:
        out = Edits()
        for r in rows:
            kind, page, index, name, value = (r[k] for k in ("kind", "page", "index", "name", "value"))
            if kind == "info":
                out.info = (out.info or {}) | {name: value}
            elif kind == "attachment":
                out.attachments = (out.attachments or {}) | {name: value.encode("utf-8")}
            elif kind == "outline_title":
                out.outline_titles[index] = value
            elif kind == "content":
                out.content[page] = value.encode("latin-1")
            elif kind in ("link", "remove_link"):
                out.links[page, index] = value if kind == "link" else None
            elif kind == "text":
                out.text.setdefault(page, {})[index] = value
            elif kind == "label":
                out.labels = [*(out.labels or []), (page, name, value, index)]
            elif kind == "drop":
                out.drop += (name,)
            elif kind == "compact":
                out.compact = True
            else:
                raise PdfError(f"an unknown kind of edit {kind}")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows, fault = batch.column(1)[i].as_py() or b"", batch.column(2)[i].as_py(), None
                try:
                    out = rewrite(Document(data, password), made(rows))[0] if rows else data
                except FAULTS as e:
                    if mode.upper() != "PERMISSIVE":
                        raise
                    out, fault = data, str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([out], pa.binary()), pa.array([fault], pa.string())], names=["doc_id", "content", "fault"])

    return files.select("doc_id", "content").join(gathered, "doc_id", "left").mapInArrow(run, f"doc_id {id_type}, content binary, fault string")
