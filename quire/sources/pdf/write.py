"""Writing documents: build, rewrite and optimise."""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from quire.functions.filters import flate_encode
from quire.sources.pdf.document import Document
from quire.sources.pdf.objects import Name, PdfError, Ref, Stream, references_in, to_json, write_value

DEGREE = 64
#: Operators that show text, and the first text mode that clips.
SHOWS, FIRST_CLIP = frozenset(("Tj", "TJ", "'", '"')), 4
#: Streams with one of these keys have an identity and are never merged.
IDENTITY_KEYS = ("StructParent", "StructParents", "ID", "OPI", "F", "Ref")


def write_file(objects: dict[int, object], trailer: dict, version: str = "1.7", classic: bool = True) -> bytes:
    """A whole file; objects in number order, with a table or a stream of cross-references."""
    out, places = bytearray(b"%PDF-" + version.encode() + b"\n%\xe2\xe3\xcf\xd3\n"), {}
    for num in sorted(objects):
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + write_value(objects[num]) + b"\nendobj\n"
    size = max(objects, default=0) + 1
    at = len(out)
    if classic:
        out += b"xref\n0 %d\n" % size
        for num in range(size):
            out += b"%010d 00000 n \n" % places[num] if num in places else b"0000000000 65535 f \n"
        out += b"trailer\n" + write_value(trailer | {"Size": size}) + b"\n"
    else:
        places[size] = at
        rows = b"".join((b"\1" + places[n].to_bytes(8, "big") if n in places else bytes(9)) + b"\0\0" for n in range(size + 1))
        own = trailer | {"Type": Name("XRef"), "Size": size + 1, "W": [1, 8, 2], "Filter": Name("FlateDecode")}
        out += b"%d 0 obj\n" % size + write_value(Stream(own, flate_encode(rows))) + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def reachable(doc: Document) -> dict[int, object]:
    """Objects that the trailer leads to, in the order they are met."""
    out: dict[int, object] = {}
    pending = deque(r for k in ("Root", "Info") for _, r in references_in(doc.trailer.get(k)))
    while pending:
        ref = pending.popleft()
        if ref.num in out:
            continue
        value = doc.object(ref.num, ref.gen)
        if value is None:
            continue
        out[ref.num] = value
        pending.extend(r for _, r in references_in(value))
    return out


def with_references(v: object, change) -> object:
    """A value with every reference passed through ``change``."""
    if isinstance(v, Ref):
        return change(v)
    if isinstance(v, list):
        return [with_references(x, change) for x in v]
    if isinstance(v, dict):
        return {k: with_references(x, change) for k, x in v.items()}
    if isinstance(v, Stream):
        return Stream(with_references(v.dict, change), v.raw, v.num, v.gen)
    return v


def stream_key(v: Stream, content: str | None = None) -> str | None:
    """Hash by which equal streams merge, or None for one with an identity; ``content`` is that of its bytes, if known."""
    if any(k in v.dict for k in IDENTITY_KEYS):
        return None
    own = {k: x for k, x in v.dict.items() if k != "Length"}
    return hashlib.sha256(to_json(own).encode() + b"\0" + (content or hashlib.sha256(v.raw).hexdigest()).encode()).hexdigest()


def aliases(objects: dict[int, object]) -> dict[int, int]:
    """Number of each repeated stream to that of the first equal one, as references settle.

    Only streams whose bytes and keys have an equal are looked at again; their
    bytes are hashed once.
    """
    raw = {n: hashlib.sha256(v.raw).hexdigest() for n, v in objects.items() if isinstance(v, Stream)}
    alike: dict[tuple, list[int]] = {}
    for num, content in raw.items():
        alike.setdefault((content, *sorted(objects[num].dict)), []).append(num)
    open_ = sorted((n for group in alike.values() if len(group) > 1 for n in group), key=list(objects).index) if len(alike) < len(raw) else []
    out: dict[int, int] = {}
    while True:
        first: dict[str, int] = {}
        found = dict(out)
        for num in open_:
            if num not in out:
                v = objects[num]
                key = stream_key(Stream(with_references(v.dict, lambda r: Ref(out.get(r.num, r.num), r.gen)), b"", v.num, v.gen), raw[num])
                if key is not None and first.setdefault(key, num) != num:
                    found[num] = first[key]
        if found == out:
            return out
        out = found


@dataclass
class Edits:
    """Changes to make while rewriting.

    ``links``: (page, index of the annotation) to a URI, or to None to take the link
    out. ``text``: page to texts that replace text objects by their order.
    ``images``: object number to RGBA pixels. ``labels``: page label ranges (start,
    style, prefix, first). ``drop``: keys of the catalogue to leave out. ``compact``
    joins neighbouring text objects on every page.
    """

    info: dict[str, str] | None = None
    attachments: dict[str, bytes] | None = None
    outline_titles: dict[int, str] = field(default_factory=dict)
    content: dict[int, bytes] = field(default_factory=dict)
    links: dict[tuple[int, int], str | None] = field(default_factory=dict)
    text: dict[int, dict[int, str]] = field(default_factory=dict)
    images: dict[int, np.ndarray] = field(default_factory=dict)
    labels: list[tuple[int, str, str, int]] | None = None
    drop: tuple[str, ...] = ()
    compact: bool = False


@dataclass
class Report:
    objects: int = 0
    removed: int = 0
    merged: int = 0
    compressed: int = 0
    bytes_in: int = 0
    bytes_out: int = 0
    signed: bool = False


def is_signed(doc: Document, objects: dict[int, object]) -> bool:
    return any(isinstance(v, dict) and v.get("Type") == "Sig" and "ByteRange" in v for v in objects.values())


def balanced_kids(count: int, degree: int = DEGREE) -> list[list[tuple[int, int]]]:
    """Levels of (first, stop) over the level below, until one node is left."""
    levels = []
    while count > 1 or not levels:
        levels.append([(i, min(i + degree, count)) for i in range(0, count, degree)])
        count = len(levels[-1])
        if count <= 1:
            break
    return levels


def rewrite(doc: Document, edits: Edits | None = None, optimise: bool = False) -> tuple[bytes, Report]:
    """The document written anew with ``edits``; optimising drops, merges and compresses.

    A signed document is returned as it was, unless edits are asked for.
    """
    objects = reachable(doc)
    report = Report(bytes_in=len(doc.data), removed=sum(e.kind != 0 for e in doc.xref.values()) - len(objects))
    if is_signed(doc, objects):
        if edits:
            raise PdfError("a signed document is not edited")
        return doc.data, Report(len(objects), signed=True, bytes_in=len(doc.data), bytes_out=len(doc.data))
    same: dict[int, int] = {}
    if optimise:
        same = aliases(objects)
        report.merged = len(same)
        objects = {n: v for n, v in objects.items() if n not in same}
    numbers = {old: i + 1 for i, old in enumerate(objects)}
    change = lambda r: Ref(numbers[same.get(r.num, r.num)], 0) if same.get(r.num, r.num) in numbers else None
    out = {numbers[n]: with_references(v, change) for n, v in objects.items()}
    trailer = {k: with_references(doc.trailer[k], change) for k in ("Root", "Info", "ID") if k in doc.trailer}
    if edits:
        _edit(doc, out, trailer, edits, change)
    if optimise:
        balance_pages(doc, out, change)
    for v in out.values():
        if optimise and isinstance(v, Stream) and "Filter" not in v.dict and "F" not in v.dict and len(packed := flate_encode(v.raw)) < len(v.raw):
            v.raw, v.dict = packed, v.dict | {"Filter": Name("FlateDecode")}
            report.compressed += 1
    data = write_file(out, trailer, max(doc.version, "1.5") if optimise else doc.version, classic=not optimise)
    report.objects, report.bytes_out = len(out), len(data)
    return data, report


def balance_pages(doc: Document, out: dict[int, object], change) -> None:
    """Puts the pages under a tree of ``DEGREE`` kids a node; inherited values go to the pages."""
    pages = list(doc.pages())
    refs = [change(p.ref) if p.ref else None for p in pages]
    root = change(doc.catalog["Pages"]) if isinstance(doc.catalog.get("Pages"), Ref) else None
    # pages shared by several places of the tree, or written inside their parent, stay as they are
    if root is None or None in refs or len({r.num for r in refs}) != len(refs) or len(pages) <= DEGREE:
        return
    above: dict[int, dict] = {}
    inner: set[int] = set()

    def walk(node: object, held: dict) -> None:
        pending = [(node, held)]
        while pending:
            ref, held = pending.pop()
            own = doc.resolve(ref)
            held = held | {k: own[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in own}
            if "Kids" in own:
                inner.add(change(ref).num)
                pending += [(kid, held) for kid in doc.resolve(own["Kids"])]
            else:
                above[ref.num] = held

    walk(doc.catalog["Pages"], {})
    keys = ("MediaBox", "CropBox", "Rotate", "Resources")
    for p, ref in zip(pages, refs, strict=True):
        out[ref.num] = {k: v for k, v in out[ref.num].items() if k not in keys} | with_references(above[p.ref.num], change)
    for num in inner - {root.num}:
        del out[num]
    level, numbers = [(ref, 1) for ref in refs], itertools.count(max(out) + 1)
    while len(level) > 1:
        spans, top = balanced_kids(len(level))[0], len(level) <= DEGREE
        above_level = []
        for start, stop in spans:
            node = root if top else Ref(next(numbers), 0)
            count = sum(n for _, n in level[start:stop])
            out[node.num] = {"Type": Name("Pages"), "Kids": [r for r, _ in level[start:stop]], "Count": count}
            for r, _ in level[start:stop]:
                out[r.num] = out[r.num] | {"Parent": node}
            above_level.append((node, count))
        level = above_level


def _edit(doc: Document, out: dict[int, object], trailer: dict, edits: Edits, change) -> None:
    from quire.functions.filters import encode_text

    numbers = itertools.count(max(out, default=0) + 1)
    fresh = lambda v: (out.__setitem__(n := next(numbers), v), Ref(n, 0))[1]
    if edits.info is not None:
        held = trailer.get("Info")
        own = (out.get(held.num) if isinstance(held, Ref) else held) or {}
        own = own | {k: encode_text(v) for k, v in edits.info.items()}
        if isinstance(held, Ref):
            out[held.num] = own
        else:
            trailer["Info"] = fresh(own)
    if edits.attachments is not None:
        held = []
        for name in sorted(edits.attachments):
            data = edits.attachments[name]
            stream = fresh(Stream({"Type": Name("EmbeddedFile"), "Params": {"Size": len(data)}}, data))
            held += [name.encode(), fresh({"Type": Name("Filespec"), "F": encode_text(name), "UF": encode_text(name), "EF": {"F": stream}})]
        root = out[trailer["Root"].num]
        names = dict(doc.get(doc.catalog, "Names", dict, {}))
        root["Names"] = with_references({k: v for k, v in names.items() if k != "EmbeddedFiles"}, change) | {"EmbeddedFiles": {"Names": held}}
    titles = edits.outline_titles
    for i, item in enumerate(doc.outlines()) if titles else ():
        if i in titles:
            if not isinstance(item["ref"], Ref):
                raise PdfError(f"outline item {i} is no object of its own")
            out[change(item["ref"]).num]["Title"] = encode_text(titles[i])
    _edit_pages(doc, out, edits, change, fresh)
    for num, pixels in sorted(edits.images.items()):
        to = change(Ref(num, 0))
        if to is None or not isinstance(out.get(to.num), Stream) or out[to.num].dict.get("Subtype") != "Image":
            raise PdfError(f"no image {num} to replace")
        colors, alpha = create_image(pixels)
        out[to.num] = Stream(colors.dict | ({"SMask": fresh(alpha)} if alpha else {}), colors.raw)
    root = out[trailer["Root"].num]
    if edits.labels is not None:
        ranges = [v for start, style, prefix, first in sorted(edits.labels) for v in (start, ({"S": Name(style)} if style else {}) | ({"P": encode_text(prefix)} if prefix else {}) | ({"St": first} if first != 1 else {}))]
        root["PageLabels"] = {"Nums": ranges}
    for key in edits.drop:
        root.pop(key, None)


def _edit_pages(doc: Document, out: dict[int, object], edits: Edits, change, fresh) -> None:
    """Content, replaced text and links, pages in order and links by their index."""
    wanted = {*edits.content, *edits.text, *(page for page, _ in edits.links)}
    met = set()
    for page in doc.pages() if wanted or edits.compact else ():
        if not page.ref or not (edits.compact or page.index in wanted):
            continue
        met.add(page.index)
        own = out[change(page.ref).num]
        if edits.compact or page.index in edits.content or page.index in edits.text:
            data = replace_text(edits.content.get(page.index, doc.content(page)), edits.text.get(page.index, {}))
            own["Contents"] = fresh(Stream({}, compact_text(data) if edits.compact else data))
        held = doc.resolve(page.dict.get("Annots")) or []
        gone = set()
        for (_, index), uri in sorted((k, v) for k, v in edits.links.items() if k[0] == page.index):
            if not 0 <= index < len(held) or doc.get(held[index], "Subtype") != "Link":
                raise PdfError(f"no link {index} on page {page.index}")
            if uri is None:
                gone.add(index)
                continue
            link = out[change(held[index]).num] if isinstance(held[index], Ref) else None
            if link is None:
                raise PdfError(f"link {index} on page {page.index} is no object of its own")
            link.pop("Dest", None)
            link["A"] = {"S": Name("URI"), "URI": uri.encode("utf-8")}
        if gone:
            own["Annots"] = [with_references(v, change) for i, v in enumerate(held) if i not in gone]
    if missing := wanted - met:
        raise PdfError(f"no page {min(missing)}")


def create_image(pixels: np.ndarray) -> tuple[Stream, Stream | None]:
    """The image of RGBA pixels, in gray where nothing is lost, and its soft mask unless it is opaque."""
    height, width = pixels.shape[:2]
    gray = (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 1] == pixels[..., 2]).all()

    def stream(plane: np.ndarray, space: str) -> Stream:
        own = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name(space), "Filter": Name("FlateDecode")}
        return Stream(own, flate_encode(np.ascontiguousarray(plane).tobytes()))

    colors = stream(pixels[..., :1], "DeviceGray") if gray else stream(pixels[..., :3], "DeviceRGB")
    return colors, None if (pixels[..., 3] == 255).all() else stream(pixels[..., 3], "DeviceGray")


def replace_text(data: bytes, replacements: dict[int, str]) -> bytes:
    """Content with text objects (by order) wrapped in spans that carry the given text."""
    from quire.functions.filters import encode_text
    from quire.sources.pdf.document import operators

    out, at, nth, start, inside = bytearray(), 0, -1, 0, 0
    for op, args, offset in operators(data):
        inside += (op in ("BMC", "BDC")) - (op == "EMC")
        if op == "BT":
            nth, start = nth + 1, offset
        elif op == "ET" and nth in replacements:
            if inside:
                raise PdfError("a replaced text object inside marked content", start)
            stop = offset + 2
            out += data[at:start] + b"/Span " + write_value({"ActualText": encode_text(replacements[nth])}) + b" BDC\n" + data[start:stop] + b"\nEMC"
            at = stop
    if missing := set(replacements) - set(range(nth + 1)):
        raise PdfError(f"no text object {min(missing)}")
    return bytes(out + data[at:])


def compact_text(data: bytes) -> bytes:
    """Joins a text object to the next where only ``ET BT`` stands between and a matrix follows.

    A text object that shows text in a clipping mode stays: its end is where the clip
    begins. The mode is text state, so it is carried through text objects and ``q``/``Q``.
    """
    from quire.sources.pdf.document import operators

    ops = list(operators(data))
    drop: set[int] = set()
    mode, saved, clips = 0, [], False
    for i, (op, args, _) in enumerate(ops):
        if op == "Tr" and args and isinstance(args[-1], (int, float)):
            mode = int(args[-1])
        elif op == "q":
            saved.append(mode)
        elif op == "Q" and saved:
            mode = saved.pop()
        elif op in SHOWS:
            clips |= mode >= FIRST_CLIP
        elif op == "ET":
            if not clips and [o for o, *_ in ops[i + 1 : i + 3]] == ["BT", "Tm"]:
                drop |= {i, i + 1}
            clips = False
    lines = [b" ".join([*map(write_value, args), op.encode("latin-1")]) if op != "BI" else _inline(args[0]) for i, (op, args, _) in enumerate(ops) if i not in drop]
    return b"\n".join(lines)


def _inline(image: Stream) -> bytes:
    return b"BI " + b" ".join(write_value(Name(k)) + b" " + write_value(v) for k, v in image.dict.items()) + b" ID " + image.raw + b" EI"


def text_document(pages: list[list[str]], encoding: str = "WinAnsiEncoding", compress: bool = True, **info: str) -> bytes:
    """A document that shows the given lines, one list for each page; characters outside the encoding become ``?``."""
    from quire.functions.filters import encode_text

    codec = "cp1252" if encoding == "WinAnsiEncoding" else "mac_roman"
    objects: dict[int, object] = {3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name(encoding)}}
    kids = []
    for num, lines in zip(itertools.count(4, 2), pages):  # noqa: B905  as many as there are pages
        shown = b"\n".join(write_value(x.encode(codec, "replace")) + b" '" for x in lines)
        data = b"BT\n/F1 10 Tf\n12 TL\n1 0 0 1 50 780 Tm\n" + shown + b"\nET"
        objects[num] = Stream({"Filter": Name("FlateDecode")}, flate_encode(data)) if compress else Stream({}, data)
        objects[num + 1] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(num, 0)}
        kids.append(Ref(num + 1, 0))
    objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 595, 842], "Resources": {"Font": {"F1": Ref(3, 0)}}}
    trailer: dict = {"Root": Ref(1, 0)}
    if info:
        num = max(objects) + 1
        objects[num] = {k: encode_text(v) for k, v in info.items()}
        trailer["Info"] = Ref(num, 0)
    return write_file(objects, trailer)
