"""A document: cross-references, objects, pages, trees, annotations, actions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from quire.functions import filters
from quire.sources.pdf.crypt import Security
from quire.sources.pdf.objects import Keyword, Name, Parser, PdfError, Ref, Stream, name_of

HEAD, TAIL = 1024, 1 << 20
PAGE_DEPTH, TREE_DEPTH = 8192, 256
VERSIONS = {f"1.{i}" for i in range(8)} | {"2.0"}
_HERE = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+obj\b")
#: A whole entry of a table of cross-references.
_ENTRY = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+([nf])(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
#: The head of an indirect object.
_HEAD = re.compile(rb"[\x00\t\n\f\r ]*+(\d+)[\x00\t\n\f\r ]++(\d+)[\x00\t\n\f\r ]++obj(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_INDIRECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\f\r ]+(\d{1,5})[\x00\t\n\f\r ]+obj\b")


@dataclass(frozen=True)
class Entry:
    """kind 0 free, 1 at a byte position, 2 inside an object stream (``position``) at an index (``gen``)."""

    kind: int
    position: int
    gen: int
    rev: int


@dataclass
class Page:
    index: int
    ref: Ref | None
    dict: dict
    media_box: list[float]
    crop_box: list[float]
    rotation: int
    user_unit: float
    resources: dict


class Document:
    """Lazy access to one document's objects; not for concurrent use."""

    def __init__(self, data: bytes, password: str = "", lenient: bool = False):
        self.data, self.lenient = data, lenient
        self.notes: list[tuple[int, int, str]] = []
        self.xref: dict[int, Entry] = {}
        self.sections: list[dict[int, Entry]] = []
        self.trailer: dict = {}
        self.security: Security | None = None
        self._cache: dict[int, object] = {}
        self._inside: dict[int, dict[int, bytes]] = {}
        self._busy: set[int] = set()
        self._dests: dict[bytes, object] | None = None
        self.wanted_page: Callable[[int], bool] = lambda index: True  # pages that tables by page are asked for
        self.version = self._version()
        try:
            self._load_xref()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise PdfError("no document catalogue")
        except (PdfError, filters.FilterError, RecursionError) as e:
            if not lenient:
                raise
            self.note(f"cross-references rebuilt: {e}")
            self._recover()
        self._open_security(password)

    def note(self, message: str, offset: int = -1, page: int = -1) -> None:
        self.notes.append((page, offset, message))

    def fault(self, message: str, offset: int = -1) -> None:
        if not self.lenient:
            raise PdfError(message, offset)
        self.note(message, offset)

    def _version(self) -> str:
        at = self.data.find(b"%PDF-", 0, HEAD)
        if len(self.data) < 8 or at < 0:
            raise PdfError("no document header")
        found = self.data[at + 5 : at + 8].decode("latin-1")
        if found not in VERSIONS:
            self.fault("an unknown version", at)
            return "1.7"
        return found

    # Cross-references

    def _load_xref(self) -> None:
        tail = max(0, len(self.data) - TAIL)
        at = self.data.rfind(b"startxref", tail)
        if at < 0:
            raise PdfError("no startxref")
        start = Parser(self.data, at + 9).value()
        seen: set[int] = set()
        pending, rev = [start], 0
        while pending:
            position = pending.pop(0)
            if not isinstance(position, int) or not 0 <= position < len(self.data):
                raise PdfError("a cross-reference outside the file")
            if position in seen:
                raise PdfError("a cycle of cross-references", position)
            seen.add(position)
            section, trailer = self._section(position, rev)
            hybrid = trailer.get("XRefStm")
            if isinstance(hybrid, int):
                section = section | {k: v for k, v in self._section(hybrid, rev)[0].items() if k not in section or section[k].kind == 0}
            self.sections.append(section)
            for num, entry in section.items():
                self.xref.setdefault(num, entry)
            self.trailer = trailer | self.trailer if rev else trailer
            if trailer.get("Prev") is not None:
                pending.append(int(trailer["Prev"]))
            rev += 1

    def _section(self, position: int, rev: int) -> tuple[dict[int, Entry], dict]:
        p = Parser(self.data, position, self.lenient)
        p.gap()
        if self.data.startswith(b"xref", p.at):
            p.at += 4
            return self._table(p, rev)
        stream = self._indirect(position)[2]
        if not isinstance(stream, Stream) or stream.dict.get("Type") != "XRef":
            raise PdfError("no cross-reference section", position)
        return self._xref_stream(stream, rev), stream.dict

    def _table(self, p: Parser, rev: int) -> tuple[dict[int, Entry], dict]:
        out: dict[int, Entry] = {}
        while True:
            first = p.value()
            if first == b"trailer":
                trailer = p.value()
                if not isinstance(trailer, dict):
                    raise PdfError("no trailer dictionary", p.at)
                return out, trailer
            count = p.value()
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("a wrong subsection", p.at)
            for num in range(first, first + count):
                if m := _ENTRY.match(p.data, p.at):
                    position, gen, kind, p.at = int(m[1]), int(m[2]), m[3], m.end()
                else:
                    position, gen, kind = p.value(), p.value(), p.value()
                if kind not in (b"n", b"f"):
                    raise PdfError("a wrong entry", p.at)
                if num in out:
                    self.fault("overlapping subsections", p.at)
                out[num] = Entry(int(kind == b"n"), position, min(gen, 65535), rev)

    def _xref_stream(self, stream: Stream, rev: int) -> dict[int, Entry]:
        data, widths = self.decoded(stream), stream.dict["W"]
        index = stream.dict.get("Index") or [0, stream.dict["Size"]]
        row = sum(widths)
        numbers = [n for first, count in zip(index[::2], index[1::2], strict=True) for n in range(first, first + count)]
        if any(not 0 <= w <= 8 for w in widths) or len(data) != row * len(numbers):
            raise PdfError("cross-reference data of a wrong size")
        out = {}
        for i, num in enumerate(numbers):
            at, fields = i * row, []
            for w in widths:
                fields.append(int.from_bytes(data[at : at + w], "big") if w else None)
                at += w
            kind = 1 if fields[0] is None else fields[0]
            out[num] = Entry(kind if kind <= 2 else 0, fields[1] or 0, fields[2] or 0, rev)
        return out

    def _recover(self) -> None:
        """Rebuilds the cross-references from the indirect objects found in the whole file.

        Trailers count only between objects, never inside a stream.
        """
        self.xref, self._cache, self._inside, self.sections = {}, {}, {}, []
        at, trailer, gaps, done = 0, {}, [], 0
        data = self.data
        while m := _INDIRECT.search(data, at):
            self.xref[int(m[1])] = Entry(1, m.start(), int(m[2]), 0)
            at = m.end()
            try:
                _, _, value, at = self._indirect(m.start(), whole=True)
            except (PdfError, filters.FilterError):
                continue
            gaps.append((done, m.start()))
            done = at
            if isinstance(value, Stream) and value.dict.get("Type") == "XRef":
                trailer |= {k: v for k, v in value.dict.items() if k in ("Root", "Info", "ID", "Encrypt")}
        words = re.compile(rb"trailer")
        for m in (m for start, stop in [*gaps, (done, len(data))] for m in words.finditer(data, start, stop)):
            try:
                found = Parser(self.data, m.end(), True).value()
            except PdfError:
                continue
            if isinstance(found, dict):
                trailer |= found
        self.trailer = trailer
        for num in [n for n, e in self.xref.items() if e.kind == 1]:
            try:
                value = self.object(num)
            except (PdfError, filters.FilterError):
                continue
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                for i, inner in enumerate(self._members(num)):
                    self.xref.setdefault(inner, Entry(2, num, i, 0))
            elif isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(num, self.xref[num].gen))

    # Objects

    def _indirect(self, position: int, whole: bool = False):
        p = Parser(self.data, position, self.lenient)
        if m := _HEAD.match(self.data, position):
            num, gen, p.at = int(m[1]), int(m[2]), m.end()
        else:
            num, gen, word = p.value(), p.value(), p.value()
            if word != b"obj" or not isinstance(num, int) or not isinstance(gen, int):
                raise PdfError("no indirect object", position)
        value = p.value()
        end = p.at
        p.gap()
        if isinstance(value, dict) and self.data.startswith(b"stream", p.at):
            start = p.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            end = self._stream_end(value, start)
            value = Stream(value, self.data[start:end], num, gen)
        self.notes += [(-1, o, m) for o, m in p.notes]
        return (num, gen, value, end) if whole else (num, gen, value)

    def _stream_end(self, own: dict, start: int) -> int:
        length = self.resolve(own.get("Length"))
        if isinstance(length, int) and length >= 0 and re.match(rb"[\x00\t\n\f\r ]*endstream", self.data[start + length : start + length + 20]):
            return start + length
        self.fault("a stream of a wrong length", start)
        end = self.data.find(b"endstream", start)
        if end < 0:
            raise PdfError("a stream without end", start)
        return end - (2 if self.data[end - 2 : end] == b"\r\n" else self.data[end - 1 : end] in (b"\n", b"\r"))

    def object(self, num: int, gen: int | None = None) -> object:
        """An object by number; missing and freed ones are null."""
        if num in self._cache:
            return self._cache[num]
        entry = self.xref.get(num)
        if entry is None or entry.kind == 0 or (gen is not None and entry.kind == 1 and entry.gen != gen):
            return None
        if num in self._busy:
            raise PdfError(f"object {num} contains itself")
        if len(self._busy) > 256:
            raise PdfError("objects nested too deep")
        self._busy.add(num)
        try:
            if entry.kind == 2:
                value = self._compressed(entry.position, num)
            else:
                found, found_gen, value = self._indirect(self._offset(num, entry))
                if self.security:
                    value = self.security.value(value, found, found_gen)
        finally:
            self._busy.discard(num)
        self._cache[num] = value
        return value

    def _offset(self, num: int, entry: Entry) -> int:
        """The entry's position, or in lenient mode the only nearby one that fits."""
        if (m := _HERE.match(self.data, entry.position)) and m[1] == b"%d" % num:
            return entry.position
        low = max(0, entry.position - HEAD)
        near = [m.start() + low for m in _INDIRECT.finditer(self.data[low : entry.position + HEAD]) if int(m[1]) == num]
        if not self.lenient or len(near) != 1:
            raise PdfError(f"object {num} is not where the cross-references say", entry.position)
        self.note(f"object {num} found nearby", near[0])
        return near[0]

    def _members(self, holder: int) -> dict[int, bytes]:
        if holder not in self._inside:
            stream = self.object(holder)
            if not isinstance(stream, Stream) or stream.dict.get("Type") != "ObjStm":
                raise PdfError(f"object {holder} is no object stream")
            data = self.decoded(stream)
            n, first = self.resolve(stream.dict["N"]), self.resolve(stream.dict["First"])
            p = Parser(data[:first])
            pairs = [(p.value(), p.value()) for _ in range(n)]
            if any(a[1] >= b[1] for a, b in zip(pairs, pairs[1:], strict=False)) or len({x for x, _ in pairs}) < n:
                raise PdfError("an object stream's header is wrong")
            stops = [o for _, o in pairs[1:]] + [len(data) - first]
            self._inside[holder] = {num: data[first + o : first + stop] for (num, o), stop in zip(pairs, stops, strict=True)}
        return self._inside[holder]

    def _compressed(self, holder: int, num: int) -> object:
        part = self._members(holder).get(num)
        if part is None:
            return None
        p = Parser(part, 0, self.lenient)
        value = p.value()
        if not p.done():
            self.fault(f"more than one value for object {num}")
        return value

    def resolve(self, v: object) -> object:
        """Follows references to a value that is none."""
        seen = set()
        while isinstance(v, Ref):
            if v in seen:
                raise PdfError("a cycle of references")
            seen.add(v)
            v = self.object(v.num, v.gen)
        return v

    def get(self, holder, key: str, kind: type | tuple | None = None, default=None):
        """A dictionary's resolved value if it has the wanted type."""
        own = self.resolve(holder)
        own = own.dict if isinstance(own, Stream) else own
        v = self.resolve(own.get(key)) if isinstance(own, dict) else None
        return default if v is None or (kind is not None and not isinstance(v, kind)) else v

    def filters_of(self, stream: Stream) -> tuple[list[str], list[dict]]:
        names = self.resolve(stream.dict.get("Filter", stream.dict.get("F") if not isinstance(stream.dict.get("F"), (bytes, dict)) else None))
        own = self.resolve(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        names = [] if names is None else [str(self.resolve(n)) for n in names] if isinstance(names, list) else [str(names)]
        own = own if isinstance(own, list) else [own]
        parameters = [{k: self.resolve(v) for k, v in (self.resolve(p) or {}).items()} for p in own[: len(names)]]
        return names, parameters + [{}] * (len(names) - len(parameters))

    def decoded(self, stream: Stream) -> bytes:
        return self.decoded_image(stream)[0]

    def decoded_image(self, stream: Stream) -> tuple[bytes, str | None]:
        return filters.decode(stream.raw, *self.filters_of(stream), lenient=self.lenient)

    def _open_security(self, password: str) -> None:
        encrypt = self.resolve(self.trailer.get("Encrypt"))
        if encrypt is None:
            return
        first = (self.resolve(self.trailer.get("ID")) or [b""])[0]
        plain = {k: self.resolve(v) for k, v in encrypt.items()}
        if isinstance(plain.get("CF"), dict):
            plain["CF"] = {k: self.resolve(v) for k, v in plain["CF"].items()}
        self.security = Security(plain, self.resolve(first) or b"", password)
        holder = self.trailer["Encrypt"]
        self._cache = {holder.num: encrypt} if isinstance(holder, Ref) else {}
        self._inside = {}

    @property
    def catalog(self) -> dict:
        return self.resolve(self.trailer.get("Root")) or {}

    # Pages

    def pages(self) -> Iterator[Page]:
        """Pages in order with inherited attributes resolved."""
        root = self.catalog.get("Pages")
        pending = [(root, {}, 0, frozenset())]
        index = 0
        while pending:
            ref, above, depth, path = pending.pop()
            node = self.resolve(ref)
            if depth >= PAGE_DEPTH or (isinstance(ref, Ref) and ref in path):
                raise PdfError("the page tree is too deep or cyclic")
            if not isinstance(node, dict):
                self.fault("a page node is missing")
                continue
            own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node or node.get("Type") == "Pages":
                inside = path | {ref} if isinstance(ref, Ref) else path
                pending += [(kid, own, depth + 1, inside) for kid in reversed(self.resolve(node.get("Kids")) or [])]
                continue
            yield self._page(index, ref if isinstance(ref, Ref) else None, node, own)
            index += 1

    def _box(self, v: object) -> list[float] | None:
        v = self.resolve(v)
        if not isinstance(v, list) or len(v) != 4:
            return None
        n = [self.resolve(x) for x in v]
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in n):
            return None
        return [float(min(n[0], n[2])), float(min(n[1], n[3])), float(max(n[0], n[2])), float(max(n[1], n[3]))]

    def _page(self, index: int, ref: Ref | None, node: dict, own: dict) -> Page:
        media = self._box(own.get("MediaBox"))
        if media is None:
            self.fault(f"page {index} has no media box")
            media = [0.0, 0.0, 612.0, 792.0]
        crop = self._box(own.get("CropBox")) or media
        crop = [max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])]
        rotation = self.resolve(own.get("Rotate")) or 0
        if not isinstance(rotation, int) or rotation % 90:
            self.fault(f"page {index} has a wrong rotation")
            rotation = 0
        unit = self.resolve(node.get("UserUnit"))
        unit = float(unit) if isinstance(unit, (int, float)) and 0 < unit <= 75000 else 1.0
        return Page(index, ref, node, media, crop, rotation % 360, unit, self.resolve(own.get("Resources")) or {})

    def content(self, page: Page) -> bytes:
        """A page's content streams, joined by line ends."""
        held = self.resolve(page.dict.get("Contents"))
        parts = held if isinstance(held, list) else [] if held is None else [held]
        streams = [self.resolve(p) for p in parts]
        return b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream))

    # Trees

    def name_tree(self, root: object) -> Iterator[tuple[bytes, object]]:
        yield from self._tree(root, "Names", bytes)

    def number_tree(self, root: object) -> Iterator[tuple[int, object]]:
        last = None
        for key, value in self._tree(root, "Nums", int):
            if last is not None and key <= last:
                self.fault("number tree keys are out of order")
            last = key
            yield key, value

    def _tree(self, root: object, leaf: str, kind: type) -> Iterator[tuple]:
        pending, seen = [(root, 0)], set()
        while pending:
            ref, depth = pending.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    raise PdfError("a tree contains itself")
                seen.add(ref)
            node = self.resolve(ref)
            if not isinstance(node, dict) or depth > TREE_DEPTH:
                continue
            own = self.resolve(node.get(leaf)) or []
            for key, value in zip(own[::2], own[1::2], strict=False):
                key = self.resolve(key)
                if isinstance(key, kind):
                    yield key, value
            pending += [(kid, depth + 1) for kid in reversed(self.resolve(node.get("Kids")) or [])]

    def names(self, kind: str) -> Iterator[tuple[bytes, object]]:
        yield from self.name_tree(self.get(self.catalog, "Names", dict, {}).get(kind))

    def outlines(self) -> Iterator[dict]:
        """Outline items, first children before next siblings."""
        pending = [(self.get(self.catalog, "Outlines", dict, {}).get("First"), 0)]
        seen: set = set()
        while pending:
            ref, level = pending.pop()
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            if isinstance(ref, Ref):
                if ref in seen:
                    raise PdfError("an outline contains itself")
                seen.add(ref)
            flags, count = self.get(node, "F", int, 0), self.get(node, "Count", int, 0)
            color = [float(self.resolve(c)) for c in self.get(node, "C", list, [0, 0, 0])]
            yield {
                "level": level, "title": filters.decode_text(self.get(node, "Title", bytes, b"")), "expanded": count > 0,
                "italic": bool(flags & 1), "bold": bool(flags & 2), "color": color, "dict": node, "ref": ref,
                "destination": node.get("Dest", self.get(node.get("A"), "D")),
            }
            pending.append((node.get("Next"), level))
            pending.append((node.get("First"), level + 1))

    def destination(self, v: object) -> list | None:
        """A destination array; names look in the old dictionary, strings in the name tree."""
        v = self.resolve(v)
        if isinstance(v, Name):
            v = self.get(self.get(self.catalog, "Dests", dict, {}), str(v))
        elif isinstance(v, bytes):
            if self._dests is None:
                self._dests = dict(self.names("Dests"))
            v = self.resolve(self._dests.get(v))
        if isinstance(v, dict):
            v = self.resolve(v.get("D"))
        return v if isinstance(v, list) and len(v) >= 2 else None

    def page_labels(self) -> Iterator[dict]:
        for start, value in self.number_tree(self.catalog.get("PageLabels")):
            own = self.resolve(value) or {}
            style = self.get(own, "S", Name)
            yield {"start": start, "style": None if style is None else str(style), "prefix": filters.decode_text(self.get(own, "P", bytes, b"")), "first": self.get(own, "St", int, 1)}

    def embedded_files(self) -> Iterator[dict]:
        for name, value in self.names("EmbeddedFiles"):
            own = self.resolve(value) or {}
            file = self.get(own, "UF", bytes) or self.get(own, "F", bytes, b"")
            held = self.get(own, "EF", dict, {})
            stream = held.get("UF", held.get("F"))
            yield {"name": name, "file_name": filters.decode_text(file), "description": filters.decode_text(self.get(own, "Desc", bytes, b"")), "stream": stream if isinstance(stream, Ref) else None}

    def info(self) -> dict[str, str]:
        own = self.resolve(self.trailer.get("Info"))
        if not isinstance(own, dict):
            return {}
        values = {k: self.resolve(v) for k, v in own.items()}
        return {k: filters.decode_text(v) if isinstance(v, bytes) else str(v) for k, v in values.items() if isinstance(v, (bytes, Name))}

    def structure(self) -> Iterator[dict]:
        """Structure elements and their marked content, in order."""
        root = self.get(self.catalog, "StructTreeRoot", dict, {})
        roles = {k: str(self.resolve(v)) for k, v in self.get(root, "RoleMap", dict, {}).items()}
        first = self.resolve(root.get("K"))
        pending = [(k, 0, None, None) for k in reversed(first if isinstance(first, list) else [root.get("K")])]
        seen: set = set()
        while pending:
            ref, level, parent, page = pending.pop()
            node = self.resolve(ref)
            if isinstance(node, int) and not isinstance(node, bool):
                yield {"level": level, "type": "MCID", "tag": None, "num": None, "parent": parent, "page": page, "mcid": node}
                continue
            if not isinstance(node, dict):
                continue
            if isinstance(ref, Ref):
                if ref in seen:
                    raise PdfError("the structure contains itself")
                seen.add(ref)
            num = ref.num if isinstance(ref, Ref) else None
            held = node.get("Pg")
            page = held.num if isinstance(held, Ref) else page
            kind = node.get("Type")
            if kind == "MCR":
                yield {"level": level, "type": "MCR", "tag": None, "num": num, "parent": parent, "page": page, "mcid": self.get(node, "MCID", int)}
                continue
            if kind == "OBJR":
                yield {"level": level, "type": "OBJR", "tag": None, "num": num, "parent": parent, "page": page, "mcid": None}
                continue
            tag = self.get(node, "S", Name)
            yield {"level": level, "type": resolve_role(str(tag), roles) or str(tag), "tag": None if tag is None else str(tag), "num": num, "parent": parent, "page": page, "mcid": None}
            kids = self.resolve(node.get("K"))
            pending += [(k, level + 1, num, page) for k in reversed(kids if isinstance(kids, list) else [] if kids is None else [node["K"]])]

    def structure_ids(self) -> Iterator[tuple[bytes, int | None]]:
        """(identifier, element number) of the structure's name tree."""
        for key, value in self.name_tree(self.get(self.get(self.catalog, "StructTreeRoot", dict, {}), "IDTree", dict)):
            yield key, value.num if isinstance(value, Ref) else None

    def metadata(self) -> bytes | None:
        """The document's metadata stream."""
        held = self.get(self.catalog, "Metadata", Stream)
        return None if held is None else self.decoded(held)

    def output_intents(self) -> Iterator[dict]:
        for v in self.get(self.catalog, "OutputIntents", list, []):
            own = self.resolve(v)
            if not isinstance(own, dict):
                continue
            text = lambda key, own=own: filters.decode_text(x) if (x := self.get(own, key, bytes)) is not None else None
            profile = own.get("DestOutputProfile")
            yield {
                "subtype": str(self.get(own, "S", Name, "")), "condition": text("OutputCondition"), "identifier": text("OutputConditionIdentifier"),
                "registry": text("RegistryName"), "info": text("Info"), "profile": profile.num if isinstance(profile, Ref) else None,
                "components": self.get(profile, "N", int) if isinstance(self.resolve(profile), Stream) else None,
            }

    def structure_parents(self) -> Iterator[tuple[int, int, int]]:
        """(key, mcid or -1, element number)."""
        root = self.get(self.catalog, "StructTreeRoot", dict, {})
        for key, value in self.number_tree(root.get("ParentTree")):
            held = value if isinstance(value, Ref) and not isinstance(self.resolve(value), list) else self.resolve(value)
            if isinstance(held, Ref):
                yield key, -1, held.num
            elif isinstance(held, list):
                yield from ((key, i, x.num) for i, x in enumerate(held) if isinstance(x, Ref))

    def annotations(self, page: Page) -> Iterator[dict]:
        for i, ref in enumerate(self.resolve(page.dict.get("Annots")) or []):
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            own = dict(node)
            if node.get("Subtype") == "Popup" and isinstance(parent := self.resolve(node.get("Parent")), dict):
                # the parent's fields replace the popup's, even when they are absent
                for key in ("Contents", "M", "C", "T"):
                    own.pop(key, None)
                    if key in parent:
                        own[key] = parent[key]
            yield {
                "index": i, "num": ref.num if isinstance(ref, Ref) else None, "subtype": str(node.get("Subtype", "")),
                "rect": self._box(node.get("Rect")), "flags": self.get(node, "F", int, 0),
                "contents": filters.decode_text(self.get(own, "Contents", bytes, b"")), "dict": own,
            }

    def appearance(self, annotation: dict) -> dict | None:
        """The stored normal appearance in the annotation's state, and the matrix that puts it into its rectangle."""
        own, rect = annotation["dict"], annotation["rect"]
        held = self.get(own, "AP", dict, {}).get("N")
        state = self.get(own, "AS", Name)
        if isinstance(states := self.resolve(held), dict):
            held = states.get(str(state)) if state is not None else None
        stream = self.resolve(held)
        if not isinstance(stream, Stream) or rect is None or (box := self._box(stream.dict.get("BBox"))) is None:
            return None
        a, b, c, d, e, f = (float(self.resolve(v)) for v in self.get(stream, "Matrix", list, [1, 0, 0, 1, 0, 0]))
        corners = [(a * x + c * y + e, b * x + d * y + f) for x in box[::2] for y in box[1::2]]
        left, bottom = min(x for x, _ in corners), min(y for _, y in corners)
        width, height = max(x for x, _ in corners) - left, max(y for _, y in corners) - bottom
        if not width or not height:
            return None
        sx, sy = (rect[2] - rect[0]) / width, (rect[3] - rect[1]) / height
        return {"state": None if state is None else str(state), "num": held.num if isinstance(held, Ref) else None, "matrix": [sx, 0.0, 0.0, sy, rect[0] - left * sx, rect[1] - bottom * sy]}

    def field(self, node: dict) -> dict:
        """Form field attributes from the nearest ancestor, and the full name."""
        out, parts, seen = {}, [], 0
        while isinstance(node, dict) and seen < TREE_DEPTH:
            for key in ("FT", "Ff", "V", "DV", "DA", "Q", "Opt", "MaxLen"):
                if key in node:
                    out.setdefault(key, self.resolve(node[key]))
            if isinstance(name := self.resolve(node.get("T")), bytes):
                parts.insert(0, filters.decode_text(name))
            node, seen = self.resolve(node.get("Parent")), seen + 1
        return out | {"name": ".".join(parts)}

    def actions(self, first: object) -> Iterator[dict]:
        """An action and those that follow it, each once; actions are never run."""
        pending, seen = [first], set()
        while pending:
            ref = pending.pop(0)
            node = self.resolve(ref)
            key = ref if isinstance(ref, Ref) else id(node)
            if not isinstance(node, dict) or key in seen:
                continue
            seen.add(key)
            yield {"type": str(node.get("S", "")), "dict": node}
            after = self.resolve(node.get("Next"))
            pending += after if isinstance(after, list) else [] if after is None else [node["Next"]]

    # Files and media

    def file_specification(self, v: object) -> dict | None:
        """Name and embedded stream: a plain string, or the Unicode name before the other."""
        v = self.resolve(v)
        if isinstance(v, bytes):
            return {"file_name": filters.decode_text(v), "description": "", "stream": None, "url": False}
        if not isinstance(v, dict):
            return None
        name = self.get(v, "UF", bytes) or self.get(v, "F", bytes, b"")
        held = self.get(v, "EF", dict, {})
        stream = held.get("UF", held.get("F"))
        return {
            "file_name": filters.decode_text(name), "description": filters.decode_text(self.get(v, "Desc", bytes, b"")),
            "stream": stream if isinstance(stream, Ref) else None, "url": v.get("FS") == "URL",
        }

    def rendition(self, v: object, depth: int = 0) -> dict | None:
        """A media rendition, or a selector with its alternatives in order."""
        own = self.resolve(v)
        if depth >= 32:
            raise PdfError("renditions nested too deep")
        if not isinstance(own, dict):
            return None
        kind = str(own.get("S", ""))
        clip = self.get(own, "C", dict, {})
        return {
            "subtype": kind, "name": filters.decode_text(self.get(own, "N", bytes, b"")), "clip": str(clip.get("S", "")) or None,
            "content_type": filters.decode_text(self.get(clip, "CT", bytes, b"")), "file": self.file_specification(clip.get("D")),
            "alternatives": [r for x in self.get(own, "R", list, []) if (r := self.rendition(x, depth + 1))] if kind == "SR" else [],
            "dict": own,
        }

    def named_destinations(self) -> Iterator[tuple[str, bytes, list | None]]:
        """(kind, name, array) of the old dictionary, then of the name tree."""
        for name in sorted(self.get(self.catalog, "Dests", dict, {})):
            yield "name", name.encode("utf-8"), self.destination(Name(name))
        for name, value in self.names("Dests"):
            yield "string", name, self.destination(value)

    # Optional content

    def group_visible(self, ref: object) -> bool:
        """State of a group: intent, then base state, then the ON list, then the OFF list."""
        config = self.get(self.get(self.catalog, "OCProperties", dict, {}), "D", dict, {})
        group = self.resolve(ref) or {}
        listed = lambda v: {str(x) for x in (v if isinstance(v, list) else [v])}
        wanted, own = listed(self.get(config, "Intent", (Name, list), Name("View"))), listed(self.get(group, "Intent", (Name, list), Name("View")))
        if "All" not in wanted and not wanted & own:
            return True
        visible = self.get(config, "BaseState", Name, Name("ON")) != "OFF"
        if ref in self.get(config, "ON", list, []):
            visible = True
        return visible and ref not in self.get(config, "OFF", list, [])

    def content_visible(self, ref: object, depth: int = 0) -> bool:
        """A group's state, or a membership's expression or policy."""
        node = self.resolve(ref)
        if depth >= 64 or not isinstance(node, dict):
            return True
        if node.get("Type") != "OCMD":
            return self.group_visible(ref)
        if isinstance(rule := self.resolve(node.get("VE")), list):
            return self._expression(rule, 0)
        held = self.resolve(node.get("OCGs"))
        groups = held if isinstance(held, list) else [] if held is None else [node["OCGs"]]
        states = [self.group_visible(g) for g in groups if self.resolve(g) is not None]
        if not states:
            return True
        policy = str(self.get(node, "P", Name, Name("AnyOn")))
        return {"AllOn": all(states), "AnyOff": not all(states), "AllOff": not any(states)}.get(policy, any(states))

    def _expression(self, rule: list, depth: int) -> bool:
        if depth >= 64 or not rule:
            raise PdfError("a visibility expression is empty or too deep")
        parts = [self._expression(v, depth + 1) if isinstance(v := self.resolve(x), list) else self.group_visible(x) for x in rule[1:]]
        op = str(self.resolve(rule[0]))
        if op == "Not":
            return not parts[0]
        return all(parts) if op == "And" else any(parts)


def resolve_role(role: str, roles: dict[str, str], accepts=None) -> str | None:
    """Follows the role map: a mapped role is mapped before it is looked at.

    Without ``accepts`` the first role that is not mapped is the answer, otherwise
    the first that it takes. None where a role comes up again, or none is taken.
    """
    seen: set[str] = set()
    while True:
        mapped = role in roles
        role = roles.get(role, role)
        if role in seen:
            return None
        seen.add(role)
        if accepts(role) if accepts else role not in roles:
            return role
        if not mapped:
            return None


def select_rendition(rendition: dict | None, viable) -> dict | None:
    """The first viable media rendition, depth first; an unviable selector skips its branch."""
    if not rendition or rendition["subtype"] not in ("MR", "SR") or not viable(rendition):
        return None
    if rendition["subtype"] == "MR":
        return rendition
    return next((r for x in rendition["alternatives"] if (r := select_rendition(x, viable))), None)


#: The plain tokens of content: integers, reals, names, strings without escapes, even hexadecimal ones, operators.
_TOKEN = re.compile(
    rb"[\x00\t\n\f\r ]*+(?:\(([^()\\\r]*+)\)|<([0-9A-Fa-f]*+)>"
    rb"|(?:([+-]?\d+)|([+-]?(?:\d+\.\d*|\.\d+))|/([^\x00\t\n\f\r ()<>\[\]{}/%#]+)|([A-Za-z'\"][A-Za-z0-9'\"*]*))(?![^\x00\t\n\f\r ()<>\[\]{}/%]))"
)
#: Words that are no operators, or that more than operands belong to.
_OTHER_WORDS = frozenset((b"true", b"false", b"null", b"BI"))


def operators(data: bytes, lenient: bool = False) -> Iterator[tuple[str, list, int]]:
    """(operator, operands, offset) of a content stream; an inline image is one ``BI``."""
    p = Parser(data, 0, lenient, references=False)
    operands: list = []
    while True:
        # plain tokens one after another, all others by the parser
        m = _TOKEN.match(data, p.at)
        while m and (kind := m.lastindex):
            if kind == 6:
                if m[6] in _OTHER_WORDS:
                    break
                p.at = m.end()
                yield m[6].decode("latin-1"), operands, m.start(6)
                operands = []
            else:
                if kind == 2 and len(m[2]) % 2:
                    break
                p.at = m.end()
                if kind == 1:
                    operands.append(m[1])
                elif kind == 3:
                    operands.append(int(m[3]))
                elif kind == 4:
                    operands.append(float(m[4]))
                elif kind == 2:
                    operands.append(bytes.fromhex(m[2].decode("ascii")))
                else:
                    operands.append(name_of(m[5]))
            m = _TOKEN.match(data, p.at)
        if p.done():
            break
        at = p.at
        try:
            v = p.value()
        except PdfError:
            if not lenient:
                raise
            p.at = at + 1
            continue
        if not isinstance(v, Keyword):
            operands.append(v)
            continue
        if v == b"BI":
            operands = [_inline_image(p)]
        yield v.decode("latin-1"), operands, at
        operands = []
    if operands and not lenient:
        raise PdfError("operands without an operator", len(data))


#: Short keys and values of inline images.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def _inline_image(p: Parser) -> Stream:
    own: dict = {}
    while True:
        key = p.value()
        if isinstance(key, Keyword):
            break
        own[INLINE_KEYS.get(str(key), str(key))] = p.value()
    if isinstance(own.get("ColorSpace"), Name):
        own["ColorSpace"] = Name(INLINE_SPACES.get(own["ColorSpace"], own["ColorSpace"]))
    start = p.at + 1
    length = _inline_length(own)
    if length is not None and re.match(rb"[\x00\t\n\f\r ]*EI(?![^\x00\t\n\f\r ])", p.data[start + length : start + length + 8]):
        end = start + length
    else:
        m = re.compile(rb"(?<=[\x00\t\n\f\r >])EI(?=[\x00\t\n\f\r ]|$)").search(p.data, start)
        if not m:
            raise PdfError("an inline image without end", start)
        end = m.start()
    p.at = p.data.index(b"EI", end) + 2
    return Stream(own, p.data[start:end])


def _inline_length(own: dict) -> int | None:
    """Bytes of unfiltered samples."""
    if own.get("Filter"):
        return None
    n = {"DeviceRGB": 3, "DeviceCMYK": 4}.get(str(own.get("ColorSpace")), 1)
    bits = 1 if own.get("ImageMask") else own.get("BitsPerComponent", 8)
    try:
        return (int(own["Width"]) * n * bits + 7) // 8 * int(own["Height"])
    except (KeyError, TypeError, ValueError):
        return None
