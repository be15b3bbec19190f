"""Sample documents of every structure, one for each row of a table.

The queries of the document tables read these: each document's pages, trees,
marks and streams follow from the row's key and name by plain arithmetic, so that
SQL can say what must come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.filters import ascii85_encode, encode_text, flate_encode, lzw_encode, run_length_encode
from quire.sources.pdf import crypt
from quire.sources.pdf.document import Document
from quire.sources.pdf.objects import Name, Ref, Stream, write_value
from quire.sources.pdf.write import reachable, text_document, write_file

#: The order of filter chains and of predictors that samples go through.
CHAINS = (("FlateDecode",), ("ASCIIHexDecode", "FlateDecode"), ("ASCII85Decode", "LZWDecode"), ("RunLengthDecode",), ("ASCIIHexDecode", "RunLengthDecode"))
PREDICTORS = (1, 2, 10, 11, 12, 13, 14, 15)
COLUMNS = 8


def sample_documents(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id and content for ``rows`` of doc_id and name; ``kind`` is one of ``KINDS``."""
    build = KINDS[kind]
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = build(int(batch.column(0)[i].as_py()), batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([data], pa.binary())], names=["doc_id", "content"])

    return rows.select("doc_id", "name").mapInArrow(run, f"doc_id {id_type}, content binary")


def _courier() -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}


def one_page(content: bytes, resources: dict | None = None, extra: dict | None = None, **catalog) -> bytes:
    """A document of one page that shows ``content``; ``extra`` holds objects from number 10 on."""
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | catalog,
        2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 600, 800]},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Resources": {"Font": {"F": Ref(5, 0)}} | (resources or {})},
        4: Stream({"Filter": Name("FlateDecode")}, flate_encode(content)),
        5: _courier(),
    }
    return write_file(objects | (extra or {}), {"Root": Ref(1, 0)})


def structured(key: int, name: str) -> bytes:
    """``key % 4 + 1`` pages in a tree of two levels, and every tree and table of the catalogue.

    Page i is under node i // 2; node j turns its pages by 90 j degrees; odd pages
    are cropped. Two objects are reached from nowhere.
    """
    n = key % 4 + 1
    page, node, note, popup = (lambda i: 20 + i), (lambda j: 10 + j), (lambda i: 40 + 2 * i), (lambda i: 41 + 2 * i)
    text = lambda s: encode_text(s)
    objects: dict[int, object] = {
        2: {"Type": Name("Pages"), "Kids": [Ref(node(j), 0) for j in range((n + 1) // 2)], "Count": n, "MediaBox": [0, 800, 600, 0], "Resources": {"Font": {"F": Ref(5, 0)}}},
        5: _courier(), 6: {"Title": text(f"{name} title"), "Custom": text("own")},
        8: Stream({}, b"lost"), 9: [Ref(8, 0), Ref(2, 0)],
    }
    for j in range((n + 1) // 2):
        objects[node(j)] = {"Type": Name("Pages"), "Parent": Ref(2, 0), "Kids": [Ref(page(i), 0) for i in range(2 * j, min(2 * j + 2, n))], "Count": min(2, n - 2 * j), "Rotate": 90 * j}
    for i in range(n):
        objects[page(i)] = {"Type": Name("Page"), "Parent": Ref(node(i // 2), 0), "Contents": Ref(30 + i, 0), "Annots": [Ref(note(i), 0), Ref(popup(i), 0)]} | ({"CropBox": [10, 20, 300 + key % 50, 400]} if i % 2 else {})
        objects[30 + i] = Stream({}, b"BT /F 10 Tf 1 0 0 1 50 %d Tm %s Tj ET" % (700 - i, write_value(f"{name} {i}".encode("cp1252", "replace"))))
        objects[note(i)] = {"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [i, 0, i + 10, 10], "Contents": text(f"note {i}"), "F": i, "Popup": Ref(popup(i), 0)}
        objects[popup(i)] = {"Type": Name("Annot"), "Subtype": Name("Popup"), "Rect": [0, 0, 1, 1], "Parent": Ref(note(i), 0), "Contents": text("own"), "T": text("own")}
    # outline: two items, the first with key % 3 children
    kids = key % 3
    objects[60] = {"First": Ref(61, 0), "Last": Ref(62, 0)}
    objects[61] = {"Title": text(f"{name} one"), "Next": Ref(62, 0), "Parent": Ref(60, 0), "Dest": b"d0", "F": 2, "Count": kids} | ({"First": Ref(63, 0), "Last": Ref(62 + kids, 0)} if kids else {})
    objects[62] = {"Title": text("two"), "Parent": Ref(60, 0), "A": {"S": Name("GoTo"), "D": [Ref(page(n - 1), 0), Name("XYZ"), 1, 2, 0]}}
    for c in range(kids):
        objects[63 + c] = {"Title": text(f"child {c}"), "Parent": Ref(61, 0), "Dest": Name("old")} | ({"Next": Ref(64 + c, 0)} if c + 1 < kids else {})
    # structure: mapped, cyclic and plain roles over each page's content
    objects[70] = {"Type": Name("StructTreeRoot"), "K": [Ref(71 + i, 0) for i in range(n)], "RoleMap": {"A": Name("B"), "B": Name("P"), "X": Name("Y"), "Y": Name("X")},
                   "ParentTree": {"Nums": [v for i in range(n) for v in (i, [Ref(71 + i, 0)])]}, "IDTree": {"Names": [v for i in range(n) for v in (b"id%d" % i, Ref(71 + i, 0))]}}
    for i in range(n):
        objects[71 + i] = {"Type": Name("StructElem"), "P": Ref(70, 0), "S": Name(("A", "X", "H1", "B")[i]), "Pg": Ref(page(i), 0), "K": i, "ID": b"id%d" % i}
    objects[80] = {"T": text("form"), "FT": Name("Tx"), "Ff": key % 8, "Kids": [Ref(81, 0), Ref(82, 0)]}
    objects[81] = {"T": text("first"), "Parent": Ref(80, 0), "V": text(name)}
    objects[82] = {"T": text("second"), "Parent": Ref(80, 0), "FT": Name("Ch"), "Ff": 1}
    objects[90] = {"S": Name("URI"), "URI": b"http://x/%d" % key, "Next": [Ref(91, 0), Ref(92, 0)]}
    objects[91] = {"S": Name("GoTo"), "D": b"d0", "Next": Ref(92, 0)}
    objects[92] = {"S": Name("Named"), "N": Name("NextPage"), "Next": Ref(90, 0)}
    objects[93] = Stream({"Type": Name("EmbeddedFile")}, name.encode())
    objects[94] = Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, b"<x>%d</x>" % key)
    objects[95] = Stream({"N": 4}, b"profile")
    labels = [0, {"S": Name("r")}] + ([2, {"S": Name("D"), "St": key % 7 + 1, "P": text("p-")}] if n > 2 else [])
    names = [v for i in range(n) for v in (b"d%d" % i, {"D": [Ref(page(i), 0), Name("FitH"), 100 + i]})]
    half = len(names) // 4 * 2
    objects[1] = {
        "Type": Name("Catalog"), "Pages": Ref(2, 0), "PageLabels": {"Nums": labels}, "Outlines": Ref(60, 0), "Dests": {"old": [Ref(page(0), 0), Name("Fit")]},
        "Names": {"Dests": {"Kids": [{"Names": names[:half]}, {"Names": names[half:]}]}, "EmbeddedFiles": {"Names": [b"f", {"UF": text(f"{name}.txt"), "Desc": text("d"), "EF": {"F": Ref(93, 0)}}]}},
        "StructTreeRoot": Ref(70, 0), "AcroForm": {"Fields": [Ref(80, 0)]}, "OpenAction": Ref(90, 0), "Metadata": Ref(94, 0),
        "OutputIntents": [{"S": Name("GTS_PDFX"), "OutputConditionIdentifier": text(f"C{key % 5}"), "DestOutputProfile": Ref(95, 0)}],
    }
    return write_file(objects, {"Root": Ref(1, 0), "Info": Ref(6, 0)}, classic=key % 2 == 0)


def revised(key: int, name: str) -> bytes:
    """A document with ``key % 3`` later revisions, each with a new title."""
    data = text_document([[name]], Title=f"{name} 0")
    for rev in range(1, key % 3 + 1):
        doc = Document(data)
        num, at, previous = doc.trailer["Info"].num, len(data), int(data[data.rindex(b"startxref") + 9 :].split()[0])
        added = b"%d 0 obj\n" % num + write_value({"Title": encode_text(f"{name} {rev}")}) + b"\nendobj\n"
        data += added + b"xref\n%d 1\n%010d 00000 n \ntrailer\n" % (num, at) + write_value(doc.trailer | {"Prev": previous}) + b"\nstartxref\n%d\n%%%%EOF\n" % (at + len(added))
    return data


def damaged(key: int, name: str) -> bytes:
    """A document without end, without cross-references, with shifted ones, or whole."""
    data = text_document([[name]])
    start = data.rindex(b"startxref")
    return (data[:start], data[: data.rindex(b"xref\n0")], data.replace(b"%PDF-1.7\n", b"%PDF-1.7\n%%%%\n"), data)[key % 4]


def graphic(key: int, name: str) -> bytes:
    """Paths, states, colours, clips and marked content with numbers of the key."""
    k, f = key % 10, key % 4
    tint = {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [0, 1, 0.5, 0]}
    resources = {
        "ColorSpace": {"S": [Name("Separation"), Name("Spot"), Name("DeviceCMYK"), tint], "N": [Name("Separation"), Name("None"), Name("DeviceCMYK"), tint], "I": [Name("Indexed"), Name("DeviceRGB"), 3, bytes(range(0, 240, 20))], "P": [Name("ICCBased"), Ref(12, 0)]},
        "ExtGState": {"G": {"LW": k, "D": [[k + 1, 2], 1], "FL": k, "RI": Name("Perceptual"), "ca": 0.5, "CA": 0.25, "BM": [Name("Unheard"), Name("Multiply")], "SA": True, "OP": True, "OPM": 1, "SM": 0.5, "TK": False, "AIS": True, "SMask": Name("None")}},
        "XObject": {"X": Ref(10, 0), "Y": Ref(11, 0)}, "Properties": {"M": {"MCID": k}},
    }
    form = Stream({"Subtype": Name("Form"), "Matrix": [2, 0, 0, 2, 0, 0], "BBox": [0, 0, 9, 9], "Resources": {}}, b"0 0 m 1 1 l S")
    image = Stream({"Subtype": Name("Image"), "Width": k + 1, "Height": 2, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, bytes(2 * (k + 1)))
    content = b"\n".join([
        b"q 1 0 0 1 %d 0 cm 0 0 m 10 0 l 10 10 20 10 20 0 c 1 1 2 2 v 3 3 4 4 y h S Q" % k,
        b"q 2 0 0 3 1 1 cm 0 0 %d 5 re f* Q" % (k + 1),
        b"q 0 0 m 5 5 l s 0 0 m 5 5 l b 0 0 m 5 5 l b* 0 0 m 5 5 l B 0 0 m 5 5 l B* 0 0 m 5 5 l F Q",
        b"q %d w 1 J 2 j 5 M [%d 3] 0 d /Saturation ri %d i 0 0 1 1 re S Q" % (k, k + 1, k),
        b"q /G gs 0 0 1 1 re B Q",
        b"q 0.25 g 0 0 1 1 re f 1 0 0.5 rg 0 0 1 1 re f 0 0.5 1 0 k 0 0 1 1 re f Q",
        b"q /S cs 0 0 1 1 re f 0.5 scn 0 0 1 1 re f /N cs 1 scn 0 0 1 1 re f /I cs %d sc 0 0 1 1 re f /P cs 0.5 0.25 1 scn 0 0 1 1 re f Q" % f,
        b"q 0 0 50 50 re W n 10 10 20 20 re W* n 0 0 1 1 re f Q 0 0 1 1 re f",
        b"/Span BMC /T /M BDC 0 0 1 1 re f EMC EMC /MP0 MP /X Do /Y Do BI /W 2 /H 1 /CS /G /BPC 8 ID ab EI",
    ])
    return one_page(content, resources, {10: form, 11: image, 12: Stream({"N": 3}, b"icc")})


def typeset(key: int, name: str) -> bytes:
    """Every text operator, in Courier at size 10 (6 units a glyph)."""
    k = key % 10
    content = b"\n".join([
        b"BT /F 10 Tf %d %d Td (ab) Tj ET" % (k, 2 * k),
        b"BT %d Tc %d Tw (a b) Tj 0 Tc 0 Tw ET" % (k, 2 * k),
        b"BT 50 Tz (ab) Tj (c) Tj 100 Tz ET",
        b"BT 12 TL 1 0 0 1 5 100 Tm (a) Tj T* (b) Tj (c) ' %d 1 (d) \" 0 Tw 0 Tc ET" % k,
        b"BT 7 -%d TD (e) Tj T* (f) Tj ET" % (k + 1),
        b"BT %d Ts (g) Tj 0 Ts [(h) -%d (i)] TJ ET" % (k, 100 * k),
        b"BT 2 0 0 2 1 1 Tm 3 Tr (j) Tj 0 Tr ET",
        b"/Span << /ActualText (real) /MCID %d >> BDC BT (k) Tj ET EMC" % k,
    ])
    return one_page(content)


def layered(key: int, name: str) -> bytes:
    """Two optional groups, the first off for odd keys, the second for keys of which 3 is a divisor; members of every policy."""
    off = [Ref(10, 0)] * (key % 2) + [Ref(11, 0)] * (key % 3 == 0)
    groups = {10: {"Type": Name("OCG"), "Name": b"a"}, 11: {"Type": Name("OCG"), "Name": b"b"}}
    members = {12 + i: {"Type": Name("OCMD"), "OCGs": [Ref(10, 0), Ref(11, 0)], "P": Name(p)} for i, p in enumerate(("AnyOn", "AllOn", "AnyOff", "AllOff"))}
    members[16] = {"Type": Name("OCMD"), "VE": [Name("And"), Ref(10, 0), [Name("Not"), Ref(11, 0)]]}
    shown = b"".join(b"/OC /G%d BDC BT /F 10 Tf (g%d) Tj ET EMC\n" % (i, i) for i in range(10, 17))
    return one_page(shown, {"Properties": {f"G{i}": Ref(i, 0) for i in range(10, 17)}}, groups | members, OCProperties={"OCGs": [Ref(10, 0), Ref(11, 0)], "D": {"OFF": off}})


def _predicted(data: bytes, predictor: int) -> bytes:
    """Rows of ``COLUMNS`` bytes before a predictor is undone; 15 changes the kind from row to row."""
    out, above = bytearray(), bytes(COLUMNS)
    for at in range(0, len(data), COLUMNS):
        row = data[at : at + COLUMNS].ljust(COLUMNS)
        kind = predictor - 10 if predictor < 15 else at // COLUMNS % 5
        if predictor == 2:
            out += bytes((v - (row[i - 1] if i else 0)) & 255 for i, v in enumerate(row))
            continue
        out.append(kind)
        a = c = 0
        for v, b in zip(row, above, strict=True):
            if kind == 4:
                guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[kind]
            out.append((v - guess) & 255)
            a, c = v, b
        above = row
    return bytes(out)


def filtered(key: int, name: str) -> bytes:
    """Streams of the name, fifty times over, through every chain of filters and every predictor; copies of two of them."""
    data = (name * 50).encode()
    data = data.ljust(-(-len(data) // COLUMNS) * COLUMNS)
    code: dict[str, Callable[[bytes], bytes]] = {"FlateDecode": flate_encode, "ASCIIHexDecode": lambda d: d.hex().encode() + b">", "ASCII85Decode": ascii85_encode, "LZWDecode": lzw_encode, "RunLengthDecode": run_length_encode}
    extra: dict[int, object] = {}
    for i, chain in enumerate(CHAINS):
        raw = data
        for step in reversed(chain):
            raw = code[step](raw)
        extra[10 + i] = Stream({"Filter": [Name(c) for c in chain]}, raw)
    for i, p in enumerate(PREDICTORS):
        raw = flate_encode(data if p == 1 else _predicted(data, p))
        extra[20 + i] = Stream({"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": p, "Columns": COLUMNS}}, raw)
    extra[30], extra[31] = Stream(dict(extra[10].dict), extra[10].raw), Stream(extra[10].dict | {"StructParent": 1}, extra[10].raw)
    return one_page(b"", {"XObject": {f"X{n}": Ref(n, 0) for n in extra}}, extra)


def sealed(key: int, name: str) -> bytes:
    """A document under a user password ``open``: RC4, AES-128 or AES-256 by ``key % 3``."""
    version, word, ident = (2, 4, 5)[key % 3], b"open", b"0123456789abcdef"
    doc = Document(text_document([[name]], Title=name))
    if version == 5:
        secret, salt = hashlib.sha256(name.encode()).digest(), b"saltsaltkeysaltk"
        u = crypt.hash_r6(word, salt[:8], b"", 5) + salt
        o = crypt.hash_r6(b"boss", salt[:8], u, 5) + salt
        own = {"O": o, "OE": crypt.aes_cbc_encrypt(crypt.hash_r6(b"boss", salt[8:], u, 5), bytes(16), secret, padded=False), "U": u, "UE": crypt.aes_cbc_encrypt(crypt.hash_r6(word, salt[8:], b"", 5), bytes(16), secret, padded=False), "R": 5}
    else:
        digest = lambda d, times: d if times == 0 else digest(hashlib.md5(d[:16]).digest(), times - 1)
        owner, o = digest(hashlib.md5((b"boss" + crypt.PAD)[:32]).digest(), 50), (word + crypt.PAD)[:32]
        for i in range(20):
            o = crypt.rc4(bytes(c ^ i for c in owner[:16]), o)
        secret = digest(hashlib.md5((word + crypt.PAD)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest(), 50)
        u = hashlib.md5(crypt.PAD + ident).digest()
        for i in range(20):
            u = crypt.rc4(bytes(c ^ i for c in secret), u)
        own = {"O": o, "U": u + bytes(16), "R": 3 if version == 2 else 4}
    method = {2: None, 4: "AESV2", 5: "AESV3"}[version]
    own |= {"Filter": Name("Standard"), "V": version, "P": -4, "Length": 256 if version == 5 else 128}
    if method:
        own |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def seal(v: object, num: int) -> object:
        if isinstance(v, bytes):
            mine = secret if version == 5 else hashlib.md5(secret + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if method else b"")).digest()
            return b"i" * 16 + crypt.aes_cbc_encrypt(mine, b"i" * 16, v) if method else crypt.rc4(mine, v)
        if isinstance(v, dict):
            return {k: seal(x, num) for k, x in v.items()}
        return Stream(v.dict, seal(v.raw, num)) if isinstance(v, Stream) else v

    return write_file({n: seal(v, n) for n, v in reachable(doc).items()} | {99: own}, doc.trailer | {"Encrypt": Ref(99, 0), "ID": [ident, ident]})


def faced(key: int, name: str) -> bytes:
    """The name in each standard text face at size 1."""
    faces = ("Helvetica", "Helvetica-Bold", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Courier")
    fonts = {f"F{i}": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(f), "Encoding": Name("WinAnsiEncoding")} for i, f in enumerate(faces)}
    shown = b"".join(b"BT /F%d 1 Tf %s Tj ET\n" % (i, write_value(name.encode("cp1252", "replace"))) for i in range(len(faces)))
    return one_page(shown, {"Font": fonts})


def annotated(key: int, name: str) -> bytes:
    """A note, an unknown kind that odd keys make invisible, an empty square, a link in a group that keys divisible by 3 hide, a check box with two states."""
    stamp = lambda data: Stream({"Subtype": Name("Form"), "BBox": [0, 0, 10, 20], "Matrix": [0, 1, -1, 0, 0, 0]}, data)
    look = lambda num: {"N": Ref(num, 0)}
    box = {"Subtype": Name("Widget"), "Rect": [0, 0, 40, 10], "AS": Name("On" if key % 2 else "Off"), "AP": {"N": {"On": Ref(20, 0), "Off": Ref(21, 0)}}}
    held = {
        10: {"Subtype": Name("Text"), "Rect": [100, 100, 120 + key % 10, 110], "AP": look(20)}, 11: {"Subtype": Name("Own"), "Rect": [0, 0, 1, 1], "F": key % 2}, 12: {"Subtype": Name("Square"), "Rect": [5, 5, 5, 9]},
        13: {"Subtype": Name("Link"), "Rect": [0, 0, 20, 10], "OC": Ref(16, 0), "AP": look(21)}, 14: box, 16: {"Type": Name("OCG"), "Name": b"g"}, 20: stamp(b"0 0 1 1 re f"), 21: stamp(b""),
    }
    data = one_page(b"", {}, held | {3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Annots": [Ref(n, 0) for n in range(10, 15)]}}, OCProperties={"OCGs": [Ref(16, 0)], "D": {"OFF": [Ref(16, 0)] * (key % 3 == 0)}})
    return data


def drawn(key: int, name: str) -> bytes:
    """An annotation of every kind that is drawn from its dictionary alone."""
    k, rect = key % 10, [0, 0, 100, 50]
    quad = [10, 10 + k, 90, 10 + k, 90, 22 + k, 10, 22 + k]
    rows = [10, 22 + k, 90, 22 + k, 10, 10 + k, 90, 10 + k]
    own = [
        {"Subtype": Name("Link"), "Border": [0, 0, k]}, {"Subtype": Name("Link"), "BS": {"W": 2, "S": Name("U")}}, {"Subtype": Name("Square"), "BS": {"W": 4}, "IC": [1, 0, 0]}, {"Subtype": Name("Circle"), "BS": {"W": 0}, "IC": [0.5]},
        {"Subtype": Name("Polygon"), "Vertices": [0, 0, k, 0, k, 5]}, {"Subtype": Name("PolyLine"), "Vertices": [0, 0, k, 5]}, {"Subtype": Name("Line"), "L": [1, 2, 3, k]}, {"Subtype": Name("Ink"), "InkList": [[1, 1, 2, 2, k, 3], [4, 4, 5, 5]]},
        {"Subtype": Name("Highlight"), "QuadPoints": quad}, {"Subtype": Name("Underline"), "QuadPoints": rows}, {"Subtype": Name("StrikeOut"), "QuadPoints": quad + rows}, {"Subtype": Name("Squiggly"), "QuadPoints": quad},
        {"Subtype": Name("Text")}, {"Subtype": Name("Square"), "AP": {"N": Ref(20, 0)}},
    ]
    page = {"Type": Name("Page"), "Parent": Ref(2, 0), "Annots": [v | {"Rect": rect} for v in own]}
    return one_page(b"", {}, {3: page, 20: Stream({"Subtype": Name("Form"), "BBox": [0, 0, 1, 1]}, b"")})


def patterned(key: int, name: str) -> bytes:
    """Shadings of every type, both kinds of patterns, and a font of drawn glyphs."""
    k = key % 10
    ramp = {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [1, 0.5, k / 10]}
    mesh = {"ColorSpace": Name("DeviceGray"), "BitsPerCoordinate": 8, "BitsPerComponent": 8, "Decode": [0, 255, 0, 255, 0, 1]}
    flat = {"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1]}
    shadings: dict[int, object] = {
        10: {"ShadingType": 1, "ColorSpace": Name("DeviceGray"), "Domain": [0, 1, 0, 1], "Matrix": [k + 1, 0, 0, 1, 0, 0], "Function": Ref(30, 0)}, 11: {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, k + 1, 0], "Function": ramp, "Extend": [True, False]},
        12: {"ShadingType": 3, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, 1, 5, 5, k + 1], "Function": ramp}, 13: Stream(mesh | {"ShadingType": 4, "BitsPerFlag": 8}, bytes([0, k, 20, 255] * 3)), 14: Stream(mesh | {"ShadingType": 5, "VerticesPerRow": 2}, bytes([k, 1, 0] * 4)),
        15: Stream(mesh | {"ShadingType": 6, "BitsPerFlag": 8}, bytes([0, *[k] * 24, 0, 0, 255, 255])), 16: Stream(mesh | {"ShadingType": 7, "BitsPerFlag": 8}, bytes([0, *[k] * 32, 255, 255, 0, 0])),
    }
    glyphs = {"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "CharProcs": {"sq": Ref(24, 0), "dot": Ref(25, 0)}, "Encoding": {"Differences": [97, Name("sq"), Name("dot")]}, "FirstChar": 97, "Widths": [500, 250]}
    extra = shadings | {
        20: Stream({"PatternType": 1, "PaintType": 2, "BBox": [0, 0, 4, 4], "XStep": k + 5, "YStep": 6}, b"0 0 4 4 re f"), 21: {"PatternType": 2, "Shading": Ref(11, 0), "Matrix": [2, 0, 0, 2, 0, 0]}, 22: glyphs,
        24: Stream({}, b"500 0 0 0 400 400 d1 1 0 0 rg 0 0 400 400 re f"), 25: Stream({}, b"250 0 d0 0 0 1 rg 0 0 100 100 re f"), 30: Stream(flat, b"{ mul }"),
    }
    content = b"".join(b"/S%d sh\n" % n for n in shadings) + b"/U cs 0.25 /T scn 0 0 1 1 re f /Pattern cs /A scn 0 0 1 1 re f 0 1 0 rg BT /G 10 Tf %d 4 Td (aab) Tj ET" % k
    return one_page(content, {"Shading": {f"S{n}": Ref(n, 0) for n in shadings}, "Pattern": {"T": Ref(20, 0), "A": Ref(21, 0)}, "ColorSpace": {"U": [Name("Pattern"), Name("DeviceGray")]}, "Font": {"G": Ref(22, 0)}}, extra)


def pictured(key: int, name: str) -> bytes:
    """Images of two pixels in a row, in every space, depth and kind of mask."""
    k = key % 16
    image = lambda space, bits, data, **own: Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": bits} | ({} if space is None else {"ColorSpace": space}) | own, bytes(data))
    gray, tint = Name("DeviceGray"), {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [1, 0, 1]}
    return one_page(b"", {}, {
        10: image(gray, 8, [k, 255]), 11: image(gray, 4, [k << 4 | 15 - k]), 12: image(gray, 1, [0x40]), 13: image(gray, 2, [k % 4 << 6 | 0x30]), 14: image(gray, 16, [k, 0, 255, 255]), 15: image(Name("DeviceRGB"), 8, [k, 1, 2, 3, 4, 5]),
        16: image(Name("DeviceCMYK"), 8, [255 - k, 0, 0, 0, 0, 0, 0, 255]), 17: image([Name("Indexed"), Name("DeviceRGB"), 1, bytes([1, 2, 3, k, 5, 6])], 8, [1, 0]), 18: image([Name("Separation"), Name("Spot"), Name("DeviceRGB"), tint], 8, [k, 255]),
        19: image(gray, 8, [k, 255], Decode=[1, 0]), 20: image(None, 1, [0x40], ImageMask=True), 21: image(gray, 8, [k, 255], Mask=[k, k]), 22: image(gray, 8, [k, 255], SMask=Ref(10, 0)), 23: image([Name("ICCBased"), Ref(24, 0)], 8, [k, 1, 2, 3, 4, 5]),
        24: Stream({"N": 3}, b"icc"),
    })


KINDS: dict[str, Callable[[int, str], bytes]] = {
    "structured": structured, "revised": revised, "damaged": damaged, "graphic": graphic, "typeset": typeset, "layered": layered, "filtered": filtered, "sealed": sealed, "faced": faced,
    "annotated": annotated, "drawn": drawn, "patterned": patterned, "pictured": pictured,
}
