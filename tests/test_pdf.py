"""Documents of every structure, built here, read back; damaged and hostile ones too."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions.filters import ascii85_encode, flate_encode, run_length_encode
from quire.sources.pdf import crypt
from quire.sources.pdf.document import Document, operators, resolve_role
from quire.sources.pdf.fonts import Font, glyph_text, parse_cmap
from quire.sources.pdf.interpret import Interpreter
from quire.sources.pdf.objects import Name, Parser, PdfError, Ref, Stream, to_json, write_value
from quire.sources.pdf.write import Edits, aliases, balanced_kids, compact_text, reachable, replace_text, rewrite, text_document, write_file


def marks(doc, kind="text"):
    return [m for p in doc.pages() for k, m in Interpreter(doc, p).run() if k == kind]


def shown(doc):
    return ["".join(g["text"] for g in m["glyphs"]) for m in marks(doc)]


def page_file(content, resources=None, extra=None, page=None, **trailer):
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | (extra or {}).get(1, {}),
        2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 200, 100], "Contents": Ref(4, 0), "Resources": resources or {"Font": {"F": Ref(5, 0)}}} | (page or {}),
        4: Stream({}, content),
        5: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")},
    }
    return write_file(objects | {k: v for k, v in (extra or {}).items() if k != 1}, {"Root": Ref(1, 0)} | trailer)


def test_parser():
    v = Parser(b"<< /A [1 -2.5 (a\\(b\\051\\n\\101) <48 4> true null 3 0 R] /B#20C /d % x\n >>").value()
    assert v == {"A": [1, -2.5, b"a(b)\nA", b"H@", True, None, Ref(3, 0)], "B C": Name("d")}
    assert Parser(write_value(v)).value() == v
    assert to_json([Name("n"), b"\xff", Ref(1, 0), 1, 1.0]) == '[{"$n":"n"},{"$s":"ff"},{"$r":[1,0]},1,1.0]'
    for bad in (b"(abc", b"<< /a 1 /a 2 >>", b"/a#00", b"[" * 300, b"<4g>", b"1e5"):
        with pytest.raises(PdfError):
            Parser(bad).value()
    assert Parser(b"<< /a 1 /a 2 >>", lenient=True).value() == {"a": 2}
    assert Parser(b"(a\\\nb\r\nc(d)e)").value() == b"ab\nc(d)e"


def test_text_and_classic_table():
    doc = Document(text_document([["Hello (x)", "naïve"], ["two"]], Title="Größe", Custom="c"))
    assert shown(doc) == ["Hello (x)", "naïve", "two"]
    assert doc.info() == {"Title": "Größe", "Custom": "c"}
    assert [p.media_box for p in doc.pages()] == [[0, 0, 595, 842]] * 2


def test_streams_of_objects_and_references():
    inner = b"1 0 2 %d " % len(b"<</Type/Catalog/Pages 2 0 R>> ")
    body = b"<</Type/Catalog/Pages 2 0 R>> <</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 9 9]>>"
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for num, v in {3: {"Type": Name("Page"), "Parent": Ref(2, 0)}, 6: Stream({"Type": Name("ObjStm"), "N": 2, "First": len(inner), "Filter": Name("FlateDecode")}, flate_encode(inner + body))}.items():
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + write_value(v) + b"\nendobj\n"
    at = len(out)
    rows = [(0, 0, 0), (2, 6, 0), (2, 6, 1), (1, places[3], 0), (0, 0, 0), (0, 0, 0), (1, places[6], 0), (1, at, 0)]
    data = b"".join(bytes([k]) + p.to_bytes(4, "big") + bytes([g]) for k, p, g in rows)
    own = {"Type": Name("XRef"), "Size": 8, "W": [1, 4, 1], "Root": Ref(1, 0), "Filter": Name("FlateDecode")}
    out += b"7 0 obj\n" + write_value(Stream(own, flate_encode(data))) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    doc = Document(bytes(out))
    assert len(list(doc.pages())) == 1 and doc.xref[1].kind == 2


def test_newest_revision_wins():
    first = text_document([["old"]], Title="old")
    doc = Document(first)
    num = doc.trailer["Info"].num
    at, start = len(first), first.rindex(b"startxref")
    previous = int(first[start + 9 :].split()[0])
    added = b"%d 0 obj\n<</Title (new)>>\nendobj\n" % num
    table = b"xref\n%d 1\n%010d 00000 n \ntrailer\n" % (num, at) + write_value(doc.trailer | {"Prev": previous}) + b"\nstartxref\n%d\n%%%%EOF\n" % (at + len(added))
    newer = Document(first + added + table)
    assert newer.info() == {"Title": "new"} and len(newer.sections) == 2 and shown(newer) == ["old"]


def test_damage_is_repaired_only_when_lenient():
    data = text_document([["kept"]])
    broken = [data.replace(b"startxref", b"startxxxx"), data[: data.rindex(b"xref\n0")], data.replace(b"%PDF-1.7", b"%PDF-9.9")]
    for bad in broken:
        with pytest.raises(PdfError):
            Document(bad)
        doc = Document(bad, lenient=True)
        assert shown(doc) == ["kept"] and doc.notes
    moved = data.replace(b"\n0000000", b"\n0000001", 0)
    assert shown(Document(moved)) == ["kept"]
    with pytest.raises(PdfError):
        Document(b"not a document at all", lenient=True)


def test_cycles_are_refused():
    kids = page_file(b"", extra={2: {"Type": Name("Pages"), "Kids": [Ref(2, 0)]}})
    with pytest.raises(PdfError):
        list(Document(kids).pages())
    form = Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"X": Ref(6, 0)}}}, b"/X Do")
    with pytest.raises(PdfError):
        marks(Document(page_file(b"/X Do", {"XObject": {"X": Ref(6, 0)}}, {6: form})))


def test_inherited_page_attributes():
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0), Ref(4, 0)], "MediaBox": [10, 10, 0, 0], "Rotate": -90},
        3: {"Type": Name("Pages"), "Kids": [Ref(5, 0)], "CropBox": [2, 2, 20, 20]}, 4: {"Type": Name("Page"), "Rotate": 450, "UserUnit": 2}, 5: {"Type": Name("Page")},
    }
    a, b = Document(write_file(objects, {"Root": Ref(1, 0)})).pages()
    assert (a.media_box, a.crop_box, a.rotation, a.user_unit) == ([0, 0, 10, 10], [2, 2, 10, 10], 270, 1)
    assert (b.crop_box, b.rotation, b.user_unit) == ([0, 0, 10, 10], 90, 2)


def test_text_positions():
    content = b"q 2 0 0 2 10 20 cm BT /F 10 Tf 50 Tz 3 Tc 4 Tw 12 TL 1 0 0 1 5 5 Tm (a b) Tj T* [(c) -500 (d)] TJ 1 2 (e) \" 7 0 Td (f) ' 5 Ts (g) Tj ET Q"
    a, cd, e, f, g = marks(Document(page_file(content)))
    assert a["matrix"] == [2, 0, 0, 2, 20, 30] and [x["x"] for x in a["glyphs"]] == pytest.approx([0, 4.5, 11.0])
    assert cd["matrix"][5] == 6 and [x["x"] for x in cd["glyphs"]] == pytest.approx([0, 7.0])
    assert e["matrix"][5] == -18 and f["matrix"][4:] == [34, -42] and g["matrix"][5] == -32


def test_paths_states_images_and_marked_content():
    image = Stream({"Subtype": Name("Image"), "Width": 2, "Height": 2}, b"1234")
    content = b"q 3 w 1 0 0 rg /G gs 0 0 10 5 re B* Q 1 1 m 2 2 l s /T <</MCID 7>> BDC /I Do EMC BI /W 1 /H 1 /CS /G /BPC 8 ID E EI 0 0 m 1 1 2 2 3 3 c f"
    doc = Document(page_file(content, {"XObject": {"I": Ref(6, 0)}, "ExtGState": {"G": {"ca": 0.5, "BM": [Name("Nope"), Name("Multiply")]}}}, {6: image}))
    rect, line, curve = marks(doc, "path")
    assert rect["even_odd"] and rect["fill"] and rect["stroke"] and [s[0] for s in rect["segments"]] == ["M", "L", "L", "L", "Z"]
    assert (rect["style"]["fill"], rect["style"]["fill_alpha"], rect["style"]["blend"], rect["style"]["line_width"]) == ("1 0 0", 0.5, "Multiply", 3)
    assert line["style"]["line_width"] == 1.0 and line["segments"][-1][0] == "Z" and curve["segments"][1][1] == [1, 1, 2, 2, 3, 3]
    outer, inline = marks(doc, "image")
    assert (outer["num"], outer["mcid"], inline["num"], inline["width"]) == (6, 7, None, 1)
    assert [m["operator"] for m in marks(doc, "content")] == ["BDC", "EMC"]


def test_content_faults():
    for bad in (b"foo", b"1 2 m 3", b"Q", b"q", b"EMC", b"BT", b"(x) Tj", b"BT 9 Tr ET", b"/N gs"):
        with pytest.raises(PdfError):
            list(marks(Document(page_file(bad))))
        list(marks(Document(page_file(bad), lenient=True)))
    assert marks(Document(page_file(b"BX foo EX"))) == []
    with pytest.raises(PdfError):
        marks(Document(page_file(b"q " * 300)))


def test_optional_content():
    groups = {n: {"Type": Name("OCG"), "Name": b"g"} for n in (6, 7)}
    config = {1: {"OCProperties": {"OCGs": [Ref(6, 0), Ref(7, 0)], "D": {"OFF": [Ref(7, 0)]}}}}
    content = b"/OC /A BDC BT /F 1 Tf (on) Tj ET EMC /OC /B BDC BT (off) Tj ET EMC /OC /C BDC BT (not) Tj ET EMC /OC /D BDC BT (all) Tj ET EMC"
    members = {8: {"Type": Name("OCMD"), "VE": [Name("Not"), Ref(7, 0)]}, 9: {"Type": Name("OCMD"), "OCGs": [Ref(6, 0), Ref(7, 0)], "P": Name("AllOn")}}
    resources = {"Font": {"F": Ref(5, 0)}, "Properties": {"A": Ref(6, 0), "B": Ref(7, 0), "C": Ref(8, 0), "D": Ref(9, 0)}}
    assert shown(Document(page_file(content, resources, config | groups | members))) == ["on", "not"]


def test_fonts():
    assert [glyph_text(n) for n in ("A", "eacute", "f_i", "uni00410042", "u1F600", "a.alt", "Ccedilla", "nothing", "uniD800")] == ["A", "é", "fi", "AB", "😀", "a", "Ç", None, None]
    cmap = parse_cmap(b"1 begincodespacerange <00> <7f> endcodespacerange 1 begincodespacerange <8000> <ffff> endcodespacerange 1 beginbfchar <41> <0058> endbfchar 2 beginbfrange <8001> <8003> <0061> <8004> <8005> [<0031> <0032>] endbfrange")
    assert [cmap.next(b"\x41\x80\x01", i) for i in (0, 1)] == [b"A", b"\x80\x01"]
    assert cmap.text == {b"A": "X", b"\x80\x01": "a", b"\x80\x02": "b", b"\x80\x03": "c", b"\x80\x04": "1", b"\x80\x05": "2"}
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(7, 0), "DescendantFonts": [{"Subtype": Name("CIDFontType2"), "DW": 500, "W": [1, [600, 700], 5, 6, 250]}]}
    doc = Document(page_file(b"BT /F 10 Tf <000100020005> Tj ET", {"Font": {"F": Ref(6, 0)}}, {6: font, 7: Stream({}, b"1 beginbfrange <0001> <0005> <0041> endbfrange")}))
    (m,) = marks(doc)
    assert [(g["text"], g["cid"], round(g["width"], 9)) for g in m["glyphs"]] == [("A", 1, 0.6), ("B", 2, 0.7), ("E", 5, 0.25)]
    simple = Font(doc, {"Subtype": Name("Type1"), "BaseFont": Name("H"), "Encoding": {"Differences": [65, Name("eacute"), Name("B")]}, "FirstChar": 65, "Widths": [444]})
    assert [(g.text, g.width) for g in simple.decode(b"AB")] == [("é", 0.444), ("B", 0.0)]
    assert simple.encode("éB") == b"AB"


def test_trees():
    extra = {
        1: {"Outlines": Ref(6, 0), "PageLabels": {"Nums": [0, {"S": Name("r")}, 4, {"S": Name("D"), "St": 2, "P": b"A-"}]}, "Dests": {"old": [Ref(3, 0), Name("Fit")]},
            "Names": {"Dests": {"Kids": [Ref(9, 0)]}, "EmbeddedFiles": {"Names": [b"f", {"UF": b"f.txt", "EF": {"F": Ref(4, 0)}}]}}, "StructTreeRoot": Ref(10, 0)},
        6: {"First": Ref(7, 0)}, 7: {"Title": b"one", "First": Ref(8, 0), "Next": Ref(13, 0), "F": 3, "Count": 1, "Dest": b"new"}, 8: {"Title": b"inner", "Dest": Name("old")}, 13: {"Title": b"two", "A": {"S": Name("GoTo"), "D": b"gone"}},
        9: {"Names": [b"new", {"D": [Ref(3, 0), Name("XYZ"), 1, 2, None]}]},
        10: {"K": [Ref(11, 0)], "RoleMap": {"My": Name("Other"), "Other": Name("P"), "X": Name("Y"), "Y": Name("X")}, "ParentTree": {"Nums": [0, [Ref(11, 0), None, Ref(12, 0)], 1, Ref(12, 0)]}},
        11: {"S": Name("My"), "K": [0, Ref(12, 0)], "Pg": Ref(3, 0)}, 12: {"S": Name("Span"), "K": {"Type": Name("MCR"), "MCID": 2}},
    }
    doc = Document(page_file(b"", extra=extra))
    items = list(doc.outlines())
    assert [(o["title"], o["level"], o["bold"], o["italic"], o["expanded"]) for o in items] == [("one", 0, True, True, True), ("inner", 1, False, False, False), ("two", 0, False, False, False)]
    assert [doc.destination(o["destination"]) for o in items] == [[Ref(3, 0), Name("XYZ"), 1, 2, None], [Ref(3, 0), Name("Fit")], None]
    assert list(doc.page_labels()) == [{"start": 0, "style": "r", "prefix": "", "first": 1}, {"start": 4, "style": "D", "prefix": "A-", "first": 2}]
    assert [e["file_name"] for e in doc.embedded_files()] == ["f.txt"]
    assert [(s["type"], s["level"], s["mcid"], s["page"]) for s in doc.structure()] == [("P", 0, None, 3), ("MCID", 1, 0, 3), ("Span", 1, None, 3), ("MCR", 2, 2, 3)]
    assert list(doc.structure_parents()) == [(0, 0, 11), (0, 2, 12), (1, -1, 12)]
    roles = {"X": "Y", "Y": "X", "My": "Other", "Other": "P"}
    assert resolve_role("X", roles) is None and resolve_role("My", roles) == "P" and resolve_role("H", roles) == "H"
    # a mapped role is mapped before it is looked at
    assert resolve_role("My", roles, {"My", "Other"}.__contains__) == "Other" and resolve_role("My", roles, {"My"}.__contains__) is None and resolve_role("X", roles, {"X"}.__contains__) == "X"


def test_annotations_fields_and_actions():
    extra = {
        1: {"AcroForm": {"Fields": [Ref(8, 0)]}, "OpenAction": Ref(10, 0)}, 6: {"Subtype": Name("Text"), "Contents": b"parent", "Rect": [0, 0, 1, 1], "A": Ref(10, 0)}, 7: {"Subtype": Name("Popup"), "Parent": Ref(6, 0), "Contents": b"own", "T": b"own"},
        8: {"T": b"form", "FT": Name("Tx"), "V": b"up", "Kids": [Ref(9, 0)]}, 9: {"T": b"name", "Parent": Ref(8, 0)},
        10: {"S": Name("URI"), "URI": b"http://x", "Next": [Ref(11, 0), Ref(12, 0)]}, 11: {"S": Name("GoTo"), "Next": Ref(12, 0)}, 12: {"S": Name("Named"), "Next": Ref(10, 0)},
    }
    doc = Document(page_file(b"", extra=extra, page={"Annots": [Ref(6, 0), Ref(7, 0)]}))
    (page,) = doc.pages()
    text, popup = doc.annotations(page)
    assert popup["contents"] == "parent" and "T" not in popup["dict"]
    assert [a["type"] for a in doc.actions(Ref(10, 0))] == ["URI", "GoTo", "Named"]
    assert doc.field(doc.object(9)) == {"FT": Name("Tx"), "V": b"up", "name": "form.name"}


def encrypted(version, password):
    """A one-page document sealed with RC4 (V2), AES-128 (V4) or AES-256 (V5)."""
    data, ident, word = text_document([["sealed"]], Title="secret"), b"0123456789abcdef", password.encode()
    if version == 5:
        key, salt = bytes(range(32)), b"saltsaltkeysaltk"
        u = crypt.hash_r6(word, salt[:8], b"", 6) + salt
        ue = crypt.aes_cbc_encrypt(crypt.hash_r6(word, salt[8:], b"", 6), bytes(16), key, padded=False)
        own = {"O": crypt.hash_r6(b"boss", salt[:8], u, 6) + salt, "OE": crypt.aes_cbc_encrypt(crypt.hash_r6(b"boss", salt[8:], u, 6), bytes(16), key, padded=False), "U": u, "UE": ue, "R": 6}
    else:
        owner = hashlib.md5((b"boss" + crypt.PAD)[:32]).digest()
        for _ in range(50):
            owner = hashlib.md5(owner[:16]).digest()
        o = (word + crypt.PAD)[:32]
        for i in range(20):
            o = crypt.rc4(bytes(c ^ i for c in owner[:16]), o)
        key = hashlib.md5((word + crypt.PAD)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()
        for _ in range(50):
            key = hashlib.md5(key[:16]).digest()
        u = hashlib.md5(crypt.PAD + ident).digest()
        for i in range(20):
            u = crypt.rc4(bytes(c ^ i for c in key), u)
        own = {"O": o, "U": u + bytes(16), "R": 3 if version == 2 else 4}
    method = {2: None, 4: "AESV2", 5: "AESV3"}[version]
    own |= {"Filter": Name("Standard"), "V": version, "P": -4, "Length": 256 if version == 5 else 128}
    if method:
        own |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def seal(v, num):
        if isinstance(v, bytes):
            own_key = key if version == 5 else hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if method else b"")).digest()
            return b"i" * 16 + crypt.aes_cbc_encrypt(own_key, b"i" * 16, v) if method else crypt.rc4(own_key, v)
        if isinstance(v, dict):
            return {k: seal(x, num) for k, x in v.items()}
        if isinstance(v, Stream):
            return Stream(v.dict, seal(v.raw, num))
        return v

    doc = Document(data)
    objects = {n: seal(v, n) for n, v in reachable(doc).items()}
    return write_file(objects | {99: own}, doc.trailer | {"Encrypt": Ref(99, 0), "ID": [ident, ident]})


@pytest.mark.parametrize("version", [2, 4, 5])
def test_encryption(version):
    data = encrypted(version, "open")
    for password, owner in (("open", False), ("boss", True)):
        doc = Document(data, password)
        assert shown(doc) == ["sealed"] and doc.info()["Title"] == "secret" and doc.security.owner == owner
    with pytest.raises(PdfError):
        Document(data, "wrong")


def test_ciphers():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypt.aes_cbc_decrypt(bytes(16), bytes(16), crypt.aes_cbc_encrypt(bytes(16), bytes(16), b"x" * 33)) == b"x" * 33
    assert crypt.prepare_password("I­X") == b"IX" and crypt.prepare_password("Ⅸ") == b"IX"
    with pytest.raises(PdfError):
        crypt.prepare_password("\u0007")


def test_rewrite_and_optimise():
    page = {"Contents": [Ref(4, 0), Ref(6, 0), Ref(7, 0)]}
    twin = Stream({"Filter": Name("ASCII85Decode")}, ascii85_encode(b"BT /F 5 Tf (twin) Tj ET " * 9))
    kept = Stream({"StructParent": 1}, b"BT /F 5 Tf (kept) Tj ET")
    extra = {6: twin, 7: Stream(dict(twin.dict), twin.raw), 8: Stream({}, b"lost"), 9: kept, 10: Stream(dict(kept.dict), kept.raw)}
    doc = Document(page_file(b"BT /F 5 Tf (a) Tj ET " + b" " * 500, extra=extra, page=page))
    data, report = rewrite(doc, optimise=True)
    again = Document(data)
    assert shown(again) == shown(doc) and report.merged == 1 and report.compressed == 1 and report.removed == 3 and report.bytes_out < report.bytes_in
    assert aliases({1: kept, 2: Stream(dict(kept.dict), kept.raw)}) == {}
    edited, _ = rewrite(doc, Edits(info={"Title": "né"}, attachments={"b": b"2", "a": b"1"}, content={0: b"BT /F 5 Tf (new) Tj ET"}))
    again = Document(edited)
    assert again.info() == {"Title": "né"} and [e["name"] for e in again.embedded_files()] == [b"a", b"b"] and shown(again) == ["new"]
    signed = Document(page_file(b"", extra={1: {"X": Ref(6, 0)}, 6: {"Type": Name("Sig"), "ByteRange": [0, 1]}}))
    assert rewrite(signed, optimise=True)[0] == signed.data
    assert [len(level) for level in balanced_kids(65)] == [2, 1] and balanced_kids(1) == [[(0, 1)]]


def test_text_edits():
    content = b"BT /F 1 Tf (a) Tj ET BT 1 0 0 1 0 0 Tm (b) Tj ET"
    doc = Document(page_file(replace_text(content, {1: "Bé"})))
    assert [m["replacement"] for m in marks(doc)] == [None, "Bé"]
    assert [op for op, _, _ in operators(compact_text(content))] == ["BT", "Tf", "Tj", "Tm", "Tj", "ET"]
    with pytest.raises(PdfError):
        replace_text(content, {5: "x"})
    assert run_length_encode(b"aaab") == b"\xfea\x00b\x80"


def test_images():
    import struct
    import zlib

    import numpy as np

    from quire.sources.pdf import images

    gray = Stream({"Subtype": Name("Image"), "Width": 3, "Height": 2, "BitsPerComponent": 4, "ColorSpace": Name("DeviceGray")}, bytes([0x0F, 0x80, 0xF0, 0x10]))
    rgb = Stream({"Subtype": Name("Image"), "Width": 1, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "SMask": Ref(6, 0), "Filter": Name("FlateDecode")}, flate_encode(bytes([255, 0, 0, 0, 0, 255])))
    palette = Stream({"Subtype": Name("Image"), "Width": 4, "Height": 1, "BitsPerComponent": 2, "ColorSpace": [Name("Indexed"), Name("DeviceCMYK"), 1, bytes([0, 0, 0, 255, 0, 255, 0, 0])], "Mask": [1, 1]}, bytes([0b00010100]))
    stencil = Stream({"Subtype": Name("Image"), "Width": 8, "Height": 1, "ImageMask": True}, bytes([0b10101010]))
    doc = Document(page_file(b"", extra={6: gray}))
    a, b, c, d = (images.decode_image(doc, i) for i in (gray, rgb, palette, stencil))
    assert a[..., 0].tolist() == [[0, 255, 136], [255, 0, 17]]
    assert b[:, 0, :].tolist() == [[255, 0, 0, 0], [0, 0, 255, 255]]
    assert c[0].tolist() == [[0, 0, 0, 255], [255, 0, 255, 0], [255, 0, 255, 0], [0, 0, 0, 255]]
    assert d[0, :, 3].tolist() == [0, 255] * 4
    png = images.encode_png(b)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (1, 2) and png[25] == 6
    size = struct.unpack(">I", png[33:37])[0]
    assert len(zlib.decompress(png[41 : 41 + size])) == 2 * 5
    flat = np.full((40, 60, 4), 200, np.uint8)
    small = images.resized(flat, 15, 5)
    assert small.shape == (10, 15, 4) and (small == 200).all() and images.resized(flat, 100, 5) is flat
    with pytest.raises(images.CodedImage):
        images.decode_image(doc, Stream({"Width": 1, "Height": 1, "Filter": Name("DCTDecode")}, b""))
    assert not images.is_photographic(flat)


def test_links_destinations_and_renditions():
    from quire.sources.pdf.document import select_rendition
    from quire.sources.tables import TABLES

    extra = {
        1: {"Dests": {"old": [Ref(3, 0), Name("FitH"), 7]}, "Names": {"Dests": {"Names": [b"new", [Ref(3, 0), Name("XYZ"), 1, None, 0]]}, "Renditions": {"Names": [b"r", Ref(8, 0)]}}},
        6: {"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "Dest": b"new"}, 7: {"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "A": {"S": Name("URI"), "URI": b"http://x"}},
        8: {"S": Name("SR"), "R": [Ref(9, 0), Ref(10, 0)]}, 9: {"S": Name("MR"), "N": b"a", "C": {"S": Name("MCD"), "CT": b"video/x", "D": {"F": b"f", "UF": b"u", "EF": {"F": Ref(4, 0)}}}}, 10: {"S": Name("MR"), "N": b"b"},
    }
    doc = Document(page_file(b"", extra=extra, page={"Annots": [Ref(6, 0), Ref(7, 0)]}))
    rows = {name: list(TABLES[name][1](doc)) for name in ("named_destinations", "links", "renditions")}
    assert rows["named_destinations"] == [("name", b"old", 0, "FitH", [7.0]), ("string", b"new", 0, "XYZ", [1.0, None, 0.0])]
    assert [r[3:] for r in rows["links"]] == [(0, None, None), (None, "http://x", "URI")]
    assert [(r[1:5], r[6:]) for r in rows["renditions"]] == [((0, 0, "SR", ""), ("", None, None)), ((1, 1, "MR", "a"), ("video/x", "u", 4)), ((2, 1, "MR", "b"), ("", None, None))]
    whole = doc.rendition(Ref(8, 0))
    assert select_rendition(whole, lambda r: r["name"] != "a")["name"] == "b" and select_rendition(whole, lambda r: r["subtype"] == "MR") is None


def test_truetype():
    import struct

    from quire.sources.pdf import truetype

    segments = struct.pack(">HHHHHHH", 4, 0, 0, 4, 0, 0, 0) + struct.pack(">2H", 66, 0xFFFF) + b"\0\0" + struct.pack(">2H2h2H", 65, 0xFFFF, -60, 1, 0, 0)
    groups = struct.pack(">HHIII", 12, 0, 0, 0, 1) + struct.pack(">III", 0x1F600, 0x1F601, 9)
    cmap = struct.pack(">HH", 0, 3) + struct.pack(">HHI", 3, 1, 28) + struct.pack(">HHI", 3, 10, 28 + len(segments)) + struct.pack(">HHI", 1, 0, 28 + len(segments) + len(groups)) + segments + groups + struct.pack(">HHHHH2H", 6, 0, 0, 200, 2, 3, 4)
    held = {"cmap": cmap, "head": bytes(18) + struct.pack(">H", 2000) + bytes(34), "maxp": struct.pack(">IH", 0, 3), "hhea": bytes(34) + struct.pack(">H", 2), "hmtx": struct.pack(">HhHhh", 1000, 0, 500, 0, 0)}
    out, at = struct.pack(">IHHHH", 0x10000, len(held), 0, 0, 0), 12 + 16 * len(held)
    for tag, t in held.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at, len(t))
        at += len(t)
    data = out + b"".join(held.values())
    maps = truetype.character_maps(truetype.tables(data)["cmap"])
    assert maps == {(3, 1): {65: 5, 66: 6}, (3, 10): {0x1F600: 9, 0x1F601: 10}, (1, 0): {200: 3, 201: 4}}
    assert truetype.advances(data) == [500, 250, 250]
    assert [truetype.simple_glyph(maps, 65, "A", False), truetype.simple_glyph(maps, 201, None, True)] == [5, 4]


def test_screens_and_transfers(spark):
    from quire.functions import screens

    pixels = spark.range(1600).selectExpr("id % 40 AS x", "id div 40 AS y")
    at = screens.threshold_at(bytes([64, 128, 192, 255]), 2, 2, F.col("x"), F.col("y"))
    for levels in (1, 3):
        got = {(r["x"], r["y"]): r["v"] for r in pixels.select("x", "y", screens.quantised(F.lit(40000), at, levels).alias("v")).collect()}
        low, rest = divmod(40000 * levels, 65535)
        assert got == {(x, y): low + (rest >= [64, 128, 192, 255][y % 2 * 2 + x % 2] * 257) for x in range(40) for y in range(40)}
    square = lambda v: v * v
    functions = [square, square, square, lambda v: v / 2]
    assert screens.apply_transfer([0.5], "DeviceGray", functions) == [0.25]
    assert screens.apply_transfer([0.5, 0.5, 0.5, 0.5], "DeviceCMYK", functions, "DeviceGray") == [0.5, 0.5, 0.5, 0.75]
    assert screens.apply_transfer([0.5] * 3, "DeviceRGB", functions) == [0.25] * 3


def test_graphics_states_colours_and_clips():
    tint = {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [0, 1, 0, 0]}
    resources = {
        "ColorSpace": {"S": [Name("Separation"), Name("Spot"), Name("DeviceCMYK"), tint], "N": [Name("Separation"), Name("None"), Name("DeviceGray"), tint | {"C0": [0], "C1": [1]}], "I": [Name("Indexed"), Name("DeviceRGB"), 1, b"\xff\0\0\0\xff\0"]},
        "ExtGState": {"G": {"Type": Name("ExtGState"), "LW": 2, "D": [[3, 1], 0], "FL": 5, "RI": Name("Perceptual"), "SA": True, "OP": True, "OPM": 1, "SM": 0.5, "TK": False, "AIS": True, "TR": Name("Identity"), "TR2": Name("Default"), "SMask": {"S": Name("Alpha"), "G": Ref(6, 0)}, "AAPL:AA": False}},
    }
    content = b"/G gs /S cs 0.5 scn 0 0 5 5 re W n 1 1 m 2 2 l S 0 0 1 1 re f /N cs 1 scn 0 0 1 1 re f /I cs 1 sc 0 0 1 1 re f [] 0 d /Saturation ri 7 i 0 0 1 rg 0 0 m 1 1 l B*"
    doc = Document(page_file(content, resources, {6: Stream({"Subtype": Name("Form")}, b"")}))
    (clip,) = marks(doc, "clip")
    line, tinted, indexed, last = marks(doc, "path")
    assert line["clips"] == [clip["ord"]] and clip["segments"][0][0] == "M" and not clip["even_odd"]
    s = line["style"]
    assert (s["line_width"], s["dash"], s["flatness"], s["intent"], s["stroke_adjust"], s["overprint_fill"], s["overprint_stroke"], s["overprint_mode"], s["smoothness"], s["text_knockout"], s["alpha_is_shape"]) == (2, [[3.0, 1.0], 0.0], 5, "Perceptual", True, True, True, 1, 0.5, False, True)
    assert s["transfer"] == "Default" and s["soft_mask"] == {"kind": "Alpha", "group": 6} and s["antialias"] is False
    assert tinted["fill_rgb"] == [1, 0.5, 1] and tinted["style"]["fill_space"] == "Separation"
    assert indexed["fill_rgb"] == [0, 1, 0]  # the separation named None paints nothing
    assert last["fill_rgb"] == [0, 0, 1] and last["style"]["dash"] == [[], 0.0] and last["style"]["intent"] == "Saturation" and last["style"]["flatness"] == 7 and "fill_space" not in last["style"]
    for bad in (b"[0 0] 0 d", b"/Odd ri", b"/Nope cs"):
        with pytest.raises(PdfError):
            marks(Document(page_file(bad, resources)))


def test_text_clips_type3_patterns_and_shadings():
    glyph = Stream({}, b"500 0 0 0 400 400 d1 1 0 0 rg 0 0 400 400 re f")
    font = {"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "CharProcs": {"sq": Ref(7, 0)}, "Encoding": {"Differences": [97, Name("sq")]}, "FirstChar": 97, "Widths": [500]}
    ramp = {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [1, 0.5, 0]}
    axial = {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, 9, 0], "Function": ramp, "Extend": [True, False]}
    mesh = Stream({"ShadingType": 4, "ColorSpace": Name("DeviceGray"), "BitsPerFlag": 8, "BitsPerCoordinate": 8, "BitsPerComponent": 8, "Decode": [0, 255, 0, 255, 0, 1]}, bytes([0, 10, 20, 255, 1, 30, 40, 0]))
    tiling = Stream({"PatternType": 1, "PaintType": 2, "BBox": [0, 0, 4, 4], "XStep": 5, "YStep": 6}, b"0 0 4 4 re f")
    resources = {"Font": {"F": Ref(5, 0), "T": Ref(6, 0)}, "Shading": {"A": axial, "M": Ref(8, 0)}, "Pattern": {"P": Ref(9, 0), "Q": {"PatternType": 2, "Shading": axial, "Matrix": [2, 0, 0, 2, 0, 0]}}, "ColorSpace": {"U": [Name("Pattern"), Name("DeviceGray")]}}
    content = b"BT 7 Tr /F 10 Tf (x) Tj ET 0 1 0 rg BT 0 Tr /T 10 Tf 3 4 Td (aa) Tj ET /A sh /M sh /U cs 0.25 /P scn 0 0 1 1 re f /Pattern cs /Q scn"
    doc = Document(page_file(content, resources, {6: font, 7: glyph, 8: mesh, 9: tiling}))
    first, second = marks(doc)
    (clip,) = marks(doc, "clip")
    assert clip["text_ords"] == [first["ord"]] and second["clips"] == [clip["ord"]]
    squares = [m for m in marks(doc, "path") if m["segments"]][:2]
    assert [m["segments"][0][1] for m in squares] == [[3, 4], [8, 4]] and [m["fill_rgb"] for m in squares] == [[0, 1, 0]] * 2  # d1 keeps the text's colour
    axials = [m for m in marks(doc, "shading") if m["kind"] == 2]
    assert axials[0]["colors"] == [[0, 0, 0], [0.25, 0.125, 0], [0.5, 0.25, 0], [0.75, 0.375, 0], [1, 0.5, 0]] and axials[0]["extend"] == [True, False] and axials[1]["matrix"] == [2, 0, 0, 2, 0, 0]
    (vertices,) = [m["vertices"] for m in marks(doc, "shading") if m["kind"] == 4]
    assert vertices == [[0, 10, 20, 1], [1, 30, 40, 0]]
    tile, _ = marks(doc, "pattern")
    assert (tile["kind"], tile["paint_type"], tile["bbox"], tile["x_step"], tile["y_step"], tile["colors"]) == (1, 2, [0, 0, 4, 4], 5, 6, [0.25])
    kinds = [k for p in doc.pages() for k, _ in Interpreter(doc, p, frozenset(["path"])).run()]
    assert set(kinds) == {"path"} and [m["ord"] for p in doc.pages() for k, m in Interpreter(doc, p, frozenset(["path", "text"])).run()] == sorted(m["ord"] for p in doc.pages() for k, m in Interpreter(doc, p).run() if k in ("path", "text"))


def test_functions_and_spaces():
    from quire.sources.pdf.color import Space, read_function

    doc = Document(page_file(b""))
    square = Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 255, 255, 0]))
    f = read_function(doc, square)
    assert f([0, 0]) == [0] and f([1, 0]) == [1] and f([0.5, 0.5]) == [0.5] and f([0.25, 0]) == [0.25]
    # a cubic through samples of a straight line is that line; through others it passes every sample
    line = Stream({"FunctionType": 0, "Domain": [0, 5], "Range": [0, 1], "Size": [6], "BitsPerSample": 8, "Order": 3}, bytes([0, 51, 102, 153, 204, 255]))
    bent = Stream(line.dict | {}, bytes([0, 200, 10, 250, 40, 90]))
    assert [round(read_function(doc, line)([x])[0], 9) for x in (0, 0.5, 2.25, 4.9, 5)] == [0, 0.1, 0.45, 0.98, 1]
    assert [round(255 * read_function(doc, bent)([x])[0]) for x in range(6)] == [0, 200, 10, 250, 40, 90]
    assert read_function(doc, bent)([2.5])[0] == pytest.approx((-200 + 9 * 10 + 9 * 250 - 40) / 16 / 255)
    four = Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1, 0, 1]}, b"{ dup 1 exch sub }")
    joined = read_function(doc, {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [{"FunctionType": 2, "N": 1}] * 2})
    assert read_function(doc, four)([0.25]) == [0.25, 0.75] and [joined([x])[0] for x in (0, 0.25, 0.75, 1)] == [0, 0.5, 0.5, 0]
    assert Space(doc, [Name("DeviceN"), [Name("A"), Name("B")], Name("DeviceRGB"), Stream({"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1, 0, 1, 0, 1]}, b"{ 0 }")]).rgb([0.25, 0.5]) == [0.25, 0.5, 0]
    icc = Space(doc, [Name("ICCBased"), Stream({"N": 4}, b"")])
    assert icc.first == [0, 0, 0, 1] and icc.rgb([0, 1, 0, 0]) == [1, 0, 1]
    for bad in (Name("Nope"), [Name("ICCBased"), Stream({"N": 2}, b"")]):
        with pytest.raises(PdfError):
            Space(doc, bad)


def test_widths_of_standard_faces():
    doc = Document(page_file(b""))
    width = lambda name, text: [round(g.width * 1000) for g in Font(doc, {"Subtype": Name("Type1"), "BaseFont": Name(name), "Encoding": Name("WinAnsiEncoding")}).decode(text)]
    assert width("Times-Roman", b"i\xe9") == [278, 444] and width("Helvetica-Bold", b"a") == [556] and width("ABCDEF+TimesNewRoman,BoldItalic", b"A") == [667] and width("Courier-Bold", b"m") == [600]
    standard = Font(doc, {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica")})
    assert [round(g.width * 1000) for g in standard.decode(b"'`")] == [222, 222]
    with pytest.raises(PdfError):
        width("Unheard-Of", b"a")
    with pytest.raises(PdfError):
        Font(doc, {"Subtype": Name("Type0"), "Encoding": Name("90ms-RKSJ-H"), "DescendantFonts": [{}]})


def test_recovery_reads_the_whole_file_and_no_trailer_in_streams():
    body = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)]}, 3: {"Type": Name("Page"), "MediaBox": [0, 0, 1, 1]}, 4: Stream({}, b"trailer << /Root 9 0 R >>")}
    data = write_file(body, {"Root": Ref(1, 0)})
    far = data[: data.index(b"3 0 obj")] + b"%" + b" " * (65 << 20) + b"\n" + data[data.index(b"3 0 obj") : data.rindex(b"startxref")]
    doc = Document(far, lenient=True)
    assert len(list(doc.pages())) == 1 and doc.trailer["Root"] == Ref(1, 0)


def test_optimised_pages_are_balanced():
    data = text_document([[str(i)] for i in range(200)])
    out, _ = rewrite(Document(data), optimise=True)
    doc = Document(out)
    assert shown(doc) == [str(i) for i in range(200)] and [p.media_box for p in doc.pages()] == [[0, 0, 595, 842]] * 200
    root = doc.object(doc.catalog["Pages"].num)
    assert root["Count"] == 200 and [doc.object(k.num)["Count"] for k in root["Kids"]] == [64, 64, 64, 8]


def test_document_level_tables():
    extra = {
        1: {"Metadata": Ref(6, 0), "OutputIntents": [{"S": Name("GTS_PDFX"), "OutputConditionIdentifier": b"CGATS", "DestOutputProfile": Ref(7, 0)}], "StructTreeRoot": {"IDTree": {"Names": [b"a", Ref(3, 0)]}}},
        6: Stream({"Type": Name("Metadata")}, b"<x/>"), 7: Stream({"N": 4}, b"icc"),
    }
    doc = Document(page_file(b"", extra=extra))
    (intent,) = doc.output_intents()
    assert doc.metadata() == b"<x/>" and (intent["subtype"], intent["identifier"], intent["profile"], intent["components"], intent["info"]) == ("GTS_PDFX", "CGATS", 7, 4, None)
    assert list(doc.structure_ids()) == [(b"a", 3)]


def test_edits_of_links_images_and_labels():
    import numpy as np

    from quire.sources.pdf.images import decode_image

    link = {"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "Dest": b"x"}
    image = Stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"a")
    data = page_file(b"BT /F 1 Tf (a) Tj ET /I Do", {"Font": {"F": Ref(5, 0)}, "XObject": {"I": Ref(8, 0)}}, {6: link, 7: dict(link), 8: image}, page={"Annots": [Ref(6, 0), Ref(7, 0)]})
    pixels = np.array([[[1, 2, 3, 255], [4, 5, 6, 7]]], np.uint8)
    out, _ = rewrite(Document(data), Edits(links={(0, 0): "http://é", (0, 1): None}, images={8: pixels}, labels=[(0, "D", "p", 3)], text={0: {0: "whole"}}, drop=("Dests",)))
    doc = Document(out)
    (page,) = doc.pages()
    (kept,) = doc.annotations(page)
    assert kept["dict"]["A"]["URI"].decode() == "http://é" and "Dest" not in kept["dict"] and [m["replacement"] for m in marks(doc)] == ["whole"]
    assert list(doc.page_labels()) == [{"start": 0, "style": "D", "prefix": "p", "first": 3}]
    ((_, mark),) = [(k, m) for k, m in Interpreter(doc, page).run() if k == "image"]
    assert (decode_image(doc, doc.object(mark["num"])) == pixels).all()
    joined = page_file(b"BT /F 1 Tf 1 0 0 1 5 5 Tm (a) Tj ET BT 1 0 0 1 9 9 Tm (b) Tj ET")
    compact = Document(rewrite(Document(joined), Edits(compact=True))[0])
    assert [(m["matrix"], m["glyphs"][0]["text"]) for m in marks(compact)] == [(m["matrix"], m["glyphs"][0]["text"]) for m in marks(Document(joined))]
    assert [op for p in compact.pages() for op, _, _ in operators(compact.content(p))].count("BT") == 1
    for bad in (Edits(links={(0, 5): "x"}), Edits(images={5: pixels}), Edits(content={3: b""})):
        with pytest.raises(PdfError):
            rewrite(Document(data), bad)


def broken_files():
    """Documents with one fault each, in places that only some tables read."""
    text, resources = b"BT /F 9 Tf 5 5 Td (a) Tj ET 0 0 9 9 re f BT /G 9 Tf (b) Tj ET 1 1 5 5 re S", {"Font": {"F": Ref(5, 0), "G": Ref(6, 0)}}
    composite = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H")}
    bad_map = Stream({"Filter": Name("FlateDecode")}, b"no deflate")
    yield page_file(text, resources, {6: composite | {"DescendantFonts": 7}})
    yield page_file(text, resources, {6: composite | {"DescendantFonts": [Ref(7, 0)], "ToUnicode": bad_map and Ref(8, 0)}, 7: {"W": [Name("x"), []]}, 8: bad_map})
    yield page_file(text, None, {6: {"Type": Name("Font"), "Subtype": Name("Type0"), "DescendantFonts": [Ref(6, 0)]}})
    yield page_file(text, None, {1: {"Names": {"Dests": {"Kids": [Ref(1, 0)]}}, "Outlines": Ref(8, 0)}, 8: {"First": Ref(9, 0)}, 9: {"Next": Ref(9, 0)}}, {"Annots": [{"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "Dest": b"d"}]})
    yield page_file(text + b" BI /W 1 ID", None, {1: {"StructTreeRoot": {"K": 5, "ParentTree": {"Nums": [0]}}, "PageLabels": {"Nums": [0]}}})
    yield page_file(text, None, {1: {"AcroForm": {"Fields": [Ref(9, 0)]}, "OCProperties": {"D": 7}}, 9: {"Kids": [3]}, 8: Stream({"Subtype": Name("Image"), "Width": 1, "Height": 9, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")}, b"")})
    cut = page_file(text, resources, {6: {"Type": Name("Font"), "Subtype": Name("Type3"), "CharProcs": 1}})
    yield cut.replace(b"/Courier", b"/Cou#00er")
    yield cut.replace(b"[0 0 200 100]", b"[0 0 (x) 100]")


@pytest.mark.parametrize("nth", range(8))
def test_a_fault_costs_only_its_own_table(nth):
    from quire.sources.tables import TABLES, rows_of

    data = list(broken_files())[nth]
    rows = lambda tables: [(t, repr(row)) for t, row in rows_of(Document(data, "", True), tables) if t != "diagnostics"]
    together = rows([*TABLES, "diagnostics"])
    for table in TABLES:
        alone = rows([table])
        assert alone == rows([table, "diagnostics"]) == [r for r in together if r[0] == table], table
        assert alone == [r for r in rows([*reversed(TABLES)]) if r[0] == table], table
    assert nth == 0 or any(t == "diagnostics" for t, _ in rows_of(Document(data, "", True), ["diagnostics"]))
    assert together, "the rest of the document stays readable"


def test_large_object_streams_and_images():
    inner, body = b"1 0 2 %d " % len(b"<</Type/Catalog/Pages 2 0 R>> "), b"<</Type/Catalog/Pages 2 0 R>> <</Type/Pages/Kids[]/Count 0>>" + b" " * (17 << 20)
    out = bytearray(b"%PDF-1.5\n")
    at = len(out)
    out += b"6 0 obj\n" + write_value(Stream({"Type": Name("ObjStm"), "N": 2, "First": len(inner), "Filter": Name("FlateDecode")}, flate_encode(inner + body))) + b"\nendobj\n"
    table = b"".join(bytes([k]) + a.to_bytes(4, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (2, 6, 0), (2, 6, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, at, 0), (1, len(out), 0)])
    start = len(out)
    out += b"7 0 obj\n" + write_value(Stream({"Type": Name("XRef"), "Size": 8, "W": [1, 4, 1], "Root": Ref(1, 0)}, table)) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    assert Document(bytes(out)).catalog["Pages"] == Ref(2, 0)

    from quire.sources.pdf import images

    side = 12_000
    bitmap = {"Subtype": Name("Image"), "Width": side, "Height": side, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray")}
    rows = 0
    for first, band in images.image_bands(Document(page_file(b"")), Stream(bitmap, bytes((side - 1) * (side // 8)) + b"\xff" * (side // 8))):
        assert first == rows and len(band) <= images.BAND // side and band.shape[1:] == (side, 4)
        rows += len(band)
    assert rows == side and (band[-1] == 255).all() and side * side > 128 << 20


def test_images_by_bands_equal_whole_ones(monkeypatch):
    from quire.sources.pdf import images

    doc = Document(page_file(b""))
    mask = Stream({"Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, bytes([0, 90, 180, 255]))
    image = Stream({"Subtype": Name("Image"), "Width": 3, "Height": 7, "BitsPerComponent": 4, "ColorSpace": Name("DeviceRGB"), "SMask": mask}, bytes(range(35)))
    whole = images.decode_image(doc, image)
    monkeypatch.setattr(images, "BAND", 5)
    assert (images.decode_image(doc, image) == whole).all() and whole.shape == (7, 3, 4)


def test_wide_ranges_are_kept():
    cmap = parse_cmap(b"1 begincodespacerange <00000000> <ffffffff> endcodespacerange 2 begincidrange <00000000> <00ffffff> 5 <00000010> <00000011> 900 endcidrange 1 beginbfrange <00000000> <0001ffff> <0041> endbfrange")
    assert [cmap.cid(n.to_bytes(4, "big")) for n in (0, 0x10, 0x11, 0x12, 0xFFFFFF, 0x1000000)] == [5, 900, 901, 23, 0xFFFFFF + 5, 0]
    assert [cmap.text_of(n.to_bytes(4, "big")) for n in (0, 1, 0x20000)] == ["A", "B", None]
    child = {"Subtype": Name("CIDFontType2"), "DW": 100, "W": [0, 200_000, 700, 7, [300], 70_000, 70_001, 400]}
    own = {"Subtype": Name("Type0"), "BaseFont": Name("X"), "DescendantFonts": [child]}
    font = Font(Document(page_file(b"")), own | {"Encoding": Stream({}, b"1 begincodespacerange <000000> <ffffff> endcodespacerange 1 begincidrange <000000> <ffffff> 0 endcidrange")})
    assert [g.width for n in (7, 8, 70_000, 200_000, 200_001) for g in font.decode(n.to_bytes(3, "big"))] == pytest.approx([0.3, 0.7, 0.4, 0.7, 0.1])
    unknown = Font(Document(page_file(b""), "", True), own | {"Encoding": Name("UniGB-UCS2-H")})
    assert [(g.code, g.cid, g.gid, g.text) for g in unknown.decode(b"\x4e\x00")] == [(0x4E00, None, None, "")]
    with pytest.raises(PdfError):
        Font(Document(page_file(b"")), own | {"Encoding": Name("UniGB-UCS2-H")})


def test_ranges_of_which_the_last_holds():
    import random

    from quire.sources.pdf.fonts import Ranges

    rng = random.Random(1)
    for _ in range(200):
        declared = [(a, a + rng.randint(0, 20), i) for i in range(rng.randint(0, 12)) for a in [rng.randint(0, 60)]]
        held = Ranges(declared)
        for n in range(-1, 85):
            assert held.at(n) == next((v for low, high, v in reversed(declared) if low <= n <= high), None)


def test_compacted_text_looks_the_same():
    """Random content: text, its matrices and modes, and the clips stay; objects in clipping modes are not joined."""
    import random

    rng = random.Random(7)
    joined = kept = 0
    for _ in range(150):
        parts, depth = [], 0
        for _ in range(rng.randint(2, 10)):
            roll = rng.random()
            if roll < 0.15:
                parts.append("q")
                depth += 1
            elif roll < 0.25 and depth:
                parts.append("Q")
                depth -= 1
            elif roll < 0.4:
                parts.append(f"{rng.randint(0, 7)} Tr")
            else:
                first = f"1 0 0 1 {rng.randint(0, 50)} {rng.randint(0, 50)} Tm " if rng.random() < 0.8 else ""
                parts.append(f"BT {first}/F 9 Tf {rng.choice(['', '7 Tr ', '0 Tr '])}({chr(97 + len(parts))}) Tj ET")
        content = "\n".join(parts + ["Q"] * depth).encode()
        small = compact_text(content)
        look = lambda c: [(k, m.get("glyphs"), m.get("matrix"), m.get("mode"), m.get("segments"), len(m.get("text_ords") or ())) for p in Document(page_file(c)).pages() for k, m in Interpreter(Document(page_file(c)), p).run()]
        assert look(small) == look(content), content
        joined += small.count(b"BT") < content.count(b"BT")
    assert joined > 20
    for mode, count in ((0, 1), (3, 1), (4, 2), (7, 2)):
        assert compact_text(b"BT /F 9 Tf %d Tr (a) Tj ET BT 1 0 0 1 5 5 Tm (b) Tj ET" % mode).count(b"BT") == count
    assert compact_text(b"q 7 Tr Q BT (a) Tj ET BT 1 0 0 1 5 5 Tm (b) Tj ET").count(b"BT") == 1


def test_a_direct_information_dictionary_is_edited():
    data = page_file(b"", Info={"Title": b"old", "Author": b"me"})
    doc = Document(rewrite(Document(data), Edits(info={"Title": "new"}))[0])
    assert doc.info() == {"Title": "new", "Author": "me"}


def test_names_of_greek_letters_ligatures_and_signs():
    want = {"alpha": "α", "Omega": "\u2126", "Delta": "\u2206", "dcroat": "đ", "ff": "ﬀ", "ffi": "ﬃ", "lambda": "λ", "Psi": "Ψ", "infinity": "∞", "eacute": "é", "uni03B1": "α", "f_f": "ff", "nonsense": None, "ogonek_": None}
    assert {n: glyph_text(n) for n in want} == want


def test_titles_of_equal_outline_items_are_edited_by_place():
    items = {10: {"First": Ref(11, 0), "Last": Ref(13, 0)}, 11: {"Title": b"same", "Parent": Ref(10, 0), "Next": Ref(12, 0)}, 12: {"Title": b"same", "Parent": Ref(10, 0), "Next": Ref(13, 0)}, 13: {"Title": b"same", "Parent": Ref(10, 0)}}
    data = page_file(b"", None, {1: {"Outlines": Ref(10, 0)}, **items})
    doc = Document(rewrite(Document(data), Edits(outline_titles={1: "other"}))[0])
    assert [o["title"] for o in doc.outlines()] == ["same", "other", "same"]
