"""Fonts: decoding of shown strings into glyphs with text and widths."""

from __future__ import annotations

import bisect
import codecs
import heapq
import re
import struct
import unicodedata
from dataclasses import dataclass, field
from functools import cache, lru_cache

from quire.sources.pdf.objects import Keyword, Name, Parser, PdfError, Stream

#: Ranges of at least this many codes are kept as ranges.
EXPANDED = 256
#: Where the standard encoding leaves ASCII, and its upper half by code.
STANDARD_ASCII = {0x27: "’", 0x60: "‘"}
STANDARD_HIGH = {
    0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿",
    0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—",
    0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}

#: Glyph names of marks and signs; letters and accents follow from rules.
SIGNS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "colon": ":", "semicolon": ";",
    "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_",
    "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨",
    "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ",
    "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾",
    "questiondown": "¿", "multiply": "×", "divide": "÷", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð",
    "Thorn": "Þ", "thorn": "þ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "florin": "ƒ", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†",
    "daggerdbl": "‡", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "quotesinglbase": "‚",
    "trademark": "™", "Euro": "€", "fi": "ﬁ", "fl": "ﬂ", "fraction": "⁄", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚",
    "ogonek": "˛", "hungarumlaut": "˝",
}

#: Accent suffixes of glyph names and their combining marks.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "commaaccent": "̧", "cedilla": "̧", "ogonek": "̨"}

#: Advance widths of Helvetica for codes 32 to 126.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)

#: Advance widths of the other standard text faces for codes 32 to 126.
HELVETICA_BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
TIMES = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)
TIMES_BOLD = (
    250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500,
    930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500,
    333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520,
)
TIMES_ITALIC = (
    250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 675, 675, 675, 500,
    920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500,
    333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541,
)
TIMES_BOLD_ITALIC = (
    250, 389, 555, 500, 500, 833, 778, 278, 333, 333, 500, 570, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 333, 333, 570, 570, 570, 500,
    832, 667, 667, 667, 722, 667, 667, 722, 778, 389, 500, 667, 611, 889, 722, 722, 611, 722, 667, 556, 611, 722, 667, 889, 667, 611, 611, 333, 278, 333, 570, 500,
    333, 500, 500, 444, 500, 444, 333, 500, 556, 278, 278, 500, 278, 778, 556, 500, 500, 500, 389, 389, 278, 556, 444, 667, 500, 444, 389, 348, 220, 348, 570,
)


@lru_cache(maxsize=64)
def standard_widths(name: str) -> tuple[dict[str, float], float] | None:
    """(widths by character, width of the rest) of a standard face; None for any other.

    Subset prefixes and the usual aliases are understood. An accented letter is as
    wide as its base letter.
    """
    plain = name.split("+", 1)[-1].replace(",", "-").replace(" ", "")
    bold, slanted = "Bold" in plain, "Italic" in plain or "Oblique" in plain
    if plain.startswith("Courier"):
        return {}, 600.0
    if plain.startswith(("Times-", "TimesNewRoman")) or plain == "Times":
        held = {(False, False): TIMES, (True, False): TIMES_BOLD, (False, True): TIMES_ITALIC, (True, True): TIMES_BOLD_ITALIC}[bold, slanted]
    elif plain.startswith(("Helvetica", "Arial")):
        held = HELVETICA_BOLD if bold else HELVETICA
    else:
        return None
    known = {chr(32 + i): float(w) for i, w in enumerate(held)}
    quote = {HELVETICA: 222.0, HELVETICA_BOLD: 278.0}.get(held, 333.0)
    known |= {"’": quote, "‘": quote, "\u00a0": known[" "]}
    return known, known["0"]


#: Glyph names of further letters, ligatures and mathematical signs; two Greek names mean signs.
LETTERS = {
    "dcroat": "đ", "Dcroat": "Đ", "hbar": "ħ", "Hbar": "Ħ", "tbar": "ŧ", "Tbar": "Ŧ", "eng": "ŋ", "Eng": "Ŋ", "ij": "ĳ", "IJ": "Ĳ", "ldot": "ŀ", "Ldot": "Ŀ", "kgreenlandic": "ĸ", "napostrophe": "ŉ", "longs": "ſ",
    "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "Delta": "\u2206", "Omega": "\u2126", "lambda": "λ", "Lambda": "Λ", "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ", "Upsilon1": "ϒ",
    "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "infinity": "∞", "partialdiff": "∂", "summation": "∑", "product": "∏", "integral": "∫", "radical": "√", "approxequal": "≈", "lozenge": "◊", "arrowleft": "←",
    "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "element": "∈", "universal": "∀", "existential": "∃", "emptyset": "∅", "gradient": "∇", "intersection": "∩", "union": "∪", "equivalence": "≡", "similar": "∼", "angle": "∠",
}


def glyph_text(name: str) -> str | None:
    """Text of a glyph name; parts are joined by ``_`` and end at the first dot."""
    name = name.split(".", 1)[0]
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return None if None in parts else "".join(parts)
    if name in SIGNS:
        return SIGNS[name]
    if re.fullmatch(r"[A-Za-z]", name):
        return name
    if m := re.fullmatch(r"([A-Za-z]|dotlessi)([a-z]{4,})", name):
        if mark := ACCENTS.get(m[2]):
            text = unicodedata.normalize("NFC", m[1][:1].replace("d", "i" if m[1] == "dotlessi" else "d") + mark)
            return text if len(text) == 1 else None
    if name in LETTERS:
        return LETTERS[name]
    if re.fullmatch(r"[A-Z]?[a-z]{2,7}", name):
        case = "CAPITAL" if name[0].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"GREEK {case} LETTER {name.upper()}")
        except KeyError:
            return None
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        codes = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)]
        return None if any(0xD800 <= c <= 0xDFFF for c in codes) else "".join(map(chr, codes))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        code = int(m[1], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None
    return None


def encoding_text(name: str) -> dict[int, str]:
    """Text of every code of a named encoding; the caller's own to change."""
    return dict(_encoding_text(name if name in ("WinAnsiEncoding", "MacRomanEncoding") else ""))


@cache
def _encoding_text(name: str) -> dict[int, str]:
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        out = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)}
        return {c: t for c, t in out.items() if t}
    return {c: chr(c) for c in range(32, 127)} | STANDARD_ASCII | STANDARD_HIGH


@lru_cache(4096)
def _base(text: str) -> str:
    """The first character of a text, without its accents."""
    return unicodedata.normalize("NFD", text)[:1]


def parse_afm(text: str) -> dict[str, float]:
    """Advance widths by glyph name from a metrics file."""
    return {m[2]: float(m[1]) for m in re.finditer(r"^C\s+-?\d+\s*;\s*WX\s+([\d.]+)\s*;\s*N\s+(\S+)", text, re.M)}


@dataclass
class CMap:
    """Code spaces, and text or CIDs of codes and ranges."""

    spaces: list[tuple[bytes, bytes]] = field(default_factory=list)
    text: dict[bytes, str] = field(default_factory=dict)
    cids: dict[bytes, int] = field(default_factory=dict)
    ranges: list[tuple[bytes, bytes, int]] = field(default_factory=list)
    text_ranges: list[tuple[bytes, bytes, bytes]] = field(default_factory=list)
    vertical: bool = False

    def next(self, data: bytes, at: int) -> bytes:
        """The code at ``at`` by the code spaces; one byte without them."""
        for size in range(1, 5):
            code = data[at : at + size]
            for low, high in self.spaces:
                if len(low) == size == len(code) and all(a <= c <= b for a, c, b in zip(low, code, high, strict=True)):
                    return code
        return data[at : at + (min(len(low) for low, _ in self.spaces) if self.spaces else 1)]

    def cid(self, code: bytes) -> int:
        if code in self.cids:
            return self.cids[code]
        held = self._held("ranges").at(_place(code))
        return held[2] + _place(code) - _place(held[0]) if held else 0

    def text_of(self, code: bytes) -> str | None:
        """The text of a code, of its own or by the range that holds it."""
        if code in self.text or not self.text_ranges:
            return self.text.get(code)
        held = self._held("text_ranges").at(_place(code))
        return _shifted(held[2], _place(code) - _place(held[0])) if held else None

    def _held(self, name: str) -> Ranges:
        """The declared ranges, sorted for search when first asked for."""
        if name not in self.__dict__.setdefault("_sorted", {}):
            self._sorted[name] = Ranges([(_place(r[0]), _place(r[1]), r) for r in getattr(self, name)])
        return self._sorted[name]


def _place(code: bytes) -> int:
    """Codes of all lengths in one order: first those of one byte."""
    return len(code) << 32 | int.from_bytes(code, "big")


def _shifted(value: bytes, step: int) -> str | None:
    """A mapped text with its last code ``step`` further."""
    if step:
        value = (int.from_bytes(value, "big") + step).to_bytes(len(value) + 1, "big")[-len(value) :]
    try:
        return value.decode("utf-16-be") if len(value) > 1 else chr(value[0]) if value else ""
    except UnicodeDecodeError:
        return None


class Ranges:
    """Closed ranges of numbers with a value, of which the last declared holds where several meet."""

    def __init__(self, declared: list[tuple[int, int, object]]):
        cuts = sorted({edge for low, high, _ in declared for edge in (low, high + 1)})
        opening = sorted((low, i) for i, (low, _, _) in enumerate(declared))
        self.starts, self.values = cuts, []
        live: list[int] = []  # a heap of declarations, last first
        nth = 0
        for cut in cuts:
            while nth < len(opening) and opening[nth][0] <= cut:
                heapq.heappush(live, -opening[nth][1])
                nth += 1
            while live and declared[-live[0]][1] < cut:
                heapq.heappop(live)
            self.values.append(declared[-live[0]][2] if live else None)

    def at(self, number: int) -> object | None:
        i = bisect.bisect_right(self.starts, number) - 1
        return self.values[i] if i >= 0 else None


def parse_cmap(data: bytes) -> CMap:
    """Reads ``bf`` (text) and ``cid`` maps."""
    out, stack, p = CMap(), [], Parser(data, 0, True, references=False)
    while not p.done():
        try:
            v = p.value()
        except PdfError:
            p.at += 1
            continue
        if not isinstance(v, Keyword):
            stack.append(v)
            continue
        word = bytes(v)
        if word == b"def" and len(stack) >= 2 and stack[-2] == "WMode":
            out.vertical = stack[-1] == 1
        elif word == b"endcodespacerange":
            out.spaces += [(a, b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
        elif word in (b"endbfchar", b"endcidchar"):
            for code, value in zip(stack[::2], stack[1::2], strict=False):
                _map(out, code, value, 0)
        elif word in (b"endbfrange", b"endcidrange"):
            for low, high, value in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                _map_range(out, low, high, value)
        if word.startswith((b"begin", b"end")) or word == b"def":
            stack = []
    return out


def _map(out: CMap, code: object, value: object, step: int) -> None:
    if not isinstance(code, bytes) or not 1 <= len(code) <= 4:
        return
    if isinstance(value, int):
        out.cids[code] = value + step
    elif isinstance(value, Name):
        if text := glyph_text(value):
            out.text[code] = text
    elif isinstance(value, bytes):
        if (text := _shifted(value, step)) is not None:
            out.text[code] = text


def _map_range(out: CMap, low: object, high: object, value: object) -> None:
    if not isinstance(low, bytes) or not isinstance(high, bytes) or len(low) != len(high):
        return
    first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
    if last < first:
        return
    if isinstance(value, int):
        out.ranges.append((low, high, value))
    elif isinstance(value, list):
        for i, own in enumerate(value[: last - first + 1]):
            _map(out, (first + i).to_bytes(len(low), "big"), own, 0)
    elif isinstance(value, bytes) and last - first >= EXPANDED:
        out.text_ranges.append((low, high, value))
    elif isinstance(value, bytes):
        for i in range(last - first + 1):
            _map(out, (first + i).to_bytes(len(low), "big"), value, i)


def _widths_of(codes: dict[int, str], by_text: dict[str, float]) -> dict[int, float]:
    """Widths of the codes whose text a face has."""
    return {code: w for code, text in codes.items() if text and (w := by_text.get(text, by_text.get(_base(text)))) is not None}


@lru_cache(maxsize=64)
def _standard_widths(name: str, base: str) -> dict[int, float]:
    """Widths by code of a standard face in a named encoding."""
    return _widths_of(encoding_text(base), standard_widths(name)[0])


@dataclass
class Glyph:
    code: int
    text: str
    cid: int | None
    width: float
    space: bool
    gid: int | None = None


#: What a map of characters has for a code without a text.
_NO_TEXT = "\ufffe"


def _quick_of(texts: list[str | None], widths: dict[int, float], default: float, scale: float) -> tuple[tuple[list[str], list[float]], str | None]:
    """Texts and widths by code, and the texts as a map of characters where each is one at most."""
    shown = [t or "" for t in texts]
    single = all(len(t) < 2 and t != _NO_TEXT for t in shown)
    return (shown, [widths.get(c, default) * scale for c in range(256)]), "".join([t or _NO_TEXT for t in shown]) if single else None


@lru_cache(maxsize=64)
def _standard_quick(name: str, base: str, default: float) -> tuple[tuple[list[str], list[float]], str | None]:
    codes = encoding_text(base)
    return _quick_of([codes.get(c) for c in range(256)], _standard_widths(name, base), default, 0.001)


class Font:
    """A font resource; ``decode`` gives the glyphs of a shown string."""

    def __init__(self, doc, own: dict, num: int | None = None):
        self.doc, self.num = doc, num
        self.subtype = str(doc.get(own, "Subtype", Name, Name("")))
        self.name = str(doc.get(own, "BaseFont", Name, Name("")))
        stream = doc.get(own, "ToUnicode", Stream)
        self.to_unicode = parse_cmap(doc.decoded(stream)) if stream else None
        self.matrix = [float(doc.resolve(x)) for x in doc.get(own, "FontMatrix", list, [0.001, 0, 0, 0.001, 0, 0])]
        self.composite = self.subtype == "Type0"
        self.vertical = False
        self.known = True
        self._quick: tuple[tuple[list[str], list[float]], str | None] | None = None
        self.standard: str | None = None
        self.steps: tuple | None = None  # the interpreter's last advances by code, and what they were made for
        self.maps: dict = {}
        self.symbolic = False
        self.names: dict[int, str] = {}
        self.procedures = {str(k): v for k, v in doc.get(own, "CharProcs", dict, {}).items()}
        self.resources = doc.get(own, "Resources", dict)
        self._composite(own) if self.composite else self._simple(own)

    def _simple(self, own: dict) -> None:
        doc = self.doc
        encoding = doc.get(own, "Encoding", (Name, dict))
        base = str(encoding) if isinstance(encoding, Name) else str(doc.get(encoding, "BaseEncoding", Name, Name("StandardEncoding")))
        self.base, self.codes = base, encoding_text(base)
        if isinstance(encoding, dict):
            at = 0
            for item in doc.get(encoding, "Differences", list, []):
                item = doc.resolve(item)
                if isinstance(item, Name):
                    self.names[at] = str(item)
                    self.codes[at] = glyph_text(item) or ""
                    at += 1
                elif isinstance(item, int):
                    at = item
        first = doc.get(own, "FirstChar", int, 0)
        widths = doc.get(own, "Widths", list)
        missing = doc.get(doc.get(own, "FontDescriptor", dict, {}), "MissingWidth", (int, float), 0)
        self.default = float(missing)
        self.widths = {first + i: float(w) for i, w in enumerate(map(doc.resolve, widths or [])) if isinstance(w, (int, float))}
        descriptor = doc.get(own, "FontDescriptor", dict, {})
        self.symbolic = bool(doc.get(descriptor, "Flags", int, 0) & 4)
        program = doc.get(descriptor, "FontFile2", Stream)
        if program is not None:
            self._truetype(doc.decoded(program), widths is None)
        elif widths is None and self.subtype != "Type3":
            self._standard()

    def _standard(self) -> None:
        """Widths of a standard face; another face without widths is told and measured like Helvetica."""
        known = standard_widths(self.name)
        if known is None:
            self.doc.fault(f"font {self.name} has neither widths nor a standard face")
            known = standard_widths("Helvetica")
        by_text, self.default = known
        # without differences the widths are the same for every font of the name and encoding
        if not self.names:
            self.standard = "Helvetica" if standard_widths(self.name) is None else self.name
        held = _widths_of(self.codes, by_text) if self.standard is None else _standard_widths(self.standard, self.base)
        self.widths |= held

    def _truetype(self, data: bytes, measured: bool) -> None:
        """Glyph ids, and widths where the font declares none, from an embedded TrueType program."""
        from quire.sources.pdf import truetype

        try:
            held = truetype.tables(data)
            self.maps = truetype.character_maps(held["cmap"])
            if measured:
                advances = truetype.advances(data)
                for code in range(256):
                    gid = self._glyph_id(code)
                    if gid is not None and gid < len(advances):
                        self.widths[code] = advances[gid]
        except (KeyError, ValueError, IndexError, struct.error) as e:
            self.doc.fault(f"font {self.name}: the embedded program cannot be read: {e}")

    def _glyph_id(self, code: int) -> int | None:
        if not self.maps:
            return None
        from quire.sources.pdf import truetype

        return truetype.simple_glyph(self.maps, code, self.codes.get(code), self.symbolic)

    def _composite(self, own: dict) -> None:
        doc = self.doc
        child = doc.resolve((doc.get(own, "DescendantFonts", list) or [{}])[0]) or {}
        encoding = doc.get(own, "Encoding", (Name, Stream))
        if isinstance(encoding, Stream):
            self.cmap = parse_cmap(doc.decoded(encoding))
        else:
            if str(encoding) not in ("Identity-H", "Identity-V"):
                # the published code maps are data that is not at hand: two bytes a code, CIDs unknown
                self.known = False
                doc.fault(f"the predefined code map {encoding} is not known")
            self.cmap = CMap([(b"\0\0", b"\xff\xff")], ranges=[(b"\0\0", b"\xff\xff", 0)], vertical=str(encoding).endswith("V"))
        self.vertical = self.cmap.vertical
        held = doc.get(child, "CIDToGIDMap", (Name, Stream))
        self.cid_gids = doc.decoded(held) if isinstance(held, Stream) else None
        self.embedded = doc.get(doc.get(child, "FontDescriptor", dict, {}), "FontFile2", Stream) is not None
        self.default = float(doc.get(child, "DW", (int, float), 1000))
        self.widths, ranges = {}, []
        held = [doc.resolve(x) for x in doc.get(child, "W", list, [])]
        at = 0
        while at < len(held):
            if at + 1 < len(held) and isinstance(held[at + 1], list):
                self.widths |= {held[at] + i: float(doc.resolve(w)) for i, w in enumerate(held[at + 1])}
                at += 2
            elif at + 2 < len(held):
                low, high, width = held[at], held[at + 1], float(held[at + 2])
                if high - low < EXPANDED:
                    self.widths |= dict.fromkeys(range(low, high + 1), width)
                else:
                    ranges.append((low, high, width))
                at += 3
            else:
                break
        self.width_ranges = Ranges(ranges)

    def quick(self) -> tuple[list[str], list[float]]:
        """Texts and widths by code of a simple font, as ``decode`` gives them."""
        if self._quick is None:
            if self.standard is not None and not self.to_unicode:
                self._quick = _standard_quick(self.standard, self.base, self.default)
            else:
                codes, texts = self.codes, None
                if self.to_unicode:
                    mapped = [self.to_unicode.text_of(bytes([c])) for c in range(256)]
                    texts = [codes.get(c) if m is None else m for c, m in enumerate(mapped)]
                self._quick = _quick_of(texts or [codes.get(c) for c in range(256)], self.widths, self.default, self.matrix[0] if self.subtype == "Type3" else 0.001)
        return self._quick[0]

    def text_of(self, data: bytes) -> str:
        """The text of a string in a simple font."""
        (shown, _), single = self._quick or (self.quick(), None)
        return "".join([shown[c] for c in data]) if single is None else codecs.charmap_decode(data, "ignore", single)[0]

    def decode(self, data: bytes) -> list[Glyph]:
        """Text comes from the Unicode map first, then from the code's glyph name or encoding."""
        out, at = [], 0
        while at < len(data):
            code = self.cmap.next(data, at) if self.composite else data[at : at + 1]
            number, text = int.from_bytes(code, "big"), None
            if self.to_unicode:
                text = self.to_unicode.text_of(code)
            if self.composite:
                cid = self.cmap.cid(code) if self.known else None
                width = self.widths.get(cid)
                if width is None:
                    width = self.default if cid is None or (own := self.width_ranges.at(cid)) is None else own
                gid = None if cid is None else int.from_bytes(self.cid_gids[2 * cid : 2 * cid + 2], "big") if self.cid_gids is not None else cid if self.embedded else None
            else:
                cid, width = number, self.widths.get(number, self.default)
                gid = self._glyph_id(number)
                text = self.codes.get(number) if text is None else text
            scale = self.matrix[0] if self.subtype == "Type3" else 0.001
            out.append(Glyph(number, text or "", cid, width * scale, code == b" ", gid))
            at += len(code)
        return out

    def encode(self, text: str) -> bytes:
        """Codes of a text; a character without one is an error."""
        if self.composite:
            back = {v: k for k, v in (self.to_unicode.text if self.to_unicode else {}).items()}
        else:
            back = {v: bytes([k]) for k, v in sorted(self.codes.items(), reverse=True)}
        try:
            return b"".join(back[c] for c in text)
        except KeyError as e:
            raise PdfError(f"the font has no code for {e}") from e
