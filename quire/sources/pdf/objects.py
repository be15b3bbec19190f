"""Object model and parser.

Values map to Python: null None, booleans bool, integers int, reals float,
names ``Name``, strings bytes, arrays list, dictionaries dict (str keys),
references ``Ref``, streams ``Stream``. The first five and arrays and
dictionaries of them also have a tagged JSON form (``to_json``).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from json.encoder import encode_basestring
from typing import NamedTuple

SPACE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"
DEPTH = 256

_GAP = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_SCIENTIFIC = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+")
#: Names without escapes, references and numbers, with the space before them.
_PLAIN = re.compile(
    rb"[\x00\t\n\f\r ]*(?:/([^\x00\t\n\f\r ()<>\[\]{}/%#]+)|(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R|([+-]?\d+)|([+-]?(?:\d+\.\d*|\.\d+)))"
    rb"(?![^\x00\t\n\f\r ()<>\[\]{}/%])"
)
#: A dictionary's key without escapes, with the space before it.
_KEY = re.compile(rb"[\x00\t\n\f\r ]*+/([^\x00\t\n\f\r ()<>\[\]{}/%#]++)(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_STRING_PART = re.compile(rb"[^()\\\r]+")
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f"}


class PdfError(ValueError):
    """A structural fault; ``offset`` is where it was met."""

    def __init__(self, message: str, offset: int = -1):
        super().__init__(message if offset < 0 else f"{message} at {offset}")
        self.offset = offset


class Name(str):
    """A name without its slash."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes
    num: int = 0
    gen: int = 0


class Keyword(bytes):
    """A bare word that is no value: an operator or a structural keyword."""

    __slots__ = ()


@dataclass
class Parser:
    """Reads values from ``data`` at ``at``; ``references`` is off inside content."""

    data: bytes
    at: int = 0
    lenient: bool = False
    references: bool = True
    notes: list[tuple[int, str]] = field(default_factory=list)

    def fault(self, message: str) -> None:
        if not self.lenient:
            raise PdfError(message, self.at)
        self.notes.append((self.at, message))

    def gap(self) -> None:
        at = self.at
        # a byte that is neither space nor a comment's sign
        if at >= len(self.data) or not 0x20 < self.data[at] != 0x25:
            self.at = _GAP.match(self.data, at).end()

    def done(self) -> bool:
        self.gap()
        return self.at >= len(self.data)

    def value(self, depth: int = 0) -> object:
        """The next value or keyword."""
        if depth > DEPTH:
            raise PdfError("nested too deep", self.at)
        if m := _PLAIN.match(self.data, self.at):
            kind = m.lastindex
            self.at = m.end()
            if kind == 1:
                return name_of(m[1])
            if kind == 4:
                return int(m[4])
            if kind == 5:
                return float(m[5])
            if self.references and int(m[3]) <= 65535:
                return Ref(int(m[2]), int(m[3]))
            self.at = m.end(2)
            return int(m[2])
        self.gap()
        data, at = self.data, self.at
        if at >= len(data):
            raise PdfError("the data end early", at)
        c = data[at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._string()
        if c == 0x3C:
            return self._dictionary(depth) if data[at + 1 : at + 2] == b"<" else self._hex()
        if c == 0x5B:
            return self._array(depth)
        m = _WORD.match(data, at)
        if not m:
            raise PdfError("an unexpected character", at)
        self.at = m.end()
        return self._word(m[0], at)

    def _word(self, word: bytes, at: int) -> object:
        if word[0] in b"+-.0123456789":
            if _NUMBER.fullmatch(word):
                return float(word) if b"." in word else int(word)
            if _SCIENTIFIC.fullmatch(word):
                self.fault("a number with an exponent")
                return float(word)
        if word in (b"true", b"false"):
            return word == b"true"
        if word == b"null":
            return None
        return Keyword(word)

    def _name(self) -> Name:
        m = _WORD.match(self.data, self.at + 1)
        raw = m[0] if m else b""
        self.at += 1 + len(raw)
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw)
            if b"\0" in raw:
                raise PdfError("a null character in a name", self.at)
        return name_of(raw)

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            if m := _STRING_PART.match(data, at):
                out += m[0]
                at = m.end()
                continue
            c = data[at]
            at += 1
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at
                    return bytes(out)
            elif c == 0x0D:
                at += data[at : at + 1] == b"\n"
                out += b"\n"
                continue
            elif c == 0x5C:
                at = self._escape(at, out)
                continue
            out.append(c)
        raise PdfError("a string without end", self.at)

    def _escape(self, at: int, out: bytearray) -> int:
        data = self.data
        if at >= len(data):
            return at
        if m := re.compile(rb"[0-7]{1,3}").match(data, at):
            out.append(int(m[0], 8) & 255)
            return m.end()
        c = data[at]
        if c == 0x0D:
            return at + 1 + (data[at + 1 : at + 2] == b"\n")
        if c != 0x0A:
            out += _ESCAPES.get(c, bytes([c]))
        return at + 1

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("a hexadecimal string without end", self.at)
        digits = self.data[self.at + 1 : end].translate(None, SPACE)
        try:
            out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
        except (ValueError, UnicodeDecodeError):
            self.fault("not a hexadecimal digit")
            digits = bytes(d for d in digits if d in b"0123456789abcdefABCDEF")
            out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
        self.at = end + 1
        return out

    def _array(self, depth: int) -> list:
        self.at += 1
        out: list = []
        while True:
            self.gap()
            if self.data[self.at : self.at + 1] == b"]":
                self.at += 1
                return out
            v = self.value(depth + 1)
            if isinstance(v, Keyword):
                raise PdfError("a keyword inside an array", self.at)
            out.append(v)

    def _dictionary(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            if depth < DEPTH and (m := _KEY.match(self.data, self.at)):
                key, self.at = name_of(m[1]), m.end()
            else:
                self.gap()
                if self.data[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    raise PdfError("a key that is no name", self.at)
            v = self.value(depth + 1)
            if isinstance(v, Keyword):
                raise PdfError("a keyword inside a dictionary", self.at)
            if key in out:
                self.fault("a repeated key")
            out[str(key)] = v


@lru_cache(maxsize=1024)
def name_of(raw: bytes) -> Name:
    """A name by its bytes, of UTF-8 where they are."""
    try:
        return Name(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return Name(raw.decode("latin-1"))


def to_plain(v: object) -> object:
    """The tagged JSON form as Python data."""
    if isinstance(v, Name):
        return {"$n": str(v)}
    if isinstance(v, bytes):
        return {"$s": v.hex()}
    if isinstance(v, Ref):
        return {"$r": [v.num, v.gen]}
    if isinstance(v, Stream):
        return {"$stream": to_plain(v.dict)}
    if isinstance(v, list):
        return [to_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: to_plain(v[k]) for k in sorted(v)}
    return v


def to_json(v: object) -> str:
    kind = type(v)
    if kind is list:
        return "[" + ",".join([to_json(x) for x in v]) + "]"
    if kind is bytes:
        return '{"$s":"' + v.hex() + '"}'
    if kind is int:
        return str(v)
    if kind is Name:
        return '{"$n":' + encode_basestring(v) + "}"
    return json.dumps(to_plain(v), ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> object:
    """The value that ``to_json`` shows; a stream's is its dictionary."""

    def back(v: object) -> object:
        if isinstance(v, list):
            return [back(x) for x in v]
        if not isinstance(v, dict):
            return v
        if len(v) == 1:
            ((key, held),) = v.items()
            if key == "$n":
                return Name(held)
            if key == "$s":
                return bytes.fromhex(held)
            if key == "$r":
                return Ref(*held)
        return {k: back(x) for k, x in v.items()}

    return back(json.loads(text))


def references_in(v: object, path: str = "") -> list[tuple[str, Ref]]:
    """(path, reference) of every reference inside a value, dictionary keys in order."""
    if isinstance(v, Ref):
        return [(path, v)]
    if isinstance(v, Stream):
        v = v.dict
    if isinstance(v, list):
        return [x for i, item in enumerate(v) for x in references_in(item, f"{path}[{i}]")]
    if isinstance(v, dict):
        return [x for k in sorted(v) for x in references_in(v[k], f"{path}/{k}")]
    return []


_NAME_PLAIN = re.compile(r"[A-Za-z0-9_.+\-*'\"$&!@^=|~;:,?]+")


_STRING_PLAIN = re.compile(rb"[\x20-\x7e\t\n\r]*")
#: Strings that need no escape either.
_STRING_BARE = re.compile(rb"[\x20-\x27\x2a-\x5b\x5d-\x7e\t\n]*")


def write_value(v: object) -> bytes:
    """PDF syntax of a value; dictionary keys in order."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        if _NAME_PLAIN.fullmatch(v):
            return b"/" + v.encode()
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in v.encode("utf-8"))
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        text = f"{v:.10f}".rstrip("0").rstrip(".")
        return (text if text not in ("", "-0") else "0").encode() + (b".0" if "." not in text else b"")
    if isinstance(v, bytes):
        if _STRING_BARE.fullmatch(v):
            return b"(" + v + b")"
        plain = b"(" + re.sub(rb"[()\\]", lambda m: b"\\" + m[0], v).replace(b"\r", b"\\r") + b")"
        return plain if len(plain) <= 2 * len(v) + 2 and _STRING_PLAIN.fullmatch(v) else b"<" + v.hex().encode() + b">"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, list):
        return b"[" + b" ".join(map(write_value, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b"".join(write_value(Name(k)) + b" " + write_value(v[k]) for k in sorted(v)) + b">>"
    if isinstance(v, Stream):
        own = dict(v.dict) | {"Length": len(v.raw)}
        return write_value(own) + b"\nstream\n" + v.raw + b"\nendstream"
    raise PdfError(f"no syntax for {type(v).__name__}")
