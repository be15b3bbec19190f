"""Stream filters, predictors and text strings: pure functions and column forms."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = b"\0\t\n\f\r "


class FilterError(ValueError):
    """Data that a filter cannot decode."""


def flate_decode(data: bytes, lenient: bool = False) -> bytes:
    """Inflate; lenient keeps what a truncated or wrongly summed stream gives."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error as e:
        if not lenient:
            raise FilterError(str(e)) from e
        raw = zlib.decompressobj(-15)
        try:
            return raw.decompress(data[2:])
        except zlib.error as inner:
            raise FilterError(str(inner)) from inner
    if not d.eof and not lenient:
        raise FilterError("the compressed data end early")
    return out


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data, 9)


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Variable 9 to 12 bit codes, most significant bit first; an end code is required."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = start[:], [], b""
    value = bits = 0
    # a code is wider from a table of ``wider`` entries on
    size, width, wider = 258, 9, 512 - early
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        value = (value & ((1 << bits) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
        bits += 8 * len(part)
        while bits >= width:
            bits -= width
            code = value >> bits & ((1 << width) - 1)
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, last, size, width, wider = start[:], b"", 258, 9, 512 - early
                continue
            if code < size:
                word = table[code]
            elif code == size and last:
                word = last + last[:1]
            else:
                raise FilterError("an unknown code")
            if last and size < 4096:
                table.append(last + word[:1])
                size += 1
                if size >= wider and width < 12:
                    width, wider = width + 1, (2 << width) - early
            out.append(word)
            last = word
    raise FilterError("no end code")


#: Bytes of codes taken or given as one number.
CHUNK = 64


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    # a word is its code; one longer by a byte is found under both
    codes: dict[int, int] = {}
    bits, count, out = 256, 9, bytearray()
    # the reader's table lags one entry behind the writer's; a code is wider from ``wider`` entries on
    size, width, wider = 258, 9, 513 - early
    word = data[0] if data else -1
    get = codes.get
    for byte in data[1:]:
        longer = word << 8 | byte
        known = get(longer)
        if known is not None:
            word = known
            continue
        bits, count = bits << width | word, count + width
        if count >= 8 * CHUNK:
            spare = count & 7
            out += (bits >> spare).to_bytes(count >> 3, "big")
            bits, count = bits & ((1 << spare) - 1), spare
        if size < 4095:
            codes[longer] = size
            size += 1
            if size >= wider and width < 12:
                width, wider = width + 1, (2 << width) + 1 - early
        else:
            bits, count = bits << width | 256, count + width
            codes.clear()
            size, width, wider = 258, 9, 513 - early
        word = byte
    if word >= 0:
        bits, count = bits << width | word, count + width
        size += size < 4095
        width = min(12, max(9, (size - 1 + early).bit_length()))
    bits, count = bits << width | 257, count + width
    spare = -count % 8
    out += (bits << spare).to_bytes((count + spare) >> 3, "big")
    return bytes(out)


def ascii_hex_decode(data: bytes) -> bytes:
    """Up to ``>``; white space is skipped and an odd digit padded with 0."""
    digits = data.split(b">", 1)[0].translate(None, SPACE)
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError as e:
        raise FilterError("not hexadecimal") from e


def ascii85_decode(data: bytes) -> bytes:
    """Groups of five; the end mark is required, a lone last digit and overflow are errors."""
    body, mark, _ = data.translate(None, SPACE).partition(b"~>")
    if not mark:
        raise FilterError("no end mark")
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _five(group)
                group = []
        else:
            raise FilterError("not a base-85 digit")
    if len(group) == 1:
        raise FilterError("a lone last digit")
    if group:
        out += _five(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _five(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    if value > 0xFFFFFFFF:
        raise FilterError("a group out of range")
    return value.to_bytes(4, "big")


def ascii85_encode(data: bytes) -> bytes:
    return base64.a85encode(data) + b"~>"


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 128:
            return bytes(out)
        step = n + 2 if n < 128 else 2
        if at + step > len(data):
            raise FilterError("a run ends early")
        out += data[at + 1 : at + step] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += step
    raise FilterError("no end mark")


def run_length_encode(data: bytes) -> bytes:
    out = bytearray()
    plain = bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 128):
            part = plain[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for m in re.finditer(rb"(.)\1*", data, re.S):
        run = m.end() - m.start()
        if run < 3:
            plain.extend(m[0])
            continue
        flush()
        for i in range(0, run, 128):
            n = min(128, run - i)
            if n == 1:
                plain.extend(m[1])
            else:
                out.extend((257 - n, m[1][0]))
    flush()
    out.append(128)
    return bytes(out)


def undo_predictor(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Predictor 2 (differences along a row) and 10 to 15 (a filter type before each row)."""
    if predictor in (0, 1):
        return data
    unit = max(1, colors * bits // 8)
    row = (colors * bits * columns + 7) // 8
    if predictor == 2:
        return _undo_differences(data, colors, bits, columns, row)
    if not 10 <= predictor <= 15:
        raise FilterError("unknown predictor")
    if len(data) % (row + 1):
        raise FilterError("rows end early")
    held = np.frombuffer(data, np.uint8).reshape(-1, row + 1)
    kinds, raw = held[:, 0], held[:, 1:]
    out, above, at = np.empty_like(raw), np.zeros(row, dtype=np.uint8), 0
    while at < len(raw):
        stop = at + 1
        if kinds[at] in (3, 4):
            while stop < len(raw) and kinds[stop] in (3, 4):
                stop += 1
        # a diagonal is some numpy calls, a pixel some steps of Python
        if stop - at >= WAVE_ROWS and (stop - at) * row >= WAVE_PIXELS * unit * (stop - at + row // unit):
            out[at:stop] = _undo_wave(kinds[at:stop], raw[at:stop], above, unit)
        else:
            for i in range(at, stop):
                out[i] = above = _undo_row(int(kinds[i]), raw[i], above, unit)
        at, above = stop, out[stop - 1]
    return out.tobytes()


#: Neighbouring rows, and pixels of a diagonal on average, from which on pixels that do not wait for each other are undone together.
WAVE_ROWS = 12
WAVE_PIXELS = 64


def _undo_wave(kinds: np.ndarray, raw: np.ndarray, above: np.ndarray, unit: int) -> np.ndarray:
    """Rows of filters 3 and 4, one diagonal of pixels after the other: none of a diagonal needs another of it."""
    rows, size = raw.shape
    pad = -size % unit
    shaped = lambda a: np.pad(a, ((0, 0), (0, pad))).reshape(len(a), -1, unit).astype(np.int16)
    wanted = shaped(raw)
    width = wanted.shape[1]
    out = np.zeros((rows + 1, width + 1, unit), np.int16)
    out[0, 1:] = shaped(above[None, :])[0]
    for d in range(rows + width - 1):
        r = np.arange(max(0, d - width + 1), min(rows, d + 1))
        c = d - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        a, b, e = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        near = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))
        out[r + 1, c + 1] = wanted[r, c] + np.where(kinds[r, None] == 3, (left + up) >> 1, near) & 255
    return out[1:, 1:].reshape(rows, -1)[:, :size].astype(np.uint8)


def _undo_differences(data: bytes, colors: int, bits: int, columns: int, row: int) -> bytes:
    if len(data) % row:
        raise FilterError("rows end early")
    rows = np.frombuffer(data, np.uint8).reshape(-1, row)
    if bits == 8:
        return rows[:, : colors * columns].reshape(-1, columns, colors).cumsum(axis=1, dtype=np.uint8).tobytes()
    if bits == 16:
        wide = rows.copy().view(">u2").reshape(-1, columns, colors)
        return wide.cumsum(axis=1, dtype=np.uint16).astype(">u2").tobytes()
    flat = np.unpackbits(rows, axis=1)[:, : colors * columns * bits].reshape(-1, columns, colors, bits)
    weights = 1 << np.arange(bits - 1, -1, -1)
    summed = (flat @ weights).cumsum(axis=1) % (1 << bits)
    planes = (summed[..., None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8)
    return np.packbits(planes.reshape(len(rows), -1), axis=1).tobytes()


def _undo_row(kind: int, raw: np.ndarray, above: np.ndarray, unit: int) -> np.ndarray:
    if kind == 0:
        return raw.copy()
    if kind == 2:
        return raw + above
    if kind == 1:
        pad = -len(raw) % unit
        return (np.pad(raw, (0, pad)) if pad else raw).reshape(-1, unit).cumsum(axis=0, dtype=np.uint8).reshape(-1)[: len(raw)]
    if kind not in (3, 4):
        raise FilterError("unknown row filter")
    out, up = [0] * unit, [0] * unit + above.tolist()
    for i, v in enumerate(raw.tolist()):
        left, over = out[i], up[i + unit]
        if kind == 3:
            guess = (left + over) >> 1
        else:
            corner = up[i]
            a, b, c = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
            guess = left if a <= b and a <= c else over if b <= c else corner
        out.append((v + guess) & 255)
    return np.array(out[unit:], dtype=np.uint8)


def paeth(left: int, above: int, corner: int) -> int:
    """Of the three neighbours, the one nearest to left + above - corner."""
    guess = left + above - corner
    return min((left, above, corner), key=lambda v: abs(guess - v))


def apply_up_predictor(data: bytes, row: int) -> bytes:
    """Rows as differences to the row above (filter type 2)."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, row)
    steps = np.diff(rows, axis=0, prepend=np.zeros((1, row), np.uint8))
    return np.concatenate([np.full((len(rows), 1), 2, np.uint8), steps], axis=1).tobytes()


#: Short names of filters.
ALIASES = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
IMAGE_FILTERS = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode")


def decode(data: bytes, filters: list[str], parameters: list[dict], lenient: bool = False) -> tuple[bytes, str | None]:
    """Decoded data, and the image filter that it still has, if any."""
    for at, (name, own) in enumerate(zip(filters, parameters, strict=True)):
        name = ALIASES.get(name, name)
        if name in IMAGE_FILTERS:
            if at + 1 < len(filters):
                raise FilterError("an image filter that is not last")
            return data, name
        if name == "FlateDecode":
            data = flate_decode(data, lenient)
        elif name == "LZWDecode":
            data = lzw_decode(data, int(own.get("EarlyChange", 1)))
        elif name == "ASCIIHexDecode":
            data = ascii_hex_decode(data)
        elif name == "ASCII85Decode":
            data = ascii85_decode(data)
        elif name == "RunLengthDecode":
            data = run_length_decode(data)
        elif name != "Crypt":
            raise FilterError(f"unknown filter {name}")
        if name in ("FlateDecode", "LZWDecode") and own.get("Predictor", 1) not in (0, 1):
            data = undo_predictor(data, int(own["Predictor"]), int(own.get("Colors", 1)), int(own.get("BitsPerComponent", 8)), int(own.get("Columns", 1)))
    return data, None


#: Code points of bytes 0x18 to 0x1F and 0x80 to 0xA0 of the document encoding.
_DOCUMENT_LOW = "˘ˇˆ˙˝˛˚˜"
_DOCUMENT_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
_DOCUMENT = "".join(map(chr, range(0x18))) + _DOCUMENT_LOW + "".join(map(chr, range(0x20, 0x80))) + _DOCUMENT_HIGH + "".join(map(chr, range(0xA1, 0x100)))


def decode_text(data: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else the document encoding."""
    if data.startswith(b"\xfe\xff"):
        return re.sub(r"\x1b.*?\x1b", "", data[2:].decode("utf-16-be", "replace"))
    if data.startswith(b"\xff\xfe"):
        return data[2:].decode("utf-16-le", "replace")
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    return "".join(_DOCUMENT[c] for c in data)


def encode_text(text: str) -> bytes:
    """Plain bytes for printable ASCII, tab and line ends, otherwise UTF-16 with its mark."""
    if re.fullmatch(r"[\t\n\r\x20-\x7e]*", text):
        return text.encode("ascii")
    return b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")


def _binary_udf(f):
    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(bytes(v)) for v in values], dtype=object)

    return run


CODECS = {
    "flate": (_binary_udf(flate_encode), _binary_udf(flate_decode)),
    "lzw": (_binary_udf(lzw_encode), _binary_udf(lzw_decode)),
    "ascii85": (_binary_udf(ascii85_encode), _binary_udf(ascii85_decode)),
    "run_length": (_binary_udf(run_length_encode), _binary_udf(run_length_decode)),
}


@F.pandas_udf(T.BinaryType())
def text_string_bytes(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else encode_text(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def text_string_value(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else decode_text(bytes(v)) for v in values], dtype=object)


def ascii_hex(data: Column) -> Column:
    """Native encoder: lower-case digits and the end mark."""
    return F.concat(F.lower(F.hex(data)), F.lit(">"))


def from_ascii_hex(text: Column) -> Column:
    """Native decoder."""
    digits = F.regexp_replace(F.substring_index(text, ">", 1), r"[\x00\t\n\f\r ]", "")
    return F.unhex(F.concat(digits, F.repeat(F.lit("0"), F.length(digits) % 2)))
