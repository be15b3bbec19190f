"""TrueType programs: table directory, character maps and advance widths."""

from __future__ import annotations

import struct

from quire.sources.pdf.objects import PdfError


def tables(data: bytes) -> dict[str, bytes]:
    """Tables by tag; the first font of a collection."""
    at = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
    count = struct.unpack_from(">H", data, at + 4)[0]
    out = {}
    for i in range(count):
        tag, _, start, size = struct.unpack_from(">4sIII", data, at + 12 + 16 * i)
        if start + size > len(data):
            raise PdfError("a font table ends early")
        out[tag.decode("latin-1")] = data[start : start + size]
    return out


def character_maps(cmap: bytes) -> dict[tuple[int, int], dict[int, int]]:
    """Code to glyph of each (platform, encoding) in a readable format."""
    out = {}
    for i in range(struct.unpack_from(">H", cmap, 2)[0]):
        platform, encoding, start = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        if (found := _subtable(cmap[start:])) is not None:
            out[platform, encoding] = found
    return out


def _subtable(t: bytes) -> dict[int, int] | None:
    kind = struct.unpack_from(">H", t)[0]
    if kind == 0:
        return {c: g for c, g in enumerate(t[6:262]) if g}
    if kind == 4:
        return _segments(t)
    if kind == 6:
        first, n = struct.unpack_from(">HH", t, 6)
        return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", t, 10)) if g}
    if kind == 10:
        first, n = struct.unpack_from(">II", t, 12)
        return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", t, 20)) if g}
    if kind in (12, 13):
        out: dict[int, int] = {}
        for i in range(struct.unpack_from(">I", t, 12)[0]):
            low, high, glyph = struct.unpack_from(">III", t, 16 + 12 * i)
            if high < low or high > 0x10FFFF:
                raise PdfError("a wrong character group")
            out |= {c: glyph + (c - low) * (kind == 12) for c in range(low, high + 1)}
        return out
    return None


def _segments(t: bytes) -> dict[int, int]:
    n = struct.unpack_from(">H", t, 6)[0] // 2
    read = lambda at, sign: struct.unpack_from(f">{n}{sign}", t, at)
    ends, starts, deltas, offsets = read(14, "H"), read(16 + 2 * n, "H"), read(16 + 4 * n, "h"), read(16 + 6 * n, "H")
    out = {}
    for i, (low, high) in enumerate(zip(starts, ends, strict=True)):
        for code in range(low, high + 1):
            glyph = code
            if offsets[i]:
                at = 16 + 6 * n + 2 * i + offsets[i] + 2 * (code - low)
                glyph = struct.unpack_from(">H", t, at)[0] if at + 2 <= len(t) else 0
                if not glyph:
                    continue
            if glyph := (glyph + deltas[i]) & 0xFFFF:
                out[code] = glyph
    return out


def advances(data: bytes) -> list[float]:
    """Advance width of every glyph in thousandths of the em."""
    held = tables(data)
    em = struct.unpack_from(">H", held["head"], 18)[0]
    glyphs = struct.unpack_from(">H", held["maxp"], 4)[0]
    n = struct.unpack_from(">H", held["hhea"], 34)[0]
    own = [struct.unpack_from(">H", held["hmtx"], 4 * i)[0] * 1000 / em for i in range(n)]
    return own + own[-1:] * (glyphs - n)


def simple_glyph(maps: dict[tuple[int, int], dict[int, int]], code: int, text: str | None, symbolic: bool) -> int:
    """Glyph of a simple font's code: Unicode map by its text, or the symbol and Macintosh maps by code."""
    if not symbolic and text and (found := maps.get((3, 1), maps.get((0, 3)))) and len(text) == 1:
        if glyph := found.get(ord(text)):
            return glyph
    symbol = maps.get((3, 0), {})
    for high in (0xF000, 0xF100, 0xF200, 0):
        if glyph := symbol.get(high + code):
            return glyph
    return maps.get((1, 0), {}).get(code, 0)
