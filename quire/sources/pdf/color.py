"""Functions and colour spaces of a document, evaluated on plain numbers."""

from __future__ import annotations

import math

from quire.functions import calculator
from quire.sources.pdf.objects import Name, PdfError, Stream

DEPTH = 16


def _numbers(doc, own, key: str, default=None) -> list[float] | None:
    held = doc.get(own, key, list)
    return default if held is None else [float(doc.resolve(v)) for v in held]


def _clip(values: list[float], limits: list[float] | None) -> list[float]:
    return values if not limits else [min(max(v, limits[2 * i]), limits[2 * i + 1]) for i, v in enumerate(values)]


def _spread(x: float, a: float, b: float, c: float, d: float) -> float:
    return c if a == b else c + (x - a) * (d - c) / (b - a)


def read_function(doc, v: object, depth: int = 0):
    """A callable from a list of inputs to a list of outputs; an array of functions gives one output each."""
    own = doc.resolve(v)
    if depth > DEPTH:
        raise PdfError("functions nested too deep")
    if own == "Identity":
        return lambda x: list(x)
    if isinstance(own, list):
        parts = [read_function(doc, f, depth + 1) for f in own]
        return lambda x: [y for f in parts for y in f(x)]
    if not isinstance(own, (dict, Stream)):
        raise PdfError("no function")
    domain, bounds = _numbers(doc, own, "Domain", [0.0, 1.0]), _numbers(doc, own, "Range")
    make = {0: _sampled, 2: _exponential, 3: _stitching, 4: _program}.get(doc.get(own, "FunctionType", int))
    if make is None:
        raise PdfError("an unknown function type")
    inner = make(doc, own, domain, bounds, depth)
    return lambda x: _clip(inner(_clip([float(t) for t in x], domain)), bounds)


def _exponential(doc, own, domain, bounds, depth):
    c0, c1, n = _numbers(doc, own, "C0", [0.0]), _numbers(doc, own, "C1", [1.0]), float(doc.get(own, "N", (int, float), 1))
    return lambda x: [a + (0.0 if x[0] == 0 and n > 0 else x[0] ** n) * (b - a) for a, b in zip(c0, c1, strict=True)]


def _stitching(doc, own, domain, bounds, depth):
    parts = [read_function(doc, f, depth + 1) for f in doc.get(own, "Functions", list, [])]
    edges, encode = _numbers(doc, own, "Bounds", []), _numbers(doc, own, "Encode")
    if not parts or len(edges) != len(parts) - 1 or len(encode or []) != 2 * len(parts):
        raise PdfError("a stitching function is ill-formed")
    starts = [domain[0], *edges, domain[1]]

    def run(x):
        k = min(sum(x[0] >= e for e in edges), len(parts) - 1)
        return parts[k]([_spread(x[0], starts[k], starts[k + 1], encode[2 * k], encode[2 * k + 1])])

    return run


def _sampled(doc, own, domain, bounds, depth):
    """Samples of any number of inputs: linear between neighbours, or for order 3 by cubic splines through four."""
    size = [int(doc.resolve(v)) for v in doc.get(own, "Size", list, [])]
    bits, outputs = doc.get(own, "BitsPerSample", int), len(bounds or []) // 2
    if not isinstance(own, Stream) or not outputs or len(size) != len(domain) // 2 or bits not in (1, 2, 4, 8, 12, 16, 24, 32):
        raise PdfError("a sampled function is ill-formed")
    encode = _numbers(doc, own, "Encode") or [v for s in size for v in (0.0, s - 1.0)]
    decode = _numbers(doc, own, "Decode") or bounds
    raw = doc.decoded(own)
    data, top, total = int.from_bytes(raw, "big"), (1 << bits) - 1, len(raw) * 8
    if total < math.prod(size) * outputs * bits:
        raise PdfError("a sampled function has too few samples")
    cubic = doc.get(own, "Order", int, 1) == 3

    def sample(place: tuple[int, ...], j: int) -> float:
        index = 0
        for i in reversed(range(len(size))):
            index = index * size[i] + place[i]
        return data >> (total - (index * outputs + j + 1) * bits) & top

    def between(at: list[float], place: tuple[int, ...], j: int) -> float:
        """The value where the first inputs are whole and the others lie at ``at``."""
        i = len(place)
        if i == len(size):
            return sample(place, j)
        low, last = min(int(at[i]), max(0, size[i] - 2)), size[i] - 1
        t, value = at[i] - low, lambda k: between(at, (*place, k), j)
        b, c = value(low), value(min(low + 1, last))
        if not cubic or size[i] < 4:
            return b + t * (c - b)
        # beyond the ends the samples go on in a straight line
        a = value(low - 1) if low > 0 else 2 * b - c
        d = value(low + 2) if low + 2 <= last else 2 * c - b
        return b + t / 2 * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a)))

    def run(x):
        at = [min(max(_spread(t, domain[2 * i], domain[2 * i + 1], encode[2 * i], encode[2 * i + 1]), 0.0), size[i] - 1.0) for i, t in enumerate(x)]
        return [_spread(between(at, (), j), 0, top, decode[2 * j], decode[2 * j + 1]) for j in range(outputs)]

    return run


def _program(doc, own, domain, bounds, depth):
    program = calculator.parse(doc.decoded(own).decode("latin-1"))

    def run(x):
        try:
            out = calculator.evaluate(program, x)
        except calculator.CalculatorError as e:
            raise PdfError(f"a calculator function fails: {e}") from e
        return out[len(out) - len(bounds) // 2 :] if bounds else out

    return run


class Space:
    """A colour space: its family, number of components, first colour, and colours as RGB."""

    def __init__(self, doc, v: object, resources: dict | None = None, depth: int = 0):
        own = doc.resolve(v)
        if depth > DEPTH:
            raise PdfError("colour spaces nested too deep")
        if isinstance(own, Name) and resources is not None:
            held = doc.resolve(doc.get(resources, "ColorSpace", dict, {}).get(str(own)))
            own = own if held is None else held
        own = own if isinstance(own, list) else [own]
        family = doc.resolve(own[0]) if own else None
        self.family = str(family)
        self.names: list[str] = []
        self.base: Space | None = None
        second = lambda: doc.resolve(own[1]) if len(own) > 1 else None
        self.function = None
        self.first: list[float] | None = None
        if self.family in ("DeviceGray", "G", "CalGray"):
            self.n = 1
        elif self.family in ("DeviceRGB", "RGB", "CalRGB"):
            self.n = 3
        elif self.family in ("DeviceCMYK", "CMYK"):
            self.n, self.first = 4, [0.0, 0.0, 0.0, 1.0]
        elif self.family == "Lab":
            self.n = 3
            self.white = _numbers(doc, second(), "WhitePoint", [0.9505, 1.0, 1.089])
        elif self.family == "ICCBased":
            self.n = doc.get(second(), "N", int, 0)
            if self.n not in (1, 3, 4):
                raise PdfError("a profile with a wrong number of components")
            alternate = doc.get(second(), "Alternate", (Name, list))
            self.base = Space(doc, alternate or Name({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[self.n]), resources, depth + 1)
            if self.base.n != self.n:
                raise PdfError("a profile's alternate has another number of components")
            self.first = self.base.first
        elif self.family in ("Indexed", "I"):
            self.n, self.base, self.top = 1, Space(doc, own[1], resources, depth + 1), int(doc.resolve(own[2]))
            table = doc.resolve(own[3])
            self.table = doc.decoded(table) if isinstance(table, Stream) else table
        elif self.family in ("Separation", "DeviceN"):
            held = second()
            self.names = [str(doc.resolve(x)) for x in held] if isinstance(held, list) else [str(held)]
            self.n, self.base, self.function = len(self.names), Space(doc, own[2], resources, depth + 1), read_function(doc, own[3])
            self.first = [1.0] * self.n
        elif self.family == "Pattern":
            self.n, self.base = 0, Space(doc, own[1], resources, depth + 1) if len(own) > 1 else None
        else:
            raise PdfError(f"an unknown colour space {self.family}")
        self.first = self.first or [0.0] * self.n

    @property
    def paints(self) -> bool:
        """False for a separation, or colorants all of which, named None."""
        return not self.names or any(n != "None" for n in self.names)

    def rgb(self, values: list[float]) -> list[float] | None:
        """Red, green and blue from 0 to 1; None for patterns and the wrong number of values."""
        if self.family == "Pattern" or len(values) != self.n:
            return None
        if self.family in ("Separation", "DeviceN"):
            return self.base.rgb(self.function(values))
        if self.family in ("Indexed", "I"):
            at = min(max(int(values[0]), 0), self.top) * self.base.n
            return self.base.rgb([b / 255 for b in self.table[at : at + self.base.n]])
        if self.family == "ICCBased":
            return self.base.rgb(values)
        if self.family == "Lab":
            return _lab(values, self.white)
        v = [min(max(x, 0.0), 1.0) for x in values]
        if self.n == 1:
            return v * 3
        if self.n == 3:
            return v
        return [1 - min(1.0, c + v[3]) for c in v[:3]]


def _lab(values: list[float], white: list[float]) -> list[float]:
    m = (values[0] + 16) / 116
    g = lambda t: t**3 if t >= 6 / 29 else 108 / 841 * (t - 4 / 29)
    x, y, z = white[0] * g(m + values[1] / 500), white[1] * g(m), white[2] * g(m - values[2] / 200)
    linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z)
    return [min(max(12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055, 0.0), 1.0) for v in linear]


def read_shading(doc, v: object, resources: dict | None) -> dict:
    """A shading dictionary: kind, space, geometry and, where there is a function, colours along its domain."""
    own = doc.resolve(v)
    if not isinstance(own, (dict, Stream)):
        raise PdfError("no shading")
    kind = doc.get(own, "ShadingType", int)
    held = own.dict if isinstance(own, Stream) else own
    space = Space(doc, held.get("ColorSpace"), resources)
    out = {
        "kind": kind, "space": space.family, "coords": _numbers(doc, own, "Coords"), "domain": _numbers(doc, own, "Domain", [0.0, 1.0, 0.0, 1.0] if kind == 1 else [0.0, 1.0]),
        "function_matrix": _numbers(doc, own, "Matrix"), "bbox": _numbers(doc, own, "BBox"), "background": _numbers(doc, own, "Background"),
        "extend": [bool(doc.resolve(x)) for x in doc.get(own, "Extend", list, [False, False])], "colors": [], "vertices": None,
    }
    if kind not in range(1, 8):
        raise PdfError("an unknown shading type")
    function = read_function(doc, held["Function"]) if "Function" in held else None
    if function and kind in (2, 3):
        a, b = out["domain"]
        out["colors"] = [space.rgb(function([a + (b - a) * i / 4])) for i in range(5)]
    if kind >= 4:
        if not isinstance(own, Stream):
            raise PdfError("a mesh without data")
        out["vertices"] = _vertices(doc, own, kind, 1 if function else space.n)
    return out


def _vertices(doc, own: Stream, kind: int, components: int) -> list[list[float]]:
    """Flag (-1 in lattices), x, y and components of each vertex; a patch gives its points, then its corners' colours."""
    decode = _numbers(doc, own, "Decode") or []
    widths = [doc.get(own, k, int, 0) for k in ("BitsPerFlag", "BitsPerCoordinate", "BitsPerComponent")]
    if len(decode) != 4 + 2 * components or widths[1] not in (1, 2, 4, 8, 12, 16, 24, 32) or widths[2] not in (1, 2, 4, 8, 12, 16) or (kind != 5 and widths[0] not in (2, 4, 8)):
        raise PdfError("a mesh is ill-formed")
    raw = doc.decoded(own)
    data, total, at = int.from_bytes(raw, "big"), len(raw) * 8, 0

    def take(bits: int) -> int:
        nonlocal at
        at += bits
        return data >> (total - at) & ((1 << bits) - 1)

    def scaled(bits: int, i: int) -> float:
        return _spread(take(bits), 0, (1 << bits) - 1, decode[2 * i], decode[2 * i + 1])

    point = lambda: [scaled(widths[1], 0), scaled(widths[1], 1)]
    color = lambda: [scaled(widths[2], 2 + j) for j in range(components)]
    out = []
    if kind in (4, 5):
        size = (widths[0] if kind == 4 else 0) + 2 * widths[1] + components * widths[2]
        while total - at >= size:
            out.append([float(take(widths[0])) if kind == 4 else -1.0, *point(), *color()])
            at = -(-at // 8) * 8 if kind == 4 else at
        return out
    while total - at >= widths[0]:
        flag = take(widths[0]) & 3
        points, colors = (12 if kind == 6 else 16) - (4 if flag else 0), 2 if flag else 4
        if total - at < points * 2 * widths[1] + colors * components * widths[2]:
            break
        out.append([float(flag), *[v for _ in range(points) for v in point()], *[v for _ in range(colors) for v in color()]])
        at = -(-at // 8) * 8
    return out
