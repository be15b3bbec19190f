"""The content interpreter: operations to marks in paint order.

Kinds of marks: text, path, image, group (forms and PostScript), content, clip
(a path, or the text objects, that later marks are clipped by), shading and
pattern. Marks name the clips in force by their ``ord``. Type 3 glyphs run as
content of their own. What a caller does not ask for is not built.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from quire.functions.filters import FilterError, decode_text
from quire.sources.pdf.color import Space, read_shading
from quire.sources.pdf.document import Document, Page, operators
from quire.sources.pdf.fonts import Font
from quire.sources.pdf.objects import Name, PdfError, Ref, Stream

STATES, FORMS = 256, 1024
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

#: How many operands each operator takes (-1: any number).
OPERANDS = {
    "b": 0, "B": 0, "b*": 0, "B*": 0, "BDC": 2, "BI": 1, "BMC": 1, "BT": 0, "BX": 0, "c": 6, "cm": 6, "CS": 1, "cs": 1, "d": 2, "d0": 2, "d1": 6, "Do": 1, "DP": 2, "EMC": 0,
    "ET": 0, "EX": 0, "f": 0, "F": 0, "f*": 0, "G": 1, "g": 1, "gs": 1, "h": 0, "i": 1, "j": 1, "J": 1, "K": 4, "k": 4, "l": 2, "m": 2, "M": 1, "MP": 1, "n": 0, "q": 0, "Q": 0,
    "re": 4, "RG": 3, "rg": 3, "ri": 1, "s": 0, "S": 0, "SC": -1, "sc": -1, "SCN": -1, "scn": -1, "sh": 1, "T*": 0, "Tc": 1, "Td": 2, "TD": 2, "Tf": 2, "Tj": 1, "TJ": 1, "TL": 1,
    "Tm": 6, "Tr": 1, "Ts": 1, "Tw": 1, "Tz": 1, "v": 4, "w": 1, "W": 0, "W*": 0, "y": 4, "'": 1, '"': 3,
}

#: Path painting operators as (close first, fill, even-odd, stroke).
PAINTS = {
    "S": (False, False, False, True), "s": (True, False, False, True), "f": (False, True, False, False), "F": (False, True, False, False), "f*": (False, True, True, False),
    "B": (False, True, False, True), "B*": (False, True, True, True), "b": (True, True, False, True), "b*": (True, True, True, True), "n": (False, False, False, False),
}


SPACE = 32
#: Codes of a string beyond which its width is summed by numpy.
LONG = 64
KINDS = frozenset(("text", "path", "image", "group", "content", "clip", "shading", "pattern"))
INTENTS = frozenset(("AbsoluteColorimetric", "RelativeColorimetric", "Saturation", "Perceptual"))
DEVICE = {"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}

#: Keys of graphics state dictionaries that set one plain value, with the style's name for it.
PLAIN_STATE = {
    "LW": ("line_width", (int, float)), "LC": ("cap", int), "LJ": ("join", int), "ML": ("miter", (int, float)), "ca": ("fill_alpha", (int, float)), "CA": ("stroke_alpha", (int, float)),
    "FL": ("flatness", (int, float)), "SM": ("smoothness", (int, float)), "TK": ("text_knockout", bool), "AIS": ("alpha_is_shape", bool), "SA": ("stroke_adjust", bool),
    "OPM": ("overprint_mode", int), "AAPL:AA": ("antialias", bool),
}


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """Applies ``n`` first, then ``m``."""
    a, b, c, d, e, f = m
    return (a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f)


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass
class State:
    ctm: Matrix = IDENTITY
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    h_scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill_space: Space | None = None
    stroke_space: Space | None = None
    fill_values: tuple = (0.0,)
    stroke_values: tuple = (0.0,)
    clips: tuple = ()
    colored: bool = True
    style: dict = field(default_factory=lambda: {"line_width": 1.0, "cap": 0, "join": 0, "miter": 10.0, "fill": "0", "stroke": "0", "fill_alpha": 1.0, "stroke_alpha": 1.0, "blend": "Normal"})


class Interpreter:
    """Runs one page and yields (kind, mark) pairs of the wanted kinds; ``ord`` numbers all marks."""

    def __init__(self, doc: Document, page: Page, kinds: frozenset[str] = KINDS, detailed: bool = True):
        """``detailed``: whether marks of text hold their glyphs; those of simple fonts are not made otherwise."""
        self.doc, self.page, self.kinds, self.detailed = doc, page, kinds, detailed
        self.fonts: dict = {}
        self.spaces: dict = {}
        self.content: list[dict] = []
        self.count = 0

    def run(self) -> Iterator[tuple[str, dict]]:
        state = State()
        for kind, mark in self._content(self.doc.content(self.page), self.page.resources, state, 0, ()):
            if kind in self.kinds:
                yield kind, mark

    def _mark(self, kind: str, state: State | None, /, **values) -> tuple[str, dict]:
        self.count += 1
        inside = next((c["mcid"] for c in reversed(self.content) if c["mcid"] is not None), None)
        replaced = next((c["actual"] for c in reversed(self.content) if c["actual"] is not None), None)
        return kind, {"ord": self.count - 1, "mcid": inside, "replacement": replaced, "clips": list(state.clips) if state else []} | values

    def _needless(self, state: State) -> bool:
        """Showing text moves nothing but text, so it is skipped when no text is wanted and none of it draws or clips."""
        return "text" not in self.kinds and state.mode < 4 and state.font.subtype != "Type3" and not self.kinds & {"clip"}

    def _colors(self, state: State) -> dict:
        def rgb(space: Space | None, values: tuple) -> list[float] | None:
            try:
                return [0.0, 0.0, 0.0] if space is None else None if space.family == "Pattern" else space.rgb([float(v) for v in values])
            except (PdfError, FilterError, TypeError, ValueError, IndexError) as e:
                self.doc.fault(f"a colour cannot be converted: {e}")
                return None

        return {"fill_rgb": rgb(state.fill_space, state.fill_values), "stroke_rgb": rgb(state.stroke_space, state.stroke_values)}

    def _space(self, resources: dict, fill: bool, name: object, state: State) -> None:
        key = (id(resources), str(name))
        if key not in self.spaces:
            try:
                self.spaces[key] = resources, Space(self.doc, name, resources)
            except (PdfError, FilterError) as e:
                self.doc.fault(f"colour space {name}: {e}")
                self.spaces[key] = resources, None
        if (space := self.spaces[key][1]) is not None:
            self._paint(state, fill, space, space.first)
            state.style = state.style | {"fill_space" if fill else "stroke_space": space.family}

    def _paint(self, state: State, fill: bool, space: Space | None, args: list) -> None:
        """Sets a colour; an uncoloured Type 3 glyph leaves it as it is."""
        if not state.colored:
            return
        shown = " ".join(f"/{a}" if isinstance(a, Name) else f"{float(a):g}" for a in args)
        if space is None or space.family in DEVICE.values():
            state.style = {k: v for k, v in state.style.items() if k != ("fill_space" if fill else "stroke_space")}
        state.style = state.style | {"fill" if fill else "stroke": shown}
        if fill:
            state.fill_space, state.fill_values = space, tuple(args)
        else:
            state.stroke_space, state.stroke_values = space, tuple(args)

    def _dash(self, args: list, state: State) -> None:
        array = [self.doc.resolve(v) for v in args[0]] if len(args) == 2 and isinstance(args[0], list) else None
        if array is None or any(isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0 for v in array) or (array and not any(array)):
            self.doc.fault("a wrong dash pattern")
            return
        state.style = state.style | {"dash": [[float(v) for v in array], float(args[1])]}

    def _intent(self, name: object, state: State) -> None:
        if str(name) not in INTENTS:
            self.doc.fault("an unknown rendering intent")
        state.style = state.style | {"intent": str(name) if str(name) in INTENTS else "RelativeColorimetric"}

    def _shading(self, ref: object, own: object, resources: dict, state: State, matrix: list) -> Iterator[tuple[str, dict]]:
        if "shading" not in self.kinds:
            self.count += 1
            return
        try:
            yield self._mark("shading", state, num=ref.num if isinstance(ref, Ref) else None, matrix=matrix, **read_shading(self.doc, own, resources))
        except (PdfError, FilterError, TypeError, ValueError, KeyError) as e:
            self.count += 1
            self.doc.fault(f"a shading cannot be read: {e}")

    def _pattern(self, resources: dict, args: list, fill: bool, state: State) -> Iterator[tuple[str, dict]]:
        ref, own = self._resource(resources, "Pattern", args[-1])
        if own is None:
            return
        get = lambda key, kind, default=None: self.doc.get(own, key, kind, default)
        matrix = [float(self.doc.resolve(v)) for v in get("Matrix", list, [1, 0, 0, 1, 0, 0])]
        kind = get("PatternType", int)
        yield self._mark(
            "pattern", state, num=ref.num if isinstance(ref, Ref) else None, kind=kind, fill=fill, paint_type=get("PaintType", int), matrix=matrix,
            bbox=[float(self.doc.resolve(v)) for v in get("BBox", list, [])] or None, x_step=get("XStep", (int, float)), y_step=get("YStep", (int, float)), colors=[float(v) for v in args[:-1]],
        )
        if kind == 2:
            held = own.dict if isinstance(own, Stream) else own
            yield from self._shading(held.get("Shading"), self.doc.resolve(held.get("Shading")), resources, state, matrix)

    def _type3(self, glyphs: list[dict], resources: dict, state: State, text: Matrix, depth: int, path: tuple) -> Iterator[tuple[str, dict]]:
        """Runs the glyphs' own content; a glyph that begins with ``d1`` keeps the text's colour."""
        font = state.font
        if depth >= FORMS or ("Type3", font.num, id(font)) in path:
            self.doc.fault("glyphs contain themselves or are nested too deep")
            return
        for g in glyphs:
            ref = font.procedures.get(font.names.get(g["code"]))
            own = self.doc.resolve(ref)
            if not isinstance(own, Stream):
                continue
            inner = copy.copy(state)
            scale = (state.size * state.h_scale, 0, 0, state.size, g["x"], g["y"] + state.rise)
            inner.ctm = multiply(multiply(multiply(state.ctm, text), scale), tuple(font.matrix))
            inner.style, inner.font, inner.mode = dict(state.style), None, 0
            yield from self._content(self.doc.decoded(own), font.resources or resources, inner, depth + 1, (*path, ("Type3", font.num, id(font))))

    @property
    def hidden(self) -> bool:
        return any(c["hidden"] for c in self.content)

    def _resource(self, resources: dict, kind: str, name: object) -> tuple[object, object]:
        held = self.doc.get(resources, kind, dict, {})
        ref = held.get(str(name))
        value = self.doc.resolve(ref)
        if value is None:
            self.doc.fault(f"no {kind} named {name}")
        return ref, value

    def _content(self, data: bytes, resources: dict, state: State, depth: int, path: tuple) -> Iterator[tuple[str, dict]]:
        doc, stack, loose = self.doc, [], 0
        segments: list[tuple[str, list[float]]] = []
        clip: bool | None = None  # even-odd of a clip that the next painting operator sets
        clipped: list[int] = []  # text marks of this text object that clip
        text: Matrix | None = None
        line: Matrix = IDENTITY
        current: tuple[float, float] = (0.0, 0.0)
        opened = len(self.content)
        for op, args, _ in operators(data, doc.lenient):
            if op == "BX":
                loose += 1
            elif op == "EX":
                loose = max(0, loose - 1)
            want = OPERANDS.get(op)
            if want is None:
                if not loose:
                    doc.fault(f"an unknown operator {op}")
                continue
            if want >= 0 and len(args) != want:
                doc.fault(f"{op} takes {want} operands")
                if len(args) < want:
                    continue
                args = args[-want:] if want else []
            if op == "q":
                if len(stack) >= STATES:
                    raise PdfError("graphics states nested too deep")
                stack.append(copy.copy(state))
                state.style = dict(state.style)
            elif op == "Q":
                if stack:
                    state = stack.pop()
                else:
                    doc.fault("Q without q")
            elif op == "cm":
                state.ctm = multiply(state.ctm, tuple(map(float, args)))
            elif op in ("w", "J", "j", "M"):
                state.style = state.style | {{"w": "line_width", "J": "cap", "j": "join", "M": "miter"}[op]: args[0]}
            elif op == "d":
                self._dash(args, state)
            elif op == "i":
                state.style = state.style | {"flatness": args[0]}
            elif op == "ri":
                self._intent(args[0], state)
            elif op in ("d0", "d1"):
                state.colored = op == "d0"
            elif op in ("W", "W*"):
                clip = op == "W*"
            elif op in ("g", "rg", "k", "G", "RG", "K"):
                self._paint(state, op.islower(), Space(doc, Name(DEVICE[op.lower()])), args)
            elif op in ("cs", "CS"):
                self._space(resources, op.islower(), args[0], state)
            elif op in ("sc", "scn", "SC", "SCN"):
                self._paint(state, op.islower(), state.fill_space if op.islower() else state.stroke_space, args)
                if args and isinstance(args[-1], Name) and state.colored:
                    yield from self._pattern(resources, args, op.islower(), state)
            elif op == "gs":
                self._ext_state(self._resource(resources, "ExtGState", args[0])[1] or {}, state)
            elif op == "m":
                current = (float(args[0]), float(args[1]))
                segments.append(("M", [*moved(state.ctm, *current)]))
            elif op == "l":
                current = (float(args[0]), float(args[1]))
                segments.append(("L", [*moved(state.ctm, *current)]))
            elif op in ("c", "v", "y"):
                points = list(zip(map(float, args[::2]), map(float, args[1::2]), strict=True))
                points = [current, *points] if op == "v" else [*points, points[-1]] if op == "y" else points
                current = points[-1]
                segments.append(("C", [v for q in points for v in moved(state.ctm, *q)]))
            elif op == "h":
                segments.append(("Z", []))
            elif op == "re":
                x, y, w, h = map(float, args)
                corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
                segments += [("M" if i == 0 else "L", [*moved(state.ctm, *q)]) for i, q in enumerate(corners)] + [("Z", [])]
                current = (x, y)
            elif op in PAINTS:
                close, fill, even_odd, stroke = PAINTS[op]
                if close:
                    segments.append(("Z", []))
                fill, stroke = fill and (state.fill_space is None or state.fill_space.paints), stroke and (state.stroke_space is None or state.stroke_space.paints)
                if (fill or stroke) and segments and not self.hidden:
                    yield self._mark("path", state, segments=segments, even_odd=even_odd, fill=fill, stroke=stroke, style=state.style, **self._colors(state))
                if clip is not None:
                    mark = self._mark("clip", state, segments=segments, even_odd=clip, text_ords=[])
                    state.clips = (*state.clips, mark[1]["ord"])
                    yield mark
                segments, clip = [], None
            elif op == "sh":
                ref, own = self._resource(resources, "Shading", args[0])
                if not self.hidden and own is not None:
                    yield self._mark("path", state, segments=[], even_odd=False, fill=True, stroke=False, style=state.style | {"fill": f"/{args[0]}"}, fill_rgb=None, stroke_rgb=None)
                    yield from self._shading(ref, own, resources, state, list(state.ctm))
            elif op == "BT":
                if text is not None:
                    doc.fault("BT inside a text object")
                text = line = IDENTITY
                clipped = []
            elif op == "ET":
                text = None
                if clipped:
                    mark = self._mark("clip", state, segments=[], even_odd=False, text_ords=clipped)
                    state.clips = (*state.clips, mark[1]["ord"])
                    clipped = []
                    yield mark
            elif op == "Tf":
                state.font, state.size = self._font(resources, args[0]), float(args[1])
            elif op in ("Tc", "Tw", "TL", "Ts"):
                setattr(state, {"Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise"}[op], float(args[0]))
            elif op == "Tz":
                state.h_scale = args[0] / 100
            elif op == "Tr":
                if args[0] not in range(8):
                    doc.fault("a wrong text mode")
                else:
                    state.mode = args[0]
            elif op == "Tm":
                text = line = tuple(map(float, args))
            elif op in ("Td", "TD"):
                if op == "TD":
                    state.leading = -float(args[1])
                text = line = multiply(line, (1, 0, 0, 1, float(args[0]), float(args[1])))
            elif op in ("T*", "'", '"', "Tj", "TJ"):
                if op == '"':
                    state.word_space, state.char_space = float(args[0]), float(args[1])
                if op in ("T*", "'", '"'):
                    text = line = multiply(line, (1, 0, 0, 1, 0, -state.leading))
                if op != "T*":
                    if text is None:
                        doc.fault("text is shown outside a text object")
                        text = IDENTITY
                    items = args[-1] if op == "TJ" else [args[-1]]
                    if state.font and self._needless(state):
                        self.count += any(isinstance(x, bytes) and len(x) > 0 for x in items)  # marks are numbered alike whatever is wanted
                        continue
                    before = text
                    mark, text = self._show(items, state, text)
                    if mark and state.mode >= 4:
                        clipped.append(mark[1]["ord"])
                    if mark and (not self.hidden or state.mode >= 4):
                        yield mark
                    if mark and not self.hidden and state.font.subtype == "Type3":
                        yield from self._type3(mark[1]["glyphs"], resources, state, before, depth, path)
            elif op == "Do":
                yield from self._xobject(resources, args[0], state, depth, path)
            elif op == "BI":
                if not self.hidden:
                    yield self._mark("image", state, num=None, matrix=list(state.ctm), style=state.style, width=args[0].dict.get("Width"), height=args[0].dict.get("Height"))
            elif op in ("BMC", "BDC", "MP", "DP", "EMC"):
                yield from self._marked(op, args, resources, opened)
        if stack or text is not None or len(self.content) > opened:
            doc.fault("the content ends with something open")
            del self.content[opened:]

    def _ext_state(self, own: dict, state: State) -> None:
        doc = self.doc
        if (kind := doc.get(own, "Type", Name)) not in (None, "ExtGState"):
            doc.fault("no graphics state dictionary")
        for key, (name, kinds) in PLAIN_STATE.items():
            if (v := doc.get(own, key, kinds)) is not None:
                state.style = state.style | {name: v}
        for key, name in (("OP", "overprint_stroke"), ("op", "overprint_fill")):
            if (v := doc.get(own, key, bool)) is not None:
                state.style = state.style | ({"overprint_stroke": v, "overprint_fill": v} if key == "OP" and "op" not in own else {name: v})
        if (dash := doc.get(own, "D", list)) is not None:
            self._dash([doc.resolve(v) for v in dash], state)
        if (intent := doc.get(own, "RI", Name)) is not None:
            self._intent(intent, state)
        for keys, name in ((("TR2", "TR"), "transfer"), (("BG2", "BG"), "black_generation"), (("UCR2", "UCR"), "undercolor_removal"), (("HT",), "halftone"), (("HTO",), "halftone_origin")):
            if (key := next((k for k in keys if k in own), None)) is not None:
                v = own[key]
                held = doc.resolve(v)
                state.style = state.style | {name: {"num": v.num} if isinstance(v, Ref) and isinstance(held, (dict, Stream, list)) else str(held) if isinstance(held, Name) else held}
        if "SMask" in own:
            mask = doc.resolve(own["SMask"])
            group = mask.get("G") if isinstance(mask, dict) else None
            state.style = state.style | {"soft_mask": {"kind": str(mask.get("S", "")), "group": group.num if isinstance(group, Ref) else None} if isinstance(mask, dict) else None}
        mode = doc.get(own, "BM", (Name, list))
        if mode is not None:
            from quire.functions.blend import NONSEPARABLE, SEPARABLE

            known = [str(doc.resolve(m)) for m in (mode if isinstance(mode, list) else [mode]) if str(doc.resolve(m)) in SEPARABLE | NONSEPARABLE]
            state.style = state.style | {"blend": known[0] if known else "Normal"}
        if font := doc.get(own, "Font", list):
            state.font, state.size = self._load(font[0]), float(doc.resolve(font[1]))

    def _load(self, ref: object) -> Font | None:
        key = ref if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            own = self.doc.resolve(ref)
            self.fonts[key] = Font(self.doc, own, ref.num if isinstance(ref, Ref) else None) if isinstance(own, dict) else None
        return self.fonts[key]

    def _font(self, resources: dict, name: object) -> Font | None:
        return self._load(self._resource(resources, "Font", name)[0])

    def _show(self, items: list, state: State, text: Matrix) -> tuple[tuple[str, dict] | None, Matrix]:
        font, glyphs = state.font, []
        if font is None:
            self.doc.fault("text is shown without a font")
            return None, text
        x = y = 0.0
        quick = None if self.detailed or font.composite or font.subtype == "Type3" else font.quick()
        texts, n = [], 0
        for item in items:
            if isinstance(item, (int, float)):
                shift = -item / 1000 * state.size
                x, y = (x, y + shift) if font.vertical else (x + shift * state.h_scale, y)
                continue
            if quick:
                _, widths = quick
                size, char, word, h_scale = state.size, state.char_space, state.char_space + state.word_space, state.h_scale
                if len(item) < LONG:
                    for c in item:
                        x += (widths[c] * size + (word if c == SPACE else char)) * h_scale
                else:  # the same sums in the same order
                    key = size, char, word, h_scale
                    if font.steps is None or font.steps[0] != key:
                        font.steps = key, np.array([(w * size + (word if c == SPACE else char)) * h_scale for c, w in enumerate(widths)], float)
                    x = float(np.add.accumulate(np.concatenate(([x], font.steps[1][np.frombuffer(item, np.uint8)])))[-1])
                texts.append(font.text_of(item))
                n += len(item)
                continue
            for g in font.decode(item):
                glyphs.append({"code": g.code, "text": g.text, "cid": g.cid, "gid": g.gid, "width": g.width, "x": x, "y": y, "word_space": g.space})
                extra = state.char_space + (state.word_space if g.space else 0.0)
                if font.vertical:
                    y += -state.size + extra
                else:
                    x += (g.width * state.size + extra) * state.h_scale
        mark = self._mark("text", state, font_num=font.num, font=font.name, matrix=list(multiply(state.ctm, multiply(text, (1, 0, 0, 1, 0, state.rise)))), size=state.size, h_scale=state.h_scale, mode=state.mode, glyphs=glyphs, text="".join(texts) if quick else "".join([g["text"] for g in glyphs]), style=state.style)
        return mark if glyphs or n else None, multiply(text, (1, 0, 0, 1, x, y))

    def _xobject(self, resources: dict, name: object, state: State, depth: int, path: tuple) -> Iterator[tuple[str, dict]]:
        doc = self.doc
        ref, own = self._resource(resources, "XObject", name)
        if not isinstance(own, Stream) or self.hidden or ("OC" in own.dict and not doc.content_visible(own.dict["OC"])):
            return
        num = ref.num if isinstance(ref, Ref) else None
        kind = own.dict.get("Subtype")
        if kind == "Image":
            yield self._mark("image", state, num=num, matrix=list(state.ctm), style=state.style, width=doc.get(own, "Width", int), height=doc.get(own, "Height", int))
        elif kind == "PS":
            yield self._mark("group", state, num=num, matrix=list(state.ctm), style=state.style, group="PS")
        elif kind == "Form":
            if depth >= FORMS or ref in path:
                doc.fault("forms contain themselves or are nested too deep")
                return
            inner = copy.copy(state)
            inner.ctm = multiply(state.ctm, tuple(float(doc.resolve(v)) for v in doc.get(own, "Matrix", list, [1, 0, 0, 1, 0, 0])))
            inner.style = dict(state.style)
            yield self._mark("group", state, num=num, matrix=list(inner.ctm), style=inner.style, group=str(kind))
            yield from self._content(doc.decoded(own), doc.get(own, "Resources", dict) or resources, inner, depth + 1, (*path, ref))

    def _marked(self, op: str, args: list, resources: dict, floor: int) -> Iterator[tuple[str, dict]]:
        doc = self.doc
        if op == "EMC":
            if len(self.content) <= floor:
                doc.fault("EMC without BMC")
                return
            last = self.content.pop()
            yield self._mark("content", None, operator=op, tag=last["tag"], properties=None, depth=len(self.content), hidden=self.hidden)
            return
        tag, own, ref = str(args[0]), {}, None
        if len(args) > 1:
            ref = args[1]
            own = ref if isinstance(ref, dict) else self._resource(resources, "Properties", ref)[1] or {}
            ref = self.doc.get(resources, "Properties", dict, {}).get(str(ref)) if isinstance(ref, Name) else None
        if op in ("BMC", "BDC"):
            hidden = tag == "OC" and not doc.content_visible(ref if ref is not None else own)
            actual = doc.get(own, "ActualText", bytes)
            self.content.append({"tag": tag, "hidden": hidden, "mcid": doc.get(own, "MCID", int), "actual": None if actual is None else decode_text(actual)})
        yield self._mark("content", None, operator=op, tag=tag, properties=own or None, depth=len(self.content), hidden=self.hidden)
