"""Image samples, PNG encoding and downscaling with numpy.

DCT, JPX, CCITT and JBIG2 data are not decoded here; such images pass through
with their coded bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

from quire.sources.pdf.color import Space
from quire.sources.pdf.document import Document
from quire.sources.pdf.objects import Name, PdfError, Stream

#: Pixels that are converted at a time.
BAND = 1 << 20
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}


class CodedImage(PdfError):
    """An image whose coding is not read here; ``coding`` names it."""

    def __init__(self, coding: str):
        super().__init__(f"{coding} samples are not decoded")
        self.coding = coding


def unpacked(data: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray:
    """Integer samples, shape (height, width, components); rows start on whole bytes."""
    row = (width * components * bits + 7) // 8
    if len(data) < row * height:
        raise PdfError("image data end early")
    rows = np.frombuffer(data, np.uint8, row * height).reshape(height, row)
    if bits == 8:
        out = rows
    elif bits == 16:
        out = rows.reshape(height, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    else:
        flat = np.unpackbits(rows, axis=1)[:, : width * components * bits].reshape(height, -1, bits)
        out = flat @ (1 << np.arange(bits - 1, -1, -1))
    return out[:, : width * components].reshape(height, width, components).astype(np.int64)


def _space(doc: Document, v: object) -> tuple[str, int, list]:
    """(family, components, its array) of a colour space."""
    v = doc.resolve(v)
    own = [doc.resolve(x) for x in v] if isinstance(v, list) else [v]
    family = str(own[0])
    if family == "ICCBased":
        n = doc.get(own[1], "N", int, 3)
        return {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(n, "DeviceRGB"), n, own
    if family in ("Indexed", "I"):
        return "Indexed", 1, own
    if family not in COMPONENTS:
        raise PdfError(f"colour space {family} is not converted")
    return {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK"}.get(family, family), COMPONENTS[family], own


def to_rgb(values: np.ndarray, family: str) -> np.ndarray:
    """Components in [0, 1] (Lab in its own units) to RGB in [0, 1], without profiles."""
    if family in ("DeviceGray", "CalGray"):
        return np.repeat(values, 3, axis=2)
    if family == "DeviceCMYK":
        return 1 - np.minimum(1, values[..., :3] + values[..., 3:])
    if family == "Lab":
        m = (values[..., 0] + 16) / 116
        parts = np.stack([m + values[..., 1] / 500, m, m - values[..., 2] / 200], axis=-1)
        xyz = np.where(parts >= 6 / 29, parts**3, (parts - 4 / 29) * 108 / 841) * np.array([0.95047, 1.0, 1.08883])
        linear = np.clip(xyz @ np.array([[3.2404542, -0.969266, 0.0556434], [-1.5371385, 1.8760108, -0.2040259], [-0.4985314, 0.041556, 1.0572252]]), 0, 1)
        return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return values


def image_bands(doc: Document, image: Stream) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, RGBA bytes of shape (rows, width, 4)) from top to bottom; a stencil mask is black where it paints.

    A band holds ``BAND`` pixels or one row, so that only the coded data, one band
    and a mask's plane are in memory, however large the image.
    """
    width, height = doc.get(image, "Width", int, 0), doc.get(image, "Height", int, 0)
    if width <= 0 or height <= 0:
        raise PdfError("an image without extent")
    data, coding = doc.decoded_image(image)
    if coding:
        raise CodedImage(coding)
    limits = [float(doc.resolve(v)) for v in doc.get(image, "Decode", list, [])]
    step = max(1, BAND // width)
    if doc.get(image, "ImageMask", bool, False):
        bands = _samples(data, width, height, 1, 1, step)
        for at, samples in bands:
            painted = samples[..., 0] == (1 if limits[:1] == [1.0] else 0)
            yield at, np.dstack([np.zeros((*painted.shape, 3), np.uint8), np.where(painted, 255, 0).astype(np.uint8)])
        return
    bits = doc.get(image, "BitsPerComponent", int, 8)
    n, color = _converter(doc, image, bits, limits)
    mask = _mask_plane(doc, image)
    for at, samples in _samples(data, width, height, n, bits, step):
        rgb = np.rint(np.clip(color(samples), 0, 1) * 255).astype(np.uint8)
        yield at, np.dstack([rgb, _alpha(doc, image, samples, mask, at, height)])


def decode_image(doc: Document, image: Stream) -> np.ndarray:
    """The whole image, shape (height, width, 4)."""
    return np.concatenate([band for _, band in image_bands(doc, image)])


def _samples(data: bytes, width: int, height: int, components: int, bits: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    row = (width * components * bits + 7) // 8
    if len(data) < row * height:
        raise PdfError("image data end early")
    for at in range(0, height, step):
        rows = min(step, height - at)
        yield at, unpacked(memoryview(data)[at * row : (at + rows) * row], width, rows, components, bits)


def _converter(doc: Document, image: Stream, bits: int, limits: list[float]) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """Components of a sample, and the conversion of samples to RGB in [0, 1]."""
    held = doc.resolve(image.dict.get("ColorSpace", Name("DeviceGray")))
    top = (1 << bits) - 1
    if isinstance(held, list) and doc.resolve(held[0]) in ("Separation", "DeviceN"):
        space = Space(doc, held)
        low, high = (np.array(limits[::2]), np.array(limits[1::2])) if limits else (np.zeros(space.n), np.ones(space.n))
        return space.n, lambda samples: _tinted(space, samples, low, high, top)
    family, n, own = _space(doc, image.dict.get("ColorSpace", Name("DeviceGray")))
    if family == "Indexed":
        base, m, _ = _space(doc, own[1])
        table = doc.decoded(own[3]) if isinstance(own[3], Stream) else own[3]
        palette = to_rgb(np.frombuffer(table, np.uint8)[: (own[2] + 1) * m].reshape(1, -1, m) / 255, base)[0]
        place = lambda s: s if not limits else np.rint(limits[0] + s * (limits[1] - limits[0]) / top).astype(np.int64)
        return n, lambda samples: palette[np.clip(place(samples[..., 0]), 0, len(palette) - 1)]
    if not limits:
        limits = [0.0, 100.0, -100.0, 100.0, -100.0, 100.0] if family == "Lab" else [0.0, 1.0] * n
    low, high = np.array(limits[::2]), np.array(limits[1::2])
    return n, lambda samples: to_rgb(low + samples * (high - low) / top, family)


def _tinted(space: Space, samples: np.ndarray, low: np.ndarray, high: np.ndarray, top: int) -> np.ndarray:
    """Samples of named colorants, each distinct tint of a band converted once."""
    kinds, at = np.unique(samples.reshape(-1, space.n), axis=0, return_inverse=True)
    tints = low + kinds * (high - low) / top
    return np.array([space.rgb([float(v) for v in t]) for t in tints])[at.reshape(-1)].reshape(*samples.shape[:2], 3)


def _mask_plane(doc: Document, image: Stream) -> np.ndarray | None:
    """The soft mask's, or else the stencil mask's, opacity, one byte a pixel of the mask."""
    mask = doc.get(image, "SMask", Stream) or doc.get(image, "Mask", Stream)
    if mask is None:
        return None
    stencil = doc.get(mask, "ImageMask", bool, False)
    return np.concatenate([255 - band[..., 3] if stencil else band[..., 0] for _, band in image_bands(doc, mask)])


def _alpha(doc: Document, image: Stream, samples: np.ndarray, mask: np.ndarray | None, at: int, height: int) -> np.ndarray:
    """Opacity of a band: a soft mask beats a stencil mask, which beats a colour key."""
    rows, width = samples.shape[:2]
    if mask is not None:
        held = mask[np.arange(at, at + rows) * mask.shape[0] // height]
        return held[:, np.arange(width) * mask.shape[1] // width]
    if key := doc.get(image, "Mask", list):
        limits = np.array([doc.resolve(v) for v in key]).reshape(-1, 2)
        return np.where(((samples >= limits[:, 0]) & (samples <= limits[:, 1])).all(axis=2), 0, 255).astype(np.uint8)
    return np.full((rows, width), 255, np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of RGBA bytes in the smallest of gray, gray with alpha, RGB and RGBA that loses nothing."""
    gray = (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 1] == pixels[..., 2]).all()
    opaque = (pixels[..., 3] == 255).all()
    kind, held = (0, pixels[..., :1]) if gray and opaque else (4, pixels[..., [0, 3]]) if gray else (2, pixels[..., :3]) if opaque else (6, pixels)
    height, width, n = held.shape
    rows = np.ascontiguousarray(held).reshape(height, width * n)
    left = np.concatenate([rows[:, :n], rows[:, n:] - rows[:, :-n]], axis=1)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, width * n), np.uint8))
    cost = [np.abs(c.view(np.int8).astype(np.int16)).sum(axis=1) for c in (np.ascontiguousarray(rows), np.ascontiguousarray(left), np.ascontiguousarray(up))]
    best = np.argmin(cost, axis=0)
    chosen = np.choose(best[:, None], [rows, left, up]).astype(np.uint8)
    body = np.concatenate([best[:, None].astype(np.uint8), chosen], axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 9)) + chunk(b"IEND", b"")


def _cubic(source: int, target: int) -> np.ndarray:
    """Catmull-Rom weights of a reduction, one row for each target sample."""
    scale = source / target
    centre = (np.arange(target) + 0.5) * scale - 0.5
    x = np.abs(np.arange(source)[None, :] - centre[:, None]) / scale
    w = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Reduced by the larger of both ratios, sizes rounded up; never enlarged."""
    h, w = pixels.shape[:2]
    scale = max(width / w, height / h)
    if width <= 0 or height <= 0 or scale >= 1:
        return pixels
    across, down = _cubic(w, max(1, int(np.ceil(w * scale)))), _cubic(h, max(1, int(np.ceil(h * scale))))
    alpha = pixels[..., 3:].astype(np.float64)
    weighted = np.concatenate([pixels[..., :3] * (alpha / 255), alpha], axis=2)
    out = np.einsum("yh,hwc,xw->yxc", down, weighted, across, optimize=True)
    solid = np.clip(out[..., 3:], 0, 255)
    colour = np.divide(out[..., :3] * 255, solid, out=np.zeros_like(out[..., :3]), where=solid > 0)
    return np.rint(np.clip(np.concatenate([colour, solid], axis=2), 0, 255)).astype(np.uint8)


def is_photographic(pixels: np.ndarray) -> bool:
    """More than 32 gray levels and less than 5 % edges on a grid of at most 128 x 128 samples."""
    step = [max(1, -(-s // 128)) for s in pixels.shape[:2]]
    gray = (pixels[:: step[0], :: step[1], :3] @ np.array([0.3, 0.59, 0.11])).astype(np.int64)
    edges = (np.abs(np.diff(gray, axis=0)) > 64).sum() + (np.abs(np.diff(gray, axis=1)) > 64).sum()
    return len(np.unique(gray)) > 32 and edges < 0.05 * 2 * gray.size
