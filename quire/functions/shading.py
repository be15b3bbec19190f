"""Gradients, exponential, stitching and sampled functions, transfer and screens as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return y0 + (x - x0) * ((y1 - y0) / (x1 - x0))


def exponential(x: Column, c0: list[float], c1: list[float], n: float, domain: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    """Type 2: ``c0 + x^n (c1 - c0)``."""
    power = F.pow(clamp(x, *domain), F.lit(float(n)))
    return [a + power * (b - a) for a, b in zip(c0, c1, strict=True)]


def stitching(x: Column, bounds: list[float], encode: list[tuple[float, float]], parts: list, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Type 3: the part whose interval holds ``x``, with its own encoding; parts take and give one column."""
    x, edges = clamp(x, *domain), [domain[0], *bounds, domain[1]]
    out = None
    for k, (part, (e0, e1)) in enumerate(zip(parts, encode, strict=True)):
        value = part(interpolate(x, edges[k], edges[k + 1], e0, e1) if edges[k + 1] > edges[k] else F.lit(float(e0)))
        out = F.when(x < edges[k + 1], value) if out is None else out.when(x < edges[k + 1], value) if k + 1 < len(parts) else out.otherwise(value)
    return out if len(parts) > 1 else parts[0](interpolate(x, domain[0], domain[1], *encode[0]))


def sampled(x: Column, samples: list[float], domain: tuple[float, float] = (0.0, 1.0), spread: tuple[float, float] | None = None, decode: tuple[float, float] = (0.0, 1.0), bits: int = 8) -> Column:
    """Type 0 with one input and linear interpolation."""
    last = len(samples) - 1
    at = clamp(interpolate(clamp(x, *domain), *domain, *(spread or (0.0, float(last)))), 0, last)
    low = F.least(F.floor(at), F.lit(max(0, last - 1)))
    table = F.array(*[F.lit(float(s)) for s in samples])
    a, b = F.get(table, low.cast("int")), F.get(table, (low + F.lit(min(1, last))).cast("int"))
    return interpolate(a + (b - a) * (at - low), 0, 2**bits - 1, *decode)


def axial_position(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Parameter of a point along the axis."""
    dx, dy = x1 - x0, y1 - y0
    return ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)


def radial_position(x: Column, y: Column, c0: tuple[float, float, float], c1: tuple[float, float, float], extend: tuple[bool, bool] = (False, False)) -> Column:
    """The largest parameter whose circle passes through the point, with radius 0 or more and allowed by ``extend``."""
    (x0, y0, r0), (x1, y1, r1) = c0, c1
    dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
    a = dx * dx + dy * dy - dr * dr
    px, py = x - x0, y - y0
    b = px * dx + py * dy + r0 * dr
    c = px * px + py * py - r0 * r0
    if a == 0:
        roots = [F.try_divide(c, 2 * b)]
    else:
        root = F.sqrt(F.when(b * b - a * c >= 0, b * b - a * c))
        roots = [(b + root) / a, (b - root) / a]
    good = lambda s: F.when((r0 + s * dr >= 0) & ((s >= 0) | F.lit(extend[0])) & ((s <= 1) | F.lit(extend[1])), s)
    found = [good(s) for s in roots]
    return F.greatest(*found) if len(found) > 1 else found[0]


def screen_threshold(rank: Column, count: Column) -> Column:
    """Threshold of a rank (from 0) among ``count`` cell pixels, in 16 bits."""
    return F.ceil((rank + 1) * 65535 / count).cast("long")


def predictor_paeth(left: Column, above: Column, corner: Column) -> Column:
    guess = left + above - corner
    dl, da, dc = F.abs(guess - left), F.abs(guess - above), F.abs(guess - corner)
    return F.when((dl <= da) & (dl <= dc), left).when(da <= dc, above).otherwise(corner)


def packed_sample(data: Column, index: Column, bits: int) -> Column:
    """Sample ``index`` (from 0) of 1, 2, 4, 8 or 16 bits in a binary column."""
    at = F.floor(index * bits / 8).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")
    if bits == 16:
        return byte(at) * 256 + byte(at + 1)
    shift = 8 - bits - (index * bits) % 8
    return F.floor(byte(at) / F.pow(F.lit(2), shift)).cast("int") % (1 << bits)
