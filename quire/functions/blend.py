"""Blend modes, alpha composition and device colour conversion as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _soft_light(b: Column, s: Column) -> Column:
    bright = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (bright - b))


def _hard_light(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, 2 * b * s).otherwise(1 - 2 * (1 - b) * (1 - s))


def _dodge(b: Column, s: Column) -> Column:
    return F.when(b == 0, 0.0).when(s == 1, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(b, 1 - s)))


def _burn(b: Column, s: Column) -> Column:
    return F.when(b == 1, 1.0).when(s == 0, 0.0).otherwise(1 - F.least(F.lit(1.0), F.try_divide(1 - b, s)))


#: Separable modes: result for backdrop ``b`` and source ``s``.
SEPARABLE: dict[str, Callable[[Column, Column], Column]] = {
    "Normal": lambda b, s: s,
    "Compatible": lambda b, s: s,
    "Multiply": lambda b, s: b * s,
    "Screen": lambda b, s: b + s - b * s,
    "Overlay": lambda b, s: _hard_light(s, b),
    "Darken": lambda b, s: F.least(b, s),
    "Lighten": lambda b, s: F.greatest(b, s),
    "ColorDodge": _dodge,
    "ColorBurn": _burn,
    "HardLight": _hard_light,
    "SoftLight": _soft_light,
    "Difference": lambda b, s: F.abs(b - s),
    "Exclusion": lambda b, s: b + s - 2 * b * s,
}

RGB = tuple[Column, Column, Column]


def luminosity_rgb(c: RGB) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def luminosity_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    return (0.3 * (1 - c) + 0.59 * (1 - m) + 0.11 * (1 - y)) * (1 - k)


def saturation(c: RGB) -> Column:
    return F.greatest(*c) - F.least(*c)


def _clip_color(c: RGB) -> RGB:
    """Moves out-of-range components towards the luminosity."""
    lum, low, high = luminosity_rgb(c), F.least(*c), F.greatest(*c)
    lifted = lambda x: F.when(low < 0, lum + F.try_divide((x - lum) * lum, lum - low)).otherwise(x)
    cut = lambda x: F.when(high > 1, lum + F.try_divide((lifted(x) - lum) * (1 - lum), high - lum)).otherwise(lifted(x))
    return cut(c[0]), cut(c[1]), cut(c[2])


def set_luminosity(c: RGB, lum: Column) -> RGB:
    d = lum - luminosity_rgb(c)
    return _clip_color((c[0] + d, c[1] + d, c[2] + d))


def set_saturation(c: RGB, sat: Column) -> RGB:
    """Stretches the components so that least and greatest are 0 and ``sat``."""
    low, spread = F.least(*c), saturation(c)
    scaled = lambda x: F.when(spread == 0, 0.0).otherwise(F.try_divide((x - low) * sat, spread))
    return scaled(c[0]), scaled(c[1]), scaled(c[2])


#: Non-separable modes on RGB.
NONSEPARABLE: dict[str, Callable[[RGB, RGB], RGB]] = {
    "Hue": lambda b, s: set_luminosity(set_saturation(s, saturation(b)), luminosity_rgb(b)),
    "Saturation": lambda b, s: set_luminosity(set_saturation(b, saturation(s)), luminosity_rgb(b)),
    "Color": lambda b, s: set_luminosity(s, luminosity_rgb(b)),
    "Luminosity": lambda b, s: set_luminosity(b, luminosity_rgb(s)),
}


def blend(mode: str, b: Column, s: Column) -> Column:
    return SEPARABLE[mode or "Normal"](b, s)


def blend_cmyk(mode: str, b: tuple[Column, ...], s: tuple[Column, ...]) -> tuple[Column, ...]:
    """CMYK is blended on complements; black of non-separable modes is the backdrop's, of Luminosity the source's."""
    if mode in NONSEPARABLE:
        rgb = NONSEPARABLE[mode](tuple(1 - x for x in b[:3]), tuple(1 - x for x in s[:3]))
        return (*(1 - x for x in rgb), s[3] if mode == "Luminosity" else b[3])
    return tuple(1 - blend(mode, 1 - x, 1 - y) for x, y in zip(b, s, strict=True))


def blend_gray(mode: str, b: Column, s: Column) -> Column:
    if mode in NONSEPARABLE:
        return s if mode == "Luminosity" else b
    return blend(mode, b, s)


def union_alpha(backdrop: Column, source: Column) -> Column:
    return source + backdrop * (1 - source)


def composite(mode: str, b: Column, b_alpha: Column, s: Column, s_alpha: Column) -> Column:
    """Component of the result of painting ``s`` over ``b``, cut to [0, 1]; 0 where both are clear."""
    mixed = (1 - b_alpha) * s + b_alpha * blend(mode, b, s)
    alpha = union_alpha(b_alpha, s_alpha)
    over = F.try_divide((1 - s_alpha) * b_alpha * b + s_alpha * mixed, alpha)
    return F.when(alpha == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), over)))


def rgb_to_gray(c: RGB) -> Column:
    return luminosity_rgb(c)


def gray_to_rgb(v: Column) -> RGB:
    return v, v, v


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> RGB:
    """Device conversion by complements (no profile)."""
    return tuple(1 - F.least(F.lit(1.0), x + k) for x in (c, m, y))


def rgb_to_cmyk(c: RGB, black: Callable[[Column], Column] | None = None, removal: Callable[[Column], Column] | None = None) -> tuple[Column, ...]:
    """Black generation and undercolour removal default to identity."""
    same = lambda k: k
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    k = 1 - F.greatest(*c)
    return (*(clip(1 - x - (removal or same)(k)) for x in c), clip((black or same)(k)))
