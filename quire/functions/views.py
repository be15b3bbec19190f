"""Destination views and CIE colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def view(mode: Column, target: dict[str, Column], page: Box, content: Box, width: Column, height: Column, current: dict[str, Column]) -> Column:
    """struct(left, top, zoom) that shows a destination in a viewport.

    ``target`` and ``current``: left, top, right, bottom, zoom (null keeps).
    """
    bounded = mode.isin("FitB", "FitBH", "FitBV")
    visible = (F.greatest(page[0], content[0]), F.greatest(page[1], content[1]), F.least(page[2], content[2]), F.least(page[3], content[3]))
    region = tuple(target[k] for k in ("left", "top", "right", "bottom"))
    box = tuple(F.when(bounded, v).when(mode == "FitR", r).otherwise(p) for v, r, p in zip(visible, region, page, strict=True))
    wide, high = box[2] - box[0], box[3] - box[1]
    across, down = F.try_divide(width, wide), F.try_divide(height, high)
    both = F.least(across, down)
    rows, columns, free = mode.isin("FitH", "FitBH"), mode.isin("FitV", "FitBV"), mode == "XYZ"
    zoom = F.when(free, F.coalesce(F.nullif(target["zoom"], F.lit(0.0)), current["zoom"])).when(rows, across).when(columns, down).otherwise(both)
    own = lambda k: F.coalesce(target[k], current[k])
    left = F.when(free | columns, own("left")).when(rows, box[0]).otherwise(box[0] + (wide - width / both) / 2)
    top = F.when(free | rows, own("top")).when(columns, box[1]).otherwise(box[1] + (high - height / both) / 2)
    return F.struct(left.alias("left"), top.alias("top"), zoom.alias("zoom"))


def constrained(position: Column, least: Column, most: Column, extent: Column) -> Column:
    """Centres a range that fits the extent, otherwise keeps the extent inside it."""
    centre = least + (most - least - extent) / 2
    return F.when(most - least <= extent, centre).otherwise(F.greatest(least, F.least(most - extent, position)))


def srgb(linear: Column) -> Column:
    """Gamma-encoded component, cut to [0, 1]."""
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear))
    return F.when(cut <= 0.0031308, 12.92 * cut).otherwise(1.055 * F.pow(cut, F.lit(1 / 2.4)) - 0.055)


#: XYZ (D65) to linear RGB.
_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
_D65 = (0.95047, 1.0, 1.08883)


def xyz_to_rgb(x: Column, y: Column, z: Column, white: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """sRGB of a tristimulus value, its white point scaled to D65."""
    scaled = [v * (d / w) for v, d, w in zip((x, y, z), _D65, white, strict=True)]
    return tuple(srgb(row[0] * scaled[0] + row[1] * scaled[1] + row[2] * scaled[2]) for row in _TO_RGB)


def cal_gray(a: Column, white: tuple[float, float, float], gamma: float = 1.0) -> tuple[Column, Column, Column]:
    level = F.pow(a, F.lit(float(gamma)))
    return xyz_to_rgb(level * white[0], level * white[1], level * white[2], white)


def cal_rgb(a: Column, b: Column, c: Column, white: tuple[float, float, float], gamma: tuple[float, float, float], matrix: tuple[float, ...]) -> tuple[Column, Column, Column]:
    """``matrix``: XYZ of A, then of B, then of C."""
    raised = [F.pow(v, F.lit(float(g))) for v, g in zip((a, b, c), gamma, strict=True)]
    return xyz_to_rgb(*[sum((raised[j] * matrix[3 * j + i] for j in range(1, 3)), raised[0] * matrix[i]) for i in range(3)], white)


def lab(lightness: Column, a: Column, b: Column, white: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    m = (lightness + 16) / 116
    stage = lambda x: F.when(x >= 6 / 29, x * x * x).otherwise((x - 4 / 29) * (108 / 841))
    return xyz_to_rgb(white[0] * stage(m + a / 500), white[1] * stage(m), white[2] * stage(m - b / 200), white)


def indexed(value: Column, table: Column, components: int) -> Column:
    """Components of an entry of a binary palette, in [0, 1]."""
    entry = F.substring(table, (value * components + 1).cast("int"), F.lit(components))
    byte = lambda i: F.conv(F.hex(F.substring(entry, i + 1, 1)), 16, 10).cast("double") / 255
    return F.array(*[byte(i) for i in range(components)])


def rendering_intent(name: Column) -> Column:
    """Unknown intents count as relative colorimetric."""
    return F.when(name.isin("AbsoluteColorimetric", "RelativeColorimetric", "Saturation", "Perceptual"), name).otherwise("RelativeColorimetric")
