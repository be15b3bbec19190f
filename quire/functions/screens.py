"""Threshold screens and transfer functions, on numbers, arrays and columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_at(data: bytes, width: int, height: int, x: Column, y: Column) -> Column:
    """The threshold (1 to 65535) of a device pixel: a rectangle of 8-bit thresholds that repeats in both directions."""
    held = F.array(*[F.lit(max(1, v * 257)) for v in data[: width * height]])
    return F.get(held, (F.pmod(y, F.lit(height)) * width + F.pmod(x, F.lit(width))).cast("int"))


def quantised(value: Column, threshold: Column, levels: int) -> Column:
    """Output level of a 16-bit value: the next level is reached where the share beyond the last one passes the threshold."""
    scaled = value.cast("long") * levels
    rest = scaled % 65535
    reached = (rest >= threshold) & (rest > 0)
    return F.least(F.lit(levels), F.floor(scaled / 65535) + reached.cast("int"))


def apply_transfer(values: Sequence, model: str, functions: Sequence[Callable], source: str = ""):
    """Device components through their channel's function, cut to [0, 1].

    Subtractive components are evaluated on complements; gray uses the fourth
    channel; a gray source on CMYK leaves the first three alone. Works on
    numbers, arrays and columns whose functions do.
    """
    wanted = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}[model]
    if len(values) != wanted:
        raise ValueError("a wrong number of components")
    out = []
    for i, value in enumerate(values):
        if model == "DeviceCMYK" and source == "DeviceGray" and i < 3:
            out.append(value)
            continue
        own = functions[3 if model == "DeviceGray" else i]
        out.append(1 - own(1 - value) if model == "DeviceCMYK" else own(value))
    return out
