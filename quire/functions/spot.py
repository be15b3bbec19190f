"""Halftone spot functions on [-1, 1] x [-1, 1] as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TURN = 2 * math.pi


def _corner(x: Column, y: Column) -> Column:
    return (x - 1) * (x - 1) + (y - 1) * (y - 1) - 1


def _round(x: Column, y: Column) -> Column:
    x, y = F.abs(x), F.abs(y)
    return F.when(x + y <= 1, 1 - x * x - y * y).otherwise(_corner(x, y))


def _ellipse(x: Column, y: Column) -> Column:
    x, y = F.abs(x), F.abs(y)
    w, flat = 3 * x + 4 * y - 3, 0.75 * 0.75
    inside = 1 - (x * x + y * y / flat) / 4
    outside = ((1 - x) * (1 - x) + (1 - y) * (1 - y) / flat) / 4 - 1
    return F.when(w < 0, inside).when(w > 1, outside).otherwise(0.5 - w)


def _diamond(x: Column, y: Column) -> Column:
    x, y = F.abs(x), F.abs(y)
    return F.when(x + y <= 0.75, 1 - x * x - y * y).when(x + y <= 1.23, 1 - 0.85 * x - y).otherwise(_corner(x, y))


def _waves(fx: float, fy: float, wave: Callable[[Column], Column], x: Column, y: Column) -> Column:
    return (wave(fx * x) + wave(fy * y)) / 2


#: The standard spot functions by name.
SPOTS: dict[str, Callable[[Column, Column], Column]] = {
    "SimpleDot": lambda x, y: 1 - x * x - y * y,
    "InvertedSimpleDot": lambda x, y: x * x + y * y - 1,
    "DoubleDot": lambda x, y: _waves(_TURN, _TURN, F.sin, x, y),
    "InvertedDoubleDot": lambda x, y: -_waves(_TURN, _TURN, F.sin, x, y),
    "CosineDot": lambda x, y: _waves(math.pi, math.pi, F.cos, x, y),
    "Double": lambda x, y: _waves(math.pi, _TURN, F.sin, x, y),
    "InvertedDouble": lambda x, y: -_waves(math.pi, _TURN, F.sin, x, y),
    "Line": lambda x, y: -F.abs(y),
    "LineX": lambda x, y: x,
    "LineY": lambda x, y: y,
    "Round": _round,
    "Ellipse": _ellipse,
    "EllipseA": lambda x, y: 1 - x * x - 0.9 * y * y,
    "InvertedEllipseA": lambda x, y: x * x + 0.9 * y * y - 1,
    "EllipseB": lambda x, y: 1 - F.sqrt(x * x + 5 * y * y / 8),
    "EllipseC": lambda x, y: 1 - 0.9 * x * x - y * y,
    "InvertedEllipseC": lambda x, y: 0.9 * x * x + y * y - 1,
    "Square": lambda x, y: -F.greatest(F.abs(x), F.abs(y)),
    "Cross": lambda x, y: -F.least(F.abs(x), F.abs(y)),
    "Rhomboid": lambda x, y: (0.9 * F.abs(x) + F.abs(y)) / 2,
    "Diamond": _diamond,
}


def spot(name: str, x: Column, y: Column) -> Column:
    """Arguments and result are cut to [-1, 1]."""
    cut = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    return cut(SPOTS[name](cut(x), cut(y)))
