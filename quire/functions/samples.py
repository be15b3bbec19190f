"""Sampled functions of any number of inputs as columns: gathers from a table with tensor weights.

An input point lies in a cell of the grid; its value is a weighted sum of the cell's
corners (two a dimension), or for order 3 of four points a dimension on a cubic that
goes on in a straight line beyond the ends. The weights of a point are the products of
those of its dimensions, so the work grows with the corners and the expression does not. Places
are columns; a literal table's corners are summed by numpy, a batch of rows at a time.

Up to ``LITERAL`` values the table is a literal of the plan. A larger one (a colour
profile's, say) is a table: each point's corners are joined with it (``sampled_by_table``).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.shading import clamp, interpolate
from quire.operators.scans import let

#: Most sample values that are put into a plan.
LITERAL = 4096
CORNER = "struct<at:bigint,w:double>"


def _corner(at: Column, w: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), w.cast("double").alias("w"))


def _along(at: Column, size: int, cubic: bool) -> Column:
    """array of (index, weight) along one dimension of ``size`` samples, for a place from 0 to size - 1."""
    if size == 1:
        return F.array(_corner(F.lit(0), F.lit(1.0)))
    low = F.least(F.floor(at), F.lit(size - 2))

    def linear(x: Column) -> Column:
        return F.array(_corner(x["low"], 1 - x["t"]), _corner(x["low"] + 1, x["t"]))

    def spline(x: Column) -> Column:
        i, t = x["low"], x["t"]
        a, d = -t / 2 + t * t - t * t * t / 2, -t * t / 2 + t * t * t / 2
        b, c = 1 - 2.5 * t * t + 1.5 * t * t * t, t / 2 + 2 * t * t - 1.5 * t * t * t
        first, last = i == 0, i == size - 2
        # a sample before the first is twice the first less the second, and likewise behind the last
        b_all = b + F.when(first, 2 * a).otherwise(0.0) - F.when(last, d).otherwise(0.0)
        c_all = c - F.when(first, a).otherwise(0.0) + F.when(last, 2 * d).otherwise(0.0)
        return F.array(
            _corner(F.greatest(i - 1, F.lit(0)), F.when(first, 0.0).otherwise(a)), _corner(i, b_all), _corner(i + 1, c_all), _corner(F.least(i + 2, F.lit(size - 1)), F.when(last, 0.0).otherwise(d))
        )

    return let(F.struct(low.cast("bigint").alias("low"), (at - low).alias("t")), spline if cubic and size >= 4 else linear)


def _placed(place: Column, size: int, cubic: bool) -> Column:
    return let(place, lambda at: _along(at, size, cubic))


def _crossed(some: Column, more: Column, stride: int) -> Column:
    """Every corner of the dimensions so far with every one of the next."""
    both = F.struct(some.alias("a"), more.alias("b"))
    return let(both, lambda z: F.flatten(F.transform(z["a"], lambda p: F.transform(z["b"], lambda q: _corner(p["at"] + q["at"] * stride, p["w"] * q["w"])))))


def _places(inputs: list[Column], sizes: list[int], domain: list[float], encode: list[float] | None) -> list[Column]:
    """Where a point lies along each dimension, from 0 to size - 1."""
    encode = encode or [v for s in sizes for v in (0.0, s - 1.0)]
    out = []
    for i, (x, size) in enumerate(zip(inputs, sizes, strict=True)):
        d0, d1, e0, e1 = *domain[2 * i : 2 * i + 2], *encode[2 * i : 2 * i + 2]
        out.append(clamp(interpolate(clamp(x.cast("double"), d0, d1), d0, d1, e0, e1) if d1 > d0 else F.lit(float(e0)), 0, size - 1))
    return out


def corners(inputs: list[Column], sizes: list[int], domain: list[float], encode: list[float] | None = None, order: int = 1) -> Column:
    """array of (at, w): the samples a point is made of, by their number in the table (the first input varies fastest), and their weights."""
    out, stride = None, 1
    for place, size in zip(_places(inputs, sizes, domain, encode), sizes, strict=True):
        own = _placed(place, size, order == 3)
        out = own if out is None else _crossed(out, own, stride)
        stride *= size
    return out


def _weights(at: np.ndarray, size: int, cubic: bool) -> list[tuple[np.ndarray | int, np.ndarray | float]]:
    """(index, weight) of each corner along one dimension, as ``_along`` has them, for a batch of places."""
    if size == 1:
        return [(0, 1.0)]
    low = np.minimum(np.floor(at), size - 2).astype(np.int64)
    t = at - low
    if not (cubic and size >= 4):
        return [(low, 1 - t), (low + 1, t)]
    a, d = -t / 2 + t * t - t * t * t / 2, -t * t / 2 + t * t * t / 2
    b, c = 1 - 2.5 * t * t + 1.5 * t * t * t, t / 2 + 2 * t * t - 1.5 * t * t * t
    first, last = low == 0, low == size - 2
    b_all = b + np.where(first, 2 * a, 0.0) - np.where(last, d, 0.0)
    c_all = c - np.where(first, a, 0.0) + np.where(last, 2 * d, 0.0)
    return [(np.maximum(low - 1, 0), np.where(first, 0.0, a)), (low, b_all), (low + 1, c_all), (np.minimum(low + 2, size - 1), np.where(last, 0.0, d))]


def _summed(places: list[Column], sizes: list[int], samples: np.ndarray, cubic: bool) -> Column:
    """The weighted sum of the corners of every point, in the order of ``corners``."""
    strides = [math.prod(sizes[:i]) for i in range(len(sizes))]

    @F.pandas_udf("double")
    def run(*at: pd.Series) -> pd.Series:
        own = [_weights(x.to_numpy(dtype=np.float64), size, cubic) for x, size in zip(at, sizes, strict=True)]
        total = np.zeros(len(at[0]))
        for met in itertools.product(*own):
            where, weight = 0, 1.0
            for (index, w), stride in zip(met, strides, strict=True):
                where, weight = where + index * stride, weight * w
            total += weight * samples[where]
        return pd.Series(total)

    return run(*places)


def decoded(value: Column, bits: int, low: float, high: float, bounds: tuple[float, float] | None = None) -> Column:
    """A sum of samples in the function's range."""
    y = low + value * ((high - low) / (2**bits - 1))
    return F.when(y.isNotNull(), clamp(y, *bounds)) if bounds else y


def sampled(inputs: list[Column], sizes: list[int], samples: list[int], outputs: int, domain: list[float], bounds: list[float], bits: int = 8, encode: list[float] | None = None, decode: list[float] | None = None, order: int = 1) -> list[Column]:
    """A type 0 function's outputs. ``samples``: whole numbers of ``bits``, a point's outputs together, the first input varying fastest.

    A null input gives null outputs. More than ``LITERAL`` samples are an error: see
    ``sampled_by_table``.
    """
    if len(samples) < math.prod(sizes) * outputs:
        raise ValueError("too few samples")
    if len(samples) > LITERAL:
        raise ValueError(f"{len(samples)} samples are no literal: use sampled_by_table")
    decode = decode or bounds
    table = np.array(samples, dtype=np.float64)
    known = F.lit(True)
    for x in inputs:
        known = known & x.isNotNull()
    # a null place would reach the batch as a NaN
    places = [F.coalesce(p, F.lit(0.0)) for p in _places(inputs, sizes, domain, encode)]

    def output(j: int) -> Column:
        total = F.when(known, _summed(places, sizes, table[j::outputs], order == 3))
        return decoded(total, bits, *decode[2 * j : 2 * j + 2], tuple(bounds[2 * j : 2 * j + 2]))

    return [output(j) for j in range(outputs)]


def sampled_by_table(rows: DataFrame, key: list[str], inputs: list[Column], sizes: list[int], table: DataFrame, names: list[str], domain: list[float], bounds: list[float], bits: int = 8, encode: list[float] | None = None, decode: list[float] | None = None, order: int = 1) -> DataFrame:
    """``rows`` with the outputs of a function whose samples are a table, as columns ``names``.

    ``key``: columns that tell rows apart. ``table``: at (a sample's number) and values
    (its outputs). Points that lie at one place are looked up once, corner by corner;
    a missing sample counts as 0; a row with a null input has null outputs.
    """
    decode = decode or bounds
    coded = [f"_x{i}" for i in range(len(inputs))]
    held = rows.select("*", *[x.cast("double").alias(c) for x, c in zip(inputs, coded, strict=True)])
    points = held.select(*coded).dropna().distinct()
    parts = points.select(*coded, F.explode(corners([F.col(c) for c in coded], sizes, domain, encode, order)).alias("_c"))
    met = parts.join(table.select(F.col("at").alias("_at"), F.col("values").alias("_v")), F.col("_c.at") == F.col("_at"))
    sums = met.groupBy(*coded).agg(*[F.sum(F.col("_c.w") * F.get("_v", F.lit(j))).alias(f"_y{j}") for j in range(len(names))])
    done = held.join(sums, coded, "left")
    return done.select(*rows.columns, *[decoded(F.col(f"_y{j}"), bits, *decode[2 * j : 2 * j + 2], tuple(bounds[2 * j : 2 * j + 2])).alias(n) for j, n in enumerate(names)])
