"""Matrices, points and rectangles of page space as column expressions.

A matrix is six numbers ``(a, b, c, d, e, f)`` mapping ``(x, y)`` to
``(a x + c y + e, b x + d y + f)``; here a tuple of columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = tuple[Column, Column, Column, Column, Column, Column]


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies ``n`` first, then ``m``."""
    a, b, c, d, e, f = m
    return (
        a * n[0] + c * n[1],
        b * n[0] + d * n[1],
        a * n[2] + c * n[3],
        b * n[2] + d * n[3],
        a * n[4] + c * n[5] + e,
        b * n[4] + d * n[5] + f,
    )


def apply(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def determinant(m: Matrix) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def inverse(m: Matrix) -> Matrix:
    """Null where the matrix is singular."""
    a, b, c, d, e, f = m
    over = lambda v: F.try_divide(v, determinant(m))
    return over(d), over(-b), over(-c), over(a), over(c * f - d * e), over(b * e - a * f)


def max_scale(m: Matrix) -> Column:
    """The larger singular value of the linear part."""
    a, b, c, d, _, _ = m
    half = (a * a + b * b + c * c + d * d) / 2
    det = determinant(m)
    return F.sqrt(half + F.sqrt(F.greatest(F.lit(0.0), half * half - det * det)))


def bounds(m: Matrix, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """Bounding box of a transformed rectangle."""
    corners = [apply(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)
