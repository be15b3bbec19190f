"""Page label text as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits of units, tens and hundreds.
ROMAN = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
)


def roman(n: Column) -> Column:
    """Capital Roman numeral; thousands repeat M without end."""
    digit = lambda place: F.element_at(F.array(*map(F.lit, ROMAN[place])), (F.floor(n / 10**place) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(2), digit(1), digit(0))


def letters(n: Column) -> Column:
    """A to Z, then AA to ZZ, and so on."""
    return F.repeat(F.char(65 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """Label number ``n`` in style D, R, r, A, a or none, after its prefix."""
    text = (
        F.when(style == "D", n.cast("string"))
        .when(style == "R", roman(n))
        .when(style == "r", F.lower(roman(n)))
        .when(style == "A", letters(n))
        .when(style == "a", F.lower(letters(n)))
        .otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), text)
