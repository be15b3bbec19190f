"""Scalar functions against hand values and against each other."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import blend, calculator, filters, geometry, labels, shading
from quire.functions.dates import parse_date
from quire.functions.spot import spot


def value(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(*values):
    return tuple(F.lit(float(v)) for v in values)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_filters_round_trip(data):
    assert filters.flate_decode(filters.flate_encode(data)) == data
    assert filters.ascii85_decode(filters.ascii85_encode(data)) == data
    assert filters.run_length_decode(filters.run_length_encode(data)) == data
    assert filters.ascii_hex_decode(data.hex().encode() + b">") == data
    for early in (0, 1):
        assert filters.lzw_decode(filters.lzw_encode(data, early), early) == data


def test_lzw_spans_all_widths():
    data = bytes((i * i) % 251 for i in range(60_000))
    assert filters.lzw_decode(filters.lzw_encode(data)) == data


@pytest.mark.parametrize("data", [b"abc", b"!~>", b"zzz!z~>", b"s8W-\"~>"])
def test_bad_base85(data):
    with pytest.raises(filters.FilterError):
        filters.ascii85_decode(data)


def test_ends_are_required():
    for decode, data in ((filters.run_length_decode, b"\x01ab"), (filters.lzw_decode, b"\x80"), (filters.flate_decode, filters.flate_encode(b"x" * 99)[:-6])):
        with pytest.raises(filters.FilterError):
            decode(data)
    assert filters.flate_decode(filters.flate_encode(b"x" * 99)[:-4], lenient=True) == b"x" * 99


def test_chains_and_aliases():
    packed = filters.ascii85_encode(filters.flate_encode(b"hello"))
    assert filters.decode(packed, ["A85", "Fl"], [{}, {}]) == (b"hello", None)
    assert filters.decode(b"jpeg", ["DCT"], [{}]) == (b"jpeg", "DCTDecode")
    with pytest.raises(filters.FilterError):
        filters.decode(b"", ["DCT", "Fl"], [{}, {}])


def test_predictors():
    rows = bytes([0, 10, 20, 30, 1, 10, 10, 10, 2, 1, 1, 1, 3, 10, 10, 10, 4, 5, 5, 5])
    assert list(filters.undo_predictor(rows, 15, 1, 8, 3)) == [10, 20, 30, 10, 20, 30, 11, 21, 31, 15, 28, 39, 20, 33, 44]
    assert list(filters.undo_predictor(bytes([1, 2, 3, 1, 1, 1]), 2, 3, 8, 2)) == [1, 2, 3, 2, 3, 4]
    assert filters.undo_predictor(bytes([0b01010101]), 2, 1, 2, 4) == bytes([0b01101100])
    assert filters.undo_predictor(b"\0\1\0\2", 2, 1, 16, 2) == b"\0\1\0\3"
    assert filters.paeth(10, 20, 10) == 20 and filters.paeth(5, 5, 5) == 5


@given(st.text(max_size=200).filter(lambda t: "\x1b" not in t))
@settings(max_examples=200, deadline=None)
def test_text_strings_round_trip(text):
    assert filters.decode_text(filters.encode_text(text)) == text


def test_document_encoding():
    assert filters.decode_text(b"\x80\x92\xa0") == "•™€"
    assert filters.decode_text(b"\xef\xbb\xbf\xc3\xa9") == "é"


def test_geometry(spark):
    m, n = lits(2, 1, -1, 3, 5, 7), lits(0.5, 0, 0, 4, 1, -2)
    x, y = geometry.apply(geometry.multiply(m, n), F.lit(3.0), F.lit(4.0))
    inner = geometry.apply(m, *geometry.apply(n, F.lit(3.0), F.lit(4.0)))
    back = geometry.apply(geometry.inverse(m), *geometry.apply(m, F.lit(3.0), F.lit(4.0)))
    r = value(spark, x, y, *inner, *back, geometry.max_scale(lits(3, 0, 0, 4, 9, 9)), geometry.inverse(lits(1, 2, 2, 4, 0, 0))[0])
    assert r[0] == pytest.approx(r[2]) and r[1] == pytest.approx(r[3])
    assert (r[4], r[5]) == (pytest.approx(3), pytest.approx(4))
    assert r[6] == pytest.approx(4) and r[7] is None


@pytest.mark.parametrize("mode", [*blend.SEPARABLE])
def test_blends_stay_in_range(spark, mode):
    grid = spark.range(36).select((F.floor(F.col("id") / 6) / 5).alias("b"), (F.col("id") % 6 / 5).alias("s"))
    for r in grid.select(blend.blend(mode, F.col("b"), F.col("s"))).collect():
        assert -1e-9 <= r[0] <= 1 + 1e-9


def test_nonseparable_blends_keep_luminosity(spark):
    b, s = lits(0.2, 0.5, 0.7), lits(0.9, 0.1, 0.3)
    for mode, like in (("Hue", b), ("Saturation", b), ("Color", b), ("Luminosity", s)):
        out = blend.NONSEPARABLE[mode](b, s)
        r = value(spark, blend.luminosity_rgb(out), blend.luminosity_rgb(like))
        assert r[0] == pytest.approx(r[1])
    k = blend.blend_cmyk("Luminosity", (*b, F.lit(0.4)), (*s, F.lit(0.6)))
    assert value(spark, k[3], blend.blend_gray("Hue", F.lit(0.3), F.lit(0.8)))[:] == (0.6, 0.3)


def test_spots_and_labels(spark):
    r = value(spark, spot("Round", F.lit(0.0), F.lit(0.0)), spot("Diamond", F.lit(1.0), F.lit(1.0)), spot("LineX", F.lit(9.0), F.lit(0.0)))
    assert r[:] == (1.0, -1.0, 1.0)
    show = lambda style, n: labels.page_label(F.lit(style), F.lit("p"), F.lit(n))
    assert value(spark, show("R", 4994), show("r", 49), show("A", 26), show("a", 53), show("D", 7), show(None, 7))[:] == ("pMMMMCMXCIV", "pxlix", "pZ", "paaa", "p7", "p")


@pytest.mark.parametrize(
    ("text", "want"),
    [("D:2024", "2024-01-01 00:00:00"), ("D:20240229", "2024-02-29 00:00:00"), ("D:20230229", None), ("D:20240101120000+01'30'", "2024-01-01 10:30:00"), ("D:20240101120000-01", "2024-01-01 13:00:00"),
     ("D:20240101Z00'00'", "2024-01-01 00:00:00"), ("D:20240101Z01'00'", None), ("2024", None), ("D:202413", None), ("D:2024010112000", None), ("D:20240101+24'00", None)],
)
def test_dates(spark, text, want):
    got = value(spark, parse_date(F.lit(text))["ts"].cast("string"))[0]
    assert got == want


PROGRAMS = [
    ("{ add 2 div }", [3, 5], [4]), ("{ exch sub }", [3, 5], [2]), ("{ dup mul exch }", [3, 5], [25, 3]), ("{ 2 copy gt { exch } if pop }", [9, 5], [5]),
    ("{ 3 1 roll }", [1, 2, 3], [3, 1, 2]), ("{ 1 index }", [1, 2], [1, 2, 1]), ("{ cvi 4 mod }", [-7], [-3]), ("{ cvi 2 idiv }", [-7], [-3]), ("{ round }", [-2.5], [-2]),
    ("{ truncate }", [-2.5], [-2]), ("{ 90 mul sin }", [1], [1]), ("{ 1 atan }", [-1], [315]), ("{ pop 1 3 bitshift }", [0], [8]), ("{ 0.5 lt { 1 } { 2.5 } ifelse }", [0.7], [2.5]),
    ("{ cvi 12 and }", [10], [8]), ("{ cvi not }", [5], [-6]), ("{ 100 exch exp log }", [2], [4]),
]


@pytest.mark.parametrize(("text", "inputs", "want"), PROGRAMS)
def test_calculator(spark, text, inputs, want):
    program = calculator.parse(text)
    assert calculator.evaluate(program, inputs) == pytest.approx(want)
    columns = calculator.compile_columns(program, list(lits(*inputs)))
    assert list(value(spark, *columns)) == pytest.approx(want)


@pytest.mark.parametrize("text", ["{ 0 div }", "{ add }", "{ true add }", "{ 1.5 2 idiv }", "{ pop 0 0 atan }", "{ -1 sqrt add }", "{ 5 index }"])
def test_calculator_faults(text):
    with pytest.raises(calculator.CalculatorError):
        calculator.evaluate(calculator.parse(text), [1.0])
    with pytest.raises(calculator.CalculatorError):
        calculator.parse("{ 1")


def test_function_types(spark):
    x = F.lit(0.25)
    r = value(
        spark, shading.exponential(x, [0.0, 1.0], [1.0, 0.0], 2)[1], shading.stitching(x, [0.5], [(0, 1), (1, 0)], [lambda v: v, lambda v: v]), shading.sampled(x, [0, 255, 0]),
        shading.axial_position(F.lit(1.0), F.lit(9.0), 0, 0, 4, 0), shading.radial_position(F.lit(0.0), F.lit(3.0), (0, 0, 1), (0, 0, 5)), shading.radial_position(F.lit(0.0), F.lit(9.0), (0, 0, 1), (0, 0, 5)),
    )
    assert r[:5] == (pytest.approx(0.9375), pytest.approx(0.5), pytest.approx(0.5), pytest.approx(0.25), pytest.approx(0.5)) and r[5] is None
    bits = F.unhex(F.lit("1B2C"))
    assert value(spark, *[shading.packed_sample(bits, F.lit(i), n) for i, n in ((0, 4), (1, 4), (3, 2), (0, 1), (3, 1), (1, 8), (0, 16))])[:] == (1, 11, 3, 0, 1, 0x2C, 0x1B2C)
    assert math.isclose(value(spark, shading.predictor_paeth(F.lit(10), F.lit(20), F.lit(10)))[0], 20)


def test_rows_undone_together_equal_single_rows(monkeypatch):
    import numpy as np

    from quire.functions import filters

    rng = np.random.default_rng(6)
    for colors, columns in ((1, 7), (3, 11), (4, 5)):
        row = colors * columns
        data = rng.integers(0, 256, (60, row + 1)).astype(np.uint8)
        data[:, 0] = rng.choice([0, 1, 2, 3, 4, 3, 4, 4, 4], 60)
        data[20:50, 0] = rng.choice([3, 4], 30)
        together = filters.undo_predictor(data.tobytes(), 15, colors, 8, columns)
        monkeypatch.setattr(filters, "WAVE_ROWS", 10**9)
        assert filters.undo_predictor(data.tobytes(), 15, colors, 8, columns) == together
        monkeypatch.undo()
