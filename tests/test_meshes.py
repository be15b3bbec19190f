"""Meshes against plain sequential reading and against looking at every triangle."""

import random

import pytest
from pyspark.sql import functions as F

VERTICES = "mesh long, ord long, flag int, x double, y double, color array<double>"


def corners(rows):
    return {(r["mesh"], r["ord"]): [(c["x"], c["y"], tuple(c["color"])) for c in r["corners"]] for r in rows}


def test_free_triangles_equal_reading_in_order(spark, monkeypatch):
    from quire.operators import scans
    from quire.operators.meshes import free_triangles

    monkeypatch.setattr(scans, "BLOCK", 4)
    rng = random.Random(1)
    meshes = {m: [(rng.choice([0, 1, 1, 2]), float(rng.randrange(50)), float(rng.randrange(50)), [float(i)]) for i in range(rng.choice([1, 2, 3, 40]))] for m in (1, 2, 3, 4, 5, None)}
    want = {}
    for m, vertices in meshes.items():
        begun, last = [], None
        for i, (flag, x, y, c) in enumerate(vertices):
            v = (x, y, tuple(c))
            if begun or flag == 0:
                begun.append(v)
                if len(begun) < 3:
                    continue
                last, begun = begun, []
            elif last is None:
                continue
            else:
                last = [last[1], last[2], v] if flag == 1 else [last[0], last[2], v]
            want[m, i] = list(last)
    df = spark.createDataFrame([(m, i, *v) for m, vs in meshes.items() for i, v in enumerate(vs)], VERTICES).repartition(3)
    assert corners(free_triangles(df, ["mesh"]).collect()) == want


def test_lattices(spark):
    from quire.operators.meshes import lattice_triangles

    width, n = 4, 14  # the last row is not whole
    df = spark.createDataFrame([(m, i, None, float(i % width), float(i // width), [float(i)]) for m in (1, None) for i in range(n)], VERTICES).repartition(3)
    found = corners(lattice_triangles(df, ["mesh"], F.lit(width)).collect())
    want = {}
    for m in (1, None):
        for i in range(n):
            if i % width < width - 1 and i + width + 1 < n:
                v = [(float(k % width), float(k // width), (float(k),)) for k in (i, i + 1, i + width, i + width + 1)]
                want[m, 2 * i], want[m, 2 * i + 1] = v[:3], v[1:]
    assert found == want


@pytest.mark.parametrize("tensor", [False, True])
def test_patches_equal_reading_in_order(spark, monkeypatch, tensor):
    from quire.operators import scans
    from quire.operators.meshes import BOUNDARY, EDGE_COLORS, EDGE_POINTS, INNER, patch_lattices, whole_patches

    monkeypatch.setattr(scans, "BLOCK", 3)
    rng = random.Random(tensor)
    rows, want = [], {}
    for mesh in (1, 2, None):
        last = None
        for i in range(12):
            flag = rng.choice([0, 1, 2, 3]) if i or mesh == 2 else 0
            points = [[rng.uniform(0, 9), rng.uniform(0, 9)] for _ in range((16 if tensor else 12) - (4 if flag else 0))]
            colors = [[rng.random(), rng.random()] for _ in range(2 if flag else 4)]
            rows.append((mesh, i, flag, points, colors))
            inner = points[-4:] if tensor else None
            outer = points[: len(points) - 4] if tensor else points
            if flag:
                if last is None:
                    continue
                outer = [last[0][k] for k in EDGE_POINTS[flag]] + outer
                colors = [last[1][k] for k in EDGE_COLORS[flag]] + colors
            last = outer, colors
            net = dict(zip(BOUNDARY, outer, strict=True))
            if tensor:
                net |= dict(zip(INNER, inner, strict=True))
            else:
                p = lambda a, b: net[a, b]  # noqa: B023, E731
                formula = lambda z, ws: sum(w * q[z] for w, q in ws) / 9
                made = {
                    (1, 1): [(-4, p(0, 0)), (6, p(0, 1)), (6, p(1, 0)), (-2, p(0, 3)), (-2, p(3, 0)), (3, p(3, 1)), (3, p(1, 3)), (-1, p(3, 3))],
                    (1, 2): [(-4, p(0, 3)), (6, p(0, 2)), (6, p(1, 3)), (-2, p(0, 0)), (-2, p(3, 3)), (3, p(3, 2)), (3, p(1, 0)), (-1, p(3, 0))],
                    (2, 1): [(-4, p(3, 0)), (6, p(3, 1)), (6, p(2, 0)), (-2, p(3, 3)), (-2, p(0, 0)), (3, p(0, 1)), (3, p(2, 3)), (-1, p(0, 3))],
                    (2, 2): [(-4, p(3, 3)), (6, p(3, 2)), (6, p(2, 3)), (-2, p(3, 0)), (-2, p(0, 3)), (3, p(0, 2)), (3, p(2, 0)), (-1, p(0, 0))],
                }
                net |= {cell: [formula(0, ws), formula(1, ws)] for cell, ws in made.items()}
            want[mesh, i] = [net[i, j] for j in range(4) for i in range(4)], colors
    df = spark.createDataFrame(rows, "mesh long, ord long, flag int, points array<array<double>>, colors array<array<double>>").repartition(3)
    patches = whole_patches(df, ["mesh"])
    found = {(r["mesh"], r["ord"]): r for r in patches.collect()}
    assert set(found) == set(want)
    for k, (net, colors) in want.items():
        assert [list(c) for c in found[k]["colors"]] == colors
        for a, b in zip(found[k]["net"], net, strict=True):
            assert list(a) == pytest.approx(b)
    grid = {(r["mesh"], r["patch"], r["ord"]): r for r in patch_lattices(patches, ["mesh"], 4).collect()}
    for (mesh, i), (net, colors) in want.items():
        for nth, (point, color) in {0: (net[0], colors[0]), 4: (net[3], colors[3]), 20: (net[12], colors[1]), 24: (net[15], colors[2])}.items():
            r = grid[mesh, i, nth]
            assert (r["x"], r["y"]) == pytest.approx(tuple(point)) and list(r["color"]) == pytest.approx(color)


def test_points_equal_looking_at_every_triangle(spark):
    from quire.operators.meshes import painted_points

    rng = random.Random(6)
    triangles = {(m, i): [(rng.uniform(0, 100) * s, rng.uniform(0, 100) * s, [rng.random()]) for s in [rng.choice([1, 1, 0.1])] for _ in range(3)] for m in (1, 2, None) for i in range(25)}
    triangles[1, 99] = [(5.0, 5.0, [0.0])] * 3
    points = [(i, rng.choice([1, 2, 3, None]), rng.uniform(-5, 100), rng.uniform(-5, 100)) for i in range(300)]
    df = spark.createDataFrame([(m, i, [{"x": x, "y": y, "color": c} for x, y, c in t]) for (m, i), t in triangles.items()], "mesh long, ord long, corners array<struct<x:double,y:double,color:array<double>>>")
    found = {r["id"]: r["color"] for r in painted_points(spark.createDataFrame(points, "id long, mesh long, x double, y double").repartition(3), df, ["mesh"], ["id"]).collect()}
    assert len(found) == len(points)
    for i, mesh, x, y in points:
        color = None
        for (m, n), ((ax, ay, a), (bx, by, b), (cx, cy, c)) in sorted(((k, v) for k, v in triangles.items() if k[0] == mesh), key=lambda kv: kv[0][1]):
            area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
            if area:
                w = [((bx - x) * (cy - y) - (cx - x) * (by - y)) / area, ((cx - x) * (ay - y) - (ax - x) * (cy - y)) / area, ((ax - x) * (by - y) - (bx - x) * (ay - y)) / area]
                if min(w) >= -1e-9:
                    color = w[0] * a[0] + w[1] * b[0] + w[2] * c[0]
        assert (found[i] is None) == (color is None) and (color is None or found[i][0] == pytest.approx(color, abs=1e-9))
    assert painted_points(spark.createDataFrame(points, "id long, mesh long, x double, y double"), df.where("false"), ["mesh"], ["id"]).where("color IS NULL").count() == len(points)
