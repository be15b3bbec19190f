"""Relational operators against folds and brute force in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F


def test_scan_equals_a_fold(spark, monkeypatch):
    from quire.operators import scans

    monkeypatch.setattr(scans, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, "x", "yz", f"{i}"]), 1, "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, v string, place int, before string").repartition(3)
    found = {r["at"]: r for r in scans.segmented_scan(df, ["g"], "at", F.col("v"), lambda a, b: F.concat(a, b), "all", "earlier").collect()}
    held = {}
    for g, at, v, *_ in rows:
        assert found[at]["earlier"] == held.get(g)
        held[g] = (held.get(g) or "") + v if v is not None else held.get(g)
        assert found[at]["all"] == held[g]
    assert scans.segmented_scan(df.where("false"), ["g"], "at", F.col("v"), lambda a, b: F.concat(a, b)).count() == 0


def folded(ops, advance):
    """The states after each operation, one after another."""
    mul = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])
    ctm, stack, line, tm = (1, 0, 0, 1, 0, 0), [], None, None
    state = {"leading": 0, "char_space": 0, "word_space": 0, "h_scale": 100, "rise": 0, "mode": 0, "size": None}
    names = {"TL": "leading", "Tc": "char_space", "Tw": "word_space", "Tz": "h_scale", "Ts": "rise", "Tr": "mode"}
    out = []
    for op, args in ops:
        if op == "q":
            stack.append((ctm, dict(state)))
        elif op == "Q" and stack:
            ctm, state = stack.pop()
        elif op == "cm":
            ctm = mul(args, ctm)
        elif op in names:
            state[names[op]] = args[0]
        elif op == "Tf":
            state["size"] = args[1]
        elif op == "BT":
            line = tm = (1, 0, 0, 1, 0, 0)
        elif op == "Tm":
            line = tm = tuple(args)
        elif op in ("Td", "TD", "T*", "'", '"'):
            if op == '"':
                state["word_space"], state["char_space"] = args[:2]
            if op == "TD":
                state["leading"] = -args[1]
            move = args if op in ("Td", "TD") else (0, -state["leading"])
            if line is not None:
                line = tm = mul((1, 0, 0, 1, *move), line)
        seen = tm
        if op in ("Tj", "TJ", "'", '"') and tm is not None:
            tm = mul((1, 0, 0, 1, advance, 0), tm)
        out.append((len(stack), ctm, line, seen, tuple(state.values())))
    return out


def content(rng, n):
    """Numbers that add and multiply without rounding."""
    ops = []
    for _ in range(n):
        op = rng.choice(["q", "q", "Q", "Q", "cm", "cm", "BT", "Tm", "Td", "TD", "T*", "'", '"', "Tj", "TL", "Tc", "Tf", "Tz", "Tr", "re", "ET"])
        turn = rng.choice([(1, 0, 0, 1), (0, 1, -1, 0), (0, -1, 1, 0), (-1, 0, 0, 1)])
        args = {"cm": [*turn, rng.randint(-9, 9), rng.randint(-9, 9)], "Tm": [*turn, rng.randint(0, 9), 2], "Td": [rng.randint(0, 9), 3], "TD": [1, -rng.randint(0, 9)], "'": ["(x)"], '"': [1, rng.randint(0, 3), "(x)"], "Tf": ["/F", rng.randint(1, 9)]}
        ops.append((op, args.get(op, [rng.randint(0, 5)] if op[0] == "T" and op not in ("T*", "Tj") else [])))
    return ops


def test_placed_operations_equal_a_fold(spark, monkeypatch):
    from quire.operators import scans
    from quire.operators.placement import placed_operations

    monkeypatch.setattr(scans, "BLOCK", 8)
    rng = random.Random(5)
    pages = {(d, p): content(rng, n) for d, p, n in [(1, 0, 300), (1, 1, 20), (2, 0, 1), (None, 0, 40)]}
    pages[3, 0] = [("q", [])] * 60 + [("cm", [1, 0, 0, 1, 1, 1])] + [("Q", [])] * 70 + [("cm", [2, 0, 0, 2, 0, 0]), ("re", [])]
    rows = [(*key, i, op, json.dumps(args), "clash") for key, ops in pages.items() for i, (op, args) in enumerate(ops)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, ord int, operator string, operands_json string, depth string").repartition(3)
    found = placed_operations(df, advance=F.lit(0.5))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    got = {(r["doc_id"], r["page_index"], r["ord"]): r for r in found.collect()}
    assert len(got) == len(rows)
    for key, ops in pages.items():
        for i, (depth, ctm, line, tm, state) in enumerate(folded(ops, 0.5)):
            r = got[*key, i]
            assert (r["depth"], tuple(r["ctm"]), r["line"] and tuple(r["line"]), r["text_matrix"] and tuple(r["text_matrix"])) == (depth, ctm, line, tm), (key, i, ops[i])
            assert tuple(r[k] for k in ("leading", "char_space", "word_space", "h_scale", "rise", "mode", "size")) == state, (key, i, ops[i])
    assert placed_operations(df.where("false")).count() == 0


def refinement(shapes, refs):
    """The coarsest stable partition by repeated splitting."""
    kind = {n: (shapes[n],) for n in shapes}
    while True:
        after = {n: (kind[n], tuple(sorted((p, kind.get(d, "missing")) for s, p, d in refs if s == n))) for n in shapes}
        names = {v: i for i, v in enumerate(dict.fromkeys(after.values()))}
        if len(names) == len(set(kind.values())):
            return kind
        kind = {n: names[after[n]] for n in shapes}


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_equal_a_naive_refinement(spark, monkeypatch, seed):
    from quire.operators.graphs import aliases_of, duplicate_classes
    from quire.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "HOT_SHARE", 6)
    rng = random.Random(seed)
    shapes = {(d, n): rng.choice(["a", "b", None]) for d in (1, 2, None) for n in range(25)}
    refs = [((d, n), f"p{k}", (d, rng.choice([0, 0, rng.randrange(27)]))) for d, n in shapes for k in range(rng.randint(0, 2))]
    # two cycles that no path tells apart, and a copy of them in another document
    for d in (1, 2):
        shapes |= {(d, 100 + i): "c" for i in range(4)}
        refs += [((d, 100), "n", (d, 101)), ((d, 101), "n", (d, 100)), ((d, 102), "n", (d, 103)), ((d, 103), "n", (d, 102))]
    objects = spark.createDataFrame([(d, n, s, None) for (d, n), s in shapes.items()] + [(1, 200, "x", True), (1, 201, "x", True)], "doc_id long, num long, shape string, fixed boolean")
    edges = spark.createDataFrame([(s[0], s[1], p, d[1]) for s, p, d in refs], "doc_id long, src_num long, path string, dst_num long").repartition(3)
    found = duplicate_classes(objects, edges)
    rows = found.collect()
    want, mine, least = refinement(shapes, refs), {}, {}
    order = lambda k: (k[0] is not None, k[0] or 0, k[1])
    for r in rows:
        mine.setdefault(r["class"], []).append((r["doc_id"], r["num"]))
        least[r["class"]] = tuple(r["canonical"])
    groups = {}
    for n, k in want.items():
        groups.setdefault(k, []).append(n)
    expected = sorted(sorted(map(str, g)) for g in [*groups.values(), [(1, 200)], [(1, 201)]])
    assert sorted(sorted(map(str, g)) for g in mine.values()) == expected
    assert all(least[k] == min(g, key=order) for k, g in mine.items())
    assert len(next(g for g in mine.values() if (1, 100) in g)) == 8
    for r in aliases_of(found).collect():
        same = next(g for g in mine.values() if (r["doc_id"], r["num"]) in g)
        assert r["canonical_num"] == min(n for d, n in same if d == r["doc_id"]) < r["num"]
    apart = duplicate_classes(objects, edges, across=False).groupBy("class").agg(F.count_distinct("doc_id").alias("n")).agg(F.max("n")).first()[0]
    assert apart == 1
    assert duplicate_classes(objects.where("false"), edges.where("false")).count() == 0


def test_flags_travel_along_references(spark, monkeypatch):
    from quire.operators.graphs import propagated
    from quire.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 8)
    rng = random.Random(9)
    refs = [(d, rng.choice([0, 0, rng.randrange(30)]), rng.randrange(30), rng.choice([-1, -1, 3])) for d in (1, 2) for _ in range(60)] + [(3, i, i + 1, None) for i in range(25)] + [(3, 25, 0, None)]
    labels = [(d, rng.randrange(30), 1 << rng.randrange(5), rng.choice([None, float(i)])) for i in range(8) for d in (1, 2)] + [(3, 7, 16, 2.5), (3, 7, 1, None), (9, 9, 4, 1.0)]
    known = {}
    for d, n, f, low in labels:
        a, b = known.get((d, n), (0, None))
        known[d, n] = (a | f, low if b is None else b if low is None else min(b, low))
    while True:
        after = dict(known)
        for d, s, t, passes in refs:
            if (d, s) in known:
                f, low = known[d, s]
                a, b = after.get((d, t), (0, None))
                after[d, t] = (a | (f & (-1 if passes is None else passes)), low if b is None else b if low is None else min(b, low))
        if after == known:
            break
        known = after
    found = propagated(spark.createDataFrame(refs, "doc_id long, src_num long, dst_num long, passes long").repartition(3), spark.createDataFrame(labels, "doc_id long, num long, flags long, low double"))
    assert {(r["doc_id"], r["num"]): (r["flags"], r["low"]) for r in found.collect()} == known


def test_expressions_equal_recursion(spark):
    from quire.operators.graphs import evaluated_expressions

    rng = random.Random(4)
    rows, want = [], {}

    def grow(tree, parent, depth, ids):
        node = next(ids)
        op = rng.choice(["And", "Or", "Not", None]) if depth < 7 else None
        state = rng.choice([True, False, None]) if op is None else None
        rows.append((tree, node, parent, op, state))
        kids = [grow(tree, node, depth + 1, ids) for _ in range(0 if op is None else 1 if op == "Not" else rng.randint(1, 4))]
        value = (state is not False) if op is None else not kids[0] if op == "Not" else all(kids) if op == "And" else any(kids)
        want[tree, node] = value
        return value

    for tree in [*range(30), None]:
        grow(tree, None, 0, iter(range(100_000)))
    df = spark.createDataFrame(rows, "tree long, node long, parent long, op string, state boolean").repartition(3)
    found = evaluated_expressions(df, ["tree"])
    assert {(r["tree"], r["node"]): r["value"] for r in found.collect()} == want
    assert evaluated_expressions(df.where("false"), ["tree"]).count() == 0
    for bad in ([(1, 1, None, "And", None)], [(1, 1, 2, "And", None), (1, 2, 1, "And", None)], [(1, 1, None, "Not", None), (1, 2, 1, None, True), (1, 3, 1, None, True)]):
        with pytest.raises(ValueError):
            evaluated_expressions(spark.createDataFrame(bad, df.schema), ["tree"])


def test_intervals_equal_comparing_each(spark, monkeypatch):
    from quire.operators.intervals import in_intervals
    from quire.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    rng = random.Random(2)
    spans = [(rng.choice([1, 2, None]), a, a + rng.choice([0, 3, 17, 400, -2]), i, f"r{i}") for i in range(60) for a in [rng.randrange(500)]] + [(1, 0, (1 << 40) - 1, -1, "all"), (2, 5, 5, 1000, None)]
    points = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([7, 7, rng.randrange(-3, 950), None, 1 << 39])) for i in range(500)]
    df = spark.createDataFrame(points, "id long, font long, code long").repartition(3)
    found = in_intervals(df, spark.createDataFrame(spans, "font long, low long, high long, ord long, name string"), ["font"], "code")
    got = {r["id"]: (r["low"], r["high"], r["name"]) for r in found.collect()}
    assert len(got) == len(points)
    for i, font, code in points:
        held = [s for s in spans if s[0] == font and code is not None and s[1] <= code <= s[2]]
        best = max(held, key=lambda s: s[3], default=None)
        assert got[i] == ((best[1], best[2], best[4]) if best else (None, None, None)), (font, code)
    empty = in_intervals(df, spark.createDataFrame([], "font long, low long, high long, ord long, name string"), ["font"], "code")
    assert empty.where("name IS NULL").count() == len(points)


def test_plans_stay_small(spark):
    """Plans grow with what is computed, not with how often it is used."""
    from quire.functions import calculator
    from quire.operators.appearances import drawn_annotations

    none = spark.createDataFrame([], "doc_id long, page_index int, index int, num long, subtype string, rect array<double>, flags long, contents string, dict_json string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    shown = plan(drawn_annotations(none.union(spark.createDataFrame([(1, 0, 0, 1, "Link", [0.0, 0.0, 1.0, 1.0], 0, "", "{}")], none.schema)).repartition(2)))
    assert shown.count("from_json") <= 4 and len(shown) < 60_000
    program = calculator.parse("{ " + "dup mul dup add " * 12 + "}")
    df = calculator.with_programs(spark.range(5).withColumn("x", F.col("id") / 100), {"y": (program, [F.col("x")])})
    assert len(plan(df.repartition(2))) < 40_000
    for r in df.collect():
        assert r["y"] == pytest.approx(calculator.evaluate(program, [r["x"]])[-1])


@pytest.fixture(scope="module")
def small_files(spark):
    from quire.functions.filters import flate_encode
    from quire.sources.pdf.objects import Name, Ref, Stream
    from quire.sources.pdf.write import text_document, write_file

    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}
    content = b"BT /F 9 Tf 5 50 Td (shown) Tj ET " * 40
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0), Ref(13, 0)], "Count": 2, "MediaBox": [0, 0, 99, 99]},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Resources": {"Font": {"F": Ref(5, 0)}}}, 4: Stream({}, content), 5: font | {"ToUnicode": Ref(6, 0)}, 6: Stream({"Filter": Name("FlateDecode")}, flate_encode(b"1 begincodespacerange <00> <ff> endcodespacerange")),
        13: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(14, 0), "Resources": {"Font": {"F": Ref(15, 0)}}}, 14: Stream({}, content), 15: font | {"ToUnicode": Ref(16, 0)}, 16: Stream({"Filter": Name("FlateDecode")}, flate_encode(b"1 begincodespacerange <00> <ff> endcodespacerange")),
        5000: Stream({"StructParent": 1}, b"nobody refers to this"), 9000: {"Odd(name": b"\xff\x00", "r": 0.25, "n": None, "t": True},
    }
    rows = [(1, write_file(objects, {"Root": Ref(1, 0), "Info": Ref(9000, 0)})), (2, text_document([[f"line {i} of page {p}" for i in range(50)] for p in range(130)])), (3, b"not a document")]
    return spark.createDataFrame(rows, "doc_id long, content binary").repartition(3)


@pytest.mark.parametrize("optimise", [True, False])
def test_documents_rewritten_by_relations_read_back_equal(spark, small_files, optimise, tmp_path):
    from quire.operators import serialise
    from quire.sources.tables import scan, scan_together

    held = scan_together(small_files, serialise.TABLES)
    progress = serialise.Progress()
    parts = serialise.rewritten_parts(held, optimise, progress).persist()
    rows = sorted((r["doc_id"], r["ord"], r["offset"], bytes(r["data"])) for r in parts.collect())
    for before, after in zip(rows, rows[1:], strict=False):
        assert after[2] == (before[2] + len(before[3]) if after[0] == before[0] else 0)
    again = serialise.assembled(parts)
    assert {r["doc_id"] for r in again.collect()} == {1, 2}
    for table in ("pages", "text_marks"):
        columns = [c for c in scan(small_files, table).columns if c != "font_num"]
        read = lambda files: sorted(map(str, scan(files, table, "FAILFAST").select(*columns).collect()))  # noqa: B023, E731
        assert read(again) == read(small_files.where("doc_id < 3")), table
    assert scan(again, "diagnostics").count() == 0
    nums = {r["num"] for r in scan(again, "objects").where("doc_id = 1").collect()}
    assert nums == ({1, 2, 3, 4, 5, 6, 13, 9000} if optimise else {1, 2, 3, 4, 5, 6, 13, 14, 15, 16, 9000})
    report = progress.report()
    assert report["write"]["bytes"] == sum(len(r[3]) for r in rows) and report["write"]["rows"] == len(rows)
    assert report["merge"]["rows"] == (3 if optimise else 0) and (report["compress"]["compressed"] > 0) == optimise
    assert report["scan"]["rows"] == report["compress"]["rows"] + report["merge"]["rows"]

    written = serialise.write_parts(parts, tmp_path.as_uri(), part_bytes=20_000).collect()
    for doc in (1, 2):
        files = sorted((tmp_path / str(doc)).iterdir())
        assert b"".join(f.read_bytes() for f in files) == b"".join(r[3] for r in rows if r[0] == doc)
    assert len([w for w in written if w["doc_id"] == 2]) > 2


def painted_over(below, element, base, knockout):
    """One element on (premultiplied colours, opacity); ``base`` is what lay below a knockout group."""
    colors, alpha, mode, shape, on = element
    blend = {"Normal": lambda b, s: s, "Multiply": lambda b, s: b * s, "Screen": lambda b, s: b + s - b * s, "Exclusion": lambda b, s: b + s - 2 * b * s, "HardLight": lambda b, s: 2 * b * s if s <= 0.5 else 1 - 2 * (1 - b) * (1 - s)}[mode]
    c0, a0 = base if knockout else below
    over = []
    for c, s, paint in zip(c0, colors, on, strict=True):
        b = c / a0 if a0 else 0.0
        s, mixed = (s, blend(b, s)) if paint else (0.0, b)
        over.append((1 - alpha) * c + alpha * (1 - a0) * s + alpha * a0 * mixed)
    result = over, a0 + alpha - a0 * alpha
    if not knockout:
        return result
    # inside the shape the element stands on what lay below the group, outside on what is there
    c, a = below
    return [(1 - shape) * x + y - (1 - shape) * z for x, y, z in zip(c, result[0], c0, strict=True)], (1 - shape) * a + result[1] - (1 - shape) * a0


@pytest.mark.parametrize("block", [2, 128])
def test_painting_equals_a_fold(spark, monkeypatch, block):
    from quire.operators import compositing, scans

    monkeypatch.setattr(scans, "BLOCK", block)
    rng = random.Random(block)
    groups = {1: (None, 7, True, False, 0.8, "Multiply"), 2: (None, 20, False, False, 0.5, "Normal"), 3: (1, 4, True, True, 0.9, "Screen"), 4: (2, 3, False, True, 0.7, "Normal"), 5: (3, 2, True, False, 1.0, "Normal")}
    paints = {}
    for place in range(12):
        for grp in (None, 1, 2, 3, 4, 5):
            for ord_ in rng.sample([o for o in range(30) if o not in (2, 3, 4, 7, 20)], rng.randint(0, 6)):
                alpha = rng.choice([0.0, 0.25, 0.5, 1.0])
                paints[place, grp, ord_] = ([rng.random() for _ in range(3)], alpha, rng.choice(["Normal", "Multiply", "Screen", "Exclusion", "HardLight"]), rng.choice([1.0, max(alpha, 0.5)]), [rng.random() < 0.8 for _ in range(3)])

    def run(place, grp, state, knockout):
        base = state
        items = [(o, "paint", e) for (p, g, o), e in paints.items() if p == place and g == grp] + [(v[1], "group", g) for g, v in groups.items() if v[0] == grp]
        for _, kind, x in sorted(items, key=lambda i: i[0]):
            if kind == "paint":
                state = painted_over(state, x, base, knockout)
            elif any(p == place and inside(g, x) for p, g, _ in paints):
                _, _, isolated, ko, fade, mode = groups[x]
                if isolated:
                    c, a = run(place, x, ([0.0] * 3, 0.0), ko)
                    state = painted_over(state, ([v / a if a else 0.0 for v in c], a * fade, mode, 1.0 if a > 0 else 0.0, [True] * 3), base, knockout)
                else:
                    c, a = run(place, x, state, ko)
                    state = [(1 - fade) * v + fade * w for v, w in zip(state[0], c, strict=True)], (1 - fade) * state[1] + fade * a
        return state

    def inside(g, x):
        while g is not None and g != x:
            g = groups[g][0]
        return g == x

    df = spark.createDataFrame([(p, g, o, *e) for (p, g, o), e in paints.items()], "place int, grp int, ord int, colors array<double>, alpha double, mode string, shape double, painted array<boolean>").repartition(5)
    rules = spark.createDataFrame([(g, *v) for g, v in groups.items()], "grp int, parent int, ord int, isolated boolean, knockout boolean, alpha double, mode string")
    found = compositing.composited(df, rules, ["place"])
    got = {r["place"]: r["x"] for r in found.select("place", compositing.applied(F.col("paint"), F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)), F.lit(0.6)).alias("x")).collect()}
    for place in {p for p, _, _ in paints}:
        c, a = run(place, None, ([0.6, 0.3, 0.15], 0.6), False)
        assert got[place]["alpha"] == pytest.approx(a) and list(got[place]["colors"]) == pytest.approx([v / a for v in c])
    with pytest.raises(Exception, match="not linear"):
        compositing.composited(df.withColumn("mode", F.lit("SoftLight")), rules, ["place"]).collect()


@pytest.mark.parametrize("sizes,order", [([5], 1), ([5], 3), ([3, 4], 1), ([4, 5, 4], 3), ([2, 3, 4], 1), ([1, 4, 3], 3)])
def test_sampled_functions_of_several_inputs(spark, sizes, order):
    import math

    from quire.functions import samples
    from quire.sources.pdf.color import read_function
    from quire.sources.pdf.document import Document
    from quire.sources.pdf.objects import Name, Stream
    from quire.sources.pdf.write import text_document

    rng = random.Random(len(sizes) * 10 + order)
    m, n = len(sizes), 2
    domain, bounds, encode, decode = [-1.0, 2.0] * m, [0.0, 9.0] * n, [v for s in sizes for v in (0.25, s - 1.5)], [-2.0, 10.0, 9.0, 0.0]
    raw = bytes(rng.randrange(256) for _ in range(math.prod(sizes) * n))
    own = {"FunctionType": 0, "Domain": domain, "Range": bounds, "Size": sizes, "BitsPerSample": 8, "Encode": encode, "Decode": decode, "Order": order}
    plain = read_function(Document(text_document([["x"]])), Stream(own | {"Length": len(raw)}, raw))
    points = [tuple(rng.uniform(-1.5, 2.5) for _ in range(m)) for _ in range(40)] + [tuple([2.0] * m), tuple([-1.0] * m)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(99, *[None] * m)], "id long, " + ", ".join(f"x{i} double" for i in range(m)))
    xs = [F.col(f"x{i}") for i in range(m)]
    columns = samples.sampled(xs, sizes, list(raw), n, domain, bounds, 8, encode, decode, order)
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", columns[0].alias("a"), columns[1].alias("b")).collect()}
    table = spark.createDataFrame([(i, [float(v) for v in raw[n * i : n * i + n]]) for i in range(math.prod(sizes))], "at long, values array<double>")
    joined = samples.sampled_by_table(df, ["id"], xs, sizes, table, ["a", "b"], domain, bounds, 8, encode, decode, order)
    also = {r["id"]: (r["a"], r["b"]) for r in joined.collect()}
    for i, p in enumerate(points):
        assert got[i] == pytest.approx(plain(list(p))) and also[i] == pytest.approx(plain(list(p)))
    assert got[99] == also[99] == (None, None)
    with pytest.raises(ValueError):
        samples.sampled([F.lit(0.0)], [5000], [0] * 5000, 1, [0.0, 1.0], [0.0, 1.0])


def test_references_between_documents(spark, monkeypatch):
    from urllib.parse import urldefrag, urljoin

    from quire.operators.links import linked, missed, normalised
    from quire.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    places = {1: "http://a.example/x/y.html", 2: "http://a.example/x/z.html?q=1", 3: "https://B.example", 4: None, 5: "http://a.example/"}
    references = ["z.html?q=1", "/", "../", "./y.html#part", "//b.example/k", "https://b.example/", "", "#top", "?q=2", "../../x/y.html", "HTTP://A.example:80/x/./y.html", "y%2Ehtml", "none.html", "g/", "..", None]
    links = spark.createDataFrame([(d, r, 1) for d in (1, 2, 3, 4, 77) for r in references], "doc_id long, reference string, place int")
    found = linked(links, spark.createDataFrame(list(places.items()), "doc_id long, place string"))
    fixed = lambda u: urldefrag(u)[0].replace("http://A.example:80", "http://a.example").replace("HTTP://A.example:80", "http://a.example").replace("B.example", "b.example").replace("y%2Ehtml", "y.html").replace("/./", "/")
    at = {"http://a.example/x/y.html": 1, "http://a.example/x/z.html?q=1": 2, "https://b.example/": 3, "http://a.example/": 5}
    rows = found.collect()
    assert len(rows) == 5 * len(references)
    for r in rows:
        base = places.get(r["doc_id"])
        want = None if base is None or r["reference"] is None else fixed(urljoin(base, r["reference"]))
        want = want and re.sub(r"^(https?://[^/?]+)(\?|$)", r"\1/\2", want)
        assert r["target"] == want, (base, r["reference"])
        assert r["target_id"] == at.get(want)
    gone = {r["target"]: r["n"] for r in missed(found).collect()}
    assert gone["http://a.example/x/none.html"] == 2 and not set(gone) & set(at)
    assert spark.range(1).select(normalised(F.lit("HTTP://X.org:80/a/../b%7e%2f?c#d"))).first()[0] == "http://x.org/b~%2F?c"


def test_reach_over_a_long_way(spark, monkeypatch):
    from quire.operators import relations as R

    monkeypatch.setattr(R, "FRONTS", 3)
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(10)] + [(1, 4, 0), (2, 3, 3)], "doc_id long, src long, dst long")
    found = R.reachable(edges, spark.createDataFrame([(1, 0), (2, 3), (1, 0)], "doc_id long, num long"))
    assert sorted(map(tuple, found.collect())) == [*[(1, i, i) for i in range(11)], (2, 3, 0)]
