"""Where content operations act: transformation, text line and text state as columns.

The input is the ``operations`` table (or any of its shape); nothing is interpreted
one operation after another. The running depth of ``q``/``Q`` is a scan of (sum,
least sum), since a ``Q`` too many does nothing. The ``q`` that last opened a depth
names the frame an operation is in; inside a frame, matrices and settings are a scan
of affine products and last values; what a frame starts with is composed up the tree
of frames by doubling, so nesting of any depth takes the logarithm of it in rounds.
Text lines are one more scan: ``BT`` and ``Tm`` set the line matrix, ``Td``, ``TD``,
``T*``, ``'`` and ``"`` move it, shown text advances from it.

A group of at most ``BLOCK`` operations without ``q``, ``Q`` and ``cm`` has one frame and
no products but of moves, which add up; running windows give all of it in one sort.

A matrix is (a, b, c, d, e, f) for row vectors. Sums of doubles are associated as
the scan has it, so the last bits may differ from a fold's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import scans
from quire.operators.scans import large_groups, let2, segmented_scan
from quire.plans.session import cut_lineage

PARTS = "abcdef"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
#: Text state by operator: the field it sets and the operand that holds its value.
SETS = {"TL": ("leading", 0), "Tc": ("char_space", 0), "Tw": ("word_space", 0), "Tz": ("h_scale", 0), "Ts": ("rise", 0), "Tr": ("mode", 0), "Tf": ("size", 1)}
#: Values that a page begins with; a font size has none.
INITIAL = {"leading": 0.0, "char_space": 0.0, "word_space": 0.0, "h_scale": 100.0, "rise": 0.0, "mode": 0.0, "size": None}
SHOWS = ("Tj", "TJ", "'", '"')
#: Operators whose operands are read; of all others, strings that are shown among them, none are kept.
NUMBERS = ("cm", "Td", "TD", "Tm", '"', *SETS)


def matrix(*parts: Column | float) -> Column:
    return F.struct(*[(p if isinstance(p, Column) else F.lit(float(p))).cast("double").alias(n) for n, p in zip(PARTS, parts, strict=True)])


IDENTITY = (1, 0, 0, 1, 0, 0)


def product(m: Column, n: Column) -> Column:
    """The matrix that applies ``m``, then ``n``."""
    row = lambda x, y, last=None: [p if last is None else p + n[last[i]] for i, p in enumerate((m[x] * n["a"] + m[y] * n["c"], m[x] * n["b"] + m[y] * n["d"]))]
    return matrix(*row("a", "b"), *row("c", "d"), *row("e", "f", "ef"))


def _later(field: str, earlier: Column, later: Column) -> Column:
    return F.coalesce(later[field], earlier[field]).alias(field)


def _compose(earlier: Column, later: Column) -> Column:
    """Graphics state: matrices multiply, settings are replaced."""
    return F.struct(product(later["m"], earlier["m"]).alias("m"), *[_later(f, earlier, later) for f in INITIAL])


def _number(at: int) -> Column:
    return F.get("args", F.lit(at)).try_cast("double")


def _line(earlier: Column, later: Column) -> Column:
    """Text lines: kind 2 sets the line matrix, 1 moves it, 0 only advances; ``shown`` is the advance since."""
    moved = F.struct(F.greatest(earlier["kind"], F.lit(1)).alias("kind"), product(later["m"], earlier["m"]).alias("m"), later["shown"].alias("shown"))
    advanced = F.struct(earlier["kind"].alias("kind"), earlier["m"].alias("m"), (earlier["shown"] + later["shown"]).alias("shown"))
    return F.when(later["kind"] == 2, later).when(later["kind"] == 1, moved).otherwise(advanced)


def depths(operations: DataFrame, by: list[str], large: DataFrame | bool | None = True) -> DataFrame:
    """``operations`` with ``depth``: how many ``q`` are open after each; a ``Q`` without one is ignored. ``large``: as of ``segmented_scan``."""
    step = F.when(F.col("operator") == "q", 1).when(F.col("operator") == "Q", -1).otherwise(0).cast("long")
    value = F.struct(step.alias("s"), F.least(step, F.lit(0)).cast("long").alias("low"))
    both = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), F.least(a["low"], a["s"] + b["low"]).alias("low"))
    found = segmented_scan(operations, by, "ord", value, both, "_d", large=large)
    return found.select(*operations.columns, (F.col("_d.s") - F.col("_d.low")).alias("depth"))


def placed_operations(operations: DataFrame, by: tuple[str, ...] = ("doc_id", "page_index"), advance: Column | None = None) -> DataFrame:
    """by, ord, operator, depth, ctm, line, text_matrix and text state of every operation.

    ``operations``: by, ord (unique and ascending in a group), operator and
    operands_json. ``ctm`` and the settings are those after the operation, as are
    ``line`` and ``text_matrix`` but that a showing operation has the text matrix it
    starts from. ``advance``: how far an operation moves the text matrix, in text
    space; none by default. Operands that are no numbers count as 0. Content without
    text objects has null lines.
    """
    by = list(by)
    op = F.col("operator")
    args = F.when(op.isin(*NUMBERS), F.from_json("operands_json", "array<string>"))
    ops = operations.select(*by, F.col("ord").cast("long").alias("ord"), "operator", args.alias("args"), (F.lit(0.0) if advance is None else F.coalesce(advance.cast("double"), F.lit(0.0))).alias("shown"))
    # dealt by group once; every group of the scans is a part of one
    whole = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plain = (F.count("*").over(whole) <= scans.BLOCK) & ~F.coalesce(F.bool_or(op.isin("q", "Q", "cm")).over(whole), F.lit(False))
    ops = cut_lineage(ops.repartition(*by).withColumn("_plain", plain))
    rest = ops.where("NOT _plain").drop("_plain")
    found = _in_windows(ops.where("_plain").drop("_plain"), by, advance is not None)
    return found if rest.isEmpty() else found.unionByName(_in_scans(rest, by))


def _settings() -> list[Column]:
    """What an operation sets each field of the text state to, or null."""
    cases = {f: [] for f in INITIAL}
    for name, (field, at) in SETS.items():
        cases[field].append((F.col("operator") == name, _zero(at)))
    cases["leading"].append((F.col("operator") == "TD", -_zero(1)))
    cases["word_space"].append((F.col("operator") == '"', _zero(0)))
    cases["char_space"].append((F.col("operator") == '"', _zero(1)))
    return [reduce(lambda c, x: c.when(*x), held[1:], F.when(*held[0])).cast("double").alias(f) for f, held in cases.items()]


def _zero(at: int) -> Column:
    return F.coalesce(_number(at), F.lit(0.0))


def _in_windows(ops: DataFrame, by: list[str], advances: bool) -> DataFrame:
    """``placed_operations`` of small groups without ``q``, ``Q`` and ``cm``; ``advances``: whether shown text moves."""
    op = F.col("operator")
    running = lambda *more: Window.partitionBy(*by, *more).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = running()
    own = dict(zip(INITIAL, _settings(), strict=True))
    state = ops.select("*", *[F.last(c, ignorenulls=True).over(so_far).alias(f) for f, c in own.items()])
    sets, is_show = op.isin("BT", "Tm"), op.isin(*SHOWS)
    moves = op.isin("Td", "TD", "T*", "'", '"')
    down = -F.coalesce("leading", F.lit(INITIAL["leading"]))
    x = F.when(op.isin("Td", "TD"), _zero(0)).otherwise(0.0)
    y = F.when(op.isin("Td", "TD"), _zero(1)).when(moves, down).otherwise(0.0)
    base = F.when(op == "Tm", matrix(*map(_zero, range(6)))).when(op == "BT", matrix(*IDENTITY))
    held = state.select(
        *by, "ord", "operator", *INITIAL, x.alias("_x"), y.alias("_y"), F.when(is_show, F.col("shown")).otherwise(0.0).alias("_own"), moves.alias("_moves"),
        F.last(base, ignorenulls=True).over(so_far).alias("_base"), F.count_if(sets).over(so_far).alias("_set"),
    )
    # moves add up since the line was set; what is shown advances since it last moved
    since = running("_set")
    held = held.select("*", F.sum("_x").over(since).alias("_dx"), F.sum("_y").over(since).alias("_dy"), F.count_if("_moves").over(since).alias("_move"))
    held = held.withColumn("_shown", F.sum("_own").over(running("_set", "_move")) - F.col("_own") if advances else F.lit(0.0))
    moved = lambda x, y: product(matrix(1, 0, 0, 1, x, y), F.col("_base"))
    begun = F.col("_base").isNotNull()
    fields = [F.coalesce(F.col(f), F.lit(v).cast("double")).alias(f) for f, v in INITIAL.items()]
    return held.select(
        *by, "ord", "operator", F.lit(0).cast("long").alias("depth"), matrix(*IDENTITY).alias("ctm"), F.when(begun, moved(F.col("_dx"), F.col("_dy"))).alias("line"),
        F.when(begun, moved(F.col("_dx") + F.col("_shown"), F.col("_dy"))).alias("text_matrix"), *fields,
    )


def _in_scans(ops: DataFrame, by: list[str]) -> DataFrame:
    """``placed_operations`` of any groups, ``ops`` dealt by them."""
    op = F.col("operator")
    large = large_groups(ops, by)
    held = depths(ops, by, large)

    # frames: the q that last opened the depth an operation acts at; a q itself acts outside what it opens
    acts = lambda depth, opens: F.struct(depth.alias("depth"), opens.cast("long").alias("opens"))
    acting, opening = acts(F.col("depth") - 1, F.lit(None)), acts(F.col("depth"), F.col("ord"))
    both = F.when(op == "q", F.array(opening, acting)).otherwise(F.array(acts(F.col("depth"), F.lit(None))))
    acted = held.select(*by, "ord", "args", "operator", "shown", F.explode(both).alias("_a")).select(*by, "ord", "args", "operator", "shown", "_a.*")
    framed = segmented_scan(acted, [*by, "depth"], "ord", F.col("opens"), lambda _, b: b, "frame", large=large).where("opens IS NULL").withColumn("frame", F.coalesce("frame", F.lit(-1)))

    concat = F.when(op == "cm", matrix(*map(_zero, range(6)))).otherwise(matrix(*IDENTITY))
    local = segmented_scan(framed, [*by, "frame"], "ord", F.struct(concat.alias("m"), *_settings()), _compose, "local", large=large)
    local = cut_lineage(local.select(*by, "ord", "operator", "args", "shown", "depth", "frame", "local"))

    # what a frame starts with: the state at its q, composed with what that frame started with
    open_ = cut_lineage(local.where(op == "q").select(*by, F.col("ord").alias("frame"), F.col("frame").alias("above"), F.col("local").alias("entry")))
    while not open_.where("above >= 0").isEmpty():
        above = open_.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("frame").alias("_frame"), F.col("above").alias("_above"), F.col("entry").alias("_entry"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.col("above") == F.col("_frame"))
        open_ = cut_lineage(
            open_.join(above, on, "left").select(
                *by, "frame", F.coalesce("_above", F.lit(-1)).alias("above"), F.when(F.col("_entry").isNull(), F.col("entry")).otherwise(let2(F.col("_entry"), F.col("entry"), _compose)).alias("entry")
            )
        )
    entries = open_.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("frame").alias("_frame"), "entry")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.col("frame") == F.col("_frame"))
    state = F.when(F.col("entry").isNull(), F.col("local")).otherwise(let2(F.col("entry"), F.col("local"), _compose))
    known = local.join(entries, on, "left").select(*by, "ord", "operator", "args", "shown", F.when(op == "q", F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), state.alias("state"))

    # lines of text, by the leading now known
    down = matrix(1, 0, 0, 1, F.lit(0.0), -F.coalesce("state.leading", F.lit(INITIAL["leading"])))
    is_show = op.isin(*SHOWS)
    kind = F.when(op.isin("BT", "Tm"), 2).when(op.isin("Td", "TD", "T*", "'", '"'), 1).when(is_show, 0)
    move = F.when(op == "Tm", matrix(*map(_zero, range(6)))).when(op.isin("Td", "TD"), matrix(1, 0, 0, 1, _zero(0), _zero(1))).when(op.isin("T*", "'", '"'), down).otherwise(matrix(*IDENTITY))
    shown = F.when(is_show, F.col("shown")).otherwise(F.lit(0.0))
    value = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), move.alias("m"), shown.alias("shown")))
    lines = segmented_scan(known, by, "ord", value, _line, "_line", large=large)
    start = matrix(1, 0, 0, 1, F.col("_line.shown") - shown, F.lit(0.0))
    text = F.when(F.col("_line.kind") == 2, let2(start, F.col("_line.m"), product))
    begun = F.col("_line.kind") == 2  # nothing is moved or shown before a text object begins
    fields = [F.coalesce(F.col(f"state.{f}"), F.lit(v).cast("double")).alias(f) for f, v in INITIAL.items()]
    return lines.select(*by, "ord", "operator", "depth", F.col("state.m").alias("ctm"), F.when(begun, F.col("_line.m")).alias("line"), text.alias("text_matrix"), *fields)
