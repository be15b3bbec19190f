"""Conversation structure repair: a generalised LR parse of the roles with weighted edits.

Roles count by their initials; a sound conversation reads ``(s?(ua)+)?``. A row may
be kept (cost 0), reroled to user or assistant (2) or deleted (3), and an empty
user or assistant turn may be inserted anywhere (2). Blank rows and duplicates
(role and text seen earlier) must be deleted; a truncated row (its last character
other than space is not ``.``, ``!`` or ``?``) that stays costs 1 more. Each row's
first fault of these three counts.

The parser's stack is graph-structured: after each row it holds one top per state
of the role grammar (``SHIFT``; a pair that is complete is reduced at once), and
tops that become equal are merged to the one of least (cost, audit), the audit being
the edits' initials in order. That loses nothing: two audits of one cost that end in
one state are never each other's prefix, so what follows cannot turn their order.

A conversation is never parsed by one task as a whole. Rows get places by a range
shuffle, duplicates are found by the least place of (conversation, role, digest of
the text) and marked by place, and every aligned run of ``SEGMENT`` places is parsed
from each state it could be entered in. A segment is then four by four (cost, audit),
and a conversation's segments are chained in order by one short step each. Only the
chosen audits go back to the texts, again by segment.

Defined cases: null roles and texts are one space; null turns come first; rows of one
turn are ordered by role, then by the text's digest, so repeated rows are adjacent,
and every row counts; a null conversation id is a conversation of its own; a role of
another initial, or none, must be reroled or deleted; a span of turns beyond a long
counts as the largest long; an empty table has no conversations; texts of any length
are hashed where they are read and move twice (to their places, to their segments);
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.order import with_row_number
from quire.plans.session import cut_lineage

SEGMENT = 1024
#: States: nothing yet, after a system turn, after a user turn, after a whole pair.
START, SYSTEM, USER, PAIR = range(4)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
ENDS = (START, PAIR)
#: The turn that a rerole or an insertion makes in each state.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", PAIR: "user"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ORDERED = {"su", "ua", "au"}
LONGEST = (1 << 63) - 1
#: Fixed value: the six ASCII space characters.
SPACES = " \t\n\v\f\r"

Tops = dict[int, tuple[int, str]]


def _merge(tops: Tops, state: int, cost: int, audit: str) -> None:
    if state not in tops or (cost, audit) < tops[state]:
        tops[state] = (cost, audit)


def with_inserts(tops: Tops) -> Tops:
    """The tops and what insertions reach from them; a third one in a row only comes back."""
    out = dict(tops)
    for _ in range(2):
        for state, (cost, audit) in list(out.items()):
            _merge(out, SHIFT[state, NEXT[state][0]], cost + INSERT, audit + "I")
    return out


def shift_row(tops: Tops, initial: str, fault: str) -> Tops:
    """The tops after one row; ``fault`` is ``-`` for a row that must go, ``t`` for a truncated one."""
    out: Tops = {}
    stays = TRUNCATED if fault == "t" else 0
    for state, (cost, audit) in with_inserts(tops).items():
        _merge(out, state, cost + DELETE, audit + "D")
        if fault != "-":
            if (state, initial) in SHIFT:
                _merge(out, SHIFT[state, initial], cost + stays, audit + "K")
            _merge(out, SHIFT[state, NEXT[state][0]], cost + REROLE + stays, audit + "R")
    return out


def ways(initials: str, faults: str) -> list[dict]:
    """The best edits of a run of rows from every state to every state."""
    out = []
    for entry in range(4):
        tops: Tops = {entry: (0, "")}
        for initial, fault in zip(initials, faults, strict=True):
            tops = shift_row(tops, initial, fault)
        out += [{"entry": entry, "exit": state, "cost": cost, "audit": audit} for state, (cost, audit) in tops.items()]
    return out


#: What may be inserted after the last row.
LAST = [{"entry": entry, "exit": state, "cost": cost, "audit": audit} for entry in range(4) for state, (cost, audit) in with_inserts({entry: (0, "")}).items()]


def chain(segments: Sequence[Sequence[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost through the segments' ways, and each segment's (entry, audit)."""
    best: dict[int, tuple] = {START: (0, "", None)}
    for held in (*segments, LAST):
        out: dict[int, tuple] = {}
        for way in held:
            if way["entry"] in best:
                cost, audit, path = best[way["entry"]]
                found = (cost + way["cost"], audit + way["audit"])
                if way["exit"] not in out or found < out[way["exit"]][:2]:
                    out[way["exit"]] = (*found, (path, way["entry"], way["audit"]))
        best = out
    cost, _, path = min((best[state] for state in ENDS if state in best), key=lambda way: way[:2])
    taken = []
    while path:
        path, entry, audit = path
        taken.append((entry, audit))
    (_, inserted), (entry, audit), *before = taken
    return cost, [*reversed(before), (entry, audit + inserted)]


def _ways(initials: pd.Series, faults: pd.Series) -> pd.Series:
    """Runs of few rows repeat, so each is parsed once a batch."""
    known = {key: ways(*key) for key in set(zip(initials, faults, strict=True))}
    return pd.Series([known[key] for key in zip(initials, faults, strict=True)], dtype=object)


TURNS = "array<struct<role:string,text:string>>"
WAYS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
REPORT = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string,pieces:array<struct<segment:long,entry:int,audit:string>>>"


def judged(segments: Sequence[dict]) -> dict:
    """One conversation from its segments in order."""
    gap = pairs = distinct = 0
    before = first = last = None
    for s in segments:
        joined = (before or "") + s["initials"]
        pairs += sum(joined[i : i + 2] not in ORDERED for i in range(len(joined) - 1))
        before = joined[-1:]
        distinct += s["turns"] - (last is not None and last == s["first"])
        first, last = s["first"] if first is None else first, s["last"] if s["last"] is not None else last
    if first is not None:
        gap = min(last - first + 1 - distinct, LONGEST)
    cost, path = chain([s["ways"] for s in segments])
    total = {f: int(sum(s[f] for s in segments)) for f in ("blank", "duplicate", "truncated")}
    pieces = [{"segment": s["segment"], "entry": entry, "audit": audit} for s, (entry, audit) in zip(segments, path, strict=True)]
    return total | {"gaps": gap, "illegal": pairs, "cost": cost, "audit": "".join(a for _, a in path), "pieces": pieces}


def _judged(segments: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judged(s) for s in segments], columns=["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"])


def edited(turns: Iterable[dict], entry: int, audit: str) -> list[dict]:
    """A segment's turns after its edits."""
    out, state, rows = [], entry, iter(turns)
    for edit in audit:
        if edit == "I":
            turn = {"role": NEXT[state], "text": ""}
        else:
            turn = next(rows)
            turn = {"role": NEXT[state] if edit == "R" else turn["role"], "text": turn["text"]}
        if edit != "D":
            out.append(turn)
            state = SHIFT[state, turn["role"][0]]
    return out


def _edited(turns: pd.Series, entry: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([edited(*x) for x in zip(turns, entry, audit, strict=True)], dtype=object)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) with one row a conversation,
    and the repaired turns (conv_id, segment, turns: array of role and text), by (conversation, segment)."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    placed, _ = with_row_number(rows, ["conv_id", "turn", "role", "digest", "tie"])
    placed = placed.withColumn("segment", F.floor(F.col("row") / SEGMENT))
    shown = F.rtrim("text", F.lit(SPACES))
    narrow = placed.select("conv_id", "segment", "row", "turn", "role", "digest", (shown == "").alias("is_blank"), F.right(shown, F.lit(1)).isin(".", "!", "?").alias("is_ended"))
    firsts = narrow.where(~F.col("is_blank")).groupBy("conv_id", "role", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_blank"), "b").when(F.col("is_first").isNull(), "d").when(~F.col("is_ended"), "t").otherwise(".")
    initial = F.substring("role", 1, 1)
    marked = narrow.join(firsts, "row", "left").select("conv_id", "segment", F.struct("row", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault")).alias("m"))
    held = marked.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("m")).alias("m"))
    faults = F.array_join("m.fault", "")
    numbers = F.array_distinct(F.array_compact("m.turn"))  # ascending
    count = lambda x: F.size(F.filter("m.fault", lambda f: f == x)).cast("long")
    segments = held.select(
        "conv_id",
        F.struct(
            "segment", F.array_join("m.initial", "").alias("initials"),
            count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
            F.size(numbers).cast("long").alias("turns"), F.get(numbers, F.lit(0)).alias("first"), F.get(numbers, F.size(numbers) - 1).alias("last"),
            F.pandas_udf(_ways, WAYS)(F.array_join("m.initial", ""), F.translate(faults, "bd", "--")).alias("ways"),
        ).alias("s"),
    )
    report = cut_lineage(segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("s"), _by_segment).alias("s")).select("conv_id", F.pandas_udf(_judged, REPORT)("s").alias("r")).select("conv_id", "r.*"))
    pieces = report.select(F.col("conv_id").alias("conversation"), F.explode("pieces").alias("p")).select("conversation", F.col("p.segment").alias("piece"), "p.entry", "p.audit")
    said = placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("row", "role", "text"))).alias("t"))
    met = said.join(pieces, said["conv_id"].eqNullSafe(pieces["conversation"]) & (said["segment"] == pieces["piece"]))
    plain = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return report.drop("pieces"), met.select("conv_id", "segment", F.pandas_udf(_edited, TURNS)(plain, "entry", "audit").alias("turns"))


def _by_segment(a: Column, b: Column) -> Column:
    return F.when(a["segment"] < b["segment"], -1).when(a["segment"] > b["segment"], 1).otherwise(0)


def repaired_sha256(repaired: DataFrame) -> DataFrame:
    """conv_id and the digest of ``role:text`` lines of the repaired turns."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = repaired.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", lines.alias("lines")))).alias("p"))
    return whole.select("conv_id", F.sha2(F.array_join(F.flatten("p.lines"), "\n"), 256).alias("repaired_sha256"))
