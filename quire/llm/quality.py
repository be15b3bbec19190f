"""Quality rules as a short-circuit cascade, native.

Each rule is a boolean expression over a document's measures. On a bounded
random sample the cascade times every rule, on the measures it will be given, and counts what it rejects, then
orders the rules by rejection per cost and chains them in one CASE, so a
document stops at the first rule that rejects it and later measures are not
taken. A text is split into words once for all rules. The order never changes a
verdict, only its cost.

Defined cases: a null text is the empty text (no words, rejected as too short);
very long texts are measured whole; repeated rows are judged alike; an empty
table gives an empty result and the rules keep their given order; a column
named like a measure is not touched unless it is passed as a prepared measure.
Three-word windows are compared by 64-bit hash within one document.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import indexes, let, words_of

#: The sample that orders the rules: rows expected (at most four times as many are read), seed, and bytes of a text in it; and how often a rule is timed.
SAMPLE_ROWS = 256
SAMPLE_SEED = 11
SAMPLE_TEXT_BYTES = 64 << 10
TIMES = 3

WINDOW = 3


def _repeat_words(w: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more."""

    def repeated(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        at = F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    windows = F.transform(indexes(F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    return let(windows, repeated)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Named measures of a text and its words, each a lazy expression."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(text, r"[#*$%&|<>]").cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "n_capitals": _count(text, r"\p{Lu}").cast("long"),
    }


def measured(text: Column, names: tuple[str, ...]) -> Column:
    """struct of the named measures, the words split once."""
    return let(words_of(text), lambda w: F.struct(*[c.alias(n) for n, c in measures(text, w).items() if n in names]))


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the measures by name and tells whether a document is rejected."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


def rules(min_words: int = 50) -> tuple[Rule, ...]:
    """The production rules; a document needs ``min_words`` words."""
    return (
        Rule("few_words", lambda m: m["n_words"] < min_words),
        Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
        Rule("symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
        Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
        Rule("capitals", lambda m: 2 * m["n_capitals"] > m["word_chars"]),
        Rule("word_length", lambda m: (m["word_chars"] > 15 * m["n_words"]) | (2 * m["word_chars"] < 3 * m["n_words"])),
    )


RULES = rules()


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prepared: dict[str, Column] | None = None, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) on a random sample of about ``rows`` texts from all partitions.

    The sample is seeded, holds at most ``4 * rows`` texts of at most
    ``SAMPLE_TEXT_BYTES``, orders rules and decides nothing else. A rule's seconds are the median of ``TIMES`` runs, beyond what
    all rules share (reading, and splitting the words unless measures are
    prepared); prepared measures are timed as ready columns.
    """
    prepared = prepared or {}
    total = docs.count()
    if total == 0:
        return [(r.name, 1.0, 0.0) for r in rules]
    drawn = docs.select("text").sample(min(1.0, rows / total), SAMPLE_SEED) if total > rows else docs.select("text")
    sample = drawn.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES).limit(4 * rows).collect()
    local = docs.sparkSession.createDataFrame([(r[0],) for r in sample], "text string").coalesce(1)
    if prepared:
        taken = local.select("text", measured(F.col("text"), tuple(prepared)).alias("m"))
        ready = taken.select("text", *[F.col(f"m.{n}").alias(f"_{n}") for n in prepared])
        local = docs.sparkSession.createDataFrame([tuple(r) for r in ready.collect()], ready.schema).coalesce(1)
    known = {n: F.col(f"_{n}") for n in prepared}

    def timed(fails: Callable[[dict[str, Column]], Column]) -> tuple[float, int]:
        query = local.select(F.count_if(_with_words(known, lambda w: fails(measures(F.col("text"), w) | known))).alias("n"))
        query.collect()
        took = []
        for _ in range(TIMES):
            began = time.perf_counter()
            n = query.collect()[0][0]
            took.append(time.perf_counter() - began)
        return median(took), n

    least, _ = timed(lambda m: m["n_words"] < 0)
    out = []
    for rule in rules:
        seconds, n = timed(rule.fails)
        out.append((rule.name, max(seconds - least, 1e-4), n / max(1, len(sample))))
    return out


def _with_words(known: dict[str, Column], judge: Callable[[Column], Column]) -> Column:
    """``judge`` of the text's words, which are split only if a measure of them is not known."""
    split = not known.keys() >= {"n_words", "word_chars", "n_repeat_words"}  # the others read the text
    return let(words_of(F.col("text")), judge) if split else judge(F.array().cast("array<string>"))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prepared: dict[str, Column] | None = None) -> tuple[Rule, ...]:
    """The rules by rejection per cost, best first; ties keep the given order."""
    rate = {name: share / seconds for name, seconds, share in estimate(docs, rules, prepared)}
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def cascade(rules: tuple[Rule, ...], by: dict[str, Column]) -> Column:
    """Name of the first rule, in the given order, that rejects; null when none does."""
    out = None
    for rule in rules:
        out = F.when(rule.fails(by), rule.name) if out is None else out.when(rule.fails(by), rule.name)
    return out.otherwise(F.lit(None).cast("string"))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prepared: dict[str, Column] | None = None, column: str = "failed_rule") -> DataFrame:
    """``docs`` with the first rejecting rule in ``column`` (null: kept).

    ``prepared`` names measures that ``docs`` already has as columns.
    """
    order, known = ordered(docs, rules, prepared), prepared or {}
    return docs.withColumn(column, _with_words(known, lambda w: cascade(order, measures(F.col("text"), w) | known)))


def drop_rejected(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("text"))
    return judge_quality(rows, rules).where("failed_rule IS NULL").select("doc.*")
