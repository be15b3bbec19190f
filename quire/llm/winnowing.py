"""Document fingerprints by winnowing, native.

A text's words (A-Z and other capitals lower-cased) are hashed, and the hashes
of ``GRAM`` consecutive words are combined by a cyclic polynomial: each word's
hash is rotated by its distance from the gram's end and all are XORed. Grams
are built up (1, 2, then 3 words), so a gram reuses what its parts computed. Of every ``WINDOW`` consecutive grams the least is kept, the
rightmost on ties, with its position; the window minima are doubled likewise.
Two texts that share ``WINDOW + GRAM - 1`` words in a row share a fingerprint.

The next document comes from one shuffle: ids are cut into buckets at sampled
quantiles, as many as the rows ask for, a bucket's first rows are also sent, marked, to the bucket before
(the first bucket's to the last), and each row looks one row ahead.

Defined cases: a null text is the empty text; a text without words has the
empty fingerprint, and two empty fingerprints are alike (1.0); fewer than
``GRAM`` words make one gram, fewer than ``WINDOW`` grams one window; null ids
come first; rows of one id are ordered by their text's hash; a single document
is its own next; an empty table gives an empty result; extra columns are
ignored. ``doc_id`` is an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import let, words_of
from quire.plans.session import shuffle_width

#: Fixed by the steps of ``grams`` and ``winnow``: words of a gram, grams of a window.
GRAM = 3
WINDOW = 4
#: Buckets per shuffle partition at least, and rows of a bucket at most, about; a bucket's rows are sorted together.
BUCKETS_EACH, BUCKET_ROWS = 4, 50_000


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _overlapped(left: Column, right: Column, shift: int, f) -> Column:
    """f(left[i], right[i + shift]) wherever both exist."""
    n = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - shift))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), f)


def grams(words: Column) -> Column:
    """Hashes of all ``GRAM``-word grams in order; of fewer words, one gram."""

    def rolled(h: Column) -> Column:
        pair = lambda x, by: _overlapped(x, x, by, lambda a, b: _rotated(a, by).bitwiseXOR(b))
        return let(pair(h, 1), lambda two: _overlapped(two, h, 2, lambda a, b: _rotated(a, 1).bitwiseXOR(b)))

    short = lambda w: F.array(F.xxhash64(F.array_join(w, " ")))
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < GRAM, short(w)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), rolled)),
    )


def winnow(text: Column) -> Column:
    """struct(positions, hashes) of the kept grams, by position."""
    least = lambda a, b: F.when(a["h"] < b["h"], a).otherwise(b)
    double = lambda m, by: _overlapped(m, m, by, least)

    def minima(m: Column) -> Column:
        one = F.array(F.aggregate(m, F.element_at(m, 1), least))
        return F.when(F.size(m) == 0, F.slice(m, 1, 0)).when(F.size(m) < WINDOW, one).otherwise(let(double(m, 1), lambda two: double(two, 2)))

    def kept(g: Column) -> Column:
        marked = F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        at = F.array_distinct(F.transform(let(marked, minima), lambda m: m["p"]))
        return let(at, lambda p: F.struct(p.alias("positions"), F.transform(p, lambda i: F.get(g, i)).alias("hashes")))

    return let(grams(words_of(F.lower(text))), kept)


def shown(fp: Column) -> Column:
    """``position:hash`` of each kept gram, space-joined; the hash in hexadecimal."""
    return F.array_join(F.zip_with(fp["positions"], fp["hashes"], lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.hex(h)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 if both are empty."""
    sets = F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))
    shared = lambda s: let(
        F.size(F.array_intersect(s["a"], s["b"])),
        lambda n: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, 1.0).otherwise(n / (F.size(s["a"]) + F.size(s["b"]) - n)),
    )
    return let(sets, shared).cast("double")


def _bucket_starts(docs: DataFrame) -> tuple[list[int], bool]:
    """First id of each bucket, ascending, and whether any id is null."""
    n = max(BUCKETS_EACH * shuffle_width(docs.sparkSession), -(-docs.count() // BUCKET_ROWS))
    cuts = [i / n for i in range(1, n)]
    least, nulls, found = docs.select(F.min("doc_id"), F.max(F.col("doc_id").isNull()), F.percentile_approx("doc_id", cuts, max(10_000, 4 * n))).first()
    return sorted({x for x in [least, *(found or [])] if x is not None}), bool(nulls)


def _array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(doc_id: Column, starts: list[int]) -> Column:
    """How many starts after the first are at most ``doc_id``, in two steps of about sqrt(n)."""
    rest = starts[1:]
    if not rest:
        return F.lit(0)
    width = max(1, int(len(rest) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    blocks = [rest[i : i + width] for i in range(0, len(rest), width)]
    block = below(_array([b[0] for b in blocks]))
    inner = F.split(F.element_at(F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";"), block), ",").cast("array<bigint>")
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + below(inner))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, next_text, ghost, and the window that orders the rows; rows with ``ghost`` = 1 only look ahead."""
    starts, nulls = _bucket_starts(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(_bucket(F.col("doc_id"), starts), F.lit(0)))
    firsts = F.element_at(_array(starts), F.col("bucket") + 1) if starts else F.lit(None).cast("long")
    is_first = F.when(F.col("bucket") > 0, F.col("doc_id") == firsts).otherwise(F.col("doc_id").isNull() if nulls else F.col("doc_id") == firsts)
    own = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, len(starts)))).alias("bucket"), F.lit(1).alias("ghost"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.inline(F.when(is_first, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "tie")
    return rows.withColumn("next_text", F.lead("text").over(order)), order


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next of every row.

    The edited text is the text with its last half replaced by the beginning of
    the next document's.
    """
    rows, order = with_next(docs)
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "ghost", "doc_id", "tie", n.cast("long").alias("n_chars"), "text", F.when(F.col("ghost") == 0, edited).alias("edited"))
    rows = rows.select(
        "bucket", "ghost", "doc_id", "tie", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow(F.col("text")).alias("fp"),
        winnow(F.col("edited")).alias("edited_fp"),
    )
    rows = rows.withColumn("next_hashes", F.lead("fp.hashes").over(order)).where("ghost = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp.hashes"), F.col("edited_fp.hashes")).alias("near_edited"),
        likeness(F.col("fp.hashes"), F.col("next_hashes")).alias("near_next"),
    )
