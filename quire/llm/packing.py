"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most ``CAPACITY``: an end id closes each
document and only longer ones are cut, the first piece taking the remainder.
What is left to decide depends on the pieces' lengths alone, so the histogram
of lengths (at most ``CAPACITY`` numbers) is all that reaches the driver.

A configuration is a multiset of lengths that fits one sequence. The linear
program (cover every length's count with the fewest configurations) is solved
by multiplicative weights: the prices of lengths grow where the plan covers
little, and a knapsack dynamic program finds the configurations worth most at
the current prices. In one round no length is covered by more than ``STEP`` of
its count, and lengths covered far beyond the others leave the knapsack. The
averaged plan is scaled and rounded to whole configurations by running sums, so
that roundings cancel out among configurations of like pieces. Most pieces come
through configurations; those that rounding leaves are packed best-fit from the
largest down, into what room configurations leave and into new sequences.

The plan is a list of runs: pieces of one length with ranks in [a, b) go to
sequences s, s+1, ... at one offset. A piece finds its place by binary search
with its rank among the pieces of its length; ranks come from counts per
partition, so no length, however frequent, meets in one task.

Defined cases: a null or empty text is its end id alone; texts of any length
are cut; repeated rows are packed separately; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.session import cut_lineage

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of encoded words a worker keeps, and what a word takes beside its text and ids; the store is emptied when full.
KEPT_BYTES, WORD_BYTES = 24 << 20, 200
#: Most that one round of multiplicative weights covers of a length's count.
STEP = 0.05
#: Weight below which a length is left out of the knapsack.
LEAST_WEIGHT = 0.01
#: Plans tried in turn, the fewest sequences win: rounds of weights, and share of the best worth within which a configuration is used.
PLANS = ((80, 0.001), (160, 0.001), (300, 0.05))
#: Below this code point a word's characters are classed alike by both encoders.
PLAIN_BELOW = "\u0250"
#: Texts tokenised together at most, by count and by characters.
TEXTS, CHARS = 128, 1 << 19

_DOUBLE = re.compile(r" (?:\s|\Z)")
_UNSAFE = re.compile(r"\s \s|\s \Z")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quick_encoder(path: str) -> Callable[[str], list[int]]:
    """The encoder of a rank table (lines of base64 bytes and rank)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_sizes(path: str) -> np.ndarray:
    """Bytes of every token of a rank table."""
    import base64

    with open(path, "rb") as lines:
        held = [(int(rank), len(base64.b64decode(word))) for word, rank in map(bytes.split, lines)]
    sizes = np.zeros(max(rank for rank, _ in held) + 1, dtype=np.int64)
    for rank, size in held:
        sizes[rank] = size
    return sizes


class WordCache:
    """Byte-level BPE of whole texts, remembering the ids of space-separated words.

    New words go to the rank-table encoder of the same vocabulary, which is
    quicker on short strings, unless they hold a special token's opening or a
    character from ``PLAIN_BELOW`` on; those go to the tokenizer itself. Words
    after a space are encoded as one text, and the ids dealt by their bytes.

    The pre-tokenizer never joins what stands on both sides of a space that no
    other white space precedes or follows in a run of three, or that ends no
    text after white space; such texts are encoded word by word (a word with
    its leading space), all others whole.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.path = path
        self.kept: dict[str, bytes] = {}  # ids of a word after a space
        self.kept_bytes = 0
        self.quick = quick_encoder(ranks_path) if ranks_path else None
        self.sizes = token_sizes(ranks_path) if ranks_path else None

    @functools.cached_property
    def tokenizer(self):
        """Read when the first text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        if not self.quick:
            return self._encode(words)
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if "<|" not in w and (w.isascii() or max(w) < PLAIN_BELOW)]
        for i, x in zip(plain, self._encode_plain([words[i] for i in plain]), strict=True):
            out[i] = x
        slow = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(slow, self._encode([words[i] for i in slow]), strict=True):
            out[i] = x
        return out

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of words by the rank table; those that all follow a space make a text that is encoded at once."""
        whole = "".join(words)
        if all(w[:1] == " " for w in words) and not (_DOUBLE.search(whole) and _UNSAFE.search(whole)):
            ids = np.array(self.quick(whole), dtype="<u4")
            stops = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
            at = np.cumsum(self.sizes[ids])
            ends = np.searchsorted(at, stops)
            if len(words) and len(at) and at[-1] == stops[-1] and (at[ends] == stops).all():
                raw, ends = ids.tobytes(), (4 * (ends + 1)).tolist()
                return [raw[a:b] for a, b in zip([0, *ends], ends)]
        return [array("I", self.quick(w)).tobytes() for w in words]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [] if not texts else [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit unsigned integers."""
        out: list[bytes | None] = [None] * len(texts)
        words: dict[int, list[str]] = {}
        missing: set[str] = set()
        if self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        kept = self.kept
        for i, text in enumerate(texts):
            if _DOUBLE.search(text) and _UNSAFE.search(text):
                out[i] = self._encode([text])[0]
                continue
            words[i] = split = text.split(" ")
            missing.update(set(split[1:]).difference(kept))
        new = list(missing)
        for word, ids in zip(new, self._encode_words([" " + w for w in new]), strict=True):
            kept[word] = ids
            self.kept_bytes += len(word) + len(ids) + WORD_BYTES
        firsts = list({split[0]: None for split in words.values() if split[0]})
        first = {"": b""} | dict(zip(firsts, self._encode_words(firsts), strict=True))
        known = kept.__getitem__
        for i, split in words.items():
            out[i] = first[split[0]] + b"".join(map(known, split[1:]))
        return out


@functools.lru_cache(maxsize=1)
def word_cache(path: str, ranks_path: str | None) -> WordCache:
    """One encoder for all tasks of a worker process."""
    return WordCache(path, ranks_path)


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n % capacity or min(capacity, n)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def piece_table(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pieces(texts: list[str], cache: WordCache) -> dict[str, list]:
        rows: dict[str, list] = {name: [] for name in ("row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
        closing = end_id.to_bytes(4, "little")
        for i, raw in enumerate(cache.encode(texts)):
            raw += closing
            for k, (start, length) in enumerate(pieces_of(len(raw) // 4, capacity)):
                own = raw[4 * start : 4 * (start + length)]
                for name, value in zip(("row", "piece", "start", "length", "ids_crc32"), (i, k, start, length, zlib.crc32(own)), strict=True):
                    rows[name].append(value)
                if with_ids:
                    rows["ids"].append(np.frombuffer(own, dtype="<u4").astype(np.int32))
        return rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path, ranks_path)
        types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            at = 0
            while at < len(sizes):
                stop, size = at, 0
                while stop < len(sizes) and stop - at < TEXTS and (stop == at or size + sizes[stop] <= CHARS):
                    size += sizes[stop]
                    stop += 1
                texts = [t or "" for t in batch.column("text").slice(at, stop - at).to_pylist()]
                rows = pieces(texts, cache)
                # ids are taken as they came: a null beside a long must not turn the column into doubles
                own = batch.column("doc_id").slice(at, stop - at).take(pa.array(rows.pop("row"), pa.int64()))
                values = [pa.array(v, types.get(name, pa.int64())) for name, v in rows.items()]
                yield pa.RecordBatch.from_arrays([own, *values], names=["doc_id", *rows])
                at = stop

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def price_configurations(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most worth that fits each room, and the last length it adds (-1: none)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    stops = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if stop := stops[room]:
            worth = best[room - lengths[:stop]] + prices[:stop]
            k = int(worth.argmax())
            if worth[k] > best[room]:
                best[room], pick[room] = worth[k], k
    return best, pick


def traced(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """Indexes of the lengths that the knapsack puts into ``room``."""
    out = []
    while room > 0:
        k = int(pick[room])
        if k < 0:
            room -= 1
        else:
            out.append(k)
            room -= int(lengths[k])
    return out


def fractional_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, slack: float) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations (index of length, how many) and how often each is used, for ``counts`` in all.

    Every round prices the lengths by how little of their count is covered and
    solves one knapsack. Its table gives, for each length, the best configuration
    holding it; all within ``slack`` of the best are near-optimal answers and are
    used, least covered lengths first, as far as the round's allowances go.
    """
    covered = np.zeros(len(lengths))
    plan: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for _ in range(rounds):
        share = covered / counts
        weights = np.exp(-(share - share.min()) / STEP)
        live = np.flatnonzero(weights > LEAST_WEIGHT)
        sizes, prices = lengths[live], weights[live] * lengths[live]
        prices = prices / prices.max()
        best, pick = price_configurations(prices, sizes, capacity)
        allowed = STEP * counts
        used_up = 0.05 * allowed / np.maximum(1, capacity // lengths)
        good = np.flatnonzero(prices + best[capacity - sizes] >= (1 - slack) * best[capacity])
        for k in good[np.argsort(share[live][good], kind="stable")].tolist():
            held: dict[int, int] = defaultdict(int)
            for j in (k, *traced(pick, sizes, capacity - int(sizes[k]))):
                held[int(live[j])] += held[int(live[j])] < counts[live[j]]
            if all(allowed[j] > 0 and allowed[j] >= n * used_up[j] for j, n in held.items()):
                size = min(allowed[j] / n for j, n in held.items())
                plan[tuple(sorted(held.items()))] += size
                for j, n in held.items():
                    covered[j] += n * size
                    allowed[j] -= n * size
    scale = counts.sum() / max(covered.sum(), 1e-300)
    return {c: n * scale for c, n in plan.items()}


#: A run: ``n`` pieces of ``length`` with ranks from ``rank`` on, in sequences from ``sequence`` on, at ``offset``.
RUN = np.dtype([("length", "i8"), ("rank", "i8"), ("n", "i8"), ("sequence", "i8"), ("offset", "i8")])


class Placement:
    """Runs under construction: how many pieces of each length are left, and their next rank."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = {k: v for k, v in histogram.items() if v > 0}
        self.used: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.capacity = capacity
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences

    def put(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], times, sequence, offset))
        self.used[length] += times
        self.left[length] -= times

    def open(self, config: list[tuple[int, int]], times: int) -> None:
        """``times`` new sequences of one configuration."""
        first, offset = self.sequences, 0
        self.sequences += times
        for length, n in config:
            for _ in range(n):
                self.put(length, times, first, offset)
                offset += length
        if offset < self.capacity:
            self.rooms[self.capacity - offset].append((first, times))


def best_fit_rest(at: Placement) -> None:
    """Packs what is left best-fit, whole runs of equal lengths at a time, from the largest down."""
    rooms = at.rooms
    for length in sorted((k for k, v in at.left.items() if v), reverse=True):
        while n := at.left[length]:
            room = min((r for r in rooms if r >= length), default=0)
            if room:
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                take = min(n, many)
                at.put(length, take, first, at.capacity - room)
                if many > take:
                    rooms[room].append((first + take, many - take))
                if room > length:
                    rooms[room - length].append((first, take))
            else:
                fit = min(at.capacity // length, n)
                at.open([(length, fit)], n // fit)


def open_planned(at: Placement, rounds: int, slack: float) -> int:
    """Plans the pieces left and opens the rounded configurations; returns how many pieces they hold."""
    lengths = np.array(sorted(k for k, v in at.left.items() if v > 0), dtype=np.int64)
    if not len(lengths):
        return 0
    plan = fractional_plan(lengths, np.array([at.left[int(k)] for k in lengths], dtype=float), at.capacity, rounds, slack)
    # neighbours in this order hold the same large pieces, so their roundings cancel out
    order = sorted(([(int(lengths[k]), n) for k, n in sorted(config, reverse=True)], times) for config, times in plan.items())
    placed, due, taken = 0, 0.0, 0
    for held, times in reversed(order):
        due += times
        want, taken = int(due + 0.5) - taken, int(due + 0.5)
        whole = min(want, *(at.left[k] // n for k, n in held))
        if whole > 0:
            at.open(held, whole)
            placed += whole * sum(n for _, n in held)
    return placed


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int, int]:
    """The runs that place every piece, sorted by (length, rank), the sequences, and the pieces that came through configurations.

    Pieces of full length are a configuration of their own. Each of ``PLANS`` is
    rounded and its rest packed best-fit; the fewest sequences win.
    """

    def rounded(rounds: int, slack: float) -> tuple[Placement, int]:
        at = Placement(histogram, capacity)
        placed = at.left.get(capacity, 0)
        if placed:
            at.open([(capacity, 1)], placed)
        placed += open_planned(at, rounds, slack)
        best_fit_rest(at)
        return at, placed

    at, placed = min((rounded(*plan) for plan in PLANS), key=lambda p: p[0].sequences)
    out = np.array(at.runs, dtype=RUN)
    return out[np.lexsort((out["rank"], out["length"]))], at.sequences, placed


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """``piece_table`` with sequence_id and offset of every piece."""
    pieces = piece_table(docs, path, capacity, end_id, with_ids, ranks_path).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    pieces = cut_lineage(pieces)
    by_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    runs, _, _ = plan_runs(histogram, capacity)
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_at")) - 1
    ranked = pieces.withColumn("_nth", nth).join(starts, ["length", "_part"])
    shared = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by rounds, lengths and capacity, however large the corpus

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        known = shared.value
        k = np.searchsorted(known["length"] << 44 | known["rank"], length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        found = known[k]
        return pd.DataFrame({"sequence_id": found["sequence"] + (rank.to_numpy() - found["rank"]), "offset": found["offset"]})

    placed = ranked.withColumn("_place", place("length", F.col("_start") + F.col("_nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "_place.sequence_id", "_place.offset")
