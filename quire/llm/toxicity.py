"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities of a fixed seed lexicon and of words and word
beginnings whose presence is telling in the training rows, how many of them
stand near a second-person word, and rates of capitals, punctuation and
obfuscated words. The trees are grown here by histogram boosting on logistic
loss; lexicons are cross-fitted, so a training row's features never come from
its own label, and scores are calibrated on held-out folds by pooling adjacent
violators.

The model is fitted on a bounded sample of labelled rows: at most
``SAMPLE_ROWS`` of them, chosen by a hash of the id, with texts of at most
``SAMPLE_TEXT_BYTES``, so at most 128 MB of text reach the driver however many
rows repeat an id. The lexicons hold every telling term of that sample. Every
document is scored, whole, in time linear in its length.

Defined cases: null and empty texts have zero features and are scored like any
other; null labels are ignored and a repeated id counts as toxic if any of its
labels is; repeated rows score alike; without a label of each kind every score
is the share of toxic labels (0 without labels); an empty table gives an empty
result. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 8000
SAMPLE_TEXT_BYTES = 16 << 10
THRESHOLD = 0.3
FOLDS = 4

#: A seed lexicon of insults, and second-person words.
SEED_WORDS = frozenset("clown disgusting idiot loser moron pathetic scum stupid trash worthless".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes tú ti tuyo".split())
#: Digits and signs that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
NEAR = 5
PREFIXES = (4, 5, 6)
MIN_DOCS, MIN_ODDS = 3, 1.8
#: Words whose findings a scorer remembers; the store is emptied when full.
WORDS_KEPT = 200_000

# a match starts at the first letter of a run only, so a long run is tried once
_OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!|]++[^\W\d_]++)+")
_EDGE = string.punctuation + "«»„“”‘’…¿¡"
NAMES = ("seed_rate", "seed_kinds", "word_rate", "word_odds", "prefix_rate", "prefix_odds", "near_you", "capitals", "exclaims", "stops", "obfuscated", "obfuscated_seed", "length")


@dataclass
class Lexicon:
    """Log odds of telling words and word beginnings."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    kept: dict[str, tuple[bool, float, float]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def found(self, term: str) -> tuple[bool, float, float]:
        """(seed word, odds as a word, best odds of its beginnings), remembered."""
        if (out := self.kept.get(term)) is None:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            best = max((self.prefixes.get(term[:n], 0.0) for n in PREFIXES if len(term) >= n), default=0.0)
            out = self.kept[term] = (term in SEED_WORDS, self.words.get(term, 0.0), best)
        return out


def terms_of(text: str) -> Counter:
    """Lower-cased words without the punctuation around them, counted."""
    out: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        if word := word.strip(_EDGE):
            out[word] += n
    return out


def learn_lexicon(terms: list[Counter], toxic: np.ndarray) -> Lexicon:
    """Terms in ``MIN_DOCS`` toxic rows or more whose log odds reach ``MIN_ODDS``."""
    positives, negatives = int(toxic.sum()), int((1 - toxic).sum())

    def telling(keys_of) -> dict[str, float]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for own, label in zip(terms, toxic, strict=True):
            seen[int(label)].update(keys_of(own))
        odds = {}
        for key, a in seen[1].items():
            b = seen[0][key]
            value = math.log((a + 0.5) / (positives - a + 0.5)) - math.log((b + 0.5) / (negatives - b + 0.5))
            if a >= MIN_DOCS and value >= MIN_ODDS:
                odds[key] = value
        return odds

    return Lexicon(telling(lambda own: set(own)), telling(lambda own: {w[:n] for w in own for n in PREFIXES if len(w) >= n}))


def features(text: str | None, lexicon: Lexicon, terms: Counter | None = None) -> list[float]:
    """One number for each of ``NAMES``."""
    text = text or ""
    terms = terms_of(text) if terms is None else terms
    n = max(1, sum(terms.values()))
    seed = word = prefix = 0
    kinds, word_odds, prefix_odds, hits = 0, 0.0, 0.0, set()
    for term, count in terms.items():
        is_seed, odds, best = lexicon.found(term)
        if is_seed:
            seed += count
            kinds += 1
            hits.add(term)
        if odds:
            word += count
            word_odds += odds
            hits.add(term)
        if best:
            prefix += count
            prefix_odds += best
    near = 0
    if hits and not SECOND_PERSON.isdisjoint(terms):
        order = [w.strip(_EDGE) for w in text.lower().split()]
        at = [i for i, w in enumerate(order) if w in SECOND_PERSON]
        told = [i for i, w in enumerate(order) if w in hits]
        k = np.searchsorted(at, told)
        left = np.abs(np.array(told) - np.array(at)[np.maximum(k - 1, 0)])
        right = np.abs(np.array(told) - np.array(at)[np.minimum(k, len(at) - 1)])
        near = int((np.minimum(left, right) <= NEAR).sum())
    codes = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    veiled = _OBFUSCATED.findall(text)
    unveiled = sum(w.lower().translate(LOOKALIKE).replace("*", "") in SEED_WORDS for w in veiled)
    return [
        100 * seed / n, kinds, 100 * word / n, word_odds, 100 * prefix / n, prefix_odds, 100 * near / n,
        capitals / n, (text.count("!") + text.count("?")) / n, (text.count(".") + text.count(",")) / n,
        len(veiled) / n, unveiled, math.log1p(n),
    ]


@dataclass
class Trees:
    """Boosted trees in level order; ``cuts`` are thresholds on raw features."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for which, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Histogram gradient boosting on logistic loss."""
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(depth, math.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(x), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        which, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            local = node - start
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                at = local * (bins + 1) + binned[:, j]
                gs = np.bincount(at, g, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(at, h, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge))[:, : len(e)]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i], which[start + i], cut[start + i] = top[i], j, e[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        model.features.append(which)
        model.cuts.append(cut)
        model.leaves.append(leaf)
        margin += leaf[at]
    return model


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (score, share) of a non-decreasing map."""
    values, at = np.unique(scores, return_inverse=True)  # equal scores are one point from the start
    blocks: list[list[float]] = []  # sum of labels, rows, first score, last score
    for s, total, n in zip(values, np.bincount(at, y), np.bincount(at), strict=True):
        blocks.append([float(total), float(n), s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    knots = [(s, total / n) for total, n, low, high in blocks for s in sorted({low, high})]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    share: float
    lexicon: Lexicon = field(default_factory=Lexicon)
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores in [0, 1]; a trace of the margin keeps order within a plateau."""
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        flat = np.interp(margin, *self.knots)
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """A model of labelled texts, in the given order."""
    toxic = np.asarray(toxic, dtype=np.int64)
    model = Model(float(toxic.mean()) if len(toxic) else 0.0)
    if len(toxic) < 2 * FOLDS or len(np.unique(toxic)) < 2:
        return model
    terms = [terms_of(t or "") for t in texts]
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(texts), len(NAMES)))
    for f in range(FOLDS):
        rest = np.flatnonzero(fold != f)
        lexicon = learn_lexicon([terms[i] for i in rest], toxic[rest])
        for i in np.flatnonzero(fold == f):
            x[i] = features(texts[i], lexicon, terms[i])
    held = np.zeros(len(texts))
    for f in range(FOLDS):
        held[fold == f] = grow(x[fold != f], toxic[fold != f]).margin(x[fold == f])
    model.lexicon = learn_lexicon(terms, toxic)
    model.trees, model.knots = grow(x, toxic), isotonic(held, toxic)
    return model


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text 2 modulo 4? A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "toxic").where(~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most ``rows`` pairs of numbers: the limit bounds what is broadcast
    sample = docs.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic")
    # an order of ids unrelated to their size; repeated ids cannot make it more than ``rows`` texts
    found = sample.orderBy(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")), "doc_id", F.xxhash64("text")).limit(rows).collect()
    return fit([r[1] for r in found], np.array([r[2] for r in found], dtype=np.int64))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([t if isinstance(t, str) else None for t in texts]))

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
