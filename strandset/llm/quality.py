"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are counts over its bytes and words. Each feature is cut into quantile bins;
rounds of boosting go through the features in turn, and each step adds a shallow tree on one
feature alone, at a low rate, to that feature's table of bin scores. Pairs of features are then
ranked by what a 2-D table over coarse bins takes off the remaining loss, and the best ones are
boosted in turn likewise. A score is the sum of table entries, looked up for a whole batch at
once, and a logistic map.

Training takes labelled rows up to `max_rows` (those whose doc_id has the smallest CRC-32), so
what comes to the driver is bounded by that parameter times the number of features. Scoring reads
every whole text, in one pass without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, table, word_hashes

REJECT_BELOW = 0.7
FEATURES = ["bytes", "letters", "upper", "digits", "marks", "exclaims", "bars", "stops", "spaces", "lines", "word_len", "long_words", "distinct_words", "top_word", "repeated_lines", "marked_words", "shouted_words", "non_ascii"]


def _class(*codes) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in codes:
        out[[*c]] = True
    return out


_UPPER, _DIGIT = _class(range(65, 91)), _class(range(48, 58))
_LETTERS = _class(range(65, 91), range(97, 123), range(128, 256))
_MARKS = _class(b"#$%&*@^~<>=+\\_{}[]/")
_STOPS = _class(b".,;:?")


def features(text: str) -> list[float]:
    """Shares and means over a whole text; all zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, letters = len(raw), max(1, n[_LETTERS].sum())
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.ones(1, np.int64)
    hashed = np.sort(word_hashes(text.lower().encode("utf-8", "surrogatepass")))
    edge = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1], True]) if len(hashed) else np.array([0, 1])
    runs = np.diff(edge)
    lines = [x for x in text.split("\n") if x]
    tails = sum(1 for w in words if w[-1] in "#$%&*@^~<>=+!|")
    shout = sum(map(str.isupper, words))
    return [
        float(np.log1p(total)), letters / total, n[_UPPER].sum() / letters, n[_DIGIT].sum() / total, n[_MARKS].sum() / total, n[33] / total, n[124] / total, n[_STOPS].sum() / total, n[32] / total,
        len(lines) / total, float(lengths.mean()), float((lengths > 20).mean()), len(runs) / max(1, len(hashed)), float(runs.max()) / max(1, len(hashed)), 1 - len(set(lines)) / max(1, len(lines)), tails / max(1, len(words)), shout / max(1, len(words)), n[128:].sum() / total,
    ]


@dataclass
class AdditiveModel:
    """Tables of bin scores for features and pairs of features."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (cut, scores) in enumerate(zip(self.cuts, self.single)):
            out += scores[np.searchsorted(cut, x[:, j], "right")]
        for a, b, scores in self.pairs:
            out += scores[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Scores of a shallow tree on ordered bins: the best cut is made again and again until there are `leaves` runs."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    ends = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(ends, ends[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (gain[k], int(at[k]))
        if best[1] is None:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(ends, ends[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 2.0) -> AdditiveModel:
    """Boost tables for features in turn, then for the `pairs` pairs that take most off the loss."""
    m = AdditiveModel()
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    m.bias = float(np.log(share / (1 - share)))
    m.cuts = [_cuts(x[:, j], bins) if n else np.zeros(0) for j in range(width)]
    m.coarse = [_cuts(x[:, j], coarse_bins) if n else np.zeros(0) for j in range(width)]
    m.single = [np.zeros(len(c) + 1) for c in m.cuts]
    if not n:
        return m
    at = [np.searchsorted(m.cuts[j], x[:, j], "right") for j in range(width)]
    margin = np.full(n, m.bias)

    def residue() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            grad, hess = residue()
            step = rate * _tree(np.bincount(at[j], grad, len(m.single[j])), np.bincount(at[j], hess, len(m.single[j])), leaves, ridge)
            m.single[j] += step
            margin += step[at[j]]
    small = [np.searchsorted(m.coarse[j], x[:, j], "right") for j in range(width)]
    grad, hess = residue()
    gains = []
    for a, b in combinations(range(width), 2):
        cell, size = small[a] * (len(m.coarse[b]) + 1) + small[b], (len(m.coarse[a]) + 1) * (len(m.coarse[b]) + 1)
        gains.append((-float((np.bincount(cell, grad, size) ** 2 / (np.bincount(cell, hess, size) + ridge)).sum()), a, b))
    m.pairs = [(a, b, np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))) for _, a, b in sorted(gains)[:pairs]]
    for _ in range(pair_rounds):
        for a, b, scores in m.pairs:
            grad, hess = residue()
            cell = small[a] * scores.shape[1] + small[b]
            g, h = (np.bincount(cell, v, scores.size).reshape(scores.shape) for v in (grad, hess))
            # One cut of the first feature, and on either side a tree on the second.
            sums = np.cumsum(g.sum(1))[:-1], np.cumsum(h.sum(1))[:-1]
            gain = sums[0] ** 2 / (sums[1] + ridge) + (g.sum() - sums[0]) ** 2 / (h.sum() - sums[1] + ridge)
            k = int(gain.argmax()) + 1 if len(gain) else len(g)
            step = np.zeros(scores.shape)
            for rows in (slice(0, k), slice(k, None)):
                if len(g[rows]):
                    step[rows] = rate * _tree(g[rows].sum(0), h[rows].sum(0), leaves, ridge)
            scores += step
            margin += step.ravel()[cell]
    return m


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of the whole text (null: an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], ["doc_id", "x"])

    return documents(docs).mapInArrow(run, "doc_id long, x array<double>")


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold (crc32 of doc_id as text, mod 4, is 2).

    Rows without a label, or with one other than 0 and 1, have no part, nor have documents that are labelled both;
    of more than max_rows, those with the smallest CRC-32 of doc_id are taken, a sample that doesn't depend on
    order. Where a doc_id has several texts each is a row, 2 * max_rows at most in the same order. Without rows
    the model scores all texts alike.
    """
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 2))
    by_hash = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    mine = mine.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("y").alias("_least")).where("y = _least").drop("_least").orderBy(by_hash, "doc_id").limit(max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id")  # at most max_rows rows
    rows = sorted(featured(chosen).join(F.broadcast(mine), "doc_id").select("doc_id", "x", "y").orderBy(by_hash, "doc_id", "x").limit(2 * max_rows).collect())
    return fit(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each input row, empty and null texts too."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(_matrix(t.as_py() for t in b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = documents(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they had.

    Each row is judged by its whole text alone, a null one as empty: equal texts fare alike, rows that repeat stay
    as often as they were, extra columns are carried along, and an empty table gives an empty table.
    """
    sent = spark.sparkContext.broadcast(train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(_matrix(texts)))

    return docs.where(scored(F.coalesce(F.col("text"), F.lit(""))) >= REJECT_BELOW)
