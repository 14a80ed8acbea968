"""Operator 4: document quality by Bradley-Terry pairwise ranking.

A document's raw score is a weighted sum of features of its text. A labelled good document is preferred to a labelled
bad one; the weights minimise the logistic loss of such preferences, that is of the differences of their features. The
threshold is the quantile of the raw scores of the labelled rows that best separates the two labels, and scores are
mapped to (0, 1) so that the threshold becomes 0.7.

The fit uses at most fit_rows labelled rows, those with the smallest hash of doc_id, and fit_pairs preferences among
them; scoring reads every text. Rows that repeat a doc_id, in either table, are used as they stand; null labels and
labels other than 0 and 1 are not used. If the labels hold one class only, or none, every score is 0.7. Null texts are
empty; an empty text has the features of no words. A text of any length has ten figures. Rows with equal figures are
taken by their label, so that ties do not depend on the order of arrival. An empty table gives an empty result. A null doc_id is not held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_NOT_SYMBOL = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *range(0x21), 0x2C, 0x2E, 0x7F])
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "distinct_words", "distinct_lines", "short_words", "sign_words", "stops")
_LETTERS = frozenset(bytes([b]) for b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)))
#: The score of a document at the threshold.
CUT = 0.7


def features(text: str) -> list[float]:
    """Figures of one text, in the order of FEATURES."""
    data = text.encode()
    size, words, lines = max(len(data), 1), data.split(), data.split(b"\n")
    n = max(len(words), 1)
    lengths = list(map(len, words))
    return [
        float(np.log1p(len(words))),
        sum(lengths) / n,
        len(data.translate(None, _NOT_SYMBOL)) / size,
        (len(data) - len(data.translate(None, _UPPER))) / size,
        (len(data) - len(data.translate(None, _DIGIT))) / size,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        sum([k <= 3 for k in lengths]) / n,
        sum([k == 1 and w not in _LETTERS for k, w in zip(lengths, words)]) / n,
        data.count(b".") / n,
    ]


@dataclass
class Ranker:
    """Weights of the standardised features and their squares, with the threshold and slope of the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _expanded(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, penalty: float = 1e-3, seed: int = 1) -> Ranker:
    """Newton steps on the logistic loss of feature differences, good minus bad."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        k = x.shape[1] if x.ndim == 2 and x.shape[1] else len(FEATURES)
        return Ranker(np.zeros(k), np.ones(k), np.zeros(2 * k))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _expanded(x, mean, scale)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = -(d * p[:, None]).mean(0) + penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    right = np.cumsum(y[order] == 0) / len(bad) + 1 - np.cumsum(y[order] == 1) / len(good)  # if rows up to here are rejected
    best = np.flatnonzero(right[:-1] >= right[:-1].max() - 1e-12) if len(right) > 1 else np.array([0])
    quantile = best[len(best) // 2]
    low, high = raw[order[quantile]], raw[order[min(quantile + 1, len(raw) - 1)]]
    spread = np.median(raw[good]) - np.median(raw[bad])
    return Ranker(mean, scale, w, float((low + high) / 2), float(8 / max(spread, 1e-6)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used to fit."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, fit_pairs: int = 100_000) -> Ranker:
    """A ranker of at most fit_rows labels outside the held-out rows, those with the smallest hashes of doc_id.

    Where doc_ids repeat, at most 2 * fit_rows of the labels' documents fit, those with the smallest hashes of their texts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(fit_rows)
    )

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            x = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["h", "x", "quality"])

    known = common.texts(docs).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("h"), "text", "quality")
    rows = known.mapInArrow(figures, "h long, x array<double>, quality int").orderBy("h", "quality").limit(2 * fit_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows["quality"].to_numpy(zero_copy_only=False)
    order = np.lexsort((y, *x.T))  # the fit does not depend on the order of arrival
    return fit_ranker(x[order], y[order], fit_pairs)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id and score of every whole text; higher is better, 0.7 is the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in (b.slice(i, j - i) for b in batches for i, j in common.chunks(b.column(1))):
            x = [features(t or "") for t in batch.column(1).to_pylist()]
            s = ranker.score(np.array(x, float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], schema=_SCHEMA)

    return common.texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t or "") for t in batch.column(at).cast(pa.string()).to_pylist()]
        return batch.filter(pa.array(ranker.score(np.array(x, float).reshape(-1, len(FEATURES))) >= CUT))

    at = docs.columns.index("text")
    common.bounded_batches(docs.sparkSession)
    named = docs.toDF(*("text" if i == at else f"c{i}" for i in range(len(docs.columns))))
    return named.mapInArrow(common.by_batch(lambda: run), named.schema).toDF(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
