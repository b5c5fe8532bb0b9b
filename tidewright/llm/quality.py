"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics are counted once. Random Fourier features of the standardised statistics approximate a Gaussian
kernel; each partition sums its part of the normal equations, and the sums are added up by row of the matrix, so
that only one matrix of fixed size reaches the driver. Labelled rows with remainder 4 calibrate, the other
training rows fit; held-out rows are used for neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents, labels, opened, share, split_remainder, written
from tidewright.llm.text_stats import COLUMNS, with_counts

FEATURES, BINS = 256, 2000


def statistics(counts: np.ndarray) -> np.ndarray:
    """Statistics of documents from the counts of COLUMNS, one row each."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COLUMNS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    share = lambda x, n: np.log1p(100 * x / n)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, share(c["n_symbols"], chars), share(c["n_dup_lines"], lines), share(c["n_repeat_words"], words),
        np.log1p(words / lines), share(c["n_upper"], chars), share(c["n_digits"], chars), share(c["n_punct"], chars), share(c["n_high"], chars),
        c["n_distinct"] / words, share(c["n_exclaim"], words), share(c["n_long"], words),
    ])


class KernelRidge:
    """Ridge regression on random Fourier features of standardised statistics, and a monotone step to probabilities."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5) -> None:
        rng, d = np.random.default_rng(seed), len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-6, spread, 1.0)
        self.freq, self.phase = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -4, 4)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -0.5, 1.5)

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: centre and level of each pooled block, for x ascending."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([yi * wi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS]).reshape(-1, len(COLUMNS))


def train(counts: DataFrame, marks: DataFrame, ridge: float = 1e-3) -> KernelRidge:
    """counts: doc_id and COLUMNS; marks: doc_id, quality. Repeated ids take the highest label. Without labels, scores are 0.5."""
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).dropna().filter(split_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = written(counts.join(marks, "doc_id").withColumn("calibrate", split_remainder("doc_id", 5) == 4).select("calibrate", "y", *COLUMNS))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(statistics(np.zeros((1, len(COLUMNS))))[0])))
        for b in batches:
            s = statistics(_matrix(b))
            total += np.stack([np.full(s.shape[1], len(s)), s.sum(axis=0), (s**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names=["i", "n", "s", "q"])

    m = rows.mapInArrow(moments, "i long, n double, s double, q double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nsq"]).toArrow().sort_by("i")
    n, s, q = (m.column(c).to_numpy() for c in "nsq")
    if not len(n) or n[0] == 0:
        model = KernelRidge(np.zeros(len(statistics(np.zeros((1, len(COLUMNS))))[0])), np.ones(len(statistics(np.zeros((1, len(COLUMNS))))[0])))
        model.levels = np.array([0.5, 0.5])
        return model
    model = KernelRidge(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))
    shared = share(counts.sparkSession, model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros((FEATURES + 1, FEATURES + 2)), opened(shared)
        for b in batches:
            x = model.features(statistics(_matrix(b)))
            total += x.T @ np.column_stack([x, b.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"i": table.column("i")[:1], "row": pa.array([np.sum(table.column("row").to_pylist(), axis=0)], pa.list_(pa.float64()))})

    fit = rows.filter("NOT calibrate").mapInArrow(normal, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").toArrow().sort_by("i")
    if fit.num_rows:
        a = np.array(fit.column("row").to_pylist())
        model.weights = np.linalg.solve(a[:, :-1] + ridge * np.eye(FEATURES + 1) * max(1.0, a[-1, -2]) / FEATURES, a[:, -1])
    fitted = share(counts.sparkSession, model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(fitted)
        for b in batches:
            bins = np.round(model.raw(statistics(_matrix(b))) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("y")], names=["bin", "y"])

    # at most 2 * BINS + 1 bins
    c = rows.filter("calibrate").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toArrow().sort_by("bin")
    if c.num_rows:
        x, level = pool_adjacent(c.column("bin").to_numpy() / BINS, c.column("y").to_numpy(), c.column("n").to_numpy().astype(float))
        model.knots, model.levels = np.r_[x[0] - 1e-9, x], np.r_[level[0], level]
    return model


def score(counts: DataFrame, model: KernelRidge) -> DataFrame:
    """(doc_id, score) from counts; empty texts get the score of zero counts."""
    shared = share(counts.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(model.probability(statistics(_matrix(b))), 0, 1))], names=["doc_id", "score"])

    return counts.select("doc_id", *COLUMNS).mapInArrow(run, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document row; null and empty texts have the score of zero counts."""
    counts = written(with_counts(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    out = score(counts, train(counts, labels(spark, sf_dir)))
    return out.select("doc_id", (split_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
