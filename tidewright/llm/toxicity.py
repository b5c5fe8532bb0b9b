"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its distinct lower-cased terms, hashed to ``1 << BITS`` slots. The machine adds to a
linear weight for each term the inner product of the latent vectors of each pair of terms, so that an insult
next to a group mention weighs more than both alone. It is trained with logistic loss on a bounded,
deterministic sample of labelled rows (``sample_rows``); scoring is one pass over all whole texts, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import deterministic_fraction, documents, labels, opened, share, split_remainder, unused

BITS, FACTORS = 18, 8
_SPACES = bytes(i if i >= 128 or bytes([i]).isalnum() else 32 for i in range(256))


def term_slots(text: bytes | None) -> np.ndarray:
    """Slots of the distinct terms of a text, ascending."""
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(w) & mask for w in set((text or b"").lower().translate(_SPACES).split())), np.int32))


class FactorizationMachine:
    """Logistic second-order machine on sets of slots.

    A slot has weights if at least `min_docs` rows hold it and its share among toxic rows differs from that among the
    others by `least_z` standard errors, or if beside a slot of which that is true it moves the share of toxic
    rows by `pair_z`: a mention of a group may be neutral alone and count next to an insult only. Without such a choice a
    text's hundreds of neutral terms would drown the few that count.
    """

    def __init__(self, factors: int = FACTORS, epochs: int = 20, rate: float = 0.2, l2: float = 1e-5, min_docs: int = 5, least_z: float = 3.5, pair_z: float = 5.0, batch: int = 64, seed: int = 7) -> None:
        self.factors, self.epochs, self.rate, self.l2, self.min_docs, self.least_z, self.pair_z, self.batch, self.seed = factors, epochs, rate, l2, min_docs, least_z, pair_z, batch, seed
        self.bias, self.slots, self.rows = 0.0, np.zeros(0, np.int32), 0
        self.w, self.v = np.zeros(1, np.float32), np.zeros((1, factors), np.float32)

    def _rows(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row number and feature number of each known slot."""
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(self.slots, flat)
        known = (at < len(self.slots)) & (self.slots[np.minimum(at, max(0, len(self.slots) - 1))] == flat) if len(self.slots) else np.zeros(len(flat), bool)
        return row[known], at[known]

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        row, col = self._rows(sets)
        return self._margins(row, col, len(sets))[0]

    def _margins(self, row: np.ndarray, col: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(row, self.w[col], n)
        sums = np.zeros((n, self.factors))
        square = np.zeros(n)
        for f in range(self.factors):
            v = self.v[col, f]
            sums[:, f] = np.bincount(row, v, n)
            square += np.bincount(row, v * v, n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - square), sums

    def _beside(self, rows: np.ndarray, flat: np.ndarray, ends: np.ndarray, y: np.ndarray, n_slots: int) -> np.ndarray:
        """Which slots move the share of toxic rows among the given rows. flat: slot numbers, those of row i from ends[i] on."""
        with_k = np.concatenate([flat[ends[i] : ends[i + 1]] for i in rows.tolist()])
        n = np.bincount(with_k, minlength=n_slots)
        toxic = np.bincount(with_k, np.repeat(y[rows], ends[rows + 1] - ends[rows]), n_slots)
        p = y[rows].mean()
        spread = np.sqrt(np.maximum(p * (1 - p) * (1 - n / len(rows)) / np.maximum(n, 1), 1e-12))
        return (n >= self.min_docs) & (n < len(rows)) & (np.abs(toxic / np.maximum(n, 1) - p) >= self.pair_z * spread) & (0 < p < 1)

    def fit(self, sets: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
        positives = float(y.sum())
        self.bias = float(np.log((positives + 0.5) / (len(y) - positives + 0.5)))
        self.rows = len(y)
        if not len(y):
            return self
        slots, inv, docs = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        toxic = np.bincount(inv, np.repeat(y, [len(s) for s in sets]), len(slots))
        ends_of = np.r_[0, np.cumsum([len(s) for s in sets])]
        share, n1, n0 = docs / len(y), max(positives, 1.0), max(len(y) - positives, 1.0)
        z = (toxic / n1 - (docs - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        often = docs >= self.min_docs
        keep = often & (np.abs(z) >= self.least_z)
        strong = np.flatnonzero(keep[inv])
        row, slot = np.searchsorted(ends_of, strong, side="right") - 1, inv[strong]
        flat = inv.astype(np.int32)
        for k in np.unique(slot).tolist():
            keep |= self._beside(row[slot == k], flat, ends_of, y, len(slots))
        self.slots = slots[keep]
        m, rng = max(1, len(self.slots)), np.random.default_rng(self.seed)
        self.w, self.v = np.zeros(m), rng.normal(0, 0.01, (m, self.factors))
        gw, gv, gb = np.full(m, 1e-6), np.full((m, self.factors), 1e-6), 1e-6
        row_all, col_all = self._rows(sets)
        ends = np.searchsorted(row_all, np.arange(len(y) + 1))
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), self.batch):
                pick = order[s : s + self.batch]
                col = np.concatenate([col_all[ends[i] : ends[i + 1]] for i in pick])
                row = np.repeat(np.arange(len(pick)), ends[pick + 1] - ends[pick])
                margin, sums = self._margins(row, col, len(pick))
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick)
                used, inv = np.unique(col, return_inverse=True)
                if len(used):
                    e = err[row]
                    g = np.bincount(inv, e) + self.l2 * self.w[used]
                    gw[used] += g * g
                    self.w[used] -= self.rate * g / np.sqrt(gw[used])
                    for f in range(self.factors):
                        v = self.v[used, f]
                        g = np.bincount(inv, e * (sums[row, f] - self.v[col, f])) + self.l2 * v
                        gv[used, f] += g * g
                        self.v[used, f] = v - 0.3 * self.rate * g / np.sqrt(gv[used, f])
                g = err.sum()
                gb += g * g
                self.bias -= self.rate * g / np.sqrt(gb)
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        return self


def train(docs: DataFrame, marks: DataFrame, sample_rows: int = 20_000) -> FactorizationMachine:
    """Fit on about `sample_rows` labelled rows at most, taken by a hash of doc_id; held-out rows are not looked at."""
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna().filter(split_remainder("doc_id", 5) != 0)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = marks.count()
    if n > sample_rows:
        marks = marks.filter(deterministic_fraction(F.col("doc_id"), sample_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([term_slots(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "y", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(marks), "doc_id")  # sample_rows bounds it
    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, slots array<int>").toArrow().sort_by("doc_id")
    slots = got.column("slots").combine_chunks()
    ends, flat = slots.offsets.to_numpy(), slots.values.to_numpy()  # no list of Python numbers
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return FactorizationMachine().fit(sets, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: FactorizationMachine, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """(keep columns..., name): the probability of each whole text, row by row. Null and empty texts get that of no terms; an empty table gives no rows."""
    keep = [f"`{c}`" for c in keep or ["doc_id"]]
    shared = share(docs.sparkSession, model)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for b in batches:
            margin = model.margins([term_slots(t) for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=[*b.schema.names[:-1], name])

    return docs.select(*keep, F.col("text").cast("binary").alias(unused(docs, "_text"))).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document row."""
    docs = documents(spark, sf_dir)
    out = score(docs, train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", (split_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Drop the documents whose score reaches the threshold; others stay as they are, all columns, whatever their names.

    Null and empty texts have the score of no terms; equal texts have equal scores, so repeated rows go or stay together. Without labels all
    scores are 0.5 and nothing is dropped. An empty table gives no rows.
    """
    name = unused(docs, "score")
    model = train(docs, labels(spark, sf_dir))
    if not model.rows:
        return docs
    return score(docs, model, docs.columns, name).filter(F.col(f"`{name}`") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
