"""Corpus stage: near-duplicate documents by SimHash candidates and five-word shingle similarity.

The fingerprints are two independent SimHashes of the document's distinct words; a few edited words move them by a
few bits only. Documents that meet in either fingerprint within `radius` bits are candidates if a sketch of their five-word
shingles, 128 one-bit minwise values, differs in at most `most_sketch_bits` (12.8 expected at a similarity of 0.8, 64 for texts that
share nothing). The index returns spanning forests of these, and each of their links is checked on the whole shingle sets. Where
a link fails, the forest may have hidden others behind it: the documents it held together are searched again, and there a
pair joins only after its own check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import bitmap_of, opened, rows_without, share, written
from tidewright.llm.components import components
from tidewright.llm.simhash import _bits_over_half, hamming_links, shingle_hashes

SKETCH = 128
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    """A second hash from a first one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def minwise(shingles: np.ndarray) -> tuple[int, int]:
    """One bit of the least value of each of SKETCH hash functions over the shingles, as two words; zeros without shingles."""
    if not len(shingles):
        return 0, 0
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    values = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for s in range(0, len(values), 4096):
        low = np.minimum(low, (values[s : s + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    bits = np.packbits(np.bitwise_count(low) & np.uint8(1))  # parity: the least value itself has few high bits
    a, b = bits.view(np.int64).tolist()
    return a, b


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, f0, f1, s0, s1): key names the lower-cased word sequence; null and word-less texts share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, f0, f1, sketches = [], [], [], []
            for text in b.column(1).to_pylist():
                words = (text or b"").lower().split()
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                h = np.array([xxhash.xxh64_intdigest(w) for w in set(words)], np.uint64)
                f0.append(_bits_over_half(h) if len(h) else 0)
                f1.append(_bits_over_half(_mix(h)) if len(h) else 0)
                sketches.append(minwise(shingle_hashes(text or b"", 5)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f0, f1)]
            halves = [pa.array([x[k] for x in sketches], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), *longs, *halves], names=["doc_id", "key", "f0", "f1", "s0", "s1"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, key binary, f0 long, f1 long, s0 long, s1 long")


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """(id, shingles): hashes of the distinct k-word shingles of the documents in ids."""
    shared = share(docs.sparkSession, bitmap_of(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened(shared)
        for b in batches:
            b = b.filter(pa.array(bitmap.may_hold(b.column(0).to_numpy().view(np.uint64))))
            sets = [np.unique(shingle_hashes(t or b"", k)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).filter("id IS NOT NULL")
    return rows.mapInArrow(run, "id long, shingles array<long>").join(ids, "id").dropDuplicates(["id"])


def duplicate_ids(docs: DataFrame, radius: int = 6, least: float = 0.8, most_sketch_bits: int = 26) -> DataFrame:
    """(doc_id, component_id): documents that repeat one of a smaller doc_id; rows without doc_id are left out."""
    sig = written(signatures(docs).filter("doc_id IS NOT NULL"))
    reps = written(sig.groupBy("key").agg(F.min(F.struct("doc_id", "f0", "f1", "s0", "s1")).alias("x")).select("key", F.col("x.doc_id").alias("id"), "x.f0", "x.f1", "x.s0", "x.s1"))
    links = written(hamming_links(reps, radius, ["f0", "f1"], ("s0", "s1"), most_sketch_bits).distinct())
    ends = written(links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = written(shingle_sets(docs, ends))
    both = links.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    passed = written(both.filter(shared >= least * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))
    # Trees of the first search that hold more than one pair and did not stay whole.
    named = written(components(links).join(components(passed).withColumnRenamed("component", "grp"), "id", "left").select("id", F.col("component").alias("tree"), F.coalesce("grp", "id").alias("grp")))
    broken = written(named.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("n > 2 AND lo <> hi").select("tree"))
    again = written(named.join(broken, "tree").join(sets, "id").select("id", "grp", F.col("shingles").alias("items")))
    points = written(reps.join(again.select("id"), "id").select("id", "f0", "f1", "s0", "s1"))
    more = hamming_links(points, radius, ["f0", "f1"], ("s0", "s1"), most_sketch_bits, agree=1, sets=again, share=least)
    comps = components(passed.unionByName(more))
    groups = written(reps.select("key", "id").join(comps, "id", "left").select("key", F.coalesce("component", "id").alias("component_id")))
    return sig.select("doc_id", "key").join(groups, "key").filter("doc_id <> component_id").select("doc_id", "component_id")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; other documents stay as they are.

    Null, empty and word-less texts are copies of each other. Rows without doc_id stay. Rows that repeat a doc_id go or stay together. All columns
    of docs are returned, whatever their names; an empty table gives no rows.
    """
    return rows_without(docs, written(duplicate_ids(docs).select("doc_id").distinct()))
