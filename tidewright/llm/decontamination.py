"""Benchmark decontamination by template canonicalisation.

Words are canonicalised to a template: numbers, units and names (capitalised words that do not start a
sentence) become typed placeholders, other words lose case and outer punctuation. Windows of `window` template
words are hashed on both sides and hash-joined, so a question whose numbers or names were replaced still
meets its source. Such a window counts only if its fillers are consistent: within one alignment each
filler of the benchmark item always stands for the same filler in the document. Windows with fewer than `least_literal` words
that are no fillers say too little as templates. All windows are also hashed by their literal words, so a verbatim window counts
whatever it holds. Items shorter than a window match as a whole; those of a few words only where they are a line or sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import bitmap_of, documents, opened, rows_without, share, written

#: Words read as units.
UNITS = frozenset(
    b"mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms "
    b"ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"mph kph km/h m/s hz khz mhz ghz w kw j kj cal kcal v a usd eur gbp dollar dollars cent cents euro euros pound pounds percent degree degrees".split()
)
_EDGES = bytes(i for i in range(33, 127) if not bytes([i]).isalnum())
_NUMBER, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"<number>", b"<unit>", b"<name>"))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Fixed value: sets the words of literal windows apart from those of templates.
_LITERAL = np.uint64(0xD6E8FEB86659FD93)


_BREAK = b"\0"


class Words:
    """Words of several texts, one after the other."""

    def __init__(self, template: np.ndarray, literal: np.ndarray, filler: np.ndarray, begins: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> None:
        self.template, self.literal, self.filler, self.begins, self.stops, self.counts = template, literal, filler, begins, stops, counts
        self.first = np.cumsum(counts) - counts
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of `size` words begin, and how many of their words are no fillers."""
        at = np.arange(max(0, len(self.template) - size + 1))
        at = at[at + size <= (self.first + self.counts)[self.owner[at]]]
        fill = np.r_[0, np.cumsum(self.filler)]
        return at, size - (fill[at + size] - fill[at])


class Templates:
    """Word tables of a task: each distinct word is looked at once."""

    def __init__(self, most_words: int = 500_000) -> None:
        self.most = most_words
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 3), np.uint64)
        self._learn(_BREAK)

    def _learn(self, word: bytes) -> int:
        stripped = word.strip(_EDGES)
        bare = stripped.lower()
        kind = 0
        if word == _BREAK:
            kind = 4
        elif any(48 <= c <= 57 for c in bare):
            kind = 1
        elif bare in UNITS:
            kind = 2
        elif stripped[:1].isupper() or stripped[:1] >= b"\xc3" and stripped.decode(errors="replace")[:1].isupper():
            kind = 3
        n = self.number[word] = len(self.number)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = xxhash.xxh64_intdigest(bare.decode(errors="replace").lower().encode()), kind, int(word[-1:] in b".!?:" and word != b"")
        return n

    def words(self, texts: list[bytes]) -> Words:
        """A word after a line break, a sentence's end or nothing begins; a word before these stops."""
        if len(self.number) > self.most:
            self.number = {}
            self._learn(_BREAK)
        split = [(t.replace(b"\n", b" \0 ") + b" \0").split() for t in texts]
        flat = list(chain.from_iterable(split))
        at = list(map(self.number.get, flat))
        for k in [k for k, n in enumerate(at) if n is None]:
            at[k] = self.number[flat[k]] if flat[k] in self.number else self._learn(flat[k])
        t = self.table[np.array(at, np.int64)]
        literal, kind, ends = t[:, 0], t[:, 1].astype(np.int64), t[:, 2] > 0
        gap = kind == 4
        begins = np.r_[np.ones(1, bool), (ends | gap)[:-1]][: len(at)]
        stops = ends | np.r_[gap[1:], np.ones(1, bool)][: len(at)]
        kind[(kind == 3) & begins] = 0
        counts = np.add.reduceat(~gap, np.cumsum([0, *map(len, split)])[:-1], dtype=np.int64) if len(split) else np.zeros(0, np.int64)
        literal, kind, begins, stops = (x[~gap] for x in (literal, kind, begins, stops))
        return Words(np.choose(kind, [literal, _NUMBER, _UNIT, _NAME]), literal, kind > 0, begins, stops, counts)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, np.uint64(size))
    for i in range(size):
        h = (h ^ words[i : i + n]) * _PRIME
        h ^= h >> np.uint64(29)
    return h


_ROW = "id long, pos long, size int, n_words long, templated boolean, n_templated long, hash long, fillers array<long>"


def _windows(rows: DataFrame, sizes: list[int] | None, window: int, least_literal: int, alone_under: int, bitmap) -> DataFrame:
    """_ROW: windows of each text, by template (templated windows) and by literal words (without fillers). sizes None: one size for a text, its length up to `window`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, known = Templates(), opened(bitmap) if bitmap is not None else None

        def told(idents: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            w, ids = templates.words(texts), np.array([-1 if i is None else i for i in idents], np.int64)
            given = np.array([i is not None for i in idents], bool)
            own = np.clip(w.counts, 1, window)
            for size in sizes or np.unique(own).tolist():
                at, literals = w.windows(size)
                use = given[w.owner[at]] & (own[w.owner[at]] == size if sizes is None else True)
                if size < alone_under and sizes is not None:
                    use &= w.begins[at] & w.stops[at + size - 1]
                at, literals = at[use], literals[use]
                templated = literals >= min(least_literal, size)
                n_templated = np.bincount(w.owner[at], templated, len(texts)).astype(np.int64)
                for form, words in ((True, w.template), (False, w.literal ^ _LITERAL)):
                    h = window_hashes(words, size)[at]
                    ok = known.may_hold(h) if known is not None else np.ones(len(at), bool)
                    if form:
                        ok &= templated
                    p, who = at[ok], w.owner[at[ok]]
                    fillers = [(np.flatnonzero(w.filler[k : k + size]) << 56 | (w.literal[k : k + size][w.filler[k : k + size]] >> np.uint64(8)).astype(np.int64)).tolist() if form else [] for k in p.tolist()]
                    cols = [pa.array(ids[who]), pa.array(p - w.first[who]), pa.array(np.full(len(p), size, np.int32)), pa.array(w.counts[who]), pa.array(templated[ok]), pa.array(n_templated[who]), pa.array(h[ok].view(np.int64)), pa.array(fillers, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "pos", "size", "n_words", "templated", "n_templated", "hash", "fillers"])

        for b in batches:
            idents, texts, size = [], [], 0
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                idents.append(ident)
                texts.append(text or b"")
                size += len(texts[-1])
                if size > 1 << 20:
                    yield from told(idents, texts)
                    idents, texts, size = [], [], 0
            if texts:
                yield from told(idents, texts)

    return rows.mapInArrow(run, _ROW)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_coverage: float = 0.3, least_literal: int = 2, alone_under: int = 4) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, coverage): documents that hold a benchmark item or a re-parameterised form of it.

    coverage is the share of the item's windows found in the document, verbatim or with fillers that are consistent in their alignment, or
    that of its windows with `least_literal` words that are no fillers, whichever is greater; pairs under `least_coverage` are left
    out. Items shorter than the window are one window of their own length; items of fewer than `alone_under` words count only where they
    are a whole line or sentence. Null and empty texts and rows without an id hold nothing and are held nowhere; other columns are not looked at;
    equal rows give one result per id; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = written(_windows(benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")), None, window, least_literal, alone_under, None).distinct())
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # `window` values at most
    bitmap = share(spark, bitmap_of(items, "hash"))
    found = _windows(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")), sizes or [window], window, least_literal, alone_under, bitmap)
    found = found.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "size", "hash", F.col("fillers").alias("doc_fillers"))
    met = found.join(items.select(F.col("id").alias("item_id"), "pos", "size", "hash", "n_words", "templated", "n_templated", "fillers"), ["hash", "size"])
    # One alignment: the item's start stands at one place of the document.
    pairs = F.transform(F.arrays_zip("fillers", "doc_fillers"), lambda x: F.struct(x["fillers"].bitwiseAND(F.lit((1 << 56) - 1)).alias("i"), x["doc_fillers"].bitwiseAND(F.lit((1 << 56) - 1)).alias("d")))
    aligned = met.groupBy("doc_id", "item_id", (F.col("doc_pos") - F.col("pos")).alias("shift")).agg(
        F.collect_set(F.struct("pos", "templated", pairs.alias("pairs"))).alias("at"), F.max(F.col("n_words") - F.col("size") + 1).alias("n_item_windows"), F.max("n_templated").alias("n_templated")
    )
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten(F.transform("at", lambda w: w["pairs"]))))
    once = F.transform(F.array_distinct(F.transform("pairs", lambda x: x["i"])), lambda i: F.struct(i.alias("i"), F.size(F.filter("pairs", lambda x: x["i"] == i)).alias("n")))
    aligned = aligned.withColumn("mixed", F.transform(F.filter(once, lambda x: x["n"] > 1), lambda x: x["i"]))
    consistent = F.filter("at", lambda w: ~F.exists(w["pairs"], lambda x: F.array_contains(F.col("mixed"), x["i"])))
    held = aligned.select("doc_id", "item_id", "n_item_windows", "n_templated", F.explode(consistent).alias("w")).select("doc_id", "item_id", "n_item_windows", "n_templated", "w.pos", "w.templated")
    counted = held.groupBy("doc_id", "item_id").agg(
        F.count_distinct("pos").alias("n_windows"), F.count_distinct(F.when(F.col("templated"), F.col("pos"))).alias("found"), F.max("n_item_windows").alias("n_item_windows"), F.max("n_templated").alias("n_templated")
    )
    share_of = F.greatest(F.col("n_windows") / F.col("n_item_windows"), F.coalesce(F.try_divide("found", "n_templated"), F.lit(0.0)))
    return counted.withColumn("coverage", share_of).filter(F.col("coverage") >= least_coverage).select("doc_id", "item_id", "n_windows", "n_item_windows", "coverage")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, coverage) of all documents and the whole benchmark; see `leaks`."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; others stay as they are, all columns, whatever their names.

    Null and empty texts and rows without doc_id stay; rows that repeat a doc_id go or stay together; an empty table on either side drops nothing.
    """
    return rows_without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
