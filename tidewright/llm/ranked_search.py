"""Ranked lexical search: the k best documents of each query text, by maximum inner product over buckets of like length.

A document is a sparse vector of term impacts, a query one of term weights; each side carries the square root of the weight.
Vectors are sorted by length over all tasks. A bucket of consecutive vectors is passed over for each query whose k-th best score
no vector of that length can reach (Cauchy-Schwarz). Inside a bucket the products over the query's heaviest coordinates are added
up, and what the other coordinates can add is bounded by the lengths that are left. What survives both is scored again in integers,
so the result is exact. The longest vectors are searched first, by all tasks; the k-th scores found there are where the rest begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm._common import documents, opened, share, written

#: Terms are stretches of other characters than these, with A-Z in lower case.
_APART = bytes(i for i in range(128) if not (chr(i).isascii() and chr(i).isalnum()))
_FOLD = bytes.maketrans(_APART + bytes(range(65, 91)), b" " * len(_APART) + bytes(range(97, 123)))
BUCKET_ROWS, BUCKET_RATIO, FOCUS = 4096, 0.9, 0.8
SLACK = 1 + 1e-9  # bounds are doubles, scores are integers
HEAD = 0.01  # share of the vectors, the longest, that thresholds are taken from
SALTS = 64


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Queries:
    """Term sets of a block of query texts: terms numbered, sets one after the other in `flat`."""

    def __init__(self, keys: list[int], sets: list[list[bytes]]) -> None:
        self.number = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(sets))))}
        self.keys = np.array(keys, np.int64)
        self.sets = [np.array([self.number[t] for t in s], np.int64) for s in sets]

    def weigh(self, weights: np.ndarray) -> None:
        """Set the integer weight of each term; terms are no longer looked up by name."""
        self.number, self.weights, self.roots = {}, weights, np.sqrt(weights.astype(np.float64))
        self.lengths = np.array([math.sqrt(weights[s].sum()) for s in self.sets])
        self.focus, self.rest = [], np.zeros(len(self.sets))  # heaviest coordinates, and the length of the others
        for k, s in enumerate(self.sets):
            order = s[np.argsort(-weights[s], kind="stable")]
            upto = np.cumsum(weights[order])
            n = int(np.searchsorted(upto, FOCUS * upto[-1])) + 1 if len(upto) else 0
            self.focus.append(order[:n])
            self.rest[k] = math.sqrt(max(0, int(upto[-1] - upto[n - 1]))) if n else 0.0


def occurrences(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the text), and the query terms in it with how often each occurs; one row per row of docs."""
    shared = share(docs.sparkSession, queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = opened(shared).number
        get, v = number.get, max(1, len(number))
        for b in batches:
            for at in range(0, b.num_rows, 512):  # a few texts at a time, so that few words are held
                part = b.slice(at, 512)
                words = [terms(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(w) for w in words], np.int64)
                ids = np.fromiter(map(get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
                keys, tf = np.unique((np.repeat(np.arange(len(words)), sizes) * v + ids)[ids >= 0], return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(words) + 1) * v).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % v, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *lists], names=["doc_id", "n", "terms", "tf"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _lists(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than rows) and values of a list column."""
    col = b.column(column)
    starts = col.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], col.values.to_numpy()[starts[0] : starts[-1]]


def impacts(found: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, length of the vector, terms and their integer impacts; vectors of length 0 can't score and are left out."""
    shared = share(found.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = opened(shared)
        for b in batches:
            starts, ids = _lists(b, 2)
            tf = _lists(b, 3)[1].astype(np.int64)
            norm = np.array([50 + 50 * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(starts))
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * norm[row])
            length = np.sqrt(np.bincount(row, weight[ids] * impact.astype(np.float64) ** 2, b.num_rows))
            lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, impact)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(length), *lists], names=["doc_id", "length", "terms", "impact"])
            yield out.filter(pa.array(length > 0))

    return found.mapInArrow(run, "doc_id long, length double, terms array<int>, impact array<int>")


class Best:
    """The k best (score, document) of one query so far; equal scores by ascending id, null last."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least = k, least  # no score under `least` can be among the k best of all documents
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= self.least
        self.score, self.null, self.doc = (np.r_[a, b[keep]] for a, b in ((self.score, score), (self.null, null), (self.doc, doc)))
        if len(self.score) > self.k:
            order = np.lexsort((self.doc, self.null, -self.score))[: self.k]
            self.score, self.null, self.doc = self.score[order], self.null[order], self.doc[order]
        if len(self.score) == self.k:
            self.least = max(self.least, int(self.score.min()))


def _buckets(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a falling sequence of lengths where it has fallen by a tenth, or at BUCKET_ROWS."""
    at = 0
    while at < len(length):
        to = min(at + BUCKET_ROWS, at + int(np.searchsorted(-length[at:], -BUCKET_RATIO * length[at], "right")))
        yield at, max(to, at + 1)
        at = max(to, at + 1)


def search_bucket(queries: Queries, best: list[Best], length: np.ndarray, starts: np.ndarray, ids: np.ndarray, impact: np.ndarray, null: np.ndarray, doc: np.ndarray) -> int:
    """Add what a bucket holds to `best`; returns how many vectors were scored in integers."""
    least = np.array([b.least for b in best], np.float64)
    near = np.flatnonzero(queries.lengths * length.max() * SLACK >= least)
    if not len(near):
        return 0
    rows, scored = len(length), 0
    row = np.repeat(np.arange(rows), np.diff(starts))
    order = np.argsort(ids, kind="stable")
    of_term = np.searchsorted(ids[order], np.arange(len(queries.weights) + 1))
    unit = (queries.roots[ids] * impact / length[row])[order]
    row_of = row[order]
    for q in near.tolist():
        inner, square = np.zeros(rows), np.zeros(rows)
        for t in queries.focus[q].tolist():
            i, j = of_term[t], of_term[t + 1]
            inner[row_of[i:j]] += queries.roots[t] * unit[i:j]
            square[row_of[i:j]] += unit[i:j] ** 2
        bound = length * (inner + queries.rest[q] * np.sqrt(np.maximum(0, 1 - square)))
        alive = np.flatnonzero(bound * SLACK >= best[q].least)
        if not len(alive):
            continue
        scored += len(alive)
        weight = np.zeros(len(queries.weights), np.int64)
        weight[queries.sets[q]] = queries.weights[queries.sets[q]]
        sizes = starts[alive + 1] - starts[alive]
        ends = np.cumsum(sizes)
        at = np.repeat(starts[alive] - (ends - sizes), sizes) + np.arange(ends[-1])
        score = np.add.reduceat(weight[ids[at]] * impact[at], ends - sizes)
        best[q].add(score, null[alive], doc[alive])
    return scored


def best_of_tasks(vectors: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score, part) with each task's k best per query that reach `least`; rows come longest first."""
    shared, floor = share(vectors.sparkSession, queries), least.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        q = opened(shared)
        best = [Best(k, x) for x in floor]
        for b in batches:
            length, (starts, ids), doc = b.column(1).to_numpy(), _lists(b, 2), b.column(0)
            impact = _lists(b, 3)[1].astype(np.int64)
            null, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            for i, j in _buckets(length):
                part = slice(starts[i], starts[j])
                search_bucket(q, best, length[i:j], starts[i : j + 1] - starts[i], ids[part], impact[part], null[i:j], doc[i:j])
        sizes = [len(x.score) for x in best]
        gather = lambda name, kind: np.concatenate([getattr(x, name) for x in best]) if best else np.zeros(0, kind)
        part = np.full(sum(sizes), TaskContext.get().partitionId() % SALTS, np.int64)
        cols = [pa.array(np.repeat(q.keys, sizes)), pa.array(gather("doc", np.int64), mask=gather("null", bool)), pa.array(gather("score", np.int64)), pa.array(part)]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score", "part"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long, part long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; in two steps, so that no task gets the rows of all others for one query."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def _block(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str) -> DataFrame | None:
    found = written(occurrences(docs, queries, id_col, text_col))
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(queries.number), np.int64)
    for t, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row per query term
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    queries.weigh(weights)
    by_length = [F.col("length").desc(), F.col("_salt")]
    vectors = impacts(found, weights, n_docs, n_terms).withColumn("_salt", F.monotonically_increasing_id())
    vectors = written(vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length).drop("_salt"))
    least = np.ones(len(queries.sets), np.int64)
    cut = vectors.agg(F.percentile_approx("length", 1 - HEAD)).first()[0]
    if cut is None:
        return None
    head = _top(best_of_tasks(vectors.where(F.col("length") >= cut), queries, least, k), k)
    seen = {q: x for q, x, n in head.groupBy("query").agg(F.min("score"), F.count("*")).collect() if n == k}  # one row per query
    least = np.array([seen.get(q, 1) for q in queries.keys.tolist()], np.int64)
    some = queries.lengths > 0
    shortest = float((least[some] / queries.lengths[some]).min()) / SLACK if some.any() else 0.0
    return _top(best_of_tasks(vectors.where(F.col("length") >= shortest), queries, least, k), k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = 400_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's k best documents: item_col, rank (from 1), doc_id, score (above 0).

    Items are taken in blocks of about `block_terms` distinct terms together, which is what a task holds; each block reads
    the documents once. A null or empty text, of an item or a document, has no terms and no rows. A row that repeats an item id
    is ranked on its own, and so is a row that repeats a doc_id. Ties go by ascending doc_id, null last. Empty tables give no
    rows. Texts of any length are read whole. Other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["query", "terms"])

    keyed = written(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("query")))
    asked = written(keyed.select("query", F.col("text").cast("binary")).mapInArrow(sets, "query long, terms array<binary>"))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    for n in range(blocks):
        rows = asked.where((F.pmod(F.xxhash64("query"), F.lit(blocks)) == n) & (F.size("terms") > 0)).orderBy("query").collect()
        got = _block(docs, Queries([r.query for r in rows], [[bytes(t) for t in r.terms] for r in rows]), k, id_col, text_col)
        if got is not None:
            out = out.unionByName(got)
    return out.join(keyed.select("query", F.col("item").alias(item_col)), "query").select(item_col, "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item; nulls, ties, repeated rows, empty and long texts, clashing columns and empty tables as in `search`."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_sql() -> str:
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"unnest(regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
WITH words AS (
  SELECT row, doc_id, {found} AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), counts AS (
  SELECT row, doc_id, term, COUNT(*) AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT row, COUNT(*) AS n FROM words GROUP BY row
), whole AS (
  SELECT COUNT(*) AS n_docs, CAST(SUM(n) AS BIGINT) AS n_terms FROM sizes
), weights AS (
  SELECT term, CAST(FLOOR(1000 * LN((2 * n_docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM counts, whole GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT query, item_id, {found} AS term FROM (SELECT row_number() OVER () AS query, item_id, text FROM benchmark)
), scores AS (
  SELECT query, item_id, row, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (row), whole GROUP BY ALL
), ranked AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
