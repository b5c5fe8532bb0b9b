"""Mixing of sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, repeatable order. A document's virtual finish time is the number of words
that its source has sent by the document's end, divided by the source's target; a source that is short of words sends its
documents again, three times at most. All copies are range-sorted by finish time and the sequence ends at the total budget.

Running totals come from range partitions: each task adds up its own rows and a table of one row per partition and group gives
the totals before it, so no source and no copy of a row, however frequent, has to fit in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm._common import documents, small, written

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null; needs no list of the words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def running_totals(df: DataFrame, keys: list[Column], amount: str, within: str | None = None) -> DataFrame:
    """df, written, with the running total of the long column `amount` up to and with each row, as column `total`.

    Rows are ordered by `keys`; with `within`, a long column that `keys` begin with, each of its values has a total of its
    own. Rows that are equal in all keys come in any order, and may be dealt over many tasks.
    """
    place = [*keys, F.col("_salt")]
    sorted_rows = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place).drop("_salt")
    at, group_at = df.columns.index(amount), df.columns.index(within) if within else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sent, group = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            total = np.cumsum(b.column(at).to_numpy()) + sent
            if group_at is not None:
                groups = b.column(group_at).to_numpy()
                first = np.flatnonzero(np.r_[groups[0] != group, groups[1:] != groups[:-1]])
                before = np.zeros(len(total), np.int64)  # of the whole run of rows, where each group begins
                if len(first):
                    before[first] = np.diff(np.r_[0, np.r_[sent, total][first]])
                    total = total - np.cumsum(before)
                group = groups[-1]
            sent = int(total[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(total), part, np.int64)), pa.array(total)], names=[*b.schema.names, "_part", "_sum"])

    own = written(sorted_rows.mapInArrow(run, df.schema.add("_part", "long").add("_sum", "long")))
    names = [within] if within else []
    sums = own.groupBy("_part", *names).agg(F.max("_sum").alias("_all"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("_part", *names, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before")))
    return own.join(small(starts), ["_part", *names]).select(*df.columns, (F.col("_before") + F.col("_sum")).alias("total"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> tuple[DataFrame, int]:
    """One row per source with `rank` (from 0), `weight` and `target`, and the sum of all sizes, which the targets share.

    sources: `source`, `source_size` and `biggest`. The level of water in vessels whose width is the weight and whose volume is
    most_copies times the size: a vessel that is full stays full, so the rounds end.
    """
    ranked = running_totals(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one")
    spread = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.withColumn("rank", F.col("total") - 1).withColumn("weight", spread.cast("long")).drop("one", "total"))
    cap = F.lit(most_copies) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, width, full = total, ranked.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(width))
        over = share > cap
        n, capped, wide = ranked.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not wide:
            return ranked.withColumn("target", F.when(over, cap.cast("double")).otherwise(share)), total
        left, width, full = total - capped, wide, n


def _horizon(sources: DataFrame, total: int, most_copies: int) -> float:
    """A finish time by which the budget is surely spent: by time t a source has sent t targets less its biggest document."""
    times = [1 + 2.0**k for k in range(-6, 8)]
    sent = [F.sum(F.least(t * F.col("target"), (most_copies * F.col("source_size")).cast("double")) - F.col("biggest")) for t in times]
    row = sources.agg(*sent).first()
    return next((t for t, x in zip(times, row, strict=True) if x is not None and x >= total), math.inf)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted).

    The budget is the sum of all sizes and is spent exactly: of the document at the end of the sequence only the words that still fit count.
    A null or empty text has size 0 and is taken 0 words. A null source is a source of its own, the last. Rows that repeat a
    doc_id are documents of their own; equal rows share what they are given in any order. A null doc_id is shuffled like the empty id.
    Sources without words have target 0. An empty table gives no rows. Other columns of docs are not looked at.
    """
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("biggest"))
    targets, total = with_targets(per_source, weights, most_copies)
    sources = written(targets)
    side = small(sources.select(F.col("source").alias("_source"), "source_size", "rank", "target"))
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    queues = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shuffled", order)
    queues = running_totals(queues, [F.col(c) for c in ("rank", "shuffled", "doc_id", "size")], "size", "rank").drop("shuffled")
    copy = F.col("copy") * F.col("source_size") + F.col("total")
    finish = copy.cast("double") / F.col("target")
    copies = queues.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most_copies - 1))))
    copies = copies.select("size", "rank", copy.alias("position"), finish.alias("finish")).where(F.col("finish") <= _horizon(sources, total, most_copies))
    sequence = running_totals(copies, [F.col("finish"), F.col("rank"), F.col("position")], "size")
    last = sequence.where(F.col("total") >= total).orderBy("total").first()
    if last is None:
        return queues.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    end = F.struct(F.lit(last.finish).alias("finish"), F.lit(last.rank).alias("rank"), F.lit(last.position).alias("position"))
    fits = last.size - (last.total - total)
    taken = F.lit(0).cast("long")
    for k in range(most_copies):
        position = F.lit(k) * F.col("source_size") + F.col("total")
        key = F.struct((position.cast("double") / F.col("target")).alias("finish"), F.col("rank").alias("rank"), position.alias("position"))
        taken = taken + F.when(key < end, F.col("size")).when(key == end, F.lit(fits)).otherwise(F.lit(0))
    return queues.select("doc_id", "source", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words of each that the mix takes; nulls, ties, repeated rows, empty and long texts, clashing columns and empty tables as in `mix`."""
    return mix(documents(spark, sf_dir)).drop("source")


def op12_sql() -> str:
    return r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, rank % 3 + 1 AS weight, SUM(source_size) OVER () AS all_size FROM sources
), filled AS (  -- in the order in which sources reach three times their size
  SELECT *, all_size - COALESCE(SUM(3 * source_size) OVER w, 0) AS rest, SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0) AS width FROM weighed
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, CAST(rest AS DOUBLE) * weight / CAST(width AS DOUBLE) > 3 * source_size AS full_up FROM filled
), level AS (
  SELECT CAST(MAX(all_size) - COALESCE(SUM(3 * source_size) FILTER (full_up), 0) AS DOUBLE) AS rest, CAST(SUM(weight) FILTER (NOT full_up) AS DOUBLE) AS width FROM marked
), targets AS (
  SELECT m.source, m.source_size, m.rank, m.all_size, CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE) ELSE l.rest * weight / l.width END AS target FROM marked m, level l
), queues AS (
  SELECT row_number() OVER () AS id, s.doc_id, s.size, t.source_size, t.rank, t.target, t.all_size,
         CAST(SUM(s.size) OVER (PARTITION BY t.rank ORDER BY md5('mix:' || COALESCE(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, copy * source_size + sent AS position, CAST(copy * source_size + sent AS DOUBLE) / target AS finish FROM queues, (SELECT UNNEST([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0
), sequence AS (
  SELECT id, size, all_size, SUM(size) OVER (ORDER BY finish, rank, position ROWS UNBOUNDED PRECEDING) AS total FROM copies
), took AS (
  SELECT id, SUM(GREATEST(0, size - GREATEST(0, total - all_size))) AS taken FROM sequence GROUP BY id
)
SELECT doc_id, size, source_size, target, CAST(COALESCE(taken, 0) AS BIGINT) AS taken FROM queues LEFT JOIN took USING (id)
"""
