"""Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, glob: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(glob)


def daily_buckets(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums per day and type; a day closes when the watermark passes it. Trailing windows sum closed days when read."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def trailing(buckets: DataFrame, until: str, days: int) -> DataFrame:
    """Sums of the last `days` daily buckets before a date."""
    end = F.to_timestamp(F.lit(until))
    return buckets.filter((F.col("day") < end) & (F.col("day") >= end - F.expr(f"INTERVAL {days} DAYS"))).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def first_events(events: DataFrame, key: list[str], late: str = "2 days") -> DataFrame:
    """Events once each by key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", apply: Callable[[DataFrame, int], None] | None = None) -> None:
    """Work through all that has arrived and stop; the next run goes on after it. apply: what to do with each batch instead of appending it."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    (writer.foreachBatch(apply) if apply else writer.format("parquet").option("path", out)).start().awaitTermination()


def apply_batches(spark: SparkSession, out: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """Each micro-batch becomes a version of a table in which later rows win; a repeated batch overwrites its own version."""

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("x")).select("x.*")
        if number:
            old = batch.sparkSession.read.parquet(f"{out}/v={number - 1}")
            last = last.unionByName(old.join(last.select(*key), key, "left_anti").select(*last.columns))
        last.write.mode("overwrite").parquet(f"{out}/v={number}")

    return apply


def last_version(spark: SparkSession, out: str) -> DataFrame:
    """The table after the last batch that `apply_batches` has finished; versions are folders v=number, found through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()[2:]) for f in files.listStatus(path) if f.getPath().getName().startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{out}/v={max(done)}")


#: What `refresh_states` gives: a product's aggregate as of its last refresh, rows held back for being late, and how far its events have been worked in.
REFRESHED = "product_id string, kind string, row_id long, ts timestamp, n long, total double, cursor timestamp"


class ProductState(StatefulProcessor):
    """Per product: count, sum and cursor of the rows worked in, and late rows, which are held until the product is next looked at.

    A row is late if it is older than the newest time that its product had seen, less `late`. It does not move the cursor, is told as held
    at once, and waits in the state; the next batch that has a row of the product works it in, so that many late rows cost one refresh. A row
    without row_id only asks for that. The cursor is the newest time up to which nothing is held, so a reader that goes on from it misses no
    row. A repeated row_id counts once.
    """

    def __init__(self, late_seconds: int) -> None:
        self.late = late_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, total double, newest timestamp")
        self.seen = handle.getMapState("seen", "row_id long", "ts timestamp")
        self.held = handle.getMapState("held", "row_id long", "ts timestamp, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, total, newest = self.sums.get() if self.sums.exists() else (0, 0.0, None)
        waiting = [(i, ts, value) for (i,), (ts, value) in self.held.iterator()] if self.held.exists() else []
        for row_id, ts, value in waiting:
            self.seen.updateValue((row_id,), (ts,))
            n, total = n + 1, total + value
        if waiting:
            self.held.clear()
        late, before, new = {}, newest, len(waiting)
        for batch in rows:
            for row_id, ts, value in batch.loc[batch["row_id"].notna(), ["row_id", "ts", "value"]].itertuples(index=False):
                row_id, ts, value = int(row_id), ts.to_pydatetime(), float(value)
                if row_id in late or self.seen.containsKey((row_id,)):
                    continue
                if before is not None and ts < before - timedelta(seconds=self.late):
                    self.held.updateValue((row_id,), (ts, value))
                    late[row_id] = ts
                else:
                    self.seen.updateValue((row_id,), (ts,))
                    n, total, new = n + 1, total + value, new + 1
                    newest = ts if newest is None else max(newest, ts)
        self.sums.update((n, total, newest))
        cursor = newest if not late else min([newest, *[t - timedelta(microseconds=1) for t in late.values()]])
        out = [(key[0], "held", i, ts, n, total, cursor) for i, ts in late.items()]
        if new:
            out.append((key[0], "refreshed", None, newest, n, total, cursor))
        if out:
            frame = pd.DataFrame(out, columns=["product_id", "kind", "row_id", "ts", "n", "total", "cursor"])
            yield frame.astype({"row_id": "Int64"})


def refresh_states(events: DataFrame, late_seconds: int = 2 * 86400) -> DataFrame:
    """A stream of REFRESHED rows from a stream of (product_id, row_id, ts, value); a product's last `refreshed` row is its aggregate.

    Needs the RocksDB state store. State grows with the rows of a product's life: whoever needs it bounded lets the key carry a period.
    """
    own = events.select(F.col("product_id").cast("string"), F.col("row_id").cast("long"), "ts", F.col("value").cast("double"))
    return own.groupBy("product_id").transformWithStateInPandas(ProductState(late_seconds), outputStructType=REFRESHED, outputMode="append", timeMode="none")
