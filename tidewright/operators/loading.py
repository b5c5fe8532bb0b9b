"""Loads as jobs: rows of embedded events with counters, pseudonyms, and several tables that become visible together."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def pseudonyms(rows: DataFrame, column: str, key: bytes, name: str = "pseudonym", digits: int = 32) -> DataFrame:
    """rows with the first hex digits of the HMAC-SHA256 of a column under a key; null stays null.

    The key is a value of the session's configuration that the caller passes. It reaches the expression through two one-row
    subqueries, so neither plan texts nor event logs show it.
    """
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pads = rows.sparkSession.sparkContext.parallelize([(bytearray(x ^ 0x36 for x in block), bytearray(x ^ 0x5C for x in block))], 1)
    held = rows.sparkSession.createDataFrame(pads, "inner binary, outer binary")
    inner, outer = held.select("inner").scalar(), held.select("outer").scalar()
    text = F.encode(F.col(column).cast("string"), "UTF-8")
    made = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)
    return rows.withColumn(name, F.when(F.col(column).isNotNull(), F.substring(made, 1, digits)))


def purchase_events(profiles: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(user_id, ord, product_id, quantity, purchased_at, price, channel): the events that stand in profiles, one row each.

    profiles: user_id, purchase_events, an array of JSON texts. An event without a product or with a quantity that is not a whole number above zero is
    left out; a quantity that is missing is 1; a time, price or channel of the wrong kind becomes null and the event stays. With an observation, what was
    left out and what became null is counted by the job that writes the rows, without another scan.
    """
    raw = profiles.select("user_id", F.posexplode("purchase_events").alias("ord", "j"))
    field = lambda name: F.get_json_object("j", f"$.{name}")
    # the kind of a value, from the text that it has in JSON
    kind = F.from_json("j", "struct<product_id:variant,quantity:variant,purchased_at:variant,price:variant,channel:variant>")
    is_kind = lambda name, *kinds: F.coalesce(F.schema_of_variant(F.col(f"k.{name}")).rlike("^(" + "|".join(kinds) + ")"), F.lit(False))
    there = lambda name: field(name).isNotNull()
    rows = raw.withColumn("k", kind)
    quantity = F.when(~there("quantity"), F.lit(1)).when(is_kind("quantity", "BIGINT"), F.try_to_number(field("quantity"), F.lit("9999999999")).cast("long"))
    told = {c: F.when(is_kind(c, *kinds), field(c)) for c, kinds in (("purchased_at", ["STRING"]), ("price", ["BIGINT", "DECIMAL", "DOUBLE"]), ("channel", ["STRING"]))}
    rows = rows.withColumns({"product_id": F.trim(field("product_id")), "quantity": quantity} | told)
    fits = F.coalesce((F.col("product_id") != "") & (F.col("quantity") > 0), F.lit(False))
    nulled = sum((F.when(there(c) & F.col(c).isNull(), 1).otherwise(0) for c in told), F.lit(0))
    rows = rows.withColumns({"_fits": fits, "_nulled": F.when(fits, nulled).otherwise(0)})
    if observation is not None:
        rows = rows.observe(observation, F.count_if("_fits").alias("kept"), F.count_if(~F.col("_fits")).alias("skipped"), F.coalesce(F.sum("_nulled"), F.lit(0)).alias("nulled"))
    return rows.where("_fits").select("user_id", "ord", "product_id", "quantity", "purchased_at", F.col("price").cast("double").alias("price"), "channel")


class Store:
    """Tables under one folder of the shared file system, seen through manifests: a reader sees the tables of one run, all of them or none.

    A run writes each table to a folder of its own and then, in one rename, a manifest that names them with the run's record: rows, the newest
    cursor, null keys and seconds of each table. What a run that was lost wrote stays unseen. A run whose manifest is there is not done again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """All finished runs, oldest first."""
        folder, files = self._path(f"{self.root}/manifests"), self._files()
        names = sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
        return [json.loads(r.value) for n in names if n.startswith("v=") for r in self.spark.read.text(f"{self.root}/manifests/{n}").collect()]

    def load(self, run_id: str, tables: dict[str, DataFrame], keys: dict[str, str], cursors: dict[str, str] | None = None) -> dict:
        """Write the tables as one run and return its record. keys: the column of each table that should not be null; cursors: a column whose highest value is kept."""
        done = self.manifests()
        for m in done:
            if m["run_id"] == run_id:
                return m
        stages = {}
        for name, rows in tables.items():
            began, seen = time.time(), Observation(f"{name}-{uuid.uuid4().hex}")
            newest = F.max(F.col(cursors[name]).cast("string")) if cursors and name in cursors else F.max(F.lit(None).cast("string"))
            path = f"{self.root}/data/{run_id}-{uuid.uuid4().hex}/{name}"
            rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(keys[name]).isNull()).alias("null_keys"), newest.alias("newest")).write.parquet(path)
            stages[name] = {"path": path, **seen.get, "seconds": round(time.time() - began, 3)}
        record = {"run_id": run_id, "number": len(done), "tables": stages}
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(staged)
        self._files().mkdirs(self._path(f"{self.root}/manifests"))
        target = self._path(f"{self.root}/manifests/v={len(done):08d}")
        if self._files().exists(target) or not self._files().rename(self._path(staged), target):
            raise RuntimeError(f"another run has taken number {len(done)}; its tables stand, those of {run_id} are not seen")
        return record

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as of the last run that has it, or of run `number`."""
        for m in reversed(self.manifests() if number is None else self.manifests()[: number + 1]):
            if table in m["tables"]:
                return self.spark.read.parquet(m["tables"][table]["path"])
        raise LookupError(f"no finished run has a table {table}")

    def run_log(self) -> DataFrame:
        """(run_id, number, table, rows, null_keys, newest, seconds) of all finished runs."""
        rows = [(m["run_id"], m["number"], name, s["rows"], s["null_keys"], s["newest"], s["seconds"]) for m in self.manifests() for name, s in m["tables"].items()]
        return self.spark.createDataFrame(rows, "run_id string, number int, table string, rows long, null_keys long, newest string, seconds double")
