"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have: `name`, with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rows_without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns as they are, without the rows whose id_col is in the one-column frame ids."""
    name = unused(docs, "gone")
    return docs.join(ids.toDF(name), F.col(id_col) == F.col(name), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def share(spark: SparkSession, thing: Any) -> Broadcast:
    """Broadcast an object of this package together with its class, so that executors need not have the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def opened(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A written df marked for broadcast if it has at most `most_rows` rows of fixed width; else it is left to the optimizer."""
    return F.broadcast(df) if df.count() <= most_rows else df


def split_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null doc_id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def deterministic_fraction(col: Column, fraction: float) -> Column:
    """True for about `fraction` of the values, the same ones in each run."""
    return F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) < int(fraction * (1 << 30))


class Bitmap:
    """Which hash values may occur, in 2 ** bits bits whatever their number: a filter before an exact join."""

    def __init__(self, bits: int = 23) -> None:
        self.mask, self.bytes = np.uint64((1 << bits) - 1), np.zeros(1 << (bits - 3), np.uint8)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = hashes & self.mask
        return (x >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slot, bit = self.place(hashes)
        return (self.bytes[slot] & bit) != 0


def bitmap_of(df: DataFrame, col: str, bits: int = 23) -> Bitmap:
    """Bitmap of the values of a long column; folded in the tasks, so at most 2 ** (bits - 3) slots reach the driver."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmap(bits)
        for b in batches:
            np.bitwise_or.at(own.bytes, *own.place(b.column(0).to_numpy().view(np.uint64)))
        used = np.flatnonzero(own.bytes)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own.bytes[used].astype(np.int64))], names=["slot", "bits"])

    got = df.select(F.col(col).cast("long").alias("h")).dropna().mapInArrow(fold, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = Bitmap(bits)
    out.bytes[got.column("slot").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return out
