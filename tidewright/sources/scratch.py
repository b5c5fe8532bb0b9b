"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder only in local mode and only if that is not set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/work/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as written and read again, which cuts its lineage and survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df as `saved`, in as many files as there are shuffle partitions: few bytes that a join turns into many rows should not be one task's."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartition(n, *by))


def together(df: DataFrame, by: str, rows: int, each: int = 1 << 20) -> DataFrame:
    """df dealt by one column into parts that each become about `each` of `rows` rows, so that joins with small sides and groups by this column and others need no further exchange."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // each)), by)


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A saved df, marked for broadcast if it has at most so many short rows; a larger one is joined by exchanges."""
    return F.broadcast(df) if df.count() <= rows else df
