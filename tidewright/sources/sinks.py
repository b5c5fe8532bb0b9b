"""Writers: dated snapshots with a manifest, and merges into partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.incremental import upsert


def write_snapshot(rows: DataFrame, root: str, date: str) -> DataFrame:
    """Write {root}/dt=date and return its manifest. The data is there before the manifest names it."""
    path = f"{root}/dt={date}"
    rows.write.mode("overwrite").parquet(path)
    manifest = rows.sparkSession.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(path).alias("path"), F.lit(date).alias("date"), "rows")
    manifest.write.mode("append").parquet(f"{root}/_manifests")
    return manifest


def merge_table(new: DataFrame, path: str, version: str, key: list[str], previous: str | None = None) -> str:
    """Write {path}/v=version with new rows over those of the previous version, which stays readable meanwhile."""
    out = new if previous is None else upsert(new.sparkSession.read.schema(new.schema).parquet(previous), new, key)
    target = f"{path}/v={version}"
    out.write.mode("errorifexists").parquet(target)
    return target
