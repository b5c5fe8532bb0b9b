"""Serving profiles: the best rows per axis as bounded arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; ranked before anything is collected."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def top_signals(aggregates: DataFrame, window: str = "all", n: int = 10, promoted_only: bool = True) -> DataFrame:
    """Best destinations per product and edge, by score, reviews, id."""
    rows = aggregates.filter(F.col("window_type") == window)
    if promoted_only:
        rows = rows.filter("is_promoted")
    return top_n(rows, ["target_product_id", "canonical_edge_type"], [F.desc("score"), F.desc("distinct_review_count"), F.asc("dst_node_id")], n)


def product_profiles(products: DataFrame, aggregates: DataFrame, edges: list[str], window: str = "all", n: int = 10, promoted_only: bool = True) -> DataFrame:
    """Products with an array of (id, score, review_cnt) per edge, support and the last signal. Products without signals have empty arrays."""
    item = F.struct("rank", F.col("dst_node_id").alias("id"), "score", F.col("distinct_review_count").alias("review_cnt"))
    tops = top_signals(aggregates, window, n, promoted_only)
    cols = [F.transform(F.array_sort(F.collect_list(F.when(F.col("canonical_edge_type") == e, item))), lambda x: x.dropFields("rank")).alias(f"top_{e.lower()}_ids") for e in edges]
    best = tops.groupBy(F.col("target_product_id").alias("product_id")).agg(*cols)
    sums = aggregates.filter(F.col("window_type") == window).groupBy(F.col("target_product_id").alias("product_id")).agg(F.sum("support_count").alias("signal_support"), F.max("last_seen_at").alias("last_signal_at"))
    out = products.join(best, "product_id", "left").join(sums, "product_id", "left")
    return out.withColumns({f"top_{e.lower()}_ids": F.coalesce(f"top_{e.lower()}_ids", F.array()) for e in edges} | {"signal_support": F.coalesce("signal_support", F.lit(0))})


def user_profiles(users: DataFrame, preferences: DataFrame, edges: list[str], n: int = 20) -> DataFrame:
    """Users with the best preferences per edge (one row per destination: the heaviest), and the scoped ones as a list."""
    one = top_n(preferences, ["user_id", "edge_type", "dst_id"], [F.desc("weight"), F.asc("scope")], 1, "_r").drop("_r")
    tops = top_n(one, ["user_id", "edge_type"], [F.desc("weight"), F.asc("dst_id")], n)
    item = F.struct("rank", F.col("dst_id").alias("id"), "weight")
    cols = [F.transform(F.array_sort(F.collect_list(F.when(F.col("edge_type") == e, item))), lambda x: x.dropFields("rank")).alias(e.lower()) for e in edges]
    return users.join(tops.groupBy("user_id").agg(*cols), "user_id", "left").withColumns({e.lower(): F.coalesce(e.lower(), F.array()) for e in edges})


def evidence_samples(evidence: DataFrame, k: int = 5) -> DataFrame:
    """The first k facts of a signal, each with an equal part in it."""
    out = top_n(evidence, ["signal_id"], [F.asc("evidence_rank")], k)
    return out.withColumn("contribution", F.round(1 / F.count(F.lit(1)).over(Window.partitionBy("signal_id")), 4))


def overlay_master(profiles: DataFrame, master: DataFrame, columns: list[str]) -> DataFrame:
    """Master values win over profile values where they are there."""
    m = master.select("product_id", *[F.col(c).alias(f"_{c}") for c in columns])
    return profiles.join(m, "product_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])
