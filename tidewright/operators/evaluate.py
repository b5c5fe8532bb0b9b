"""Ranking metrics over tables of rankings and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, dcg, idcg, ndcg, hit_1, hit_k) per judged query. ranked: query_id, item, rank from 1; judged: query_id, item, gain."""
    discount = lambda r: F.log2(r + F.lit(1.0))
    got = judged.filter("gain > 0").join(ranked.filter(F.col("rank") <= k), ["query_id", "item"]).groupBy("query_id").agg(
        F.sum(F.col("gain") / discount(F.col("rank"))).alias("dcg"), F.max((F.col("rank") == 1).cast("int")).alias("hit_1"), F.lit(1).alias("hit_k")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item"))
    ideal = judged.filter("gain > 0").withColumn("_r", place).filter(F.col("_r") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / discount(F.col("_r"))).alias("idcg"))
    out = ideal.join(got, "query_id", "left").na.fill({"dcg": 0.0, "hit_1": 0, "hit_k": 0})
    return out.select("query_id", F.round("dcg", 4).alias("dcg"), F.round("idcg", 4).alias("idcg"), F.round(F.col("dcg") / F.col("idcg"), 4).alias("ndcg"), "hit_1", "hit_k")


def slot_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Micro-averaged precision and recall of slots (query_id, slot, value) per slot."""
    key = ["query_id", "slot", "value"]
    both = expected.select(*key, F.lit(1).alias("e")).distinct().join(actual.select(*key, F.lit(1).alias("a")).distinct(), key, "full_outer").na.fill(0, ["e", "a"])
    out = both.groupBy("slot").agg(F.sum(F.col("e") * F.col("a")).alias("hits"), F.sum("e").alias("expected"), F.sum("a").alias("actual"))
    return out.select("slot", "hits", F.round(F.try_divide("hits", "actual"), 4).alias("precision"), F.round(F.try_divide("hits", "expected"), 4).alias("recall"))


def ranking_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rank and score changes of two snapshots; rows of one side only are added or removed."""
    o, n = (t.select(*key, F.col("rank").alias(f"rank_{s}"), F.col("score").alias(f"score_{s}")) for t, s in ((old, "old"), (new, "new")))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("rank_old").isNull(), "added").when(F.col("rank_new").isNull(), "removed").when(F.col("rank_old") != F.col("rank_new"), "moved").when(F.col("score_old") != F.col("score_new"), "rescored").otherwise("same")
    return both.withColumn("change", change)


def rates(outcomes: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """The share of rows for which each flag holds, per stratum."""
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 4).alias(f"{c}_rate") for c in flags])
