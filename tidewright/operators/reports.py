"""Reports: ratings, coverage, freshness, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rating_stats(reviews: DataFrame, by: list[str], today: Column, months: int = 6) -> DataFrame:
    """Counts and scores, all time and for the last calendar months. reviews: by, score, at."""
    recent = F.col("at") >= F.add_months(today, -months)
    score = lambda f, c: F.round(f(c), 4)
    return reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), score(F.avg, "score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.count_if(recent).alias("n_recent"), F.round(F.avg(F.when(recent, F.col("score"))), 4).alias("avg_recent"),
    )


def predicate_coverage(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """(predicate, n_facts, n_signals, covered): facts are counted once, however many signals their review has."""
    hit = signals.groupBy("review_id").agg(F.count(F.lit(1)).alias("_s"))
    return facts.join(hit, "review_id", "left").groupBy("predicate").agg(F.count_distinct("fact_id").alias("n_facts"), F.sum(F.coalesce("_s", F.lit(0))).alias("n_signals"), F.bool_or(F.col("_s").isNotNull()).alias("covered"))


def latest_runs(runs: DataFrame, n: int = 10, status: str | None = None) -> DataFrame:
    rows = runs if status is None else runs.filter(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("completed_at"), F.desc("run_id")).limit(n)


def top_counts(rows: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(n)


def promoted_counts(aggregates: DataFrame) -> DataFrame:
    return aggregates.groupBy("window_type").agg(F.count_if("is_promoted").alias("n_promoted"), F.count(F.lit(1)).alias("n"))
