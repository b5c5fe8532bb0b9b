"""Aggregates of product signals, user preferences and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days and corpus weight of each window; `all` has no bound.
WINDOWS = [("30d", 30, 1.0), ("90d", 90, 0.8), ("all", None, 0.6)]
MIN_REVIEWS = {"30d": 2, "90d": 2, "all": 2}
SIGNAL_KEY = ["target_product_id", "canonical_edge_type", "dst_node_type", "dst_node_id"]


def promoted(min_reviews: dict[str, int] | None = None, other: int = 3, confidence: float = 0.6, synthetic: float = 0.5) -> Column:
    """The corpus gate on an aggregate row."""
    need = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (min_reviews or MIN_REVIEWS).items() for x in kv]), F.col("window_type")), F.lit(other))
    return (F.col("distinct_review_count") >= need) & (F.col("avg_confidence") >= confidence) & (F.col("synthetic_ratio") <= synthetic)


def product_signals(signals: DataFrame, now: Column, dirty: DataFrame | None = None, evidence: int = 5) -> DataFrame:
    """Windowed aggregate of signals with the promotion gate. dirty: product ids to which the work is confined.

    A row counts in each window that holds its time; rows without a time count in `all` only. Catalog validation is left out.
    Confidence is summed in decimals, so that the order of the rows can't turn a rounding. Rows meet per review first, and each group keeps
    its first `evidence` reviews only, so the reviews of a group are never gathered in one row.
    """
    rows = signals.filter(~F.col("signal_family").eqNullSafe("CATALOG_VALIDATION"))
    if dirty is not None:
        rows = rows.join(dirty.select(F.col(dirty.columns[0]).alias("target_product_id")).distinct(), "target_product_id", "left_semi")
    inside = [F.struct(F.lit(w).alias("window_type"), F.lit(k).alias("decay"), (F.lit(True) if d is None else F.coalesce(F.col("window_ts") >= now - F.expr(f"INTERVAL {d} DAYS"), F.lit(False))).alias("in")) for w, d, k in WINDOWS]
    pol = F.upper(F.coalesce("polarity", F.lit("")))
    rows = rows.select(
        "target_product_id", F.col("edge_type").alias("canonical_edge_type"), F.col("dst_type").alias("dst_node_type"), F.col("dst_id").alias("dst_node_id"),
        F.nullif("review_id", F.lit("")).alias("review_id"), (pol == "POS").cast("int").alias("pos"), (pol == "NEG").cast("int").alias("neg"), "source_confidence",
        (F.col("evidence_kind") == "BEE_SYNTHETIC").cast("int").alias("syn"), "window_ts", F.explode(F.filter(F.array(*inside), lambda x: x["in"])).alias("w"),
    ).select("*", "w.window_type", "w.decay")
    key, n = [*SIGNAL_KEY, "window_type"], F.sum("n")
    sure = F.col("source_confidence").cast("decimal(18,6)")
    reviews = rows.groupBy(*key, "review_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(sure).alias("sure"), F.count(sure).alias("n_sure"), F.sum("syn").alias("syn"),
        F.max("window_ts").alias("window_ts"), F.max("decay").alias("decay"),
    )
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("review_id")))
    sample = reviews.select(*key, "review_id").withColumn("_r", first).where(F.col("_r") <= evidence).groupBy(*key).agg(F.array_sort(F.collect_list("review_id")).alias("evidence_sample"))
    out = reviews.groupBy(*key).agg(
        F.count("review_id").alias("distinct_review_count"), F.sum("pos").alias("pos_cnt"), F.sum("neg").alias("neg_cnt"),
        (n - F.sum("pos") - F.sum("neg")).alias("neu_cnt"), n.alias("support_count"), F.round((F.sum("pos") - F.sum("neg")) / n, 4).alias("score"),
        F.coalesce(F.sum("sure").cast("double") / F.sum("n_sure"), F.lit(0.0)).alias("conf"), F.round(F.coalesce(F.sum("syn"), F.lit(0)) / n, 4).alias("synthetic_ratio"),
        F.max("window_ts").alias("last_seen_at"), F.max("decay").alias("decay"),
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    out = out.alias("a").join(sample.alias("b"), same, "left").select("a.*", "b.evidence_sample")
    out = out.withColumn("avg_confidence", F.round("conf", 4)).withColumn("corpus_weight", F.round(F.col("distinct_review_count") * F.col("conf") * F.col("decay"), 4))
    return out.withColumn("is_promoted", promoted()).drop("conf", "decay")


def merged_facts(facts: DataFrame) -> DataFrame:
    """One row per fact: modalities as a set, provenance joined, the highest confidence, other columns of the earliest row by `ord`."""
    rest = [c for c in facts.columns if c not in ("fact_id", "source_modality", "provenance", "confidence", "ord")]
    return facts.groupBy("fact_id").agg(
        *[F.min_by(c, "ord").alias(c) for c in rest], F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source_modality")).alias("source_modalities"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "provenance"))), lambda x: x["provenance"]).alias("provenance"),
    )


def merged_signals(signals: DataFrame) -> DataFrame:
    """One row per signal: highest weight and confidence, MIXED where evidence kinds differ, fact ids in order."""
    rest = [c for c in signals.columns if c not in ("signal_id", "weight", "evidence_kind", "source_confidence", "fact_id", "ord")]
    kinds = F.collect_set("evidence_kind")
    return signals.groupBy("signal_id").agg(
        *[F.min_by(c, "ord").alias(c) for c in rest], F.max("weight").alias("weight"), F.max("source_confidence").alias("source_confidence"),
        F.when(F.size(kinds) > 1, "MIXED").otherwise(F.max("evidence_kind")).alias("evidence_kind"), F.array_sort(F.collect_set("fact_id")).alias("fact_ids"),
    )


def signal_evidence(merged: DataFrame) -> DataFrame:
    """(signal_id, fact_id, evidence_rank from 0)."""
    return merged.select("signal_id", F.posexplode("fact_ids").alias("evidence_rank", "fact_id"))


def edge_counts(rows: DataFrame, key: list[str], ord_: str) -> DataFrame:
    """Entities, mentions, keywords or edges once each, with their weight; other columns of the earliest row."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), *[F.min_by(c, ord_).alias(c) for c in rows.columns if c not in (*key, ord_)])


#: How far a source of preferences is trusted.
SOURCE_WEIGHTS = {"purchase": 1.2, "chat": 1.0, "basic": 0.8, "inferred": 0.6}


def user_preferences(facts: DataFrame, now: Column, decay: float = 0.01, cap: float = 1.5) -> DataFrame:
    """Preference weight by user, edge, destination and scope: confidence x frequency x recency x source."""
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv]), F.col("source")), F.lit(0.8))
    days = F.greatest(F.datediff(now, F.max("last_seen_at")), F.lit(0))
    weight = F.max(F.coalesce("confidence", F.lit(1.0))) * F.least(F.count(F.lit(1)) / 3, F.lit(cap)) * F.coalesce(F.exp(-decay * days), F.lit(1.0)) * F.max(trust)
    return facts.groupBy("user_id", "edge_type", "dst_id", "scope").agg(
        F.round(weight, 4).alias("weight"), F.count(F.lit(1)).alias("frequency"), F.max("last_seen_at").alias("last_seen_at"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )


def first_preferences(facts: DataFrame, ord_: str = "ord") -> DataFrame:
    """The first row of each user, edge, destination and scope."""
    w = Window.partitionBy("user_id", "edge_type", "dst_id", "scope").orderBy(ord_)
    return facts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def brand_confidence(purchases: DataFrame) -> DataFrame:
    """Quantity of a brand over that of the user's largest brand."""
    sums = purchases.groupBy("user_id", "brand").agg(F.sum("quantity").alias("quantity"))
    return sums.withColumn("confidence", F.round(F.col("quantity") / F.max("quantity").over(Window.partitionBy("user_id")), 4))


def purchase_features(purchases: DataFrame, again: int = 2) -> DataFrame:
    """Owned and repurchased sets per user. Purchases are counted per user and value first, so that no set holds repeats."""
    kinds = {"product": "product_id", "brand": "brand", "category": "category", "family": "family"}
    long = purchases.select("user_id", "purchased_at", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()])).alias("x")).select("user_id", "purchased_at", "x.*").filter("value IS NOT NULL")
    counted = long.groupBy("user_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("purchased_at").alias("last"))
    sets = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(f"owned_{k}s") for k in kinds]
    more = [F.array_sort(F.collect_set(F.when((F.col("kind") == k) & (F.col("n") >= again), F.col("value")))).alias(f"repurchased_{k}s") for k in ("brand", "category", "family")]
    return counted.groupBy("user_id").agg(*sets, *more, F.max("last").alias("last_purchased_at"))


def union_features(*features: DataFrame) -> DataFrame:
    """Purchase features of several sources as one row per user."""
    all_ = features[0]
    for f in features[1:]:
        all_ = all_.unionByName(f)
    arrays = [c for c, t in all_.dtypes if t.startswith("array")]
    return all_.groupBy("user_id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays], F.max("last_purchased_at").alias("last_purchased_at"))
