"""Facts: contracts, gates and their projection to serving signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ids import signal_id


def check_contracts(facts: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason). contracts: predicate, subject_types, object_types, lists joined by a bar."""
    c = contracts.select("predicate", F.split("subject_types", r"\|").alias("_s"), F.split("object_types", r"\|").alias("_o"))
    out = facts.join(c, "predicate", "left").withColumn(
        "reason", F.when(F.col("_s").isNull(), "unknown predicate").when(~F.array_contains("_s", F.col("subject_type")), "subject type").when(~F.array_contains("_o", F.col("object_type")), "object type")
    )
    return out.filter("reason IS NULL").select(*facts.columns), out.filter("reason IS NOT NULL").select(*facts.columns, "reason")


def gate(min_confidence: float = 0.2) -> Column:
    """DROP, QUARANTINE, EVIDENCE_ONLY or PROMOTE of an edge."""
    linked = F.coalesce("linked", F.lit(False)) & ~F.coalesce("synthetic", F.lit(False))
    return F.when(F.coalesce("confidence", F.lit(0.0)) < min_confidence, "DROP").when(F.col("evidence_kind") == "AUTO_KEYWORD", "QUARANTINE").when(~linked, "EVIDENCE_ONLY").otherwise("PROMOTE")


def with_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts with the rule of their exact polarity, else that without one. rules: predicate, subject_type, object_type, polarity, family, edge, transform, evidence_kinds, min_confidence, action."""
    key = ["predicate", "subject_type", "object_type"]
    rule = F.struct("family", "edge", "transform", "evidence_kinds", "min_confidence", "action")
    exact = rules.filter(F.coalesce("polarity", F.lit("")) != "").select(*key, F.col("polarity").alias("_pol"), rule.alias("_exact"))
    blank = rules.filter(F.coalesce("polarity", F.lit("")) == "").select(*key, rule.alias("_blank"))
    out = facts.withColumn("_pol", F.coalesce("polarity", F.lit(""))).join(exact, [*key, "_pol"], "left").join(blank, key, "left")
    return out.withColumn("rule", F.coalesce("_exact", "_blank")).drop("_pol", "_exact", "_blank")


def outcome() -> Column:
    """SIGNAL, or why a fact with its rule makes none."""
    r = F.col("rule")
    fallback = F.when(r["action"].isin("DROP", "QUARANTINE", "KEEP_CANONICAL_ONLY"), r["action"]).otherwise("QUARANTINE")
    kinds = F.transform(F.split(F.coalesce(r["evidence_kinds"], F.lit("")), ","), lambda x: F.trim(x))
    wrong = (F.coalesce(r["evidence_kinds"], F.lit("")) != "") & ~F.coalesce(F.array_contains(kinds, F.col("evidence_kind")), F.lit(False))
    weak = F.coalesce("confidence", F.lit(0.0)) < F.coalesce(r["min_confidence"], F.lit(0.0))
    none = F.coalesce(r["family"], F.lit("")) == ""
    return F.when(r.isNull(), "QUARANTINE").when(none | wrong | weak, fallback).otherwise("SIGNAL")


def project(facts: DataFrame, rules: DataFrame, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(signals, others with outcome). `reverse` swaps the ends; `product_linkage` puts the review's product first."""
    out = with_rules(facts, rules).withColumn("outcome", F.when(F.coalesce("fact_status", F.lit("")) == "EVIDENCE_ONLY", "SKIP").otherwise(outcome()))
    t = F.col("rule.transform")
    src = F.when(t == "reverse", F.col("object_iri")).when(t == "product_linkage", F.col("product_iri")).otherwise(F.col("subject_iri"))
    dst = F.when(t == "reverse", F.col("subject_iri")).otherwise(F.col("object_iri"))
    signals = out.filter("outcome = 'SIGNAL'").select(
        signal_id("review_id", src, F.col("rule.edge"), dst, "polarity", F.lit(version)).alias("signal_id"), "fact_id", "review_id", src.alias("target_product_id"),
        F.col("rule.family").alias("signal_family"), F.col("rule.edge").alias("edge_type"), dst.alias("dst_id"), "polarity", F.col("confidence").alias("source_confidence"), "evidence_kind",
    )
    return signals, out.filter("outcome <> 'SIGNAL'").select(*facts.columns, "outcome")


def missing_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Combinations that occur and no rule covers."""
    key = ["predicate", "subject_type", "object_type"]
    return facts.select(*key).distinct().join(rules.select(*key).distinct(), key, "left_anti")


def sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): where each id is, in both, left only or right only."""
    both = left.select(key, F.lit(1).alias("l")).distinct().join(right.select(key, F.lit(1).alias("r")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both").alias("side"))


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of ids in both, left only and right only."""
    return sides(left, right, key).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
