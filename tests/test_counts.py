from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import aggregate as A
from tidewright.operators import serving as V


def test_product_with_two_avoided_keys_counts_once(spark):
    avoided = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "x"), (2, "none"), (3, "none"), (4, None)], "user_id int, key string")
    keys = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "y"), ("q", "y"), ("r", None)], "product_id string, key string")
    assert {tuple(r) for r in V.exclusion_counts(avoided, keys).collect()} == {(1, 2, 2), (2, 1, 1)}


def test_evidence_is_the_first_reviews_of_a_group(spark):
    rows = [("p", "E", "T", None, r, "POS", 0.5, "REL", None, None) for r in ["r9", "r1", "r1", None, "", "r7", "r3", "r5", "r8"]] + [("p", "E", "T", "d", None, None, None, None, None, None)]
    names = "target_product_id string, edge_type string, dst_type string, dst_id string, review_id string, polarity string, source_confidence double, evidence_kind string, window_ts timestamp, signal_family string"
    got = {r.dst_node_id: r for r in A.product_signals(spark.createDataFrame(rows, names), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got[None].evidence_sample == ["r1", "r3", "r5", "r7", "r8"] and got[None].distinct_review_count == 6 and got[None].support_count == 9
    assert got["d"].evidence_sample == [] and got["d"].avg_confidence == 0.0 and got["d"].neu_cnt == 1


def test_codes_meet_the_catalog(spark):
    rows = spark.createDataFrame([(1, " a "), (2, "b"), (3, None), (4, " "), (5, "a")], "id int, code string")
    catalog = spark.createDataFrame([("a",), ("a ",), (None,), ("",)], "known string")
    assert {tuple(r) for r in V.joined_codes(rows, "code", catalog, "known").select("id", "state").collect()} == {(1, "joinable"), (2, "not_joinable"), (3, "missing"), (4, "missing"), (5, "joinable")}


def test_purchases_have_one_outcome_each(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), ("", 1.0, 1), ("p", None, 1), ("p", 0.0, None), ("p", 1.0, None), ("p", 1.0, 1)], "product_id string, quantity double, purchased_at int")
    assert [r.outcome for r in V.purchase_outcomes(rows).collect()] == ["no_product", "no_product", "bad_quantity", "bad_quantity", "no_date", "kept"]
