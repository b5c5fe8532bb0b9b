"""Operators on rows written by hand, and all registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewright.functions import ids, text
from tidewright.operators import aggregate, facts, incremental, linking, normalize, profiles, quality, recommend, search, similarity
from tidewright.plans import registry
from tidewright.sources import readers, sinks

TINY = "/root/testdata/sf0.001"


def test_ids(spark):
    row = spark.range(1).select(
        ids.review_id(F.lit("a"), F.lit("k"), F.lit("x")).alias("key"), ids.review_id(F.lit("a"), F.lit(None), F.lit("x"), F.lit(None)).alias("hash"),
        ids.qualifier_fingerprint(F.expr("array(named_struct('key', 'b', 'value', '2'), named_struct('key', 'a', 'value', '1'))")).alias("q1"),
        ids.qualifier_fingerprint(F.expr("array(named_struct('key', 'a', 'value', '1'), named_struct('key', 'b', 'value', '2'))")).alias("q2"),
        ids.join_key(F.lit("concept:Brand:x")).alias("c"), ids.join_key(F.lit("product:7")).alias("p"), ids.join_key(F.lit("plain")).alias("n"),
        ids.signal_id(F.lit("r"), F.lit("p"), F.lit("e"), F.lit("d"), F.lit(""), F.lit("v")).alias("s1"), ids.signal_id(F.lit("r"), F.lit("p"), F.lit("e"), F.lit("d"), F.lit(""), F.lit("v"), F.lit(""), F.lit(None)).alias("s2"),
    ).first()
    assert row.key == "review:a:k" and row.hash.startswith("review:a:") and len(row.hash) == 41
    assert row.q1 == row.q2 and (row.c, row.p, row.n) == ("x", "7", "plain") and row.s1 == row.s2


def test_text(spark):
    row = spark.range(1).select(text.normalized(F.lit("  Ａ \t B "), compose=True).alias("n"), text.without_brand(F.lit("(New) Acme  Red Bolt"), F.lit("ACME")).alias("w"), text.shrinkage(F.lit(0)).alias("s0"), text.shrinkage(F.lit(1)).alias("s1"), text.freshness(F.lit(None).cast("int")).alias("f")).first()
    assert row.n == "ａ b" and row.w == "red bolt" and row.s0 == 0.1 and abs(row.s1 - 1 / 11) < 1e-12 and row.f == 0.0


SIGNAL = "target_product_id string, edge_type string, dst_type string, dst_id string, review_id string, polarity string, source_confidence double, evidence_kind string, window_ts timestamp, signal_family string"


def test_windows_and_gate(spark):
    from datetime import datetime, timedelta

    now = datetime(2024, 6, 1)
    rows = [("p", "e", "t", "d", f"r{k}", pol, conf, "REL", None if k is None else now - timedelta(days=k), fam) for k, pol, conf, fam in [(29, "pos", None, None), (30, "POS", 0.9, "x"), (31, "NEG", 0.5, "x"), (90, None, 0.7, "x"), (91, "NEU", 0.8, "x"), (None, "POS", 1.0, "x"), (1, "POS", 1.0, "CATALOG_VALIDATION")]]
    out = {r.window_type: r for r in aggregate.product_signals(spark.createDataFrame(rows, SIGNAL), F.lit(now)).collect()}
    assert [out[w].support_count for w in ("30d", "90d", "all")] == [2, 4, 6]
    assert out["30d"].pos_cnt == 2 and out["30d"].avg_confidence == 0.9 and out["30d"].is_promoted
    assert out["90d"].neg_cnt == 1 and out["90d"].neu_cnt == 1 and out["all"].distinct_review_count == 6


def test_aggregate_does_not_depend_on_partitions(spark):
    from tidewright.plans.core_queries import now, signals

    rows = signals(spark, TINY)
    one, many = (aggregate.product_signals(rows.repartition(n), now()) for n in (1, 7))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_similarity_is_symmetric(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("a", "all"), ("b", "all"), ("c", "all")], "item string, node string")
    near = {(r.a, r.b): r.score for r in similarity.neighbours(similarity.shared_nodes(nodes)).collect()}
    assert set(near) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")} and all(near[a, b] == near[b, a] for a, b in near)


def test_comentions(spark):
    rows = spark.createDataFrame([(r, p, s) for r in ("r1", "r2") for p, s in (("a", "POS"), ("b", None), ("c", "neg"), ("ghost", "POS"))], "review_id string, product_id string, polarity string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "product_id string")
    assert {(r.a, r.b, r.reviews, r.strength) for r in similarity.comentions(rows, known).collect()} == {("a", "b", 2, 0.4), ("b", "a", 2, 0.4)}


def test_groups_in_reviews(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(2, 1, 2), (2, 5, 6)], "review_id long, a long, b long")
    got = {(r.review_id, r.node): r.root for r in linking.groups_in_reviews(edges).collect()}
    assert all(got[1, i] == 0 for i in range(41)) and (got[2, 2], got[2, 6]) == (1, 5)
    mentions = spark.createDataFrame([(2, 1, "it", True), (2, 2, "cream", False), (2, 5, "x", False), (2, 6, "y", False), (2, 6, "y", False)], "review_id long, node long, word string, is_placeholder boolean")
    named = {(r.node, r.representative) for r in linking.representatives(mentions, linking.groups_in_reviews(edges)).collect()}
    assert named == {(1, "it"), (2, "it"), (5, "y"), (6, "y")}


def test_attribution(spark):
    phrases = spark.createDataFrame([(1, "r", "soft", "Texture", 4), (2, "r", "soft", "Texture", 9), (3, "r", "dry", "Skin", 0)], "phrase_id int, review_id string, text string, attr string, start int")
    rel = spark.createDataFrame([("r", "soft", "Texture", 4, "P", "direct", 1), ("r", "soft", "Texture", 50, "Q", "same_entity", 0)], "review_id string, obj_text string, obj_attr string, obj_start int, subject string, subject_kind string, ord int")
    got = {r.phrase_id: (r.subject, r.subject_kind, r.confidence) for r in linking.attribute(phrases, rel).collect()}
    assert got == {1: ("P", "direct", 1.0), 2: ("P", "direct", 1.0), 3: (None, "unlinked", 0.0)}


def test_fuzzy_products(spark):
    import difflib

    products = spark.createDataFrame([("1", "A", "red widget"), ("2", "A", "blue bolt"), ("3", "B", "red widgets")], "product_id string, brand string, name string")
    reviews = spark.createDataFrame([(1, "a", "red widgets"), (2, "a", "zzz"), (3, "c", "red widget")], "review_id long, brand string, name string")
    got = {r.review_id: r for r in linking.fuzzy_products(reviews, products).collect()}
    assert got[1].product_id == "1" and got[1].ratio == round(difflib.SequenceMatcher(None, "red widgets", "red widget").ratio(), 4) and got[1].verdict == "accepted"
    assert got[2].verdict == got[3].verdict == "quarantine"


def test_alias_chains(spark):
    flat = normalize.flat_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "alias string, canonical string"))
    assert {tuple(r) for r in flat.collect()} == {("a", "c"), ("b", "c"), ("x", "y")}
    with pytest.raises(ValueError):
        normalize.flat_aliases(spark.createDataFrame([("a", "b"), ("b", "a")], "alias string, canonical string"))


def test_greedy_diversity():
    rows = [(1.0, "b1", "c1"), (0.99, "b1", "c1"), (0.98, "b2", "c2"), (0.5, "", "")]
    assert [i for i, _ in recommend.greedy_diversity(rows, 0.05, 3)] == [0, 2, 1]
    assert [i for i, _ in recommend.greedy_diversity(rows, 0.0, 4)] == [0, 1, 2, 3]


def test_prefilter_holds_the_final_result(spark):
    keys = spark.createDataFrame([("1", "a"), ("1", "bad"), ("2", "a"), ("3", "b")], "product_id string, key string")
    one = lambda k: spark.createDataFrame([(k,)], "key string")
    assert {r.product_id for r in recommend.prefilter(keys, one("bad")).collect()} == {"2", "3"}
    assert {r.product_id for r in recommend.prefilter(keys, one("bad"), one("a")).collect()} == {"2"}


def test_reverse_matches_are_capped(spark):
    q = spark.createDataFrame([(1, "aa ab ac")], "query_id long, text string")
    v = spark.createDataFrame([("n", f"k{i}", s) for i, s in enumerate(["aa", "ab", "ac", "z", "a"])], "axis string, key string, surface string")
    assert search.resolve(q, v, cap=2).isEmpty() and search.resolve(q, v, cap=3).count() == 3


def test_projection_prefers_the_exact_polarity(spark):
    f = spark.createDataFrame([("f", "r", "s", "o", "p", "P", "A", "B", "NEG", 0.9, "REL", "PROMOTE")], "fact_id string, review_id string, subject_iri string, object_iri string, product_iri string, predicate string, subject_type string, object_type string, polarity string, confidence double, evidence_kind string, fact_status string")
    rule = "predicate string, subject_type string, object_type string, polarity string, family string, edge string, transform string, evidence_kinds string, min_confidence double, action string"
    rules = spark.createDataFrame([("P", "A", "B", "", "F", "ANY", "identity", "", 0.0, ""), ("P", "A", "B", "NEG", "F", "NEGATIVE", "reverse", "", 0.0, "")], rule)
    assert [(r.edge_type, r.target_product_id) for r in facts.project(f, rules)[0].collect()] == [("NEGATIVE", "o")]


def test_profiles_without_signals(spark):
    from tidewright.plans.core_queries import aggregates

    products = spark.createDataFrame([("none",)], "product_id string")
    row = profiles.product_profiles(products, aggregates(spark, TINY), ["F"]).first()
    assert row.top_f_ids == [] and row.signal_support == 0


def test_landing_aborts_on_many_rejects(spark):
    cur, new = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    merged, counts = incremental.merge_landing(cur, new, ["id"], F.col("v").isNotNull())
    assert {tuple(r) for r in merged.select("id", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")} and {r.change: r.n for r in counts.collect()} == {"added": 1, "updated": 1, "carried": 1}
    with pytest.raises(ValueError):
        incremental.merge_landing(cur, new.withColumn("v", F.lit(None).cast("string")), ["id"], F.col("v").isNotNull())


def test_checks(spark):
    rows = spark.createDataFrame([("k", "x"), ("k", "y"), ("m", "z")], "k string, v string")
    assert {r["check"]: r.status for r in quality.checks(("twice", quality.collisions(rows, "k", ["v"])), ("none", rows.limit(0))).collect()} == {"twice": "failed", "none": "ok"}
    assert [r.k for r in quality.unambiguous(rows, "k", ["v"]).collect()] == ["m"]


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('{"ONLINE_PROD_SERIAL_NUMBER": "1", "CTGR_L_NAME": "Top", "CTGR_S_NAME": " ", "SALE_PRICE": "1,200", "MAIN_INGREDIENT": "a, b,,", "BRAND_NAME": "X", "REVIEW_SCORE": "n/a"}\n{"prd_nm": "no id"}\nbroken\n')
    rows = readers.read_catalog(spark, str(path))
    row = rows.first()
    assert rows.count() == 1 and row.category == "Top" and str(row.price) == "1200.00" and row.ingredients == ["a", "b"] and row.review_score is None
    assert {(r.axis, r.concept) for r in readers.catalog_concepts(rows).collect()} == {("brand", "x"), ("category", "top"), ("ingredient", "a"), ("ingredient", "b")}
    reviews = tmp_path / "reviews.json"
    reviews.write_text('{"source_review_key": "k1", "text": "t", "drup_dt": "2024-01-02", "ner": [{"word": "w", "start": 1}]}\n{"text": "u", "drup_dt": "never"}\n')
    parts = readers.reviews_to_rows(readers.read_reviews(spark, str(reviews)), "src")
    got = {r.review_id: r.event_at_source for r in parts["review"].collect()}
    assert got.pop("review:src:k1") == "created" and list(got.values()) == ["run"] and parts["ner"].count() == 1
    assert sinks.write_snapshot(rows, str(tmp_path / "snap"), "2024-01-01").first().rows == 1
    old = sinks.merge_table(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), str(tmp_path / "t"), "1", ["id"])
    new = sinks.merge_table(spark.createDataFrame([(2, "c")], "id long, v string"), str(tmp_path / "t"), "2", ["id"], old)
    assert {tuple(r) for r in spark.read.parquet(new).select("id", "v").collect()} == {(1, "a"), (2, "c")}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(TINY):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TINY}/{f}'")
    return con


def _rows(table):
    table = table[sorted(table.columns)]
    return sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in table.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, TINY).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, TINY).count() > 0


def test_term_clusters_equal_greedy(spark):
    import difflib
    import random

    rng = random.Random(15)
    terms = sorted({rng.choice("ab") + "".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(150)})
    rows = [(attr, t, rng.randint(1, 5)) for attr in ("x", None) for t in terms]
    want = set()
    for attr in ("x", None):
        heads: list[str] = []
        for _, t in sorted((-n, t) for a, t, n in rows if a == attr):
            head = next((h for h in heads if h[0] == t[0] and difflib.SequenceMatcher(None, h, t).ratio() >= 0.7), None)
            heads += [] if head else [t]
            want.add((attr, t, head or t))
    assert {tuple(r) for r in quality.term_clusters(spark.createDataFrame(rows, "attr string, term string, n int")).collect()} == want


def test_queries_read_whole_input(spark, tmp_path):
    from tidewright.plans import more_queries

    spark.createDataFrame([(1, "some filling words " * 10 + "lighthouse", "en"), (2, "short words", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "lighthouse" in {r.term for r in more_queries.term_clusters(spark, str(tmp_path)).collect()}
    n = spark.read.parquet(f"{TINY}/orders.parquet").select("o_custkey").distinct().count()
    assert sum(r.n for r in more_queries.chosen_documents(spark, TINY).collect()) == n
