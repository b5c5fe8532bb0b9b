"""Registered queries: text, linking, facts, recommendation, search, evaluation, increments, checks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import ids
from tidewright.functions.text import normalized
from tidewright.operators import aggregate as A
from tidewright.operators import evaluate as E
from tidewright.operators import facts as K
from tidewright.operators import incremental as I
from tidewright.operators import linking as L
from tidewright.operators import normalize as N
from tidewright.operators import quality as Q
from tidewright.operators import recommend as R
from tidewright.operators import reports as W
from tidewright.operators import search as S
from tidewright.plans import tables as T
from tidewright.plans.core_queries import _AGG, aggregates, now, signals
from tidewright.sources.readers import event_props
from tidewright.sources.scratch import new_folder
from tidewright.streaming import jobs as J


def table(spark, d, sql):
    return T.from_sql(spark, d, sql)


# --- text and ids -------------------------------------------------------------------------------------------------
def text_normalized(spark, d):
    return table(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", F.md5(normalized("text").cast("binary")).alias("digest"))


def fact_ids(spark, d):
    rows = table(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'N' THEN NULL ELSE l_returnflag END AS flag FROM lineitem")
    return rows.select("l_orderkey", "l_linenumber", ids.fact_id("l_orderkey", ids.product_iri("l_partkey"), F.lit("SOLD_BY"), ids.concept_iri("Supplier", "l_suppkey"), "flag", F.lit("")).alias("fact_id"))


_PHRASES = "SELECT p_partkey AS phrase_id, CASE p_size % 3 WHEN 0 THEN 'not ' WHEN 1 THEN 'very  ' ELSE 'not never ' END || upper(p_name) AS phrase, p_type AS attr, CASE p_size % 2 WHEN 0 THEN ' Good' ELSE 'bad' END AS sentiment FROM part"


def phrases(spark, d):
    attrs = spark.createDataFrame([("ECONOMY", "a1"), ("SMALL", "a2")], "attr string, attr_id string")
    tone = spark.createDataFrame([("good", "POS"), ("bad", "NEG")], "sentiment string, polarity string")
    words = spark.createDataFrame([("not", "negator"), ("never", "negator"), ("un", "negating_start"), ("bit", "weak"), ("very", "strong")], "term string, kind string")
    return N.phrases(table(spark, d, _PHRASES), attrs, tone, words).select("phrase_id", "attr_id", "polarity", "negated", "confidence", "intensity")


def keywords(spark, d):
    words = spark.createDataFrame([("ring", "k1"), ("red", "k2"), ("blue", "k3"), ("bolt", "k4"), ("widget", "k5")], "surface string, keyword_id string")
    alias = spark.createDataFrame([("k5", "k4")], "alias string, canonical string")
    return N.keywords(table(spark, d, _PHRASES), words, N.flat_aliases(alias))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN ' 3 times a  week' WHEN 2 THEN '2 Weeks now' WHEN 3 THEN 'in the Morning' ELSE o_orderpriority END AS t FROM orders"


def dates(spark, d):
    patterns = spark.createDataFrame([
        ("kind", "AbsoluteDate", r"\d{4}-\d{2}-\d{2}", 1), ("kind", "Frequency", r"(?i)\d+\s*times", 2), ("kind", "Duration", r"(?i)\d+\s*weeks?", 3), ("context", "day_part", "morning|evening", 4),
    ], "role string, name string, pattern string, ord int")
    return table(spark, d, _DATES).select("o_orderkey", N.dates(F.col("t"), patterns).alias("x")).select("o_orderkey", "x.kind", "x.value", "x.context")


_GROUPS = [("fastener", "bolt|screw|nut"), ("jewel", "ring"), ("gadget", "widget|gear")]


def category_groups(spark, d):
    return W.top_counts(N.category_groups(table(spark, d, "SELECT p_name, p_type FROM part"), ["p_name", "p_type"], _GROUPS), ["grp"], 100)


# --- linking ------------------------------------------------------------------------------------------------------
_REVIEWS = "SELECT o_orderkey AS review_id, CASE o_orderkey % 10 WHEN 0 THEN 'S' || CAST(o_custkey AS STRING) END AS source_id, 'Brand#' || CAST(o_custkey % 27 AS STRING) AS brand, CASE o_orderkey % 3 WHEN 0 THEN '(new) BRAND#' || CAST(o_custkey % 27 AS STRING) || ' red  bolt' WHEN 1 THEN 'Small Ring' ELSE 'unheard of' END AS name FROM orders"
_CATALOG = "SELECT CAST(p_partkey AS STRING) AS product_id, CASE p_size WHEN 9 THEN 'S' || CAST(p_partkey AS STRING) END AS source_id, p_brand AS brand, p_name AS name FROM part"


def product_match(spark, d):
    alias = spark.createDataFrame([("unheard  OF", "7")], "alias string, product_id string")
    return L.match_products(table(spark, d, _REVIEWS), table(spark, d, _CATALOG), alias).select("review_id", "product_id", "method")


def fuzzy_match(spark, d):
    reviews = table(spark, d, "SELECT o_orderkey AS review_id, 'Brand#' || CAST(o_custkey % 27 AS STRING) AS brand, CASE o_orderkey % 4 WHEN 0 THEN 'smal ring' WHEN 1 THEN 'red widgets' WHEN 2 THEN 'bleu bolt' ELSE 'zzz' END AS name FROM orders")
    return L.fuzzy_products(reviews, table(spark, d, _CATALOG))


_EDGES = "SELECT l_orderkey AS review_id, l_partkey % 12 AS a, l_suppkey % 12 AS b FROM lineitem"


def review_groups(spark, d):
    return L.groups_in_reviews(table(spark, d, _EDGES))


def chosen_documents(spark, d):
    products = table(spark, d, "SELECT o_custkey AS product_id, 'x' || CAST(o_custkey % 400 AS STRING) AS source_id, o_orderpriority AS category FROM orders").dropDuplicates(["product_id"])
    docs = table(spark, d, "SELECT o_orderkey AS doc_id, 'x' || CAST(o_custkey % 500 AS STRING) AS source_id, o_orderpriority AS category, o_orderdate AS updated_at, o_custkey AS review_count FROM orders")
    return W.top_counts(L.choose_document(products.withColumn("category", F.lit("2-HIGH")), docs), ["status"], 10)


def representative_skus(spark, d):
    bought = table(spark, d, "SELECT o_custkey AS user_id, p_name AS family, o_orderdate AS purchased_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
    return L.representative_skus(bought, table(spark, d, "SELECT p_name AS family, p_partkey AS product_id FROM part")).withColumn("purchased_on", F.col("purchased_on").cast("string"))


# --- facts --------------------------------------------------------------------------------------------------------
_FACTS = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fact_id, CAST(l_orderkey AS STRING) AS review_id, 'p' || CAST(l_partkey AS STRING) AS subject_iri, 's' || CAST(l_suppkey AS STRING) AS object_iri, 'p0' AS product_iri, CASE l_linestatus WHEN 'O' THEN 'SOLD' ELSE 'SENT' END AS predicate, CASE WHEN l_linenumber < 3 THEN 'Product' ELSE 'Mention' END AS subject_type, 'Supplier' AS object_type, CASE l_returnflag WHEN 'R' THEN 'NEG' WHEN 'A' THEN 'POS' ELSE '' END AS polarity, 1 - l_discount AS confidence, CASE WHEN l_tax > 0.04 THEN 'DICT' ELSE 'REL' END AS evidence_kind, CASE WHEN l_linenumber = 2 THEN 'EVIDENCE_ONLY' ELSE 'PROMOTE' END AS fact_status FROM lineitem"
_RULES = [("SOLD", "Product", "Supplier", "", "MASTER", "SOLD_BY", "identity", "", 0.0, "QUARANTINE"), ("SOLD", "Product", "Supplier", "NEG", "MASTER", "REFUSED_BY", "reverse", "DICT, X", 0.0, "DROP"), ("SENT", "Product", "Supplier", "", "", "", "identity", "", 0.0, "KEEP_CANONICAL_ONLY"), ("SOLD", "Mention", "Supplier", "POS", "WEAK", "NAMED", "product_linkage", "", 0.95, "")]


def rules(spark):
    return spark.createDataFrame(_RULES, "predicate string, subject_type string, object_type string, polarity string, family string, edge string, transform string, evidence_kinds string, min_confidence double, action string")


def contract_rejects(spark, d):
    contracts = spark.createDataFrame([("SOLD", "Product|User", "Supplier"), ("SENT", "Mention", "Supplier|Brand")], "predicate string, subject_types string, object_types string")
    return K.check_contracts(table(spark, d, _FACTS), contracts)[1].groupBy("predicate", "reason").agg(F.count(F.lit(1)).alias("n"))


def projected_signals(spark, d):
    return K.project(table(spark, d, _FACTS), rules(spark))[0].select("fact_id", "target_product_id", "edge_type", "dst_id", "signal_family")


def projection_outcomes(spark, d):
    return K.project(table(spark, d, _FACTS), rules(spark))[1].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def missing_rules(spark, d):
    return K.missing_rules(table(spark, d, _FACTS), rules(spark))


def promotion_gate(spark, d):
    rows = table(spark, d, "SELECT l_discount * 4 AS confidence, CASE l_returnflag WHEN 'R' THEN 'AUTO_KEYWORD' ELSE 'REL' END AS evidence_kind, l_linestatus = 'O' AS linked, l_tax > 0.05 AS synthetic FROM lineitem")
    return rows.select(K.gate().alias("gate")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def merged_facts(spark, d):
    rows = table(spark, d, "SELECT CAST(l_partkey AS STRING) || '|' || CAST(l_suppkey AS STRING) AS fact_id, l_linestatus AS source_modality, CAST(l_orderkey AS STRING) AS provenance, 1 - l_discount AS confidence, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS polarity FROM lineitem")
    return A.merged_facts(rows).select("fact_id", "polarity", F.round("confidence", 4).alias("confidence"), F.array_join("source_modalities", ",").alias("modalities"), F.array_join("provenance", ",").alias("provenance"))


# --- recommendation -----------------------------------------------------------------------------------------------
_USERS = "SELECT o_custkey AS user_id, CASE l_linenumber % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'category' ELSE 'similar' END AS axis, CASE l_linenumber % 3 WHEN 0 THEN p_brand || p_name WHEN 1 THEN p_name || CAST(p_size AS STRING) ELSE p_brand || CAST(p_size AS STRING) END AS key, 1 - l_discount AS strength FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'"
_HAS = "SELECT CAST(p_partkey AS STRING) AS product_id, 'keyword' AS axis, p_brand || p_name AS key FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 'category', p_name || CAST(p_size AS STRING) FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 'similar', p_brand || CAST(p_size AS STRING) FROM part"
_MET = f"u AS (SELECT user_id, axis, key, max(strength) AS strength FROM ({_USERS}) GROUP BY 1, 2, 3), h AS (SELECT DISTINCT * FROM ({_HAS})), met AS (SELECT user_id, product_id, axis, key, strength FROM u JOIN h USING (axis, key))"
_SHOP = "SELECT CAST(p_partkey AS STRING) AS product_id, p_brand AS brand_id, p_type AS category_id, p_size % 15 AS review_count_30d, p_size * 3 AS review_count_all, 3.5 + p_size % 4 * 0.4 AS rating FROM part"
_OWNED = "SELECT DISTINCT o_custkey AS user_id, CAST(l_partkey AS STRING) AS product_id, p_brand AS brand_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1"


def met(spark, d):
    return R.overlaps(table(spark, d, _USERS), table(spark, d, _HAS))


def class_met(spark, d, attributes=None):
    classes = R.product_classes(table(spark, d, _HAS), attributes)
    return R.class_overlaps(table(spark, d, _USERS), classes), classes


def candidate_overlaps(spark, d):
    rows, classes = class_met(spark, d)
    found = rows.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("strength"), 4).alias("best"))
    return R.of_products(found, classes).select("user_id", "product_id", "n", "best")


def eligible_candidates(spark, d):
    rows, classes = class_met(spark, d)
    return R.of_products(R.eligible(rows), classes).select("user_id", "product_id", "n_overlaps")


def retrieved_candidates(spark, d):
    rows, classes = class_met(spark, d)
    return R.retrieve_classes(R.eligible(rows), classes, table(spark, d, _OWNED), 10).select("user_id", "product_id", "own", "n_overlaps", "rank")


def _rounded_met(spark, d):
    rows, classes = class_met(spark, d, table(spark, d, _SHOP))
    return rows.withColumn("strength", F.round("strength", 2)), classes, table(spark, d, _OWNED)


def scored_candidates(spark, d):
    rows, classes, owned = _rounded_met(spark, d)
    scored = R.scores_of_products(R.score_classes(rows, classes, owned), classes)
    return scored.select("user_id", "product_id", F.round("raw_score", 9).alias("raw_score"), F.round("final_score", 9).alias("final_score"))


def reranked(spark, d):
    return R.rerank(R.first_scores(*_rounded_met(spark, d), 20), 10)


def explanations(spark, d):
    rows, classes = class_met(spark, d)
    return R.of_products(R.explanations(rows, 3), classes).select("user_id", "product_id", "axis", "key", "contribution", "rank")


def filter_reasons(spark, d):
    rows = table(spark, d, "SELECT p_size < 3 AS excluded_product, p_brand = 'Brand#2' AS excluded_brand, p_type = 'SMALL' AS excluded_category, p_size = 40 AS avoided_ingredient, p_name LIKE 'red%' AS category_mismatch, CAST(NULL AS BOOLEAN) AS owned, p_size = 30 AS owned_family, p_size = 20 AS no_evidence, p_size % 2 = 0 AS strict FROM part")
    return rows.select(R.filter_reason(F.col("strict")).alias("filter_reason")).groupBy("filter_reason").agg(F.count(F.lit(1)).alias("n"))


def prefiltered(spark, d):
    keys = table(spark, d, "SELECT CAST(l_partkey AS STRING) AS product_id, l_suppkey AS key FROM lineitem")
    avoided, preferred = (table(spark, d, f"SELECT s_suppkey AS key FROM supplier WHERE s_suppkey % 10 = {k}") for k in (3, 4))
    return R.prefilter(keys, avoided, preferred)


def constraint_states(spark, d):
    keys = table(spark, d, "SELECT DISTINCT CAST(l_partkey AS STRING) AS product_id, l_suppkey AS key FROM lineitem")
    wanted = table(spark, d, "SELECT s_suppkey % 2 AS query_id, s_suppkey % 4 AS family, s_suppkey AS key FROM supplier")
    return R.meets_constraints(keys, wanted)


def next_questions(spark, d):
    rows = table(spark, d, "SELECT o_custkey AS user_id, CAST(l_linenumber AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) AS b, 0.0D AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    return R.next_question(rows, ["c", "b", "a"])


# --- search and evaluation ----------------------------------------------------------------------------------------
_ASK = "SELECT p_partkey AS query_id, 'Show not  ' || p_name || ' of ' || p_brand AS text FROM part"


def vocabulary(spark, d):
    return table(spark, d, "SELECT DISTINCT 'name' AS axis, p_name AS key, p_name AS surface FROM part UNION ALL SELECT DISTINCT 'brand', p_brand, p_brand FROM part UNION ALL SELECT 'word', 'w1', 'red' UNION ALL SELECT 'word', 'w2', 'r'")


_RES = "q AS (SELECT query_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM (" + _ASK + ")), v AS (SELECT DISTINCT 'name' AS axis, p_name AS key, lower(p_name) AS surface FROM part UNION ALL SELECT DISTINCT 'brand', p_brand, lower(p_brand) FROM part UNION ALL SELECT 'word', 'w1', 'red'), m AS (SELECT DISTINCT query_id, axis, key, surface FROM q JOIN v ON contains(t, surface)), r AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m l WHERE l.query_id = m.query_id AND l.axis = m.axis AND length(l.surface) > length(m.surface) AND contains(l.surface, m.surface)))"


def resolved_concepts(spark, d):
    return S.resolve(table(spark, d, _ASK), vocabulary(spark, d))


def concept_search(spark, d):
    has = table(spark, d, "SELECT CAST(p_partkey AS STRING) AS product_id, 'name' AS axis, p_name AS key FROM part UNION ALL SELECT CAST(p_partkey AS STRING), 'brand', p_brand FROM part")
    return S.search(S.resolve(table(spark, d, _ASK), vocabulary(spark, d)), has, n=5).select("query_id", "product_id", "hits", "rank")


def understood_queries(spark, d):
    return S.understand(table(spark, d, _ASK), vocabulary(spark, d), ["not", "without"], ["brand", "name", "word"]).select("query_id", "surface", "axis", "key", "negated")


def unread_tokens(spark, d):
    q = table(spark, d, _ASK)
    return S.unread_tokens(q, S.resolve(q, vocabulary(spark, d)))


_RANKED = "SELECT l_orderkey AS query_id, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem"
_JUDGED = "SELECT l_orderkey AS query_id, l_partkey AS item, CAST(max(l_quantity) AS INT) % 4 AS gain FROM lineitem GROUP BY 1, 2"


def ranking_metrics(spark, d):
    ranked = table(spark, d, _RANKED).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    return E.ranking_metrics(ranked, table(spark, d, _JUDGED), 3)


def slot_scores(spark, d):
    sql = "SELECT l_orderkey AS query_id, l_shipmode AS slot, CAST(l_suppkey % 5 AS STRING) AS value FROM lineitem WHERE ".replace("l_shipmode", "l_linestatus")
    return E.slot_scores(table(spark, d, sql + "l_returnflag = 'A'"), table(spark, d, sql + "l_returnflag <> 'A'"))


def ranking_diff(spark, d):
    old = table(spark, d, "SELECT o_custkey AS user_id, o_orderkey AS item, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 7 <> 0")
    new = table(spark, d, "SELECT o_custkey AS user_id, o_orderkey AS item, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % 5 <> 0")
    return E.ranking_diff(old, new, ["user_id", "item"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def outcome_rates(spark, d):
    return E.rates(table(spark, d, "SELECT o_orderpriority AS stratum, o_orderstatus = 'F' AS done, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_totalprice > 100000 END AS large FROM orders"), ["stratum"], ["done", "large"])


# --- increments ---------------------------------------------------------------------------------------------------
_OLD = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0"


def change_counts(spark, d):
    return I.changes(table(spark, d, _OLD), table(spark, d, _NEW), ["o_orderkey"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def upserted(spark, d):
    return I.upsert(table(spark, d, _OLD), table(spark, d, _NEW), ["o_orderkey"])


def row_diff(spark, d):
    return I.row_diff(table(spark, d, _OLD), table(spark, d, _NEW), "o_orderkey", {"money": ["o_totalprice"], "who": ["o_custkey", "o_orderpriority"]})


def review_versions(spark, d):
    current = table(spark, d, "SELECT o_orderkey AS review_id, 1 AS version, o_orderpriority AS payload, o_orderstatus <> 'P' AS active FROM orders WHERE o_orderkey % 3 <> 0")
    incoming = table(spark, d, "SELECT o_orderkey AS review_id, CASE o_orderkey % 5 WHEN 0 THEN 'new' ELSE o_orderpriority END AS payload, o_orderkey % 7 = 0 AS deleted FROM orders")
    return I.review_versions(current, incoming, now()).select("review_id", "version", "op", "payload", "active")


def fact_changes(spark, d):
    old = table(spark, d, "SELECT o_orderkey AS fact_id, CASE o_orderstatus WHEN 'F' THEN o_orderdate END AS valid_to FROM orders WHERE o_orderkey % 3 <> 0")
    return I.fact_changes(old, table(spark, d, "SELECT o_orderkey AS fact_id FROM orders WHERE o_orderkey % 4 <> 0")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def changed_rows(spark, d):
    rows = table(spark, d, "SELECT o_orderdate AS updated_at, o_orderkey AS id FROM orders")
    return I.changed_since(rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")), ("1998-06-01 00:00:00", 5000), "1999-01-01 00:00:00").withColumn("updated_at", F.col("updated_at").cast("string"))


def cursor_after_skips(spark, d):
    return I.safe_cursor(table(spark, d, "SELECT o_orderdate AS updated_at, o_orderkey AS id, o_orderdate > TIMESTAMP '1998-03-01 00:00:00' AND o_orderkey % 100 = 7 AS skipped FROM orders"))


def incremental_equals_full(spark, d):
    """Aggregates of an older state with the dirty products done anew; the same as a full run over the new state."""
    new = signals(spark, d)
    old = new.filter("CAST(review_id AS BIGINT) % 4 <> 0")
    changed = new.filter("CAST(review_id AS BIGINT) % 4 = 0")
    table_, dirty = I.replace_signals(old, changed, changed.select("review_id").distinct())
    before = A.product_signals(old, now())
    return I.refresh_products(before, A.product_signals(table_, now(), dirty), dirty).drop("evidence_sample")


def soft_deleted(spark, d):
    rows = table(spark, d, "SELECT o_custkey AS user_id, max(o_orderdate) AS last_seen_at, CASE o_custkey % 10 WHEN 0 THEN FALSE END AS is_active FROM orders GROUP BY o_custkey")
    return I.soft_deleted(rows, now(), 900).select("user_id", "is_active")


# --- checks and reports -------------------------------------------------------------------------------------------
def contract_report(spark, d):
    rows = table(spark, d, "SELECT * FROM documents")
    bad = Q.validated(rows, {"short": F.length("text") < 500, "no_language": F.col("lang").isNull(), "source_zero": F.col("source") == "src0", "french": F.col("lang") == "fr"})[1]
    return Q.reason_report(bad)


def data_checks(spark, d):
    agg = aggregates(spark, d)
    return Q.checks(
        ("promotion", agg.filter("is_promoted AND (distinct_review_count < 2 OR avg_confidence < 0.6 OR synthetic_ratio > 0.5)")),
        ("missing_customers", Q.missing_parents(table(spark, d, "SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 9"), "o_custkey", table(spark, d, "SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 1"), "c_custkey")),
        ("collisions", Q.collisions(table(spark, d, "SELECT p_name, p_brand, p_type FROM part"), "p_name", ["p_brand", "p_type"])),
    )


def unambiguous_parts(spark, d):
    return Q.unambiguous(table(spark, d, "SELECT p_partkey, p_name || CAST(p_size AS STRING) AS k, p_brand FROM part"), "k", ["p_brand"]).select("p_partkey", "k")


def quarantined(spark, d):
    rows = table(spark, d, "SELECT p_partkey, p_size, p_name FROM part")
    bad = Q.validated(rows, {"big": F.col("p_size") > 45, "ring": F.contains("p_name", F.lit("ring"))})[1]
    return Q.quarantine(part=bad).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def retention(spark, d):
    return Q.retention({"orders": table(spark, d, "SELECT o_orderkey FROM orders"), "parts": table(spark, d, "SELECT p_partkey FROM part")}, {"orders": 1000, "parts": 1 << 40})


def term_clusters(spark, d):
    words = table(spark, d, "SELECT lang AS attr, explode(split(text, '\\\\s+')) AS term, 1 AS n FROM documents").filter("term <> ''")
    return Q.term_clusters(words)


def rating_stats(spark, d):
    rows = table(spark, d, "SELECT l_linestatus AS channel, l_partkey AS product_id, CASE l_returnflag WHEN 'N' THEN NULL ELSE CAST(l_quantity AS BIGINT) % 5 + 1 END AS score, l_shipdate AS at FROM lineitem")
    return W.rating_stats(rows, ["channel", "product_id"], F.to_date(now()))


def predicate_coverage(spark, d):
    return W.predicate_coverage(table(spark, d, _FACTS), signals(spark, d))


def promoted_counts(spark, d):
    return W.promoted_counts(aggregates(spark, d))


def latest_runs(spark, d):
    return W.latest_runs(table(spark, d, "SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderdate END AS completed_at, o_orderstatus AS status FROM orders"), 10)


def top_event_types(spark, d):
    return W.top_counts(event_props(table(spark, d, "SELECT * FROM events")).filter("k >= 50"), ["event_type"])


# --- streams ------------------------------------------------------------------------------------------------------
def _stream(spark, d):
    return J.read_events(spark, f"{d}/event[s].parquet")


def stream_daily(spark, d):
    out = new_folder(spark)
    J.run_once(J.daily_buckets(_stream(spark, d)), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").filter("day < TIMESTAMP '2024-01-27 00:00:00'").select("day", "event_type", "n", F.round("total", 2).alias("total"))


def stream_trailing(spark, d):
    out = new_folder(spark)
    J.run_once(J.daily_buckets(_stream(spark, d)), f"{out}/data", f"{out}/state")
    return J.trailing(spark.read.parquet(f"{out}/data"), "2024-01-25", 7)


def stream_first(spark, d):
    out = new_folder(spark)
    J.run_once(J.first_events(_stream(spark, d), ["event_id"]), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").select("event_id", "user_id", "event_type")


def stream_upsert(spark, d):
    out = new_folder(spark)
    J.run_once(_stream(spark, d), "", f"{out}/state", apply=J.apply_batches(spark, f"{out}/data", ["user_id"]))
    return J.last_version(spark, f"{out}/data").select("user_id", "event_id", "event_type")


def stream_refreshed(spark, d):
    """Events arrive in three runs of one stream; late ones are held and worked in by the run after, at last by a request for every product."""
    out, key = new_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    kind = "product_id string, row_id long, ts timestamp, value double"
    events = table(spark, d, "SELECT COALESCE(CAST(user_id AS STRING), '') AS product_id, event_id AS row_id, ts, COALESCE(value, 0) AS value FROM events")
    asked = events.groupBy("product_id").agg(F.lit(None).cast("long").alias("row_id"), F.min("ts").alias("ts"), F.lit(0.0).alias("value"))
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(4):
            (events.where(F.pmod("row_id", F.lit(3)) == k) if k < 3 else asked).write.parquet(f"{out}/in/b={k}")
            J.run_once(J.refresh_states(spark.readStream.schema(kind).parquet(f"{out}/in/*")), f"{out}/data", f"{out}/state")
    finally:
        spark.conf.set(key, before)
    told = spark.read.schema(J.REFRESHED).parquet(f"{out}/data").groupBy("product_id")
    new = F.when(F.col("kind") == "refreshed", F.struct("n", "total"))
    return told.agg(F.max(new).alias("x"), F.count_if(F.col("kind") == "held").alias("n_held")).select("product_id", "x.n", F.round("x.total", 2).alias("total"), "n_held")


_REFRESHED = """
WITH e AS (SELECT COALESCE(CAST(user_id AS VARCHAR), '') AS product_id, event_id % 3 AS b, ts, COALESCE(value, 0) AS value FROM events), t AS (SELECT product_id, b, MAX(ts) AS newest FROM e GROUP BY 1, 2)
SELECT product_id, COUNT(*) AS n, ROUND(SUM(value), 2) AS total, COUNT(*) FILTER (ts < (SELECT MAX(newest) FROM t WHERE t.product_id = e.product_id AND t.b < e.b) - INTERVAL 2 DAY) AS n_held FROM e GROUP BY product_id
"""
_EXPLODED = "SELECT kind, reason, count(*) AS n FROM (SELECT 'part' AS kind, concat_ws(',', CASE WHEN p_size > 45 THEN 'big' END, CASE WHEN contains(p_name, 'ring') THEN 'ring' END) AS reason FROM part) WHERE reason <> '' GROUP BY 1, 2"
_RV = "SELECT * FROM (SELECT i.review_id, coalesce(c.version, 0) + 1 AS version, CASE WHEN deleted THEN CASE WHEN active THEN 'TOMBSTONE' END WHEN c.version IS NULL THEN 'INSERT' WHEN NOT active THEN 'REACTIVATE' WHEN c.payload <> i.payload THEN 'UPDATE' END AS op, i.payload, NOT (deleted AND active) AS active FROM (SELECT o_orderkey AS review_id, CASE o_orderkey % 5 WHEN 0 THEN 'new' ELSE o_orderpriority END AS payload, o_orderkey % 7 = 0 AS deleted FROM orders) i LEFT JOIN (SELECT o_orderkey AS review_id, 1 AS version, o_orderpriority AS payload, o_orderstatus <> 'P' AS active FROM orders WHERE o_orderkey % 3 <> 0) c USING (review_id)) WHERE op IS NOT NULL"
_SCORE = f"""WITH {_MET}, s AS (SELECT user_id, product_id, axis, round(strength, 2) AS strength FROM met),
g AS (SELECT user_id, product_id, least(coalesce(sum(strength) FILTER (axis = 'keyword'), 0) / 3, 1) * 0.16 + least(coalesce(sum(strength) FILTER (axis = 'category'), 0), 1) * 0.05 + least(coalesce(sum(strength) FILTER (axis = 'similar'), 0), 1) * 0.02 AS f FROM s GROUP BY 1, 2),
o AS ({_OWNED}), x AS (SELECT g.user_id, g.product_id, review_count_all AS n, f + 0.04 * CASE WHEN review_count_30d > 10 THEN 1 WHEN review_count_30d > 3 THEN 0.6 WHEN review_count_30d > 0 THEN 0.3 ELSE 0 END + 0.03 * least(ln(1 + review_count_all) / ln(1001), 1) + 0.02 * greatest(0, least(1, rating - 4))
 + 0.02 * CASE WHEN own.product_id IS NOT NULL THEN 0 WHEN kb.brand_id IS NOT NULL THEN 0.5 ELSE 1 END - 0.05 * CASE WHEN own.product_id IS NOT NULL THEN 1 ELSE 0 END AS raw
 FROM g JOIN ({_SHOP}) p USING (product_id) LEFT JOIN (SELECT DISTINCT user_id, product_id FROM o) own ON own.user_id = g.user_id AND own.product_id = g.product_id LEFT JOIN (SELECT DISTINCT user_id, brand_id FROM o) kb ON kb.user_id = g.user_id AND kb.brand_id = p.brand_id)
SELECT user_id, product_id, round(CAST(raw AS DOUBLE), 9) AS raw_score, round(round(CAST(raw AS DOUBLE), 9) * CASE WHEN n > 0 THEN n / (n + 10) ELSE 0.1 END, 9) AS final_score FROM x"""

QUERIES = {
    "text_normalized": (text_normalized, "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents"),
    "fact_ids": (fact_ids, "SELECT l_orderkey, l_linenumber, 'fact:' || md5(l_orderkey || '|product:' || l_partkey || '|SOLD_BY|concept:Supplier:' || l_suppkey || '|' || CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END || '|') AS fact_id FROM lineitem"),
    "phrases": (phrases, "SELECT p_partkey AS phrase_id, CASE p_type WHEN 'ECONOMY' THEN 'a1' WHEN 'SMALL' THEN 'a2' ELSE 'bee_attr_' || lower(p_type) END AS attr_id, CASE WHEN (p_size % 2 = 0) <> (p_size % 3 = 0) THEN 'POS' ELSE 'NEG' END AS polarity, p_size % 3 = 0 AS negated, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 1.0::DOUBLE ELSE 0.7 END AS confidence, CASE p_size % 3 WHEN 1 THEN 1.5::DOUBLE ELSE 1.0 END AS intensity FROM part"),
    "keywords": (keywords, f"SELECT DISTINCT phrase_id, CASE k WHEN 'k5' THEN 'k4' ELSE k END AS keyword_id FROM ({_PHRASES}) JOIN (VALUES ('ring', 'k1'), ('red', 'k2'), ('blue', 'k3'), ('bolt', 'k4'), ('widget', 'k5')) v(s, k) ON contains(lower(phrase), s)"),
    "date_kinds": (dates, f"WITH t AS ({_DATES}) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'AbsoluteDate' WHEN 1 THEN 'Frequency' WHEN 2 THEN 'Duration' ELSE 'TemporalContext' END AS kind, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS value, CASE o_orderkey % 5 WHEN 3 THEN 'day_part' WHEN 4 THEN 'general' END AS context FROM t"),
    "category_groups": (category_groups, "SELECT CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'bolt|screw|nut') THEN 'fastener' WHEN regexp_matches(lower(p_name), 'ring') THEN 'jewel' WHEN regexp_matches(lower(p_name), 'widget|gear') THEN 'gadget' ELSE 'other' END AS grp, count(*) AS n FROM part GROUP BY 1"),
    "product_match": (product_match, f"WITH r AS ({_REVIEWS}), c AS (SELECT product_id, source_id, lower(brand) AS b, lower(name) AS n FROM ({_CATALOG})), s AS (SELECT source_id, min(product_id) AS p FROM c WHERE source_id IS NOT NULL GROUP BY 1), e AS (SELECT b, n, min(product_id) AS p FROM c GROUP BY 1, 2), u AS (SELECT n, min(product_id) AS p FROM c GROUP BY 1 HAVING count(*) = 1), x AS (SELECT review_id, source_id, lower(brand) AS b, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS n FROM r), y AS (SELECT x.*, s.p AS p1, e.p AS p2, u.p AS p3, CASE x.n WHEN 'unheard of' THEN '7' END AS p4 FROM x LEFT JOIN s USING (source_id) LEFT JOIN e ON e.b = x.b AND e.n = x.n LEFT JOIN u ON u.n = CASE WHEN starts_with(x.n, '(new)') THEN 'red bolt' ELSE x.n END) SELECT review_id, coalesce(p1, p2, p3, p4) AS product_id, CASE WHEN p1 IS NOT NULL THEN 'source_id' WHEN p2 IS NOT NULL THEN 'exact' WHEN p3 IS NOT NULL THEN 'bare' WHEN p4 IS NOT NULL THEN 'alias' ELSE 'none' END AS method FROM y"),
    "fuzzy_match": (fuzzy_match, None),
    "review_groups": (review_groups, f"WITH RECURSIVE e AS (SELECT DISTINCT review_id, a, b FROM ({_EDGES}) UNION SELECT DISTINCT review_id, b, a FROM ({_EDGES})), r AS (SELECT review_id, a AS node, b AS hit FROM e UNION SELECT r.review_id, node, e.b FROM r JOIN e ON e.review_id = r.review_id AND e.a = r.hit) SELECT review_id, node, least(node, min(hit)) AS root FROM r GROUP BY review_id, node"),
    "chosen_documents": (chosen_documents, None),
    "representative_skus": (representative_skus, "SELECT DISTINCT o_custkey AS user_id, (SELECT min(q.p_partkey) FROM part q WHERE q.p_name = p.p_name) AS product_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS purchased_on FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part p ON p_partkey = l_partkey"),
    "contract_rejects": (contract_rejects, f"SELECT predicate, 'subject type' AS reason, count(*) AS n FROM ({_FACTS}) WHERE (predicate = 'SOLD' AND subject_type <> 'Product') OR (predicate = 'SENT' AND subject_type <> 'Mention') GROUP BY 1"),
    "projected_signals": (projected_signals, f"SELECT fact_id, CASE WHEN subject_type = 'Mention' THEN 'p0' WHEN polarity = 'NEG' THEN object_iri ELSE subject_iri END AS target_product_id, CASE WHEN subject_type = 'Mention' THEN 'NAMED' WHEN polarity = 'NEG' THEN 'REFUSED_BY' ELSE 'SOLD_BY' END AS edge_type, CASE WHEN subject_type = 'Product' AND polarity = 'NEG' THEN subject_iri ELSE object_iri END AS dst_id, CASE subject_type WHEN 'Mention' THEN 'WEAK' ELSE 'MASTER' END AS signal_family FROM ({_FACTS}) WHERE fact_status <> 'EVIDENCE_ONLY' AND predicate = 'SOLD' AND ((subject_type = 'Product' AND (polarity <> 'NEG' OR evidence_kind = 'DICT')) OR (subject_type = 'Mention' AND polarity = 'POS' AND confidence >= 0.95))"),
    "projection_outcomes": (projection_outcomes, f"SELECT CASE WHEN fact_status = 'EVIDENCE_ONLY' THEN 'SKIP' WHEN predicate = 'SENT' AND subject_type = 'Product' THEN 'KEEP_CANONICAL_ONLY' WHEN predicate = 'SOLD' AND subject_type = 'Product' THEN 'DROP' ELSE 'QUARANTINE' END AS outcome, count(*) AS n FROM ({_FACTS}) WHERE NOT (fact_status <> 'EVIDENCE_ONLY' AND predicate = 'SOLD' AND ((subject_type = 'Product' AND (polarity <> 'NEG' OR evidence_kind = 'DICT')) OR (subject_type = 'Mention' AND polarity = 'POS' AND confidence >= 0.95))) GROUP BY 1"),
    "missing_rules": (missing_rules, "SELECT 'SENT' AS predicate, 'Mention' AS subject_type, 'Supplier' AS object_type"),
    "promotion_gate": (promotion_gate, "SELECT CASE WHEN l_discount * 4 < 0.2 THEN 'DROP' WHEN l_returnflag = 'R' THEN 'QUARANTINE' WHEN NOT (l_linestatus = 'O' AND NOT l_tax > 0.05) THEN 'EVIDENCE_ONLY' ELSE 'PROMOTE' END AS gate, count(*) AS n FROM lineitem GROUP BY 1"),
    "merged_facts": (merged_facts, "SELECT l_partkey || '|' || l_suppkey AS fact_id, min_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS polarity, round(max(1 - l_discount), 4) AS confidence, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS modalities, string_agg(CAST(l_orderkey AS STRING), ',' ORDER BY l_orderkey * 10 + l_linenumber) AS provenance FROM lineitem GROUP BY l_partkey, l_suppkey"),
    "candidate_overlaps": (candidate_overlaps, f"WITH {_MET} SELECT user_id, product_id, count(*) AS n, round(max(strength), 4) AS best FROM met GROUP BY 1, 2"),
    "eligible_candidates": (eligible_candidates, f"WITH {_MET} SELECT user_id, product_id, count(*) FILTER (axis <> 'similar') AS n_overlaps FROM met GROUP BY 1, 2 HAVING count(*) FILTER (axis <> 'similar') > 0"),
    "retrieved_candidates": (retrieved_candidates, f"WITH {_MET}, e AS (SELECT user_id, product_id, count(*) FILTER (axis <> 'similar') AS n_overlaps FROM met GROUP BY 1, 2 HAVING count(*) FILTER (axis <> 'similar') > 0), o AS (SELECT DISTINCT user_id, product_id, 1 AS own FROM ({_OWNED})) SELECT user_id, product_id, coalesce(own, 0) AS own, n_overlaps, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(own, 0), n_overlaps DESC, product_id) AS INT) AS rank FROM e LEFT JOIN o USING (user_id, product_id) QUALIFY rank <= 10"),
    "scored_candidates": (scored_candidates, _SCORE),
    "reranked": (reranked, None),
    "explanations": (explanations, f"WITH {_MET}, c AS (SELECT user_id, product_id, axis, key, round(CASE axis WHEN 'keyword' THEN 0.16 WHEN 'category' THEN 0.05 ELSE 0.02 END * strength / sum(strength) OVER (PARTITION BY user_id, product_id, axis), 6) AS contribution FROM met) SELECT *, CAST(row_number() OVER (PARTITION BY user_id, product_id ORDER BY abs(contribution) DESC, axis, key) AS INT) AS rank FROM c QUALIFY rank <= 3"),
    "filter_reasons": (filter_reasons, "SELECT CASE WHEN p_size < 3 THEN 'excluded_product' WHEN p_brand = 'Brand#2' THEN 'excluded_brand' WHEN p_type = 'SMALL' THEN 'excluded_category' WHEN p_size = 40 THEN 'avoided_ingredient' WHEN p_name LIKE 'red%' AND p_size % 2 = 0 THEN 'category_mismatch' WHEN p_size = 30 THEN 'owned_family' WHEN p_size = 20 THEN 'no_evidence' END AS filter_reason, count(*) AS n FROM part GROUP BY 1"),
    "prefiltered_products": (prefiltered, "SELECT CAST(l_partkey AS VARCHAR) AS product_id FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_suppkey % 10 = 3) = 0 AND count(*) FILTER (l_suppkey % 10 = 4) > 0"),
    "constraint_states": (constraint_states, "SELECT s_suppkey % 2 AS query_id, CAST(l_partkey AS VARCHAR) AS product_id, CASE WHEN count(DISTINCT s_suppkey % 4) = 2 THEN 'met' ELSE 'failed' END AS state FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"),
    "next_questions": (next_questions, "WITH v AS (SELECT o_custkey AS user_id, round(var_pop(l_linenumber), 9) AS va, round(var_pop(l_quantity), 9) AS vb, avg(l_quantity) AS mb FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT user_id, CASE WHEN vb <= va THEN 'b' ELSE 'a' END AS axis FROM v"),
    "resolved_concepts": (resolved_concepts, f"WITH {_RES} SELECT * FROM r"),
    "concept_search": (concept_search, f"WITH {_RES}, h AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS product_id, 'name' AS axis, p_name AS key FROM part UNION SELECT CAST(p_partkey AS VARCHAR), 'brand', p_brand FROM part), x AS (SELECT query_id, product_id, count(*) AS hits FROM (SELECT DISTINCT query_id, axis, key FROM r) JOIN h USING (axis, key) GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, product_id) AS INT) AS rank FROM x QUALIFY rank <= 5"),
    "understood_queries": (understood_queries, f"WITH {_RES}, x AS (SELECT *, CASE axis WHEN 'brand' THEN 1 WHEN 'name' THEN 2 ELSE 3 END AS o FROM r) SELECT x.query_id, surface, min_by(axis, o) AS axis, min_by(key, o) AS key, bool_or(regexp_extract(t, '(?:^| )(?:not|without) (\\S+)', 1) = surface) AS negated FROM x JOIN q USING (query_id) GROUP BY 1, 2"),
    "unread_tokens": (unread_tokens, f"WITH {_RES}, w AS (SELECT DISTINCT query_id, unnest(string_split(t, ' ')) AS word FROM q), k AS (SELECT DISTINCT query_id, unnest(string_split(surface, ' ')) AS word FROM r) SELECT * FROM w EXCEPT SELECT * FROM k"),
    "ranking_metrics": (ranking_metrics, f"WITH r AS (SELECT query_id, item, min(rank) AS rank FROM ({_RANKED}) GROUP BY 1, 2), j AS (SELECT * FROM ({_JUDGED}) WHERE gain > 0), i AS (SELECT query_id, sum(gain / log2(p + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item) AS p FROM j QUALIFY p <= 3) GROUP BY 1), g AS (SELECT query_id, sum(gain / log2(rank + 1)) AS dcg, max(CAST(rank = 1 AS INT)) AS hit_1 FROM j JOIN r USING (query_id, item) WHERE rank <= 3 GROUP BY 1) SELECT query_id, round(coalesce(dcg, 0), 4) AS dcg, round(idcg, 4) AS idcg, round(coalesce(dcg, 0) / idcg, 4) AS ndcg, coalesce(hit_1, 0) AS hit_1, CAST(dcg IS NOT NULL AS INT) AS hit_k FROM i LEFT JOIN g USING (query_id)"),
    "slot_scores": (slot_scores, "WITH s AS (SELECT DISTINCT l_orderkey AS q, l_linestatus AS slot, l_suppkey % 5 AS v, l_returnflag = 'A' AS e FROM lineitem), p AS (SELECT q, slot, v, bool_or(e) AS e, bool_or(NOT e) AS a FROM s GROUP BY 1, 2, 3) SELECT slot, count(*) FILTER (e AND a) AS hits, round(count(*) FILTER (e AND a) / count(*) FILTER (a), 4) AS precision, round(count(*) FILTER (e AND a) / count(*) FILTER (e), 4) AS recall FROM p GROUP BY 1"),
    "ranking_diff": (ranking_diff, "WITH x AS (SELECT o_custkey AS u, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 7 <> 0), y AS (SELECT o_custkey AS u, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 <> 0) SELECT CASE WHEN x.r IS NULL THEN 'added' WHEN y.r IS NULL THEN 'removed' WHEN x.r <> y.r THEN 'moved' ELSE 'same' END AS change, count(*) AS n FROM x FULL JOIN y ON x.u = y.u AND x.i = y.i GROUP BY 1"),
    "outcome_rates": (outcome_rates, "SELECT o_orderpriority AS stratum, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 4) AS done_rate, round(avg(CAST(o_orderstatus <> 'P' AND o_totalprice > 100000 AS INT)), 4) AS large_rate FROM orders GROUP BY 1"),
    "change_counts": (change_counts, f"SELECT CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'carried' WHEN o.o_totalprice = n.o_totalprice THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey GROUP BY 1"),
    "upserted_orders": (upserted, f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) WHERE o_orderkey % 4 = 0"),
    "row_diff": (row_diff, f"SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS side, CASE WHEN o.o_totalprice <> n.o_totalprice THEN 'money' ELSE '' END AS groups FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey WHERE o.o_totalprice IS DISTINCT FROM n.o_totalprice"),
    "review_versions": (review_versions, _RV),
    "fact_changes": (fact_changes, "SELECT op, count(*) AS n FROM (SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN w.k IS NULL AND v IS NULL THEN 'close' WHEN w.k IS NULL THEN NULL WHEN v IS NULL THEN 'refresh' ELSE 'reactivate' END AS op FROM (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN o_orderdate END AS v FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0) w ON o.k = w.k) WHERE op IS NOT NULL GROUP BY 1"),
    "changed_rows": (changed_rows, "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at, o_orderkey AS id FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-06-01 00:00:00', 5000) AND o_orderdate <= TIMESTAMP '1999-01-01 00:00:00'"),
    "cursor_after_skips": (cursor_after_skips, "WITH s AS (SELECT o_orderdate AS t, o_orderkey AS i, o_orderdate > TIMESTAMP '1998-03-01 00:00:00' AND o_orderkey % 100 = 7 AS skipped FROM orders), f AS (SELECT t, i FROM s WHERE skipped ORDER BY t, i LIMIT 1) SELECT s.t AS updated_at, s.i AS id FROM s, f WHERE (s.t, s.i) < (f.t, f.i) ORDER BY s.t DESC, s.i DESC LIMIT 1"),
    "incremental_equals_full": (incremental_equals_full, f"WITH {_AGG} SELECT target_product_id, canonical_edge_type, dst_node_type, dst_node_id, window_type, distinct_review_count, CAST(pos_cnt AS BIGINT) AS pos_cnt, CAST(neg_cnt AS BIGINT) AS neg_cnt, CAST(neu_cnt AS BIGINT) AS neu_cnt, support_count, score, avg_confidence, synthetic_ratio, corpus_weight, last_seen_at, is_promoted FROM agg"),
    "soft_deleted": (soft_deleted, f"SELECT o_custkey AS user_id, o_custkey % 10 <> 0 AND max(o_orderdate) >= {T.NOW} - INTERVAL 900 DAY AS is_active FROM orders GROUP BY 1"),
    "contract_report": (contract_report, "SELECT reason, count(*) AS n FROM (SELECT 'short' AS reason FROM documents WHERE length(text) < 500 UNION ALL SELECT 'source_zero' FROM documents WHERE source = 'src0' UNION ALL SELECT 'french' FROM documents WHERE lang = 'fr' UNION ALL SELECT 'no_language' FROM documents WHERE lang IS NULL) GROUP BY 1"),
    "data_checks": (data_checks, "WITH v AS (SELECT 'promotion' AS c, 0 AS n UNION ALL SELECT 'missing_customers', count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 10 < 9 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 1) UNION ALL SELECT 'collisions', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand || '/' || p_type) > 1)) SELECT c AS \"check\", n AS violations, CASE WHEN n = 0 THEN 'ok' ELSE 'failed' END AS status FROM v"),
    "unambiguous_parts": (unambiguous_parts, "WITH p AS (SELECT p_partkey, p_name || p_size AS k, p_brand FROM part) SELECT p_partkey, k FROM p WHERE k IN (SELECT k FROM p GROUP BY 1 HAVING count(DISTINCT p_brand) = 1)"),
    "quarantined": (quarantined, _EXPLODED),
    "retention": (retention, "SELECT 'orders' AS \"table\", count(*) AS rows, count(*) > 1000 AS over FROM orders UNION ALL SELECT 'parts', count(*), FALSE FROM part"),
    "term_clusters": (term_clusters, None),
    "rating_stats": (rating_stats, "WITH r AS (SELECT l_linestatus AS channel, l_partkey AS product_id, CASE l_returnflag WHEN 'N' THEN NULL ELSE CAST(l_quantity AS BIGINT) % 5 + 1 END AS score, l_shipdate >= DATE '2001-05-05' AS new FROM lineitem) SELECT channel, product_id, count(*) AS n, count(score) AS n_scored, round(avg(score), 4) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (new) AS n_recent, round(avg(score) FILTER (new), 4) AS avg_recent FROM r GROUP BY 1, 2"),
    "predicate_coverage": (predicate_coverage, f"WITH f AS ({_FACTS}), s AS (SELECT review_id, count(*) AS n FROM ({T.SIGNALS}) GROUP BY 1) SELECT predicate, count(DISTINCT fact_id) AS n_facts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_signals, bool_or(n IS NOT NULL) AS covered FROM f LEFT JOIN s USING (review_id) GROUP BY 1"),
    "promoted_counts": (promoted_counts, f"WITH {_AGG} SELECT window_type, count(*) FILTER (is_promoted) AS n_promoted, count(*) AS n FROM agg GROUP BY 1"),
    "latest_runs": (latest_runs, "SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderdate END AS completed_at, o_orderstatus AS status FROM orders ORDER BY completed_at DESC NULLS LAST, run_id DESC LIMIT 10"),
    "top_event_types": (top_event_types, "SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50 GROUP BY 1"),
    "stream_daily": (stream_daily, "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts < TIMESTAMP '2024-01-27 00:00:00' GROUP BY 1, 2"),
    "stream_trailing": (stream_trailing, "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1"),
    "stream_first": (stream_first, "SELECT event_id, user_id, event_type FROM events"),
    "stream_refreshed": (stream_refreshed, _REFRESHED),
    "stream_upsert": (stream_upsert, "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1"),
}
