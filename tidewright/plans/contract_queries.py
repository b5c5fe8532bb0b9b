"""Registered queries of consumer contracts, analyst reports, dictionaries and linking steps, each with the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import aggregate as A
from tidewright.operators import facts as K
from tidewright.operators import linking as L
from tidewright.operators import normalize as N
from tidewright.operators import recommend as R
from tidewright.operators import serving as V
from tidewright.plans import tables as T

QUERIES: dict = {}


def query(sql: str):
    """Register the function below under its name, with its SQL."""

    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def now():
    return F.expr(T.NOW)


_PROMOTED = f"SELECT target_product_id, edge_type, dst_id, days FROM (SELECT target_product_id, edge_type, dst_id, COUNT(DISTINCT review_id) AS n FROM ({T.SIGNALS}) GROUP BY target_product_id, edge_type, dst_id) CROSS JOIN (SELECT 30 AS days UNION ALL SELECT 90 AS days) WHERE n >= 3"


@query(f"SELECT p.target_product_id, p.edge_type, p.dst_id, days, review_id, window_ts FROM ({_PROMOTED}) p JOIN ({T.SIGNALS}) s ON p.target_product_id = s.target_product_id AND p.edge_type = s.edge_type AND p.dst_id = s.dst_id WHERE window_ts >= {T.NOW} - days * INTERVAL 1 DAY")
def promoted_evidence(spark, d):
    out = V.evidence_in_window(T.from_sql(spark, d, _PROMOTED), T.from_sql(spark, d, T.SIGNALS), now())
    return out.select("target_product_id", "edge_type", "dst_id", "days", "review_id", "window_ts")


_STATS = "SELECT CAST(l_partkey AS STRING) AS product_id, COUNT(*) AS review_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey"
_DOCS = "SELECT CAST(doc_id AS STRING) AS product_id, lang FROM documents WHERE lang IS NOT NULL"


@query(f"SELECT p.product_id, name, COALESCE(review_count, 0) AS review_count, lang FROM ({T.PRODUCTS}) p LEFT JOIN ({_STATS}) s ON p.product_id = s.product_id LEFT JOIN ({_DOCS}) d ON p.product_id = d.product_id")
def product_overview(spark, d):
    return V.overview(*[T.from_sql(spark, d, x) for x in (T.PRODUCTS, _STATS, _DOCS)]).select("product_id", "name", "review_count", "lang")


_COMPARED = "SELECT CAST(l_partkey AS STRING) AS product_id, CAST(l_suppkey * 50 AS STRING) AS other_id FROM lineitem"


@query(f"SELECT c.product_id, other_id, p.name, o.name AS other_name, n FROM (SELECT product_id, other_id, COUNT(*) AS n FROM ({_COMPARED}) GROUP BY product_id, other_id) c JOIN ({T.PRODUCTS}) p ON c.product_id = p.product_id LEFT JOIN ({T.PRODUCTS}) o ON c.other_id = o.product_id")
def compared_products(spark, d):
    return V.compared(T.from_sql(spark, d, _COMPARED), T.from_sql(spark, d, T.PRODUCTS))


_IDS = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS signal_id, l_partkey FROM lineitem"
_EVIDENCE = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS signal_id FROM lineitem WHERE l_tax <= 0.04"


@query(f"SELECT signal_id, l_partkey FROM ({_IDS}) s WHERE NOT EXISTS (SELECT 1 FROM ({_EVIDENCE}) e WHERE e.signal_id = s.signal_id)")
def signals_without_evidence(spark, d):
    return V.with_evidence(T.from_sql(spark, d, _IDS), T.from_sql(spark, d, _EVIDENCE), has=False)


_USERS = "SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN FALSE WHEN 'MACHINERY' THEN NULL ELSE TRUE END AS is_active FROM customer"


@query(f"SELECT p.user_id, edge_type, dst_id, ord FROM ({T.PREFERENCES}) p JOIN ({_USERS}) u ON p.user_id = u.user_id WHERE COALESCE(confidence, 0) >= 0.95 AND COALESCE(is_active, TRUE)")
def confident_preferences(spark, d):
    return V.confident_preferences(T.from_sql(spark, d, T.PREFERENCES), T.from_sql(spark, d, _USERS), 0.95).select("user_id", "edge_type", "dst_id", "ord")


@query(f"SELECT user_id FROM ({_USERS}) WHERE COALESCE(is_active, TRUE)")
def active_users(spark, d):
    return T.from_sql(spark, d, _USERS).filter(V.active()).select("user_id")


_PAIRS = "SELECT CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING) AS pair, COUNT(*) AS n FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY l_partkey, l_suppkey"


@query(f"SELECT pair, n FROM ({_PAIRS}) ORDER BY n DESC, pair LIMIT 50")
def top_comentions(spark, d):
    return V.ranked_top(T.from_sql(spark, d, _PAIRS), "n", "pair", 50)


_FRESH = f"SELECT p.product_id, name, COUNT(*) AS n_recent FROM ({T.PRODUCTS}) p JOIN ({T.SIGNALS}) s ON p.product_id = s.target_product_id WHERE window_ts >= {T.NOW} - INTERVAL 900 DAY GROUP BY p.product_id, name"


@query(f"SELECT product_id, name, n_recent FROM ({_FRESH}) ORDER BY n_recent DESC, product_id LIMIT 50")
def freshness_report(spark, d):
    recent = T.from_sql(spark, d, T.SIGNALS).filter(F.col("window_ts") >= now() - F.make_dt_interval(F.lit(900))).groupBy(F.col("target_product_id").alias("product_id")).agg(F.count(F.lit(1)).alias("n_recent"))
    return V.ranked_top(recent.join(T.from_sql(spark, d, T.PRODUCTS), "product_id").select("product_id", "name", "n_recent"), "n_recent", "product_id", 50)


@query(f"SELECT dst_id, category_id, COUNT(*) AS n, COUNT(DISTINCT review_id) AS n_reviews, CAST(SUM(size) AS BIGINT) AS total_size FROM ({T.SIGNALS}) s JOIN ({T.PRODUCTS}) p ON s.target_product_id = p.product_id GROUP BY dst_id, category_id")
def attribute_by_category(spark, d):
    met = T.from_sql(spark, d, T.SIGNALS).join(T.from_sql(spark, d, T.PRODUCTS), F.col("target_product_id") == F.col("product_id"))
    return met.groupBy("dst_id", "category_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("review_id").alias("n_reviews"), F.sum("size").alias("total_size"))


@query(f"SELECT dst_id, COUNT(DISTINCT user_id) AS n_users FROM ({T.PREFERENCES}) WHERE edge_type = 'AVOIDS' GROUP BY dst_id")
def concern_users(spark, d):
    return T.from_sql(spark, d, T.PREFERENCES).filter("edge_type = 'AVOIDS'").groupBy("dst_id").agg(F.count_distinct("user_id").alias("n_users"))


@query(f"SELECT target_product_id, CAST(SUM(days) AS BIGINT) AS volume FROM ({_PROMOTED}) GROUP BY target_product_id ORDER BY volume DESC, target_product_id LIMIT 20")
def top_promoted_products(spark, d):
    return V.ranked_top(T.from_sql(spark, d, _PROMOTED).groupBy("target_product_id").agg(F.sum("days").alias("volume")), "volume", "target_product_id", 20)


_MANIFESTS = "SELECT o_orderkey AS manifest_id, o_orderdate AS made_at FROM orders WHERE o_orderstatus = 'F'"
_LISTED = "SELECT p_partkey, p_size > 3 AS is_active FROM part"


@query(f"SELECT 'active_products' AS name, COUNT(*) AS value FROM ({_LISTED}) WHERE is_active UNION ALL SELECT 'active_users', COUNT(*) FROM ({_USERS}) WHERE COALESCE(is_active, TRUE) UNION ALL SELECT 'latest_manifest', MAX(manifest_id) FROM ({_MANIFESTS}) WHERE made_at = (SELECT MAX(made_at) FROM ({_MANIFESTS}))")
def readiness_counts(spark, d):
    return V.readiness(*[T.from_sql(spark, d, x) for x in (_LISTED, _USERS, _MANIFESTS)])


@query(f"SELECT user_id, COUNT(*) AS n_keys, CAST(SUM(n) AS BIGINT) AS n_products FROM (SELECT DISTINCT user_id, dst_id AS k FROM ({T.PREFERENCES}) WHERE edge_type = 'AVOIDS') JOIN (SELECT brand_id, COUNT(*) AS n FROM ({T.PRODUCTS}) GROUP BY brand_id) ON k = brand_id GROUP BY user_id")
def exclusion_counts(spark, d):
    avoided = T.from_sql(spark, d, T.PREFERENCES).filter("edge_type = 'AVOIDS'").select("user_id", F.col("dst_id").alias("key"))
    return V.exclusion_counts(avoided, T.from_sql(spark, d, T.PRODUCTS).select("product_id", F.col("brand_id").alias("key")))


@query(f"SELECT DISTINCT user_id, dst_id FROM ({T.PREFERENCES}) WHERE edge_type = 'AVOIDS' AND COALESCE(NULLIF(scope, '1-URGENT'), 'all') IN ('', 'all')")
def globally_avoided(spark, d):
    rows = T.from_sql(spark, d, T.PREFERENCES).filter("edge_type = 'AVOIDS'").withColumn("scope", F.nullif("scope", F.lit("1-URGENT")))
    return rows.filter(R.scope_allows(F.col("scope"), F.lit("all"))).select("user_id", "dst_id").distinct()


_AXES = "SELECT l_partkey AS a, l_suppkey AS b, CASE l_returnflag WHEN 'R' THEN 'brand' WHEN 'A' THEN 'ingredient' ELSE 'goal' END AS axis FROM lineitem"


@query(f"SELECT a, b, COUNT(DISTINCT axis) AS n_axes FROM ({_AXES}) GROUP BY a, b HAVING MAX(axis <> 'brand')")
def neighbours_beyond_brand(spark, d):
    return V.beyond_axis(T.from_sql(spark, d, _AXES), "brand")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'er') ORDER BY doc_id LIMIT 25 OFFSET 10")
def review_page(spark, d):
    return V.page(T.from_sql(spark, d, "SELECT doc_id, source, text FROM documents"), "text", "ER", "doc_id", 10, 25).select("doc_id", "source")


_KEYS = "SELECT CAST(p_partkey AS STRING) AS product_id, p_brand AS key FROM part WHERE p_size > 5 UNION ALL SELECT CAST(p_partkey AS STRING), p_type FROM part WHERE p_size > 5"
_WANTED = "SELECT r_regionkey AS query_id, 'brand' AS family, 'Brand#' || CAST(r_regionkey + 1 AS STRING) AS key FROM region UNION ALL SELECT r_regionkey, 'brand', 'Brand#' || CAST(r_regionkey + 2 AS STRING) FROM region UNION ALL SELECT r_regionkey, 'type', CASE WHEN r_regionkey < 2 THEN 'ECONOMY' ELSE 'SMALL' END FROM region"


@query(f"SELECT q.query_id, p.product_id, CASE WHEN k.product_id IS NULL THEN 'unknown' WHEN COALESCE(got, 0) = 2 THEN 'met' ELSE 'failed' END AS state FROM ({T.PRODUCTS}) p CROSS JOIN (SELECT DISTINCT query_id FROM ({_WANTED})) q LEFT JOIN (SELECT DISTINCT product_id FROM ({_KEYS})) k ON p.product_id = k.product_id LEFT JOIN (SELECT query_id, product_id, COUNT(DISTINCT family) AS got FROM ({_KEYS}) a JOIN ({_WANTED}) b ON a.key = b.key GROUP BY query_id, product_id) g ON g.query_id = q.query_id AND g.product_id = p.product_id")
def constraint_verdicts(spark, d):
    return V.constraint_verdicts(T.from_sql(spark, d, T.PRODUCTS).select("product_id"), T.from_sql(spark, d, _KEYS), T.from_sql(spark, d, _WANTED))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'sku' WHEN '2-HIGH' THEN 'family' ELSE 'other' END AS key_type FROM orders")
def channel_kinds(spark, d):
    return V.mapped(T.from_sql(spark, d, "SELECT o_orderkey, o_orderpriority FROM orders"), "o_orderpriority", {"1-URGENT": "sku", "2-HIGH": "family"}, "key_type", "other").select("o_orderkey", "key_type")


_LABELS = "SELECT 'nation:' || n_name AS node_id, n_name || ' (nation)' AS label FROM nation WHERE n_regionkey < 3"
_NODE_IDS = "SELECT 'nation:' || n_name AS node_id FROM nation UNION ALL SELECT 'supplier:x:' || CAST(s_suppkey AS STRING) FROM supplier"


@query(f"SELECT n.node_id, COALESCE(label, list_extract(string_split(n.node_id, ':'), -1)) AS label FROM ({_NODE_IDS}) n LEFT JOIN ({_LABELS}) l ON n.node_id = l.node_id")
def node_labels(spark, d):
    nation_labels = T.from_sql(spark, d, _LABELS)
    supplier = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("supplier:x:"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return V.labelled(T.from_sql(spark, d, "SELECT 'nation:' || n_name AS node_id FROM nation").unionByName(supplier), nation_labels)


_EVENTS = "SELECT CASE WHEN event_type = 'click' THEN NULL ELSE CAST(user_id AS STRING) END AS product_id, CASE WHEN value < 10 THEN NULL ELSE CAST(value AS BIGINT) - 20 END AS quantity, ts AS purchased_at FROM events"


@query(f"SELECT CASE WHEN COALESCE(product_id, '') = '' THEN 'no_product' WHEN quantity IS NULL OR quantity <= 0 THEN 'bad_quantity' WHEN purchased_at IS NULL THEN 'no_date' ELSE 'kept' END AS outcome, COUNT(*) AS n FROM ({_EVENTS.replace('CAST(value AS BIGINT)', 'CAST(trunc(value) AS BIGINT)')}) GROUP BY 1")
def purchase_hygiene(spark, d):
    return V.purchase_hygiene(T.from_sql(spark, d, _EVENTS))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def kept_in_key_set(spark, d):
    keys = T.from_sql(spark, d, "SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 45")
    return V.inside(T.from_sql(spark, d, "SELECT o_orderkey, o_custkey FROM orders"), keys, "o_orderkey")


_OPEN = "SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS review_id, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS valid_to FROM lineitem"
_DEAD = "SELECT o_orderkey AS review_id FROM orders WHERE o_orderstatus = 'F'"


@query(f"SELECT fact_id, f.review_id, CASE WHEN valid_to IS NULL AND d.review_id IS NOT NULL THEN {T.NOW} ELSE valid_to END AS valid_to, CASE WHEN valid_to IS NULL AND d.review_id IS NULL THEN 'open' ELSE 'closed' END AS status FROM ({_OPEN}) f LEFT JOIN ({_DEAD}) d ON f.review_id = d.review_id")
def tombstoned_facts(spark, d):
    return V.tombstoned(T.from_sql(spark, d, _OPEN), T.from_sql(spark, d, _DEAD), now()).select("fact_id", "review_id", "valid_to", "status")


@query(f"SELECT DISTINCT target_product_id FROM ({T.SIGNALS}) WHERE review_id IN (SELECT CAST(review_id AS STRING) FROM ({_DEAD}))")
def dirty_after_tombstones(spark, d):
    return V.dirty_products(T.from_sql(spark, d, T.SIGNALS), T.from_sql(spark, d, _DEAD).select(F.col("review_id").cast("string").alias("review_id")))


@query("SELECT o_orderdate AS updated_at, o_orderkey AS id FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 1")
def seeded_cursor(spark, d):
    return V.seed_cursor(T.from_sql(spark, d, "SELECT o_orderdate AS updated_at, o_orderkey AS id FROM orders"))


_CATALOG_STATS = "SELECT CAST(p_partkey AS STRING) AS product_id, p_size AS review_count, p_retailprice AS rating, p_type = 'PROMO' AS synthetic FROM part"
_OWN_STATS = "SELECT CAST(s_suppkey AS STRING) AS product_id, s_nationkey AS review_count, CASE WHEN s_nationkey > 5 THEN s_acctbal END AS rating, s_nationkey = 3 AS synthetic FROM supplier"


@query(f"SELECT c.product_id, COALESCE(o.review_count, c.review_count) AS review_count, COALESCE(o.rating, c.rating) AS rating FROM ({_CATALOG_STATS}) c LEFT JOIN (SELECT * FROM ({_OWN_STATS}) WHERE NOT synthetic) o ON c.product_id = o.product_id WHERE NOT c.synthetic")
def merged_source_stats(spark, d):
    return V.merged_stats(T.from_sql(spark, d, _CATALOG_STATS), T.from_sql(spark, d, _OWN_STATS))


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'missing' WHEN regexp_matches(c_name, '[02468]$') THEN 'joinable' ELSE 'not_joinable' END AS state, COUNT(*) AS n FROM customer GROUP BY 1")
def code_joinability(spark, d):
    return V.joinability(T.from_sql(spark, d, "SELECT CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_name END AS code FROM customer"), "code", "[02468]$")


_RANKED = "SELECT o_custkey AS user_id, CAST(o_orderkey AS STRING) AS product_id, o_totalprice AS score, o_orderpriority = '1-URGENT' AS pinned, o_orderkey AS ord FROM orders"


@query(f"SELECT user_id, product_id, place FROM (SELECT user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, CASE WHEN pinned THEN ord END, score DESC, product_id) AS INTEGER) AS place FROM ({_RANKED})) WHERE place <= 5")
def pinned_ranking(spark, d):
    return V.pinned_first(T.from_sql(spark, d, _RANKED), 5)


_TOLD = "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_type END AS liked, p_size AS n_reviews, CASE WHEN p_size % 3 = 0 THEN p_name END AS disliked FROM part"


@query(f"SELECT p_partkey, COALESCE(NULLIF(concat_ws(' ', CASE WHEN liked IS NOT NULL THEN 'Liked for ' || liked || ' by ' || CAST(n_reviews AS STRING) || ' reviews.' END, CASE WHEN disliked IS NOT NULL THEN 'Some mention ' || disliked || '.' END), ''), 'No reviews yet.') AS summary FROM ({_TOLD})")
def summary_sentences(spark, d):
    return V.summary_sentences(T.from_sql(spark, d, _TOLD)).select("p_partkey", "summary")


_TRUTH = "SELECT CAST(p_partkey AS STRING) AS product_id, CASE WHEN p_size % 4 = 0 THEN 'Unknown ' WHEN p_size % 4 = 1 THEN '' ELSE p_brand END AS brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS name FROM part"
_LENT = "SELECT CAST(s_suppkey AS STRING) AS product_id, s_name AS brand, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_name END AS name FROM supplier"
_GOOD = "CASE WHEN COALESCE(TRIM({0}), '') <> '' AND LOWER(TRIM({0})) <> 'unknown' THEN TRIM({0}) END"


@query(f"SELECT product_id, COALESCE(b, sb) AS brand, COALESCE(n, sn) AS name, CASE WHEN b IS NOT NULL AND n IS NOT NULL THEN 'catalog' WHEN sb IS NOT NULL OR sn IS NOT NULL THEN 'merged' ELSE 'incomplete' END AS truth FROM (SELECT c.product_id, {_GOOD.format('c.brand')} AS b, {_GOOD.format('c.name')} AS n, {_GOOD.format('s.brand')} AS sb, {_GOOD.format('s.name')} AS sn FROM ({_TRUTH}) c LEFT JOIN ({_LENT}) s ON c.product_id = s.product_id)")
def product_truth(spark, d):
    return V.product_truth(T.from_sql(spark, d, _TRUTH), spark.read.parquet(f"{d}/supplier.parquet").selectExpr("CAST(s_suppkey AS STRING) AS product_id", "s_name AS brand", "CASE WHEN s_nationkey < 5 THEN NULL ELSE s_name END AS name"), "^unknown$")


_FEATURES = "SELECT o_custkey AS user_id, l_partkey AS product_id, CASE l_linestatus WHEN 'O' THEN 'keyword' ELSE 'brand' END AS feature, CAST(l_quantity AS BIGINT) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(f"SELECT preset, user_id, product_id, CAST(SUM(value * weight) AS BIGINT) AS score FROM ({_FEATURES}) f JOIN (VALUES ('plain', 'keyword', 1), ('plain', 'brand', 1), ('brand_first', 'brand', 5)) p(preset, feature, weight) ON f.feature = p.feature GROUP BY preset, user_id, product_id")
def preset_scores(spark, d):
    presets = spark.createDataFrame([("plain", "keyword", 1), ("plain", "brand", 1), ("brand_first", "brand", 5)], "preset string, feature string, weight long")
    return V.weighted(T.from_sql(spark, d, _FEATURES), presets)


@query(f"SELECT target_product_id, COUNT(*) AS n_late FROM ({T.SIGNALS}) WHERE window_ts < {T.NOW} - INTERVAL 1500 DAY GROUP BY target_product_id")
def late_products(spark, d):
    return V.late_rows(T.from_sql(spark, d, T.SIGNALS), now() - F.make_dt_interval(F.lit(1500)))


_EDGES = "SELECT l_partkey AS subject, l_suppkey % 5 AS object, l_returnflag AS sentiment, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"


@query(f"SELECT subject, object, COUNT(*) AS weight, arg_min(sentiment, ord) AS sentiment FROM ({_EDGES}) GROUP BY subject, object")
def deduplicated_edges(spark, d):
    return A.edge_counts(T.from_sql(spark, d, _EDGES), ["subject", "object"], "ord")


@query("SELECT n_name AS term FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def unused_terms(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    used = spark.read.parquet(f"{d}/customer.parquet").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    return N.unused_terms(nation.select(F.col("n_name").alias("term")), used.select(F.col("n_name").alias("term")))


@query("SELECT CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' ELSE 'both' END AS side, COUNT(*) AS n FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 20) l FULL JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') r ON l.k = r.k GROUP BY 1")
def shadow_comparison(spark, d):
    left = T.from_sql(spark, d, "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 20")
    return K.compare_sets(left, T.from_sql(spark, d, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'"), "k")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SOLD' WHEN 'O' THEN 'ASKED' END AS predicate, CASE o_orderstatus WHEN 'F' THEN 'KEEP' WHEN 'O' THEN 'DROP' ELSE 'QUARANTINE' END AS action FROM orders")
def relation_actions(spark, d):
    mapping = spark.createDataFrame([(" f", "SOLD", "KEEP"), ("O", "ASKED", "DROP")], "relation string, predicate string, action string")
    rows = T.from_sql(spark, d, "SELECT o_orderkey, o_orderstatus || ' ' AS relation FROM orders")
    return N.relations(rows, mapping).select("o_orderkey", "predicate", "action")


@query("SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN 'Tool' WHEN p_name LIKE '%bolt' THEN 'Bolt' WHEN p_name LIKE '%ring%' THEN 'Ring' END AS concept, CASE WHEN p_name = 'red bolt' THEN 'exact' WHEN p_name LIKE '%bolt' OR p_name LIKE '%ring%' THEN 'pattern' ELSE 'quarantine' END AS how FROM part")
def derived_concepts(spark, d):
    words = spark.createDataFrame([("red bolt", "Tool")], "word string, concept string")
    return N.derived(T.from_sql(spark, d, "SELECT p_partkey, upper(p_name) AS object_text FROM part"), words, [("Bolt", "bolt$"), ("Ring", "ring")]).select("p_partkey", "concept", "how")


@query("SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#1' THEN 'first' ELSE lower(p_brand) END AS concept_id FROM part")
def concept_lookup(spark, d):
    alias = spark.createDataFrame([("brand#1", "first")], "alias string, canonical string")
    return N.concept_ids(T.from_sql(spark, d, "SELECT p_partkey, 'Concept:Brand:' || p_brand AS c FROM part"), "c", alias).select("p_partkey", "concept_id")


@query("SELECT c_custkey AS user_id, 'PREFERS' AS edge_type, lower(c_mktsegment) AS dst_id, 'all' AS scope, 'basic' AS source FROM customer UNION ALL SELECT c_custkey, 'FROM', lower(c_name), NULL, 'chat' FROM customer")
def profile_facts(spark, d):
    rows = T.from_sql(spark, d, "SELECT c_custkey AS user_id, c_mktsegment, c_name FROM customer").select("user_id", F.struct(F.array("c_mktsegment", F.lit(" ")).alias("likes"), F.array("c_name").alias("names")).alias("basic"))
    return N.user_facts(rows, [("basic.likes", "PREFERS", "all", "basic"), ("basic.names", "FROM", None, "chat")])


@query("WITH b AS (SELECT DISTINCT CAST(l_orderkey AS STRING) AS review_id, l_returnflag AS polarity, 'product:' || CAST(l_partkey AS STRING) AS p, CAST(l_suppkey AS STRING) AS a, l_linestatus AS k FROM lineitem) SELECT review_id, polarity, p AS subject, 'HAS_ATTRIBUTE' AS predicate, 'concept:BEEAttr:' || a AS object FROM b UNION SELECT review_id, polarity, 'concept:BEEAttr:' || a, 'HAS_KEYWORD', 'concept:Keyword:' || k FROM b")
def attribute_facts(spark, d):
    rows = T.from_sql(spark, d, "SELECT CAST(l_orderkey AS STRING) AS review_id, l_returnflag AS polarity, 'product:' || CAST(l_partkey AS STRING) AS product_iri, CAST(l_suppkey AS STRING) AS attr_id, l_linestatus FROM lineitem")
    return N.bee_facts(rows.withColumn("keyword_ids", F.array("l_linestatus")))


_SPOTS = "SELECT l_orderkey AS review_id, l_linenumber AS start, CAST(l_suppkey % 3 AS STRING) AS word, l_orderkey * 10 + l_linenumber AS mention_id FROM lineitem"
_ENDS = "SELECT l_orderkey AS review_id, l_linenumber + 1 AS start, CAST(l_suppkey % 4 AS STRING) AS word, l_partkey FROM lineitem"


@query(f"SELECT r.review_id, r.start, r.word, l_partkey, CAST(COALESCE(e, p, w) AS STRING) AS mention_id FROM ({_ENDS}) r LEFT JOIN (SELECT review_id, word, start, MIN(mention_id) AS e FROM ({_SPOTS}) GROUP BY ALL) a ON r.review_id = a.review_id AND r.word = a.word AND r.start = a.start LEFT JOIN (SELECT review_id, start, MIN(mention_id) AS p FROM ({_SPOTS}) GROUP BY ALL) b ON r.review_id = b.review_id AND r.start = b.start LEFT JOIN (SELECT review_id, word, MIN(mention_id) AS w FROM ({_SPOTS}) GROUP BY ALL) c ON r.review_id = c.review_id AND r.word = c.word")
def linked_mentions(spark, d):
    return L.relation_ends(T.from_sql(spark, d, _SPOTS), T.from_sql(spark, d, _ENDS)).select("review_id", "start", "word", "l_partkey", F.col("mention_id").cast("string").alias("mention_id"))


_SAID = "SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS phrase_id, l_orderkey AS review_id, CAST(l_suppkey % 3 AS STRING) AS text, l_returnflag AS attr, l_linenumber AS start FROM lineitem"
_NAMED = "SELECT l_orderkey AS review_id, CAST(l_suppkey % 3 AS STRING) AS obj_text, l_linestatus || '' AS obj_attr, l_linenumber AS obj_start, CAST(l_partkey AS STRING) AS subject, CASE l_linenumber % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'same_entity' ELSE 'other' END AS subject_kind, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord FROM lineitem WHERE l_tax > 0.03"


@query(f"SELECT phrase_id, review_id, subject, COALESCE(subject_kind, 'unlinked') AS subject_kind, COALESCE(c, 0.0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY c DESC NULLS LAST, ord NULLS LAST) AS n FROM (SELECT phrase_id, s.review_id, subject, subject_kind, ord, CASE subject_kind WHEN 'direct' THEN 1.0 WHEN 'placeholder' THEN 0.9 WHEN 'same_entity' THEN 0.8 WHEN 'other' THEN 0.0 END::DOUBLE AS c FROM ({_SAID}) s LEFT JOIN ({_NAMED}) r ON s.review_id = r.review_id AND s.text = r.obj_text AND s.start = r.obj_start)) WHERE n = 1")
def attributed_phrases(spark, d):
    return L.attribute(T.from_sql(spark, d, _SAID), T.from_sql(spark, d, _NAMED))


_ASKED = "SELECT c_custkey AS user_id, lower(substr(c_mktsegment, 1, 4)) AS key FROM customer"
_TEXTS = "SELECT CAST(n_nationkey AS STRING) AS product_id, lower(n_name) || ' auto furn' AS text FROM nation"


@query(f"SELECT user_id, product_id, 'catalog_keyword' AS axis, key, 1.0::DOUBLE AS strength FROM ({_ASKED}) JOIN ({_TEXTS}) ON contains(text, key)")
def catalog_keyword_overlaps(spark, d):
    return R.text_overlaps(T.from_sql(spark, d, _ASKED), T.from_sql(spark, d, _TEXTS))


_OWNED = "SELECT CAST(p_partkey AS STRING) AS product_id, p_type AS attr, p_size - 20 AS score FROM part"


@query(f"SELECT product_id, concern, MAX(score * weight) AS score FROM ({_OWNED}) JOIN (VALUES ('ECONOMY', 'price', 2), ('SMALL', 'size', 1), ('ECONOMY', 'size', 1)) b(attr, concern, weight) USING (attr) GROUP BY product_id, concern HAVING MAX(score * weight) > 0")
def bridged_concerns(spark, d):
    bridge = spark.createDataFrame([("ECONOMY", "price", 2), ("SMALL", "size", 1), ("ECONOMY", "size", 1)], "attr string, concern string, weight int")
    return R.concern_bridge(T.from_sql(spark, d, _OWNED), bridge)


_HELD = "SELECT CAST(l_partkey AS STRING) AS product_id, 'keyword' AS axis, l_linestatus AS key, CASE l_returnflag WHEN 'R' THEN 'NEG' ELSE 'POS' END AS polarity FROM lineitem"
_RULED = "(VALUES ('BUILDING', 'keyword', 'O', 2, FALSE), ('MACHINERY', 'keyword', 'F', 1, TRUE), ('BUILDING', 'keyword', 'F', 3, FALSE)) r(user_key, axis, key, strength, weak)"


@query(f"SELECT s.user_id, e.product_id, CASE WHEN weak THEN 'weak_semantic_keyword' ELSE 'semantic_keyword' END AS axis, e.key, MAX(strength) AS strength FROM (SELECT n_nationkey AS user_id, CASE WHEN n_regionkey < 3 THEN 'BUILDING' ELSE 'MACHINERY' END AS k FROM nation) s JOIN {_RULED} ON k = user_key JOIN (SELECT DISTINCT product_id, axis, key FROM ({_HELD}) WHERE polarity = 'POS') e ON e.axis = r.axis AND e.key = r.key WHERE NOT (user_key = 'BUILDING' AND r.key = 'F') GROUP BY ALL")
def semantic_overlaps(spark, d):
    rules = spark.createDataFrame([("BUILDING", "keyword", "O", 2, False), ("MACHINERY", "keyword", "F", 1, True), ("BUILDING", "keyword", "F", 3, False)], "user_key string, axis string, key string, strength int, weak boolean")
    blocked = spark.createDataFrame([("BUILDING", "F")], "user_key string, key string")
    users = T.from_sql(spark, d, "SELECT n_nationkey AS user_id, CASE WHEN n_regionkey < 3 THEN 'BUILDING' ELSE 'MACHINERY' END AS key FROM nation")
    return R.semantic_overlaps(users, T.from_sql(spark, d, _HELD), rules, blocked)
