"""Registered queries: aggregates, profiles, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import aggregate as A
from tidewright.operators import profiles as P
from tidewright.operators import similarity as S
from tidewright.plans import tables as T

def now():
    return F.expr(T.NOW)


def signals(spark: SparkSession, d: str) -> DataFrame:
    return T.from_sql(spark, d, T.SIGNALS)


def aggregates(spark: SparkSession, d: str) -> DataFrame:
    return A.product_signals(signals(spark, d), now())


_AGG = f"""
s AS ({T.SIGNALS}),
w(window_type, lo, decay) AS (VALUES ('30d', {T.NOW} - INTERVAL 30 DAY, 1.0), ('90d', {T.NOW} - INTERVAL 90 DAY, 0.8), ('all', NULL, 0.6)),
r AS (SELECT *, upper(coalesce(polarity, '')) AS pol FROM s JOIN w ON lo IS NULL OR window_ts >= lo WHERE signal_family IS DISTINCT FROM 'CATALOG_VALIDATION'),
g AS (SELECT target_product_id, edge_type AS canonical_edge_type, dst_type AS dst_node_type, dst_id AS dst_node_id, window_type,
  count(DISTINCT nullif(review_id, '')) AS distinct_review_count, count(*) FILTER (pol = 'POS') AS pos_cnt, count(*) FILTER (pol = 'NEG') AS neg_cnt,
  count(*) FILTER (pol NOT IN ('POS', 'NEG')) AS neu_cnt, count(*) AS support_count, coalesce(CAST(sum(CAST(source_confidence AS DECIMAL(18,6))) AS DOUBLE) / count(source_confidence), 0) AS conf,
  count(*) FILTER (evidence_kind = 'BEE_SYNTHETIC') AS syn, max(window_ts) AS last_seen_at, max(CAST(decay AS DOUBLE)) AS decay
  FROM r GROUP BY ALL),
agg AS (SELECT *, round((pos_cnt - neg_cnt) / support_count, 4) AS score, round(conf, 4) AS avg_confidence, round(syn / support_count, 4) AS synthetic_ratio,
  round(distinct_review_count * conf * decay, 4) AS corpus_weight,
  distinct_review_count >= 2 AND round(conf, 4) >= 0.6 AND round(syn / support_count, 4) <= 0.5 AS is_promoted FROM g)
"""
_AGG_COLS = "target_product_id, canonical_edge_type, dst_node_type, dst_node_id, window_type, distinct_review_count, CAST(pos_cnt AS BIGINT) AS pos_cnt, CAST(neg_cnt AS BIGINT) AS neg_cnt, CAST(neu_cnt AS BIGINT) AS neu_cnt, support_count, score, avg_confidence, synthetic_ratio, corpus_weight, last_seen_at, is_promoted"


def product_signals(spark, d):
    return aggregates(spark, d).drop("evidence_sample")


def dirty_signals(spark, d):
    dirty = T.from_sql(spark, d, "SELECT CAST(p_partkey AS STRING) AS id FROM part WHERE p_size < 5")
    return A.product_signals(signals(spark, d), now(), dirty).drop("evidence_sample")


def flagship(spark, d):
    top = P.top_signals(aggregates(spark, d), "all", 10)
    return top.select("target_product_id", "canonical_edge_type", "dst_node_id", "score", "distinct_review_count", "corpus_weight", "rank").orderBy(F.desc("corpus_weight"), "target_product_id", "canonical_edge_type", "rank")


def product_profiles(spark, d):
    out = P.product_profiles(T.from_sql(spark, d, T.PRODUCTS).select("product_id", "brand_id"), aggregates(spark, d), ["F", "O"], n=3)
    ids = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit("/"), x["review_cnt"].cast("string"))), " ")
    return out.select("product_id", "brand_id", ids("top_f_ids").alias("top_f"), ids("top_o_ids").alias("top_o"), "signal_support", "last_signal_at")


def merged_signals(spark, d):
    rows = signals(spark, d).selectExpr("md5(concat_ws('|', target_product_id, edge_type, dst_id)) AS signal_id", "target_product_id", "review_id AS fact_id", "evidence_kind", "source_confidence", "source_confidence AS weight", "CAST(review_id AS BIGINT) AS ord")
    return A.merged_signals(rows).select("signal_id", "target_product_id", F.round("weight", 4).alias("weight"), "evidence_kind", F.size("fact_ids").alias("n_facts"))


def evidence_ranks(spark, d):
    rows = signals(spark, d).selectExpr("concat_ws('|', target_product_id, edge_type, dst_id) AS signal_id", "review_id AS fact_id", "evidence_kind", "source_confidence", "1.0D AS weight", "1 AS ord")
    return P.evidence_samples(A.signal_evidence(A.merged_signals(rows)), 2).select("signal_id", "fact_id", "evidence_rank", "contribution")


def user_preferences(spark, d):
    return A.user_preferences(T.from_sql(spark, d, T.PREFERENCES), F.to_date(now()))


def first_preferences(spark, d):
    return A.first_preferences(T.from_sql(spark, d, T.PREFERENCES)).select("user_id", "edge_type", "dst_id", "scope", "source", "ord")


def user_profiles(spark, d):
    prefs = A.user_preferences(T.from_sql(spark, d, T.PREFERENCES), F.to_date(now()))
    out = P.user_profiles(T.from_sql(spark, d, "SELECT c_custkey AS user_id FROM customer"), prefs, ["PREFERS", "AVOIDS"], 5)
    return out.select("user_id", F.size("prefers").alias("n_prefers"), F.size("avoids").alias("n_avoids"), F.array_join(F.transform("prefers", lambda x: x["id"]), " ").alias("prefers"))


def brand_confidence(spark, d):
    return A.brand_confidence(T.from_sql(spark, d, T.PURCHASES))


def purchase_features(spark, d):
    f = A.purchase_features(T.from_sql(spark, d, T.PURCHASES))
    return f.select("user_id", F.size("owned_products").alias("n_products"), F.array_join("repurchased_brands", ",").alias("repurchased_brands"), F.array_join("owned_categorys", ",").alias("categories"), "last_purchased_at")


def union_features(spark, d):
    rows = T.from_sql(spark, d, T.PURCHASES)
    f = A.union_features(A.purchase_features(rows.filter("quantity > 25")), A.purchase_features(rows.filter("quantity <= 25")))
    return f.select("user_id", F.size("owned_products").alias("n_products"), F.array_join("owned_brands", ",").alias("brands"), "last_purchased_at")


def nodes(spark, d):
    return T.from_sql(spark, d, T.NODES)


_IDF = f"n AS (SELECT DISTINCT * FROM ({T.NODES})), i AS (SELECT node, ln((SELECT count(DISTINCT item) FROM n) / count(*)) AS idf, count(*) AS df FROM n GROUP BY node HAVING count(*) > 1)"
_SIM = f"{_IDF}, p AS (SELECT x.item AS a, y.item AS b, round(sum(idf), 4) AS score, count(*) AS n_shared FROM n x JOIN n y ON x.node = y.node AND x.item < y.item JOIN i ON i.node = x.node AND idf > 0 GROUP BY 1, 2)"
_NEAR = f"{_SIM}, u AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, score FROM p), near AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INT) AS rank FROM u QUALIFY rank <= 10)"


def near(spark, d):
    return S.nearest(nodes(spark, d), 10).select("a", "b", "score", "rank")


def node_idf(spark, d):
    return S.node_weights(nodes(spark, d)).select("node", F.round("idf", 4).alias("idf"), "df")


def similarity_pairs(spark, d):
    return S.shared_nodes(nodes(spark, d))


def similarity_gated(spark, d):
    groups = T.from_sql(spark, d, "SELECT CAST(p_partkey AS STRING) AS item, p_type AS grp FROM part")
    return S.shared_nodes(nodes(spark, d), 8.0, groups)


def attached_neighbours(spark, d):
    items = T.from_sql(spark, d, T.PRODUCTS).select("product_id")
    out = S.attach_neighbours(items, near(spark, d), "product_id", "similar")
    return out.select("product_id", F.array_join(F.transform("similar", lambda x: x["id"]), " ").alias("similar"))


def comentions(spark, d):
    return S.comentions(T.from_sql(spark, d, T.MENTIONS)).select("a", "b", "reviews", "strength", "rank")


_COM = f"m AS (SELECT DISTINCT review_id, product_id FROM ({T.MENTIONS}) WHERE polarity <> 'NEG'), p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS reviews FROM m x JOIN m y ON x.review_id = y.review_id AND x.product_id < y.product_id GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT a, b, reviews FROM p UNION ALL SELECT b, a, reviews FROM p)"


def similar_users(spark, d):
    return S.similar_users(T.from_sql(spark, d, T.TAGS), 2)


_USR = f"t AS (SELECT DISTINCT * FROM ({T.TAGS})), z AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1), p AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS shared, max(zx.n) AS sa, max(zy.n) AS sb FROM t x JOIN t y ON x.tag = y.tag AND x.user_id < y.user_id JOIN z zx ON zx.user_id = x.user_id JOIN z zy ON zy.user_id = y.user_id GROUP BY 1, 2 HAVING count(*) >= 2), q AS (SELECT a, b, shared, round(shared / (sa + sb - shared), 4) AS similarity FROM p), u AS (SELECT * FROM q UNION ALL SELECT b, a, shared, similarity FROM q), nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS INT) AS rank FROM u QUALIFY rank <= 10)"


def owned(spark, d):
    return T.from_sql(spark, d, "SELECT DISTINCT o_custkey AS user_id, CAST(l_partkey AS STRING) AS product_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")


_OWN = "o AS (SELECT DISTINCT o_custkey AS user_id, CAST(l_partkey AS VARCHAR) AS product_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def collaborative(spark, d):
    return S.collaborative(S.similar_users(T.from_sql(spark, d, T.TAGS), 2), owned(spark, d))


def owned_boost(spark, d):
    return S.owned_boost_near(owned(spark, d), nodes(spark, d))


def related_products(spark, d):
    anchors = T.from_sql(spark, d, "SELECT p_brand AS query_id, CAST(p_partkey AS STRING) AS product_id FROM part WHERE p_size = 7")
    return S.related(anchors, near(spark, d), n=5).select("query_id", "product_id", "score", "rank")


def top_graph(spark, d):
    edges = T.from_sql(spark, d, "SELECT 'c' || CAST(o_custkey AS STRING) AS src, 'p' || CAST(l_partkey AS STRING) AS dst, l_returnflag AS kind, l_quantity AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    return S.graph(edges, 2500)[1]


def two_hops(spark, d):
    edges = T.from_sql(spark, d, "SELECT DISTINCT p_brand AS src, p_name AS dst FROM part UNION SELECT DISTINCT p_name, p_type FROM part")
    return S.two_hops(edges)


QUERIES = {
    "top_promoted_signals": (flagship, f"WITH {_AGG} SELECT target_product_id, canonical_edge_type, dst_node_id, score, distinct_review_count, corpus_weight, CAST(row_number() OVER (PARTITION BY target_product_id, canonical_edge_type ORDER BY score DESC, distinct_review_count DESC, dst_node_id) AS INT) AS rank FROM agg WHERE window_type = 'all' AND is_promoted QUALIFY rank <= 10"),
    "product_signals": (product_signals, f"WITH {_AGG} SELECT {_AGG_COLS} FROM agg"),
    "dirty_product_signals": (dirty_signals, f"WITH {_AGG} SELECT {_AGG_COLS} FROM agg WHERE target_product_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 5)"),
    "product_profiles": (product_profiles, f"WITH {_AGG}, t AS (SELECT *, row_number() OVER (PARTITION BY target_product_id, canonical_edge_type ORDER BY score DESC, distinct_review_count DESC, dst_node_id) AS rk FROM agg WHERE window_type = 'all' AND is_promoted QUALIFY rk <= 3), l AS (SELECT target_product_id, coalesce(string_agg(dst_node_id || '/' || distinct_review_count, ' ' ORDER BY rk) FILTER (canonical_edge_type = 'F'), '') AS top_f, coalesce(string_agg(dst_node_id || '/' || distinct_review_count, ' ' ORDER BY rk) FILTER (canonical_edge_type = 'O'), '') AS top_o FROM t GROUP BY 1), q AS (SELECT target_product_id, CAST(sum(support_count) AS BIGINT) AS signal_support, max(last_seen_at) AS last_signal_at FROM agg WHERE window_type = 'all' GROUP BY 1) SELECT product_id, brand_id, coalesce(top_f, '') AS top_f, coalesce(top_o, '') AS top_o, coalesce(signal_support, 0) AS signal_support, last_signal_at FROM ({T.PRODUCTS}) p LEFT JOIN l ON l.target_product_id = product_id LEFT JOIN q ON q.target_product_id = product_id"),
    "merged_signals": (merged_signals, f"WITH s AS ({T.SIGNALS}) SELECT md5(concat_ws('|', target_product_id, edge_type, dst_id)) AS signal_id, target_product_id, round(max(source_confidence), 4) AS weight, CASE WHEN count(DISTINCT evidence_kind) > 1 THEN 'MIXED' ELSE max(evidence_kind) END AS evidence_kind, CAST(count(DISTINCT review_id) AS INT) AS n_facts FROM s GROUP BY target_product_id, edge_type, dst_id"),
    "evidence_samples": (evidence_ranks, f"WITH s AS (SELECT DISTINCT concat_ws('|', target_product_id, edge_type, dst_id) AS signal_id, review_id AS fact_id FROM ({T.SIGNALS})), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY fact_id) - 1 AS INT) AS evidence_rank FROM s QUALIFY evidence_rank < 2) SELECT *, round(1 / count(*) OVER (PARTITION BY signal_id), 4) AS contribution FROM r"),
    "user_preferences": (user_preferences, f"SELECT user_id, edge_type, dst_id, scope, round(max(coalesce(confidence, 1)) * least(count(*) / 3, 1.5) * exp(-0.01 * greatest(datediff('day', CAST(max(last_seen_at) AS DATE), DATE '2001-11-05'), 0)) * max(CASE source WHEN 'purchase' THEN 1.2 ELSE 0.8 END::DOUBLE), 4) AS weight, count(*) AS frequency, max(last_seen_at) AS last_seen_at, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ({T.PREFERENCES}) GROUP BY 1, 2, 3, 4"),
    "first_preferences": (first_preferences, f"SELECT user_id, edge_type, dst_id, scope, source, ord FROM ({T.PREFERENCES}) QUALIFY row_number() OVER (PARTITION BY user_id, edge_type, dst_id, scope ORDER BY ord) = 1"),
    "user_profiles": (user_profiles, None),
    "brand_confidence": (brand_confidence, f"SELECT user_id, brand, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(quantity) / max(sum(quantity)) OVER (PARTITION BY user_id), 4) AS confidence FROM ({T.PURCHASES}) GROUP BY 1, 2"),
    "purchase_features": (purchase_features, f"WITH p AS ({T.PURCHASES}), b AS (SELECT user_id, brand, count(*) AS n FROM p GROUP BY 1, 2) SELECT user_id, CAST(count(DISTINCT product_id) AS INT) AS n_products, coalesce((SELECT string_agg(brand, ',' ORDER BY brand) FROM b WHERE b.user_id = p.user_id AND n >= 2), '') AS repurchased_brands, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, max(purchased_at) AS last_purchased_at FROM p GROUP BY user_id"),
    "union_purchase_features": (union_features, f"SELECT user_id, CAST(count(DISTINCT product_id) AS INT) AS n_products, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands, max(purchased_at) AS last_purchased_at FROM ({T.PURCHASES}) GROUP BY 1"),
    "node_idf": (node_idf, f"WITH {_IDF} SELECT node, round(idf, 4) AS idf, df FROM i WHERE idf > 0"),
    "similarity_pairs": (similarity_pairs, f"WITH {_SIM} SELECT * FROM p"),
    "similarity_gated": (similarity_gated, f"WITH {_SIM} SELECT p.* FROM p JOIN part x ON CAST(x.p_partkey AS VARCHAR) = a JOIN part y ON CAST(y.p_partkey AS VARCHAR) = b WHERE x.p_type = y.p_type AND score >= 8.0"),
    "neighbours": (near, f"WITH {_NEAR} SELECT * FROM near"),
    "attached_neighbours": (attached_neighbours, f"WITH {_NEAR} SELECT CAST(p_partkey AS VARCHAR) AS product_id, coalesce((SELECT string_agg(b, ' ' ORDER BY rank) FROM near WHERE a = CAST(p_partkey AS VARCHAR)), '') AS similar FROM part"),
    "comentions": (comentions, f"WITH {_COM} SELECT a, b, reviews, least(reviews / 5, 1.0::DOUBLE) AS strength, CAST(row_number() OVER (PARTITION BY a ORDER BY least(reviews / 5, 1.0) DESC, reviews DESC, b) AS INT) AS rank FROM u QUALIFY rank <= 10"),
    "similar_users": (similar_users, f"WITH {_USR} SELECT * FROM nu"),
    "collaborative_products": (collaborative, f"WITH {_USR}, {_OWN} SELECT a AS user_id, product_id, least(round(sum(similarity), 4), 1.0::DOUBLE) AS strength FROM nu JOIN o ON o.user_id = b WHERE NOT EXISTS (SELECT 1 FROM o m WHERE m.user_id = a AND m.product_id = o.product_id) GROUP BY 1, 2"),
    "owned_boost": (owned_boost, f"WITH {_NEAR}, {_OWN} SELECT o.user_id, b AS product_id, round(least(max(score) / 30, 1.0::DOUBLE), 4) AS boost FROM o JOIN near ON a = o.product_id WHERE NOT EXISTS (SELECT 1 FROM o m WHERE m.user_id = o.user_id AND m.product_id = b) GROUP BY 1, 2"),
    "related_products": (related_products, f"WITH {_NEAR}, q AS (SELECT p_brand AS query_id, CAST(p_partkey AS VARCHAR) AS product_id FROM part WHERE p_size = 7), x AS (SELECT query_id, b AS product_id, max(score) AS score FROM q JOIN near ON a = product_id WHERE NOT EXISTS (SELECT 1 FROM q y WHERE y.query_id = q.query_id AND y.product_id = b) GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INT) AS rank FROM x QUALIFY rank <= 5"),
    "top_graph": (top_graph, "WITH e AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, l_returnflag AS kind, max(l_quantity) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3), n AS (SELECT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 2500) SELECT * FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)"),
    "two_hops": (two_hops, "WITH e AS (SELECT DISTINCT p_brand AS src, p_name AS dst FROM part UNION SELECT DISTINCT p_name, p_type FROM part) SELECT x.src, y.dst, count(*) AS paths FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.src AND z.dst = y.dst) GROUP BY 1, 2"),
}
