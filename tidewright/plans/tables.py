"""The given tables in the roles of reviews, purchases and products; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2001-11-05 00:00:00'"

SIGNALS = """
SELECT CAST(l_partkey AS STRING) AS target_product_id, l_linestatus AS edge_type, 'Supplier' AS dst_type, CAST(l_suppkey % 7 AS STRING) AS dst_id,
       CAST(l_orderkey AS STRING) AS review_id, CASE l_returnflag WHEN 'R' THEN 'NEG' WHEN 'A' THEN 'pos' ELSE 'NEU' END AS polarity,
       1 - l_discount AS source_confidence, CASE WHEN l_tax > 0.06 THEN 'BEE_SYNTHETIC' ELSE 'REL' END AS evidence_kind,
       l_shipdate AS window_ts, CASE WHEN l_linenumber = 7 THEN 'CATALOG_VALIDATION' WHEN l_linenumber = 6 THEN NULL ELSE 'REVIEW' END AS signal_family
FROM lineitem
"""
PURCHASES = """
SELECT o_custkey AS user_id, CAST(l_partkey AS STRING) AS product_id, p_brand AS brand, p_type AS category, p_name AS family, CAST(l_quantity AS BIGINT) AS quantity, o_orderdate AS purchased_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
"""
PREFERENCES = """
SELECT o_custkey AS user_id, CASE WHEN l_returnflag = 'R' THEN 'AVOIDS' ELSE 'PREFERS' END AS edge_type, p_brand AS dst_id, o_orderpriority AS scope,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE 1 - l_discount END AS confidence, CASE l_linestatus WHEN 'O' THEN 'purchase' ELSE 'basic' END AS source,
       o_orderdate AS last_seen_at, l_orderkey * 10 + l_linenumber AS ord
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
"""
NODES = """
SELECT CAST(p_partkey AS STRING) AS item, unnest_node AS node FROM (
  SELECT p_partkey, 'bs:' || p_brand || ':' || CAST(p_size AS STRING) AS unnest_node FROM part
  UNION ALL SELECT p_partkey, 'bt:' || p_brand || ':' || p_type || ':' || p_name FROM part
  UNION ALL SELECT p_partkey, 'nt:' || p_name || ':' || CAST(p_size AS STRING) FROM part)
"""
MENTIONS = "SELECT CAST(l_orderkey AS STRING) AS review_id, CAST(l_partkey % 500 AS STRING) AS product_id, CASE l_returnflag WHEN 'R' THEN 'NEG' ELSE 'POS' END AS polarity FROM lineitem"
TAGS = "SELECT o_custkey AS user_id, CAST(l_partkey AS STRING) AS tag FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
PRODUCTS = "SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS name, p_brand AS brand_id, p_type AS category_id, p_size AS size, p_retailprice AS price FROM part"


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the given tables, which are bound as arguments and not registered."""
    import re

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "pages", "labels", "conversations"]
    used = [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    bound = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(names) + r")\b", r"\1 {\2}", sql)
    return spark.sql(bound, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used})


def duck(sql: str) -> str:
    """The same text for a database that calls strings VARCHAR."""
    return sql.replace("AS STRING)", "AS VARCHAR)")
