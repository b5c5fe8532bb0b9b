"""Queries of loads: pseudonyms, embedded purchase events, and tables that become visible together."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewright.operators import loading as L
from tidewright.plans import tables as T
from tidewright.sources.scratch import new_folder, saved

_KEY = b"not a secret: the key of the check"


def pseudonymised_customers(spark, d):
    return L.pseudonyms(T.from_sql(spark, d, "SELECT c_custkey, c_nationkey FROM customer"), "c_custkey", _KEY)


def _blob(x: int) -> str:
    return "".join(f"\\x{b ^ x:02X}" for b in _KEY.ljust(64, b"\0"))


_PSEUDONYM_SQL = f"SELECT c_custkey, c_nationkey, substr(sha256('{_blob(0x5C)}'::BLOB || unhex(sha256('{_blob(0x36)}'::BLOB || encode(CAST(c_custkey AS VARCHAR))))), 1, 32) AS pseudonym FROM customer"

#: Purchases as JSON; some without product, with a quantity or a price that is no number, or with a time that is no text.
_EVENT = """
chr(123) || CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_suppkey % 9 = 1 THEN '"product_id": "  ", ' ELSE '"product_id": " ' || CAST(l_partkey AS STRING) || '", ' END
 || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '"quantity": 0, ' WHEN 3 THEN '"quantity": true, ' WHEN 4 THEN '"quantity": "3", ' ELSE '"quantity": ' || CAST(l_linenumber AS STRING) || ', ' END
 || CASE l_returnflag WHEN 'A' THEN '"price": "dear", ' WHEN 'N' THEN '"price": 12.5, ' ELSE '"price": 7, ' END || CASE l_linestatus WHEN 'O' THEN '"purchased_at": 20240101, ' ELSE '"purchased_at": "2024-01-01", ' END || '"channel": "web"' || chr(125)
"""


def _profiles(spark, d):
    rows = T.from_sql(spark, d, f"SELECT o_custkey AS user_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS n, {_EVENT} AS j FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda x: x["j"]).alias("purchase_events"))


def profile_purchases(spark, d):
    return L.purchase_events(_profiles(spark, d)).drop("ord")


def profile_purchase_counts(spark, d):
    """The counters come from the job that writes the rows."""
    seen = Observation("purchases")
    saved(L.purchase_events(_profiles(spark, d), seen))
    return spark.createDataFrame([tuple(seen.get[k] for k in ("kept", "skipped", "nulled"))], "kept long, skipped long, nulled long")


_PURCHASES = f"""
SELECT user_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n) - 1 AS INTEGER) AS ord, s, p, i, f, o FROM (
  SELECT o_custkey AS user_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS n, l_suppkey AS s, l_partkey AS p, l_linenumber AS i, l_returnflag AS f, l_linestatus AS o FROM orders JOIN lineitem ON o_orderkey = l_orderkey) t
"""
_FITS = "s % 9 > 1 AND i NOT IN (2, 3, 4)"
_PURCHASE_SQL = f"SELECT user_id, CAST(p AS VARCHAR) AS product_id, CAST(i AS BIGINT) AS quantity, CASE o WHEN 'O' THEN NULL ELSE '2024-01-01' END AS purchased_at, CASE f WHEN 'A' THEN NULL WHEN 'N' THEN 12.5::DOUBLE ELSE 7 END AS price, 'web' AS channel FROM ({_PURCHASES}) t WHERE {_FITS}"
_COUNT_SQL = f"SELECT COUNT(*) FILTER ({_FITS}) AS kept, COUNT(*) FILTER (NOT ({_FITS})) AS skipped, CAST(SUM(CASE WHEN {_FITS} THEN (o = 'O')::INT + (f = 'A')::INT ELSE 0 END) AS BIGINT) AS nulled FROM ({_PURCHASES}) t"


def _loaded(spark, d):
    store = L.Store(spark, new_folder(spark))
    orders = T.from_sql(spark, d, "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE o_custkey END AS o_custkey, CAST(o_orderdate AS STRING) AS o_orderdate FROM orders")
    parts, lines = T.from_sql(spark, d, "SELECT * FROM part"), T.from_sql(spark, d, "SELECT l_orderkey, l_partkey, CAST(l_shipdate AS STRING) AS l_shipdate FROM lineitem")
    keys, cursors = {"orders": "o_custkey", "parts": "p_partkey", "lines": "l_orderkey"}, {"orders": "o_orderdate", "lines": "l_shipdate"}
    store.load("first", {"orders": orders.where("o_orderkey % 2 = 0"), "parts": parts}, keys, cursors)
    for _ in range(2):  # the second time changes nothing
        store.load("second", {"orders": orders, "lines": lines}, keys, cursors)
    return store


def load_run_log(spark, d):
    return _loaded(spark, d).run_log().select("run_id", "number", "table", "rows", "null_keys", F.substring("newest", 1, 10).alias("newest"))


def loaded_orders(spark, d):
    store = _loaded(spark, d)
    return store.read("orders").select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey")).join(store.read("lines").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines")), "o_orderkey").withColumn("n_parts", F.lit(store.read("parts").count()))


_LOG_SQL = """
SELECT 'first' AS run_id, 0 AS number, 'orders' AS "table", COUNT(*) AS rows, COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS null_keys, MAX(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS newest FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'first', 0, 'parts', COUNT(*), 0, NULL FROM part
UNION ALL SELECT 'second', 1, 'orders', COUNT(*), COUNT(*) FILTER (o_orderpriority = '1-URGENT'), MAX(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) FROM orders
UNION ALL SELECT 'second', 1, 'lines', COUNT(*), 0, MAX(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) FROM lineitem
"""
_LOADED_SQL = "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN -1 ELSE o_custkey END AS o_custkey, COUNT(*) AS n_lines, (SELECT COUNT(*) FROM part) AS n_parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"

QUERIES = {
    "pseudonymised_customers": (pseudonymised_customers, _PSEUDONYM_SQL),
    "profile_purchases": (profile_purchases, _PURCHASE_SQL),
    "profile_purchase_counts": (profile_purchase_counts, _COUNT_SQL),
    "load_run_log": (load_run_log, _LOG_SQL),
    "loaded_orders": (loaded_orders, _LOADED_SQL),
}
