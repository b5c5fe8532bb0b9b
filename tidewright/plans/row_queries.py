"""Row by row what other queries count: rejects, outcomes, gates, reasons and changes, each row with its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import aggregate as A
from tidewright.operators import evaluate as E
from tidewright.operators import facts as K
from tidewright.operators import incremental as I
from tidewright.operators import linking as L
from tidewright.operators import normalize as N
from tidewright.operators import profiles as P
from tidewright.operators import quality as Q
from tidewright.operators import recommend as R
from tidewright.operators import serving as V
from tidewright.plans import tables as T
from tidewright.plans.more_queries import _FACTS, _GROUPS, _NEW, _OLD, rules

_CONTRACTS = [("SOLD", "Product|User", "Supplier"), ("SENT", "Mention", "Supplier|Brand")]
_GATED = "SELECT l_orderkey, l_linenumber, l_discount * 4 AS confidence, CASE l_returnflag WHEN 'R' THEN 'AUTO_KEYWORD' ELSE 'REL' END AS evidence_kind, l_linestatus = 'O' AS linked, l_tax > 0.05 AS synthetic FROM lineitem"
_CANDIDATES = """SELECT p_partkey, p_size < 3 AS excluded_product, p_brand = 'Brand#2' AS excluded_brand, p_type = 'SMALL' AS excluded_category, p_size = 40 AS avoided_ingredient, p_name LIKE 'red%' AS category_mismatch,
  CAST(NULL AS BOOLEAN) AS owned, p_size = 30 AS owned_family, p_size = 20 AS no_evidence, p_size % 2 = 0 AS strict FROM part"""
_SNAPSHOT = "SELECT o_custkey AS user_id, o_orderkey AS item, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderkey % {} <> 0"
_OPEN = "SELECT o_orderkey AS fact_id, CASE o_orderstatus WHEN 'F' THEN o_orderdate END AS valid_to FROM orders WHERE o_orderkey % 3 <> 0"
_SEEN = "SELECT o_orderkey AS fact_id FROM orders WHERE o_orderkey % 4 <> 0"
_BOUGHT = """SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS STRING) END AS product_id,
  CASE WHEN value < 10 THEN NULL ELSE floor(value) - 20 END AS quantity, CASE WHEN user_id % 11 = 0 THEN NULL ELSE ts END AS purchased_at FROM events"""
_CODES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN ' Customer' || CAST(o_custkey AS STRING) || ' ' ELSE 'Customer' || CAST(o_custkey AS STRING) END AS code FROM orders"
_KNOWN = "SELECT 'Customer' || CAST(c_custkey AS STRING) AS known FROM customer WHERE c_acctbal >= 0"
_LEFT, _RIGHT = "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 20", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'"
_LATE = "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING) AS target_product_id, l_shipdate AS window_ts FROM lineitem"
QUERIES = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


@query(f"""SELECT fact_id, predicate, subject_type, 'subject type' AS reason FROM ({_FACTS}) t WHERE (predicate = 'SOLD' AND subject_type <> 'Product') OR (predicate = 'SENT' AND subject_type <> 'Mention')""")
def contract_reject_rows(spark, d):
    contracts = spark.createDataFrame(_CONTRACTS, "predicate string, subject_types string, object_types string")
    return K.check_contracts(T.from_sql(spark, d, _FACTS), contracts)[1].select("fact_id", "predicate", "subject_type", "reason")


@query(f"""SELECT fact_id, CASE WHEN fact_status = 'EVIDENCE_ONLY' THEN 'SKIP' WHEN predicate = 'SENT' AND subject_type = 'Product' THEN 'KEEP_CANONICAL_ONLY'
  WHEN predicate = 'SOLD' AND subject_type = 'Product' THEN 'DROP' ELSE 'QUARANTINE' END AS outcome FROM ({_FACTS}) t
  WHERE NOT (fact_status <> 'EVIDENCE_ONLY' AND predicate = 'SOLD' AND ((subject_type = 'Product' AND (polarity <> 'NEG' OR evidence_kind = 'DICT'))
    OR (subject_type = 'Mention' AND polarity = 'POS' AND confidence >= 0.95)))""")
def projection_outcome_rows(spark, d):
    return K.project(T.from_sql(spark, d, _FACTS), rules(spark))[1].select("fact_id", "outcome")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 4 < 0.2 THEN 'DROP' WHEN l_returnflag = 'R' THEN 'QUARANTINE' WHEN l_linestatus <> 'O' OR l_tax > 0.05 THEN 'EVIDENCE_ONLY' ELSE 'PROMOTE' END AS gate FROM lineitem""")
def gated_rows(spark, d):
    return T.from_sql(spark, d, _GATED).select("l_orderkey", "l_linenumber", K.gate().alias("gate"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'bolt|screw|nut') THEN 'fastener' WHEN regexp_matches(lower(p_name), 'ring') THEN 'jewel' WHEN regexp_matches(lower(p_name), 'widget|gear') THEN 'gadget' ELSE 'other' END AS grp FROM part""")
def category_group_rows(spark, d):
    return N.category_groups(T.from_sql(spark, d, "SELECT p_partkey, p_name, p_type FROM part"), ["p_name", "p_type"], _GROUPS).select("p_partkey", "grp")


@query("""SELECT p_partkey, CASE WHEN p_size < 3 THEN 'excluded_product' WHEN p_brand = 'Brand#2' THEN 'excluded_brand' WHEN p_type = 'SMALL' THEN 'excluded_category' WHEN p_size = 40 THEN 'avoided_ingredient'
  WHEN p_name LIKE 'red%' AND p_size % 2 = 0 THEN 'category_mismatch' WHEN p_size = 30 THEN 'owned_family' WHEN p_size = 20 THEN 'no_evidence' END AS filter_reason FROM part""")
def filter_reason_rows(spark, d):
    return T.from_sql(spark, d, _CANDIDATES).select("p_partkey", R.filter_reason(F.col("strict")).alias("filter_reason"))


@query(f"""SELECT COALESCE(x.user_id, y.user_id) AS user_id, COALESCE(x.item, y.item) AS item, CAST(COALESCE(x.rank, 0) AS INT) AS rank_old, CAST(COALESCE(y.rank, 0) AS INT) AS rank_new,
  CASE WHEN x.rank IS NULL THEN 'added' WHEN y.rank IS NULL THEN 'removed' WHEN x.rank <> y.rank THEN 'moved' ELSE 'same' END AS change
  FROM ({_SNAPSHOT.format(7)}) x FULL JOIN ({_SNAPSHOT.format(5)}) y ON x.user_id = y.user_id AND x.item = y.item""")
def ranking_change_rows(spark, d):
    return E.ranking_diff(*(T.from_sql(spark, d, _SNAPSHOT.format(k)) for k in (7, 5)), ["user_id", "item"]).fillna(0, ["rank_old", "rank_new"]).select("user_id", "item", "rank_old", "rank_new", "change")


@query(f"""SELECT COALESCE(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'carried' WHEN o.o_totalprice = n.o_totalprice THEN 'unchanged' ELSE 'updated' END AS change
  FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey""")
def change_rows(spark, d):
    return I.changes(T.from_sql(spark, d, _OLD), T.from_sql(spark, d, _NEW), ["o_orderkey"]).select("o_orderkey", "change")


@query(f"""SELECT * FROM (SELECT COALESCE(o.fact_id, w.fact_id) AS fact_id, CASE WHEN o.fact_id IS NULL THEN 'insert' WHEN w.fact_id IS NULL AND valid_to IS NULL THEN 'close' WHEN w.fact_id IS NULL THEN NULL
  WHEN valid_to IS NULL THEN 'refresh' ELSE 'reactivate' END AS op FROM ({_OPEN}) o FULL JOIN ({_SEEN}) w ON o.fact_id = w.fact_id) t WHERE op IS NOT NULL""")
def fact_change_rows(spark, d):
    return I.fact_changes(T.from_sql(spark, d, _OPEN), T.from_sql(spark, d, _SEEN))


@query("""SELECT * FROM (SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 45 THEN 'big' END, CASE WHEN contains(p_name, 'ring') THEN 'ring' END) AS reasons FROM part) t WHERE reasons <> ''""")
def rejected_rows(spark, d):
    bad = Q.validated(T.from_sql(spark, d, "SELECT p_partkey, p_size, p_name FROM part"), {"big": F.col("p_size") > 45, "ring": F.contains("p_name", F.lit("ring"))})[1]
    return bad.select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT event_id, product_id, CASE WHEN COALESCE(product_id, '') = '' THEN 'no_product' WHEN quantity IS NULL OR quantity <= 0 THEN 'bad_quantity' WHEN purchased_at IS NULL THEN 'no_date' ELSE 'kept' END AS outcome FROM ({_BOUGHT}) t""")
def purchase_outcome_rows(spark, d):
    return V.purchase_outcomes(T.from_sql(spark, d, _BOUGHT)).select("event_id", "product_id", "outcome")


@query(f"""SELECT o_orderkey, CASE WHEN COALESCE(trim(code), '') = '' THEN 'missing' WHEN trim(code) IN (SELECT known FROM ({_KNOWN}) k) THEN 'joinable' ELSE 'not_joinable' END AS state FROM ({_CODES}) t""")
def joined_code_rows(spark, d):
    return V.joined_codes(T.from_sql(spark, d, _CODES), "code", T.from_sql(spark, d, _KNOWN), "known").select("o_orderkey", "state")


@query(f"""SELECT COALESCE(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT k FROM ({_LEFT}) a) l FULL JOIN (SELECT DISTINCT k FROM ({_RIGHT}) b) r ON l.k = r.k""")
def shadow_rows(spark, d):
    return K.sides(T.from_sql(spark, d, _LEFT), T.from_sql(spark, d, _RIGHT), "k")


@query(f"""SELECT l_orderkey, l_linenumber, target_product_id FROM ({_LATE}) t WHERE window_ts < {T.NOW} - INTERVAL 1500 DAY""")
def held_late_rows(spark, d):
    return V.held_rows(T.from_sql(spark, d, _LATE), F.expr(T.NOW) - F.make_dt_interval(F.lit(1500))).select("l_orderkey", "l_linenumber", "target_product_id")


_PREFERRED = f"""SELECT user_id, edge_type, dst_id, scope, round(max(coalesce(confidence, 1)) * least(count(*) / 3, 1.5) * exp(-0.01 * greatest(datediff('day', CAST(max(last_seen_at) AS DATE), DATE '2001-11-05'), 0))
  * max(CASE source WHEN 'purchase' THEN 1.2 ELSE 0.8 END::DOUBLE), 4) AS weight FROM ({T.PREFERENCES}) GROUP BY 1, 2, 3, 4"""
_SOLD = "SELECT c_custkey AS product_id, 'x' || CAST(c_custkey % 400 AS STRING) AS source_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '2-HIGH' END AS category FROM customer"
_TOLD = "SELECT o_orderkey AS doc_id, 'x' || CAST(o_custkey % 390 AS STRING) AS source_id, CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS category, o_orderdate AS updated_at, o_custkey AS review_count FROM orders"


@query(f"""SELECT user_id, edge_type, dst_id, weight, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, edge_type ORDER BY weight DESC, dst_id) AS place
  FROM (SELECT user_id, edge_type, dst_id, max(weight) AS weight FROM ({_PREFERRED}) p WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1, 2, 3) b) t WHERE place <= 5""")
def profile_preference_rows(spark, d):
    prefs = A.user_preferences(T.from_sql(spark, d, T.PREFERENCES), F.to_date(F.expr(T.NOW)))
    users = P.user_profiles(T.from_sql(spark, d, "SELECT c_custkey AS user_id FROM customer"), prefs, ["PREFERS", "AVOIDS"], 5)
    one = lambda e: users.select("user_id", F.lit(e).alias("edge_type"), F.posexplode(e.lower()).alias("place", "x"))
    return one("PREFERS").union(one("AVOIDS")).select("user_id", "edge_type", "x.id", "x.weight", (F.col("place") + 1).alias("place")).withColumnRenamed("id", "dst_id")


@query(f"""SELECT product_id, COALESCE(arg_max(doc_id, (updated_at, review_count, doc_id)) FILTER (fits), -1) AS doc_id, CASE WHEN COUNT(doc_id) = 0 THEN 'not_found' WHEN COUNT(*) FILTER (fits) = 0 THEN 'wrong_category'
  WHEN COUNT(*) FILTER (fits) > 1 THEN 'ambiguous' ELSE 'found' END AS status
  FROM (SELECT p.product_id, m.*, m.doc_id IS NOT NULL AND m.category IS NOT DISTINCT FROM p.category AS fits FROM ({_SOLD}) p LEFT JOIN ({_TOLD}) m ON p.source_id = m.source_id) t GROUP BY product_id""")
def chosen_document_rows(spark, d):
    return L.choose_document(T.from_sql(spark, d, _SOLD), T.from_sql(spark, d, _TOLD)).fillna(-1, ["doc_id"])
