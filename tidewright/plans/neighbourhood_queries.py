"""Queries of the graph around nodes: parts of one size, the suppliers that sold them and the customers who bought them, in three hops."""

from __future__ import annotations

from tidewright.operators import neighbourhood as H
from tidewright.plans import tables as T

_HOPS, _EACH = 3, 4
_SEEDS = "SELECT 'p' || CAST(p_partkey AS STRING) AS node FROM part WHERE p_size = 50"
_PAIRS = """
SELECT 'p' || CAST(l_partkey AS STRING) AS a, 's' || CAST(l_suppkey AS STRING) AS b, 'sold' AS kind FROM lineitem
UNION SELECT 'p' || CAST(l_partkey AS STRING), 'c' || CAST(o_custkey AS STRING), 'bought' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
"""
_EDGES = f"SELECT a AS src, b AS dst, kind FROM ({_PAIRS}) t UNION SELECT b, a, kind FROM ({_PAIRS}) t"


def _around(spark, d):
    return H.neighbourhoods(T.from_sql(spark, d, _SEEDS), T.from_sql(spark, d, _EDGES), _HOPS, _EACH)


def graph_nodes(spark, d):
    return _around(spark, d)[0]


def graph_links(spark, d):
    return _around(spark, d)[1]


def _sql() -> str:
    out = f"""
WITH edges AS ({_EDGES}), degree AS (SELECT src AS dst, COUNT(DISTINCT dst) AS degree FROM edges GROUP BY 1),
strong AS (SELECT src, dst, kind FROM edges JOIN degree USING (dst) QUALIFY ROW_NUMBER() OVER (PARTITION BY src ORDER BY degree, dst, kind) <= {_EACH}),
n0 AS (SELECT DISTINCT node AS seed, node, 0 AS hop FROM ({_SEEDS}) t)"""
    for h in range(1, _HOPS + 1):
        reached = " UNION ALL ".join(f"SELECT seed, node FROM n{k}" for k in range(h))
        out += f""",
l{h} AS (SELECT seed, {h} AS hop, src, dst, kind FROM n{h - 1} JOIN strong ON src = node),
n{h} AS (SELECT DISTINCT seed, dst AS node, {h} AS hop FROM l{h} WHERE (seed, dst) NOT IN ({reached}))"""
    return out + "\n"


_all = lambda name, first: " UNION ALL ".join(f"SELECT * FROM {name}{h}" for h in range(first, _HOPS + 1))
QUERIES = {"graph_nodes": (graph_nodes, _sql() + _all("n", 0)), "graph_links": (graph_links, _sql() + _all("l", 1))}
