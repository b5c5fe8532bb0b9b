"""The registered queries of the engine and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import contract_queries, core_queries, graph_queries, loading_queries, more_queries, neighbourhood_queries, reading_queries, recommend_queries, row_queries
from tidewright.plans.tables import duck

Query = Callable[[SparkSession, str], DataFrame]
_ALL = {**core_queries.QUERIES, **more_queries.QUERIES, **contract_queries.QUERIES, **graph_queries.QUERIES, **recommend_queries.QUERIES, **loading_queries.QUERIES, **neighbourhood_queries.QUERIES, **reading_queries.QUERIES, **row_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck(sql) for name, (_, sql) in _ALL.items() if sql}
