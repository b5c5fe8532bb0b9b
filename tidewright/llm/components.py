"""Connected components by alternating large-star and small-star rounds, each a few joins and aggregates.

Rounds grow with the logarithm of the component size. The state of a round is written to the shared
folder, so a lost executor costs at most one round. The minimum of a node's neighbours is written before it
is joined back, which lets adaptive execution split a hot centre over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm._common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id in links; component is the smallest id reachable, itself included.

    Links with a null end are ignored; a self link yields its own component; no links, no rows.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    alone = written(links.filter("a = b").select(F.col("a").alias("id")).distinct())
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, small = _state(edges), Window.partitionBy("u")
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        with_min = large.withColumn("m", F.min("v").over(small))
        edges = written(
            with_min.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").filter("u > v").distinct()
        )
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (
        edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        .unionByName(roots.select("id", F.col("id").alias("component")))
        .unionByName(alone.join(edges.selectExpr("explode(array(u, v)) AS id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    )
