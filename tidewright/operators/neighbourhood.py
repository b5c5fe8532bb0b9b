"""The graph around products or users: what can be reached from each of a set of nodes in a few hops, without the hubs' whole neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.profiles import top_n
from tidewright.sources.scratch import saved


def strongest_edges(edges: DataFrame, each: int) -> DataFrame:
    """(src, dst, kind, rank): of each node the edges to its `each` least connected neighbours, which say most about it; by degree, id, kind. edges: src, dst, kind."""
    one = edges.select("src", "dst", "kind").distinct()
    degree = one.groupBy(F.col("src").alias("dst")).agg(F.count_distinct("dst").alias("degree"))
    known = one.join(degree, "dst", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return top_n(known, ["src"], [F.asc("degree"), F.asc("dst"), F.asc("kind")], each).select("src", "dst", "kind", "rank")


def neighbourhoods(seeds: DataFrame, edges: DataFrame, hops: int = 2, each: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes: seed, node, hop; links: seed, hop, src, dst, kind) around each seed. seeds: node; edges: src, dst, kind, in both directions where both are meant.

    Each hop joins only the nodes that the hop before was the first to reach with the strongest edges of each, so a seed's rows are bounded by `each` to the
    power of the hops, whatever the degrees. A node's hop is the first that reaches it. A link to a node that was reached before stays in the links.
    """
    strong = saved(strongest_edges(edges, each))
    nodes = saved(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).where("node IS NOT NULL").distinct())
    frontier, links = nodes, None
    for hop in range(1, hops + 1):
        step = saved(frontier.select("seed", F.col("node").alias("src")).join(strong, "src").select("seed", F.lit(hop).alias("hop"), "src", "dst", "kind"))
        links = step if links is None else links.unionByName(step)
        frontier = saved(step.select("seed", F.col("dst").alias("node")).distinct().join(nodes.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        nodes = nodes.unionByName(frontier)
    return nodes, links
