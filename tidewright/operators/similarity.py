"""Similarity and neighbourhood graphs: shared nodes, co-mention, users alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.profiles import top_n
from tidewright.sources.scratch import saved, together


def node_weights(nodes: DataFrame) -> DataFrame:
    """(node, idf, df) over (item, node) rows; nodes that all items hold, or one only, join no pair and are left out."""
    total = nodes.select("item").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = nodes.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("df"))
    return df.filter("df > 1").crossJoin(F.broadcast(total)).withColumn("idf", F.log(F.col("n") / F.col("df"))).filter("idf > 0").select("node", "idf", "df")  # one row is broadcast


def item_classes(nodes: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: item, cls; keys: cls, node[, grp], idf): items that hold the same weighted nodes (and groups) are one class, whose pairs need finding once."""
    rows, key = nodes.where("item IS NOT NULL").distinct().join(node_weights(nodes), "node").select("item", "node", "idf"), ["node"]
    if groups is not None:
        rows, key = rows.join(groups.select("item", "grp").where("grp IS NOT NULL").distinct(), "item"), ["node", "grp"]
    held = F.array_sort(F.collect_set(F.struct(*key, "idf")))
    items = saved(rows.groupBy("item").agg(held.alias("held")).withColumn("cls", F.md5(F.to_json("held").cast("binary"))))
    keys = saved(items.groupBy("cls").agg(F.first("held").alias("held")).select("cls", F.inline("held")))
    return items.select("item", "cls"), keys


def class_pairs(keys: DataFrame) -> DataFrame:
    """(x, y, s, n_shared), x <= y, of the classes of `item_classes`; a class and itself too."""
    key = [c for c in keys.columns if c not in ("cls", "idf")]
    pairs = keys.withColumnRenamed("cls", "x").join(keys.select(F.col("cls").alias("y"), *key), key).filter("x <= y")
    return pairs.groupBy("x", "y").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("n_shared"))


def in_parts(members: DataFrame, size: int = 512) -> DataFrame:
    """(cls, part) with part an array of about `size` items of the class, so that no row holds a whole large class. members: item, cls."""
    n = members.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    dealt = members.join(n, "cls").withColumn("_p", F.pmod(F.xxhash64("item"), F.col("_n")))
    return dealt.groupBy("cls", "_p").agg(F.collect_list("item").alias("part")).drop("_p")


def shared_nodes(nodes: DataFrame, min_score: float = 0.0, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, score, n_shared), a < b: the summed weight of the nodes that two items share. groups: (item, grp), pairs stay inside.

    The node's weight is joined before pairs are made, so nodes without weight make none. Pairs are found between classes of equal items and
    written out at the end, where they go into no exchange any more: what is shuffled grows with the pairs of classes, not of items.
    """
    members, keys = item_classes(nodes, groups)
    pairs = class_pairs(keys).filter(F.col("s") >= min_score).select("x", "y", F.round("s", 4).alias("score"), "n_shared")
    parts = saved(in_parts(members))
    met = pairs.join(parts.select(F.col("cls").alias("x"), F.col("part").alias("_a")), "x").join(parts.select(F.col("cls").alias("y"), F.col("part").alias("_b")), "y")
    rows = met.select("x", "y", "score", "n_shared", "_b", F.explode("_a").alias("_i")).select("x", "y", "score", "n_shared", "_i", F.explode("_b").alias("_j"))
    return rows.filter("x <> y OR _i < _j").select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), "score", "n_shared")


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.withColumnsRenamed({"a": "_x", "b": "a"}).withColumnRenamed("_x", "b"))


def neighbours(pairs: DataFrame, n: int = 10) -> DataFrame:
    """(a, b, score, rank): the best n neighbours of each item from pairs seen once."""
    return top_n(symmetric(pairs), ["a"], [F.desc("score"), F.asc("b")], n)


def nearest_classes(nodes: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members: item, cls; best: cls, rank, b, score): of each class of equal items the best n + 1 items, its own among them, as an item is not its own neighbour.

    Only the first n + 1 items of a class can be among the best of another one.
    """
    members, keys = item_classes(nodes)
    pairs = saved(class_pairs(keys).select(F.col("x").alias("a"), F.col("y").alias("b"), F.round("s", 4).alias("score")))
    first = top_n(members, ["cls"], [F.asc("item")], n + 1).select(F.col("cls").alias("y"), "item")
    both = symmetric(pairs.filter("a <> b")).unionByName(pairs.filter("a = b")).select(F.col("a").alias("cls"), F.col("b").alias("y"), "score")
    rows = both.join(first, "y").select("cls", F.col("item").alias("b"), "score")
    return members, saved(top_n(rows, ["cls"], [F.desc("score"), F.asc("b")], n + 1))


def nearest(nodes: DataFrame, n: int = 10) -> DataFrame:
    """(a, b, score, rank) as `neighbours` of `shared_nodes`, without the pairs of all items."""
    members, best = nearest_classes(nodes, n)
    lists = best.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("rank", "b", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["b"] != F.col("item")), 1, n)
    rows = members.join(lists, "cls").select(F.col("item").alias("a"), F.posexplode(others).alias("at", "x"))
    return rows.select("a", "x.b", "x.score", (F.col("at") + 1).alias("rank"))


def attach_neighbours(items: DataFrame, near: DataFrame, key: str, name: str) -> DataFrame:
    lists = near.groupBy(F.col("a").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("b").alias("id"), "score"))), lambda x: x.dropFields("rank")).alias(name))
    return items.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))


def comentions(mentions: DataFrame, products: DataFrame | None = None, min_reviews: int = 2, n: int = 10) -> DataFrame:
    """(a, b, reviews, strength, rank): products named in the same reviews. mentions: (review_id, product_id, polarity); NEG and unknown products drop."""
    rows = mentions.filter(~F.upper(F.coalesce("polarity", F.lit(""))).eqNullSafe("NEG")).select("review_id", "product_id")
    if products is not None:
        rows = rows.join(products.select("product_id").distinct(), "product_id", "left_semi")
    rows = rows.distinct()
    pairs = rows.withColumnRenamed("product_id", "a").join(rows.withColumnRenamed("product_id", "b"), "review_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("reviews"))
    pairs = pairs.filter(F.col("reviews") >= min_reviews).withColumn("strength", F.least(F.col("reviews") / 5, F.lit(1.0)))
    return top_n(symmetric(pairs), ["a"], [F.desc("strength"), F.desc("reviews"), F.asc("b")], n)


def similar_users(tags: DataFrame, min_shared: int = 3, n: int = 10) -> DataFrame:
    """(a, b, shared, similarity, rank): Jaccard similarity of users' tag sets. tags: (user_id, tag)."""
    tags = tags.distinct()
    size = tags.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    rows = tags.join(size, "user_id")
    a = rows.select(F.col("user_id").alias("a"), "tag", F.col("size").alias("sa"))
    b = rows.select(F.col("user_id").alias("b"), "tag", F.col("size").alias("sb"))
    pairs = a.join(b, "tag").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("sa").alias("sa"), F.max("sb").alias("sb")).filter(F.col("shared") >= min_shared)
    pairs = pairs.select("a", "b", "shared", F.round(F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared")), 4).alias("similarity"))
    return top_n(symmetric(pairs), ["a"], [F.desc("similarity"), F.asc("b")], n)


def collaborative(near: DataFrame, owned: DataFrame) -> DataFrame:
    """(user_id, product_id, strength): what similar users own and the user does not; summed similarity up to 1."""
    theirs = near.join(owned.select(F.col("user_id").alias("b"), "product_id").distinct(), "b").groupBy(F.col("a").alias("user_id"), "product_id").agg(F.least(F.round(F.sum("similarity"), 4), F.lit(1.0)).alias("strength"))
    return theirs.join(owned.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")


def owned_boost(owned: DataFrame, near: DataFrame, scale: float = 30.0) -> DataFrame:
    """(user_id, product_id, boost): the best neighbour score of what a user owns, over `scale` and up to 1; owned products drop."""
    mine = owned.select("user_id", "product_id").distinct()
    reach = mine.withColumnRenamed("product_id", "a").join(near.select("a", F.col("b").alias("product_id"), "score"), "a").groupBy("user_id", "product_id").agg(F.round(F.least(F.max("score") / scale, F.lit(1.0)), 4).alias("boost"))
    return reach.join(mine, ["user_id", "product_id"], "left_anti")


def owned_boost_near(owned: DataFrame, nodes: DataFrame, n: int = 10, scale: float = 30.0) -> DataFrame:
    """(user_id, product_id, boost) as `owned_boost` with the best n neighbours of `nearest`.

    A user's products meet the lists of their classes in the user's own part, where owned products are told by a row of their own: lists are never dealt anew.
    """
    members, best = nearest_classes(nodes, n)
    mine = saved(owned.select("user_id", F.col("product_id").alias("item")).distinct().join(members, "item", "left"))
    lists = best.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("rank", "b", "score"))).alias("best"))
    lists = F.broadcast(saved(lists)) if best.count() <= 1 << 20 else lists
    own = F.array(F.struct(F.col("item").alias("b"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("own")))
    others = F.slice(F.filter(F.coalesce("best", F.array().cast(lists.schema["best"].dataType)), lambda x: x["b"] != F.col("item")), 1, n)
    told = F.concat(F.transform(others, lambda x: F.struct(x["b"].alias("b"), x["score"].alias("score"), F.lit(0).alias("own"))), own)
    rows = together(mine, "user_id", (n + 1) * mine.count()).join(lists, "cls", "left").select("user_id", F.inline(told))
    reach = rows.groupBy("user_id", F.col("b").alias("product_id")).agg(F.max("score").alias("score"), F.max("own").alias("own")).where("own = 0 AND score IS NOT NULL")
    return reach.select("user_id", "product_id", F.round(F.least(F.col("score") / scale, F.lit(1.0)), 4).alias("boost"))


def related(anchors: DataFrame, near: DataFrame, excluded: DataFrame | None = None, n: int = 5) -> DataFrame:
    """(query_id, product_id, score, anchor, rank): the best neighbours of a query's anchor products."""
    reach = anchors.withColumnRenamed("product_id", "a").join(near.select("a", F.col("b").alias("product_id"), "score"), "a").groupBy("query_id", "product_id").agg(F.max("score").alias("score"), F.max_by("a", F.struct("score", "a")).alias("anchor"))
    reach = reach.join(anchors.select("query_id", "product_id"), ["query_id", "product_id"], "left_anti")
    if excluded is not None:
        reach = reach.join(excluded, "product_id", "left_anti")
    return top_n(reach, ["query_id"], [F.desc("score"), F.asc("product_id")], n)


def graph(edges: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree and the edges among them. edges: (src, dst, kind, weight); equal edges keep the largest weight."""
    best = edges.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
    degree = best.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    nodes = degree.orderBy(F.desc("degree"), F.asc("node")).limit(max_nodes)
    kept = best.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes, kept.select("src", "dst", "kind", "weight")


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, dst, paths): what is reached in two steps and not in one."""
    far = edges.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paths"))
    return far.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
