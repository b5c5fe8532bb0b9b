"""Recommendation for all users at once: overlaps, filters, scores, rerank, explanations."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import freshness, popularity, rating_over_four, shrinkage
from tidewright.operators.profiles import top_n
from tidewright.operators.search import contained
from tidewright.operators.similarity import in_parts
from tidewright.sources.scratch import saved, small, together

#: Evidence families of overlap axes.
FAMILIES = {
    "master": ["brand", "category", "catalog_keyword", "ingredient", "goal_master", "product_name", "product"],
    "review_graph": ["keyword", "bee_attr", "semantic_keyword", "semantic_bee_attr", "context", "concern", "concern_bridge", "tool", "coused"],
    "weak": ["weak_semantic_keyword", "weak_semantic_bee_attr"],
    "purchase": ["owned_family", "repurchased_family", "repurchase_brand", "repurchase_category", "recent_purchase_brand"],
    "boost": ["comparison", "collab", "comention", "similar"],
}
#: Axis, weight and divisor of the features min(sum of strengths / divisor, 1).
CAPPED = {
    "keyword": (0.16, 3.0), "context": (0.08, 2.0), "catalog_keyword": (0.04, 2.0), "concern": (0.08, 2.0), "ingredient": (0.07, 3.0), "goal_master": (0.05, 2.0),
    "category": (0.05, 1.0), "active_category": (0.02, 2.0), "tool": (0.02, 2.0), "coused": (0.02, 2.0), "collab": (0.02, 1.0), "comention": (0.02, 1.0), "similar": (0.02, 1.0), "brand": (0.06, 1.0),
}


def family_of(axis: Column) -> Column:
    pairs = [F.lit(x) for fam, axes in FAMILIES.items() for a in axes for x in (a, fam)]
    return F.element_at(F.create_map(*pairs), axis)


def overlaps(users: DataFrame, products: DataFrame) -> DataFrame:
    """(user_id, product_id, axis, key, strength): what a user prefers and a product has. users: user_id, axis, key, strength; products: product_id, axis, key.

    One equi-join on (axis, key); pairs that share nothing never come up.
    """
    u = users.groupBy("user_id", "axis", "key").agg(F.max("strength").alias("strength"))
    return u.join(products.select("product_id", "axis", "key").distinct(), ["axis", "key"]).select("user_id", "product_id", "axis", "key", "strength")


def text_overlaps(users: DataFrame, texts: DataFrame, axis: str = "catalog_keyword") -> DataFrame:
    """Keywords that stand inside a product's text. Distinct texts and distinct keywords meet by an equi-join on first letters."""
    met = contained(texts.select("text").distinct(), users.select(F.col("key").alias("word")).distinct())
    held = texts.join(met, "text").select("product_id", F.col("word").alias("key"))
    return users.join(held, "key").select("user_id", "product_id", F.lit(axis).alias("axis"), "key", F.lit(1.0).alias("strength"))


@dataclass(frozen=True)
class Classes:
    """Products with the same keys (and attributes) as one class. members: item, cls; keys: cls, axis, key; info: cls, head (the least product_id), attributes."""

    members: DataFrame
    keys: DataFrame
    info: DataFrame


def product_classes(keys: DataFrame, products: DataFrame | None = None) -> Classes:
    """keys: product_id, axis, key; products: product_id and attributes that a class is to have in common; products that it lacks drop."""
    items = keys.where("product_id IS NOT NULL AND axis IS NOT NULL AND key IS NOT NULL").groupBy("product_id").agg(F.array_sort(F.collect_set(F.struct("axis", "key"))).alias("held"))
    attributes = [] if products is None else [c for c in products.columns if c != "product_id"]
    if products is not None:
        items = items.join(products, "product_id")
    items = saved(items.withColumn("cls", F.md5(F.to_json(F.struct("held", *attributes)).cast("binary"))))
    one = saved(items.groupBy("cls").agg(F.first("held").alias("held"), F.min("product_id").alias("head"), *[F.first(c).alias(c) for c in attributes]))
    return Classes(items.select(F.col("product_id").alias("item"), "cls"), saved(one.select("cls", F.inline("held"))), one.drop("held"))


def class_overlaps(users: DataFrame, classes: Classes) -> DataFrame:
    """As `overlaps`, with a class in the place of its products. Where there are few keys of classes they are sent to the users, whose rows then stay in their parts up to the end."""
    u = saved(users.groupBy("user_id", "axis", "key").agg(F.max("strength").alias("strength")))
    each = classes.keys.count() / max(classes.keys.select("axis", "key").distinct().count(), 1)
    return together(u, "user_id", int(u.count() * each)).join(small(classes.keys), ["axis", "key"]).select("user_id", F.col("cls").alias("product_id"), "axis", "key", "strength")


def of_products(rows: DataFrame, classes: Classes) -> DataFrame:
    """rows of classes (product_id) as rows of products; they go into no exchange if there are up to two million products, whose ids are sent to all tasks."""
    parts = saved(in_parts(classes.members))
    parts = F.broadcast(parts) if classes.members.count() <= 1 << 21 else parts
    rest = [c for c in rows.columns if c != "product_id"]
    return rows.withColumnRenamed("product_id", "cls").join(parts, "cls").select(*rest, F.explode("part").alias("product_id"))


def semantic_overlaps(users: DataFrame, evidence: DataFrame, rules: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Overlaps by rules (user_key, axis, key, strength, weak) with product evidence (product_id, axis, key, polarity) of positive polarity."""
    met = users.select("user_id", F.col("key").alias("user_key")).distinct().join(rules, "user_key").join(evidence.filter("polarity = 'POS'").select("product_id", "axis", "key").distinct(), ["axis", "key"])
    if blocked is not None:
        met = met.join(blocked, ["user_key", "key"], "left_anti")
    axis = F.concat(F.when(F.col("weak"), "weak_semantic_").otherwise("semantic_"), "axis")
    return met.groupBy("user_id", "product_id", axis.alias("axis"), "key").agg(F.max("strength").alias("strength"))


def concern_bridge(attributes: DataFrame, bridge: DataFrame) -> DataFrame:
    """(product_id, concern, score): the best attribute of each concern, only above zero."""
    return attributes.join(bridge, "attr").groupBy("product_id", "concern").agg(F.max(F.col("score") * F.col("weight")).alias("score")).filter("score > 0")


def filter_reason(strict: Column | bool = False) -> Column:
    """The first reason why a candidate is out, null if none; over joined boolean columns, nulls count as false."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    flags = [("excluded_product", None), ("excluded_brand", None), ("excluded_category", None), ("avoided_ingredient", None), ("category_mismatch", strict), ("owned", strict), ("owned_family", strict), ("no_evidence", None)]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, only in flags:
        hit = F.coalesce(F.col(name), F.lit(False))
        out = out.when(hit if only is None else hit & only, name)
    return out


def scope_allows(scope: Column, group: Column) -> Column:
    return F.coalesce(scope, F.lit("all")).isin("", "all") | scope.eqNullSafe(group)


def prefilter(products: DataFrame, avoided: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """Products that hold nothing avoided and, if asked, something preferred. products: product_id, key."""
    kept = products.select("product_id").distinct().join(products.join(avoided, "key", "left_semi").select("product_id").distinct(), "product_id", "left_anti")
    return kept if preferred is None else kept.join(products.join(preferred, "key", "left_semi").select("product_id").distinct(), "product_id", "left_semi")


def meets_constraints(products: DataFrame, constraints: DataFrame) -> DataFrame:
    """(query_id, product_id, state) of products that hold a key of a query: met or failed; constraints are OR inside a family and AND across.

    `serving.constraint_verdicts` gives all products, those without any key as unknown.

    products: product_id, key; constraints: query_id, family, key.
    """
    need = constraints.select("query_id", "family").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    got = constraints.join(products, "key").groupBy("query_id", "product_id").agg(F.count_distinct("family").alias("got")).join(need, "query_id")
    return got.select("query_id", "product_id", F.when(F.col("got") == F.col("need"), "met").otherwise("failed").alias("state"))


def eligible(met: DataFrame, mode: Column | str = "EXPLORE") -> DataFrame:
    """(user_id, product_id, n_overlaps) of pairs with evidence of a family that counts; COMPARE lets comparison count."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    fam = family_of(F.col("axis"))
    counts = fam.isin("master", "review_graph", "weak", "purchase") | ((mode == "COMPARE") & (F.col("axis") == "comparison"))
    return met.groupBy("user_id", "product_id").agg(F.bool_or(F.coalesce(counts, F.lit(False))).alias("ok"), F.count_if(F.coalesce(fam != "boost", F.lit(True))).alias("n_overlaps")).filter("ok").drop("ok")


def most_owned(owned: DataFrame) -> int:
    """The most products that a user owns."""
    return owned.select("user_id", "product_id").distinct().groupBy("user_id").count().agg(F.max("count")).first()[0] or 0


def retrieve_classes(candidates: DataFrame, classes: Classes, owned: DataFrame, n: int = 50) -> DataFrame:
    """As `retrieve`, of the candidates of `eligible` by classes."""
    owned = saved(owned.select("user_id", "product_id").distinct())
    rows = _with_owned(candidates, owned, classes).drop("brands").join(small(classes.info.select("cls", "head")), "cls")
    rows = first_products(rows, classes, n, most_owned(owned), [F.desc("n_overlaps")], F.struct(F.lit(0).alias("own")), F.struct(F.lit(1).alias("own")))
    return top_n(rows, ["user_id"], [F.asc("own"), F.desc("n_overlaps"), F.asc("product_id")], n)


def retrieve(candidates: DataFrame, owned: DataFrame, n: int = 50) -> DataFrame:
    """The first n candidates of each user: not owned before owned, most overlaps, id."""
    rows = candidates.join(owned.select("user_id", "product_id", F.lit(1).alias("own")).distinct(), ["user_id", "product_id"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return top_n(rows, ["user_id"], [F.asc("own"), F.desc("n_overlaps"), F.asc("product_id")], n)


def _raw(w: dict[str, float], own: Column, known: Column) -> Column:
    """The weighted sum of the features of a row with f_<axis>, the catalog columns, and whether the product and its brand are owned."""
    raw = sum((F.col(f"f_{a}") * w[a] for a in CAPPED), F.lit(0.0))
    raw = raw + w["freshness"] * freshness(F.col("review_count_30d")) + w["popularity"] * popularity(F.col("review_count_all")) + w["rating"] * rating_over_four(F.col("rating"))
    return raw + w["novelty"] * F.when(own, 0.0).when(known, 0.5).otherwise(1.0) - w["owned"] * own.cast("double")


def _capped() -> list[Column]:
    return [F.least(F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("strength"))), F.lit(0.0)) / d, F.lit(1.0)).alias(f"f_{a}") for a, (_, d) in CAPPED.items()]


def _all_weights(weights: dict[str, float] | None) -> dict[str, float]:
    return {k: v for k, (v, _) in CAPPED.items()} | {"freshness": 0.04, "popularity": 0.03, "rating": 0.02, "novelty": 0.02, "owned": 0.05} | (weights or {})


def score(met: DataFrame, products: DataFrame, owned: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(user_id, product_id, raw_score, final_score): capped sums per axis, catalog features and shrinkage by reviews, in one aggregate.

    products: product_id, brand_id, review_count_30d, review_count_all, rating; owned: user_id, product_id, brand_id.
    """
    rows = met.groupBy("user_id", "product_id").agg(*_capped()).join(products, "product_id")
    mine = owned.select("user_id", "product_id", F.lit(True).alias("_own")).distinct()
    brands = owned.select("user_id", "brand_id", F.lit(True).alias("_known")).distinct()
    rows = rows.join(mine, ["user_id", "product_id"], "left").join(brands, ["user_id", "brand_id"], "left")
    raw = _raw(_all_weights(weights), F.coalesce("_own", F.lit(False)), F.coalesce("_known", F.lit(False)))
    return rows.withColumn("raw_score", F.round(raw, 9)).select("user_id", "product_id", "brand_id", *[c for c in ("category_id",) if c in products.columns], "raw_score", F.round(F.col("raw_score") * shrinkage(F.col("review_count_all")), 9).alias("final_score"))


def _with_owned(rows: DataFrame, owned: DataFrame, classes: Classes) -> DataFrame:
    """rows of classes with what the user owns: mine (of this class), n_own (of all) and brands, joined by user alone, so that rows stay where they are."""
    what = owned.select("user_id", F.col("product_id").alias("item"), F.col("brand_id") if "brand_id" in owned.columns else F.lit(None).cast("string").alias("brand_id")).distinct().join(classes.members, "item", "left")
    held = F.filter(F.collect_set(F.struct("cls", "item")), lambda x: x["cls"].isNotNull() & x["item"].isNotNull())
    lists = what.groupBy("user_id").agg(held.alias("_held"), F.collect_set("brand_id").alias("_brands"))
    out = rows.withColumnRenamed("product_id", "cls").join(lists, "user_id", "left")
    mine = F.transform(F.filter("_held", lambda x: x["cls"] == F.col("cls")), lambda x: x["item"])
    none = F.array().cast("array<string>")
    return out.withColumns({"mine": F.coalesce(mine, none), "n_own": F.greatest(F.coalesce(F.size("_held"), F.lit(0)), F.lit(0)), "brands": F.coalesce("_brands", none)}).drop("_held", "_brands")


def score_classes(met: DataFrame, classes: Classes, owned: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(user_id, cls, head, brand_id, category_id, mine, n_own, raw_new, final_new, raw_own, final_own): as `score`, of rows of `class_overlaps`: the scores of a product
    of the class that the user does not own, and of one that the user owns. The attributes of the classes: those of `score`."""
    w, no, yes = _all_weights(weights), F.lit(False), F.lit(True)
    rows = met.groupBy("user_id", "product_id").agg(*_capped()).join(small(classes.info).withColumnRenamed("cls", "product_id"), "product_id")
    rows = rows.withColumns({"_kept": _raw(w, no, yes), "_new": _raw(w, no, no), "_own": _raw(w, yes, yes)}).drop(*[f"f_{a}" for a in CAPPED])
    rows = _with_owned(rows, owned, classes)
    known = F.coalesce(F.array_contains("brands", F.col("brand_id")), no)
    rows = rows.withColumns({"raw_new": F.round(F.when(known, F.col("_kept")).otherwise(F.col("_new")), 9), "raw_own": F.round("_own", 9)})
    final = {f"final_{x}": F.round(F.col(f"raw_{x}") * shrinkage(F.col("review_count_all")), 9) for x in ("new", "own")}
    return rows.withColumns(final).select("user_id", "cls", "head", "brand_id", *[c for c in ("category_id",) if c in rows.columns], "mine", "n_own", "raw_new", "final_new", "raw_own", "final_own")


def scores_of_products(scored: DataFrame, classes: Classes) -> DataFrame:
    """(user_id, product_id, raw_score, final_score) of all products from `score_classes`."""
    rows = of_products(scored.withColumnRenamed("cls", "product_id"), classes)
    own = (F.size("mine") > 0) & F.array_contains("mine", F.col("product_id"))
    return rows.select("user_id", "product_id", *[F.when(own, F.col(f"{c}_own")).otherwise(F.col(f"{c}_new")).alias(f"{c}_score") for c in ("raw", "final")])


def first_products(rows: DataFrame, classes: Classes, n: int, most_own: int, order: list[Column], new: Column, own: Column) -> DataFrame:
    """rows of classes (user_id, cls, head, mine, n_own and values) as rows of the products among which each user's first n are, by `order`, then by id.

    most_own: the most that a user owns; order: of a class, for products that the user does not own. new, own: structs of the values of a product that the user does not own, and of one that is owned.
    The first n of these products lie in the first n + n_own classes by order and least id, and among the first n + n_own products of each; owned ones
    are all kept. Rows are never dealt anew.
    """
    need = n + F.col("n_own")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("user_id").orderBy(*order, F.asc("head")))).where((F.col("_at") <= need) | (F.size("mine") > 0))
    most = n + most_own
    firsts = saved(top_n(classes.members, ["cls"], [F.asc("item")], most).groupBy("cls").agg(F.array_sort(F.collect_list("item")).alias("firsts")))
    firsts = F.broadcast(firsts) if classes.members.count() <= 1 << 21 else firsts
    fresh = F.filter(F.when(F.col("_at") <= need, F.slice("firsts", F.lit(1), need)).otherwise(F.array().cast("array<string>")), lambda x: ~F.array_contains("mine", x))
    told = F.concat(F.transform(fresh, lambda x: F.struct(x.alias("product_id"), new.alias("v"))), F.transform("mine", lambda x: F.struct(x.alias("product_id"), own.alias("v"))))
    return rows.join(firsts, "cls").select(*[c for c in rows.columns if c not in ("cls", "head", "mine", "n_own", "_at")], F.inline(told)).select("*", "v.*").drop("v")


def greedy_diversity(rows: list[tuple], weight: float, k: int) -> list[tuple[int, float]]:
    """Picks (row number, adjusted score) from rows (score, brand, category), best first: each pick lowers the later ones of its brand and category."""
    left, seen, out = list(range(len(rows))), {}, []
    while left and len(out) < k:
        adjusted = [rows[i][0] - weight * sum(seen.get(x, 0) for x in (("b", rows[i][1]), ("c", rows[i][2])) if x[1]) for i in left]
        at = max(range(len(left)), key=lambda j: (adjusted[j], -j))
        pick = left.pop(at)
        out.append((pick, adjusted[at]))
        for x in (("b", rows[pick][1]), ("c", rows[pick][2])):
            if x[1]:
                seen[x] = seen.get(x, 0) + 1
    return out


def rerank(scored: DataFrame, k: int = 20, diversity: float = 0.05, mode: str = "EXPLORE") -> DataFrame:
    """(user_id, product_id, original_rank, final_rank, final_score, rank_score): each user's best 2k rows, re-ordered for diversity."""
    weight = 0.0 if mode == "COMPARE" else diversity
    rows = top_n(scored, ["user_id"], [F.desc("final_score"), F.asc("product_id")], 2 * k, "original_rank")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("original_rank")
        picks = greedy_diversity(list(zip(t["final_score"], t["brand_id"], t["category_id"], strict=True)), weight, k)
        at = [i for i, _ in picks]
        return pd.DataFrame({"user_id": t["user_id"].iloc[at].values, "product_id": t["product_id"].iloc[at].values, "original_rank": t["original_rank"].iloc[at].values, "final_rank": range(1, len(at) + 1), "final_score": t["final_score"].iloc[at].values, "rank_score": [round(s, 4) for _, s in picks]})

    return rows.groupBy("user_id").applyInPandas(one, f"user_id {rows.schema['user_id'].dataType.simpleString()}, product_id string, original_rank int, final_rank int, final_score double, rank_score double")


def first_scores(met: DataFrame, classes: Classes, owned: DataFrame, n: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of `score` among which each user's first n by final_score and id are, from rows of `class_overlaps`."""
    owned = saved(owned.distinct())
    value = lambda x: F.struct(F.col(f"raw_{x}").alias("raw_score"), F.col(f"final_{x}").alias("final_score"))
    rows = first_products(score_classes(met, classes, owned, weights), classes, n, most_owned(owned), [F.desc("final_new")], value("new"), value("own"))
    return rows.drop("raw_new", "raw_own", "final_new", "final_own")


def next_question(features: DataFrame, axes: list[str], epsilon: float = 0.01) -> DataFrame:
    """(user_id, axis, variance): the axis that varies least among a user's candidates with a mean above epsilon; ties by order, the first axis without any."""
    rows = features.select("user_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("axis"), F.col(a).alias("v")) for i, a in enumerate(axes)])).alias("x")).select("user_id", "x.*")
    stats = rows.groupBy("user_id", "ord", "axis").agg(F.var_pop("v").alias("variance"), F.avg("v").alias("mean"))
    best = stats.filter(F.col("mean") > epsilon).groupBy("user_id").agg(F.min(F.struct(F.round("variance", 9), "ord", "axis")).alias("x"))
    return features.select("user_id").distinct().join(best, "user_id", "left").select("user_id", F.coalesce("x.axis", F.lit(axes[0])).alias("axis"))


def explanations(met: DataFrame, k: int = 5) -> DataFrame:
    """(user_id, product_id, axis, key, contribution, rank): the overlaps that count most; boosts share their axis in proportion to strength."""
    w = F.element_at(F.create_map(*[F.lit(x) for a, (v, _) in CAPPED.items() for x in (a, v)]), F.col("axis"))
    share = F.col("strength") / F.sum("strength").over(Window.partitionBy("user_id", "product_id", "axis"))
    return top_n(met.withColumn("contribution", F.round(F.coalesce(w, F.lit(0.0)) * share, 6)), ["user_id", "product_id"], [F.desc(F.abs("contribution")), F.asc("axis"), F.asc("key")], k).select("user_id", "product_id", "axis", "key", "contribution", "rank")


def provenance(signals: DataFrame, evidence: DataFrame, facts: DataFrame, reviews: DataFrame, facts_each: int = 3, width: int = 120) -> DataFrame:
    """(signal_id, fact_id, snippet, rank): the first facts of a signal with the start of their review."""
    rows = signals.join(evidence, "signal_id")
    rows = top_n(rows, ["signal_id"], [F.asc("evidence_rank"), F.asc("fact_id")], facts_each)
    return rows.join(facts.select("fact_id", "review_id"), "fact_id").join(reviews.select("review_id", F.substring("text", 1, width).alias("snippet")), "review_id", "left").select("signal_id", "fact_id", "snippet", "rank")
