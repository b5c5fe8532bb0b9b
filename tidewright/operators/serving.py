"""Operators behind consumer contracts and analyst reports: lookups, overviews, audits, hygiene and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import saved


def evidence_in_window(promoted: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """Promoted aggregates with the signals behind them that lie in their window. promoted: target_product_id, edge_type, dst_id, days."""
    met = promoted.join(signals, ["target_product_id", "edge_type", "dst_id"])
    return met.filter(F.col("window_ts") >= now - F.make_dt_interval(F.col("days")))


def overview(products: DataFrame, stats: DataFrame, documents: DataFrame) -> DataFrame:
    """Every product with its review counts and its document, where it has them."""
    return products.join(stats, "product_id", "left").join(documents, "product_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def compared(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, other_id, name, other_name, n): how often two products are named together; the other one may be unknown."""
    counted = pairs.groupBy("product_id", "other_id").agg(F.count(F.lit(1)).alias("n"))
    other = products.select(F.col("product_id").alias("other_id"), F.col("name").alias("other_name"))
    return counted.join(products.select("product_id", "name"), "product_id").join(other, "other_id", "left").select("product_id", "other_id", "name", "other_name", "n")


def with_evidence(signals: DataFrame, evidence: DataFrame, has: bool = True) -> DataFrame:
    """Signals that some evidence names, or those that none does."""
    return signals.join(evidence.select("signal_id").distinct(), "signal_id", "left_semi" if has else "left_anti")


def confident_preferences(preferences: DataFrame, users: DataFrame, floor: float) -> DataFrame:
    """Preferences of active users at or above a confidence; a missing confidence counts as none."""
    return preferences.filter(F.coalesce("confidence", F.lit(0.0)) >= floor).join(users.filter(active()).select("user_id"), "user_id")


def active() -> Column:
    """Rows that are not switched off; a missing mark counts as on."""
    return F.coalesce("is_active", F.lit(True))


def ranked_top(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of the largest `by`, ties by key; a report, not a cut in a computation."""
    return rows.orderBy(F.desc_nulls_last(by), key).limit(n)


def readiness(products: DataFrame, users: DataFrame, manifests: DataFrame) -> DataFrame:
    """(name, value): active products, active users and the latest manifest."""
    count = lambda df, name: df.filter(active()).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")
    latest = manifests.agg(F.max_by("manifest_id", F.struct("made_at", "manifest_id")).alias("value")).select(F.lit("latest_manifest").alias("name"), "value")
    return count(products, "active_products").unionByName(count(users, "active_users")).unionByName(latest)


def exclusion_counts(avoided: DataFrame, product_keys: DataFrame) -> DataFrame:
    """(user_id, n_keys, n_products): what a user's avoided keys shut out; keys that no product has don't count, and a product counts once.

    Each distinct set of avoided keys is counted once and the users are attached at the end. Products with the same keys are one class with its
    size, so that a set meets classes and never the products themselves.
    """
    owned = product_keys.select("product_id", "key").where("product_id IS NOT NULL AND key IS NOT NULL").distinct()
    classes = saved(owned.groupBy("product_id").agg(F.array_sort(F.collect_set("key")).alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("size")).withColumn("cls", F.md5(F.to_json("held").cast("binary"))))
    keys = classes.select("cls", "size", F.explode("held").alias("key"))
    told = avoided.select("user_id", "key").distinct().join(keys.select("key").distinct(), "key", "left_semi")
    sets = told.groupBy("user_id").agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("shut", F.md5(F.to_json("keys").cast("binary")))
    sets = saved(sets)
    met = sets.groupBy("shut").agg(F.first("keys").alias("keys")).select("shut", F.size("keys").cast("long").alias("n_keys"), F.explode("keys").alias("key")).join(keys, "key")
    counts = met.groupBy("shut", "cls").agg(F.max("n_keys").alias("n_keys"), F.max("size").alias("size")).groupBy("shut").agg(F.max("n_keys").alias("n_keys"), F.sum("size").alias("n_products"))
    return sets.select("user_id", "shut").join(counts, "shut").select("user_id", "n_keys", "n_products")


def beyond_axis(pairs: DataFrame, axis: str) -> DataFrame:
    """Neighbour pairs that share something besides one axis. pairs: a, b, axis."""
    return pairs.groupBy("a", "b").agg(F.bool_or(F.col("axis") != axis).alias("more"), F.count_distinct("axis").alias("n_axes")).filter("more").drop("more")


def page(rows: DataFrame, text: str, needle: str, order: str, offset: int, limit: int) -> DataFrame:
    """One page of the rows whose text holds the needle, in any case."""
    return rows.filter(F.contains(F.lower(text), F.lit(needle.lower()))).orderBy(order).offset(offset).limit(limit)


def constraint_verdicts(products: DataFrame, keys: DataFrame, constraints: DataFrame) -> DataFrame:
    """(query_id, product_id, state) for every product and query: met, failed, or unknown for a product without any key.

    Constraints are OR inside a family and AND across. products: product_id; keys: product_id, key; constraints: query_id, family,
    key, a table of queries whose size Spark checks before it broadcasts it.
    """
    need = constraints.groupBy("query_id").agg(F.count_distinct("family").alias("need"))
    got = keys.join(constraints, "key").groupBy("query_id", "product_id").agg(F.count_distinct("family").alias("got"))
    known = products.join(keys.select("product_id").distinct().withColumn("known", F.lit(True)), "product_id", "left")
    out = known.crossJoin(need).join(got, ["query_id", "product_id"], "left")  # a stated set of queries against all products
    state = F.when(F.col("known").isNull(), "unknown").when(F.coalesce("got", F.lit(0)) == F.col("need"), "met").otherwise("failed")
    return out.select("query_id", "product_id", state.alias("state"))


def mapped(rows: DataFrame, column: str, mapping: dict[str, str], name: str, other: str) -> DataFrame:
    """Adds name: the mapped value of a code column, else `other`. The mapping is a configured table of few rows."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(other)))


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label: that of the label table, else the last part of the id."""
    return nodes.join(labels, "node_id", "left").withColumn("label", F.coalesce("label", F.element_at(F.split("node_id", ":"), -1)))


def purchase_outcomes(events: DataFrame) -> DataFrame:
    """events with outcome: no product, no positive quantity, no date, or kept, the first that applies. The rows to load are those kept."""
    outcome = F.when(F.coalesce("product_id", F.lit("")) == "", "no_product").when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "bad_quantity").when(F.col("purchased_at").isNull(), "no_date").otherwise("kept")
    return events.withColumn("outcome", outcome)


def purchase_hygiene(events: DataFrame) -> DataFrame:
    """(outcome, n) of `purchase_outcomes`."""
    return purchase_outcomes(events).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def inside(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """What stays of a table when rows outside a key set are deleted."""
    return rows.join(keys.select(on).distinct(), on, "left_semi")


def tombstoned(facts: DataFrame, dead: DataFrame, at: Column) -> DataFrame:
    """facts with status closed and valid_to for the reviews that are gone; closed facts keep their date."""
    gone = facts.join(dead.select("review_id").distinct().withColumn("gone", F.lit(True)), "review_id", "left")
    closes = F.col("gone").isNotNull() & F.col("valid_to").isNull()
    return gone.withColumn("valid_to", F.when(closes, at).otherwise(F.col("valid_to"))).withColumn("status", F.when(F.col("valid_to").isNull(), "open").otherwise("closed")).drop("gone")


def dirty_products(signals: DataFrame, dead: DataFrame) -> DataFrame:
    """Products whose aggregates a set of gone reviews touches."""
    return signals.join(dead.select("review_id").distinct(), "review_id", "left_semi").select("target_product_id").distinct()


def seed_cursor(rows: DataFrame) -> DataFrame:
    """(updated_at, id) of the last row by both: where an incremental run begins after a full load."""
    return rows.agg(F.max(F.struct("updated_at", "id")).alias("x")).select("x.*")


def merged_stats(catalog: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured source statistics over those of the catalog; synthetic sources are skipped on both sides."""
    real = lambda df: df.filter(~F.coalesce(F.col("synthetic"), F.lit(False))).drop("synthetic")
    own = real(configured).withColumnsRenamed({"review_count": "own_count", "rating": "own_rating"})
    return real(catalog).join(own, "product_id", "left").select("product_id", F.coalesce("own_count", "review_count").alias("review_count"), F.coalesce("own_rating", "rating").alias("rating"))


def joinability(rows: DataFrame, code: str, pattern: str) -> DataFrame:
    """(state, n): codes that fit the pattern, that do not, and that are missing."""
    state = F.when(F.coalesce(F.trim(code), F.lit("")) == "", "missing").when(F.trim(code).rlike(pattern), "joinable").otherwise("not_joinable")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def joined_codes(rows: DataFrame, code: str, catalog: DataFrame, catalog_code: str) -> DataFrame:
    """rows with state: the code is missing, is in the catalog, or is not. Outer space does not count; missing codes take no part in the join."""
    known = catalog.select(F.trim(catalog_code).alias("_code")).where("_code <> ''").distinct().withColumn("_known", F.lit(True))
    out = rows.withColumn("_asked", F.nullif(F.trim(code), F.lit("")))
    out = out.join(known, F.col("_asked") == F.col("_code"), "left")
    return out.withColumn("state", F.when(F.col("_asked").isNull(), "missing").when(F.col("_known"), "joinable").otherwise("not_joinable")).drop("_asked", "_code", "_known")


def pinned_first(rows: DataFrame, n: int) -> DataFrame:
    """(user_id, product_id, place): pinned products by their own order, then the others by score; the first n of a user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("pinned"), F.when(F.col("pinned"), F.col("ord")), F.desc("score"), "product_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("user_id", "product_id", "place")


def summary_sentences(profiles: DataFrame) -> DataFrame:
    """Adds summary: what a product is liked for, how many reviews say so, and what some dislike, as far as it is known."""
    liked = F.when(F.col("liked").isNotNull(), F.concat(F.lit("Liked for "), "liked", F.lit(" by "), F.col("n_reviews").cast("string"), F.lit(" reviews.")))
    disliked = F.when(F.col("disliked").isNotNull(), F.concat(F.lit("Some mention "), "disliked", F.lit(".")))
    return profiles.withColumn("summary", F.coalesce(F.nullif(F.concat_ws(" ", liked, disliked), F.lit("")), F.lit("No reviews yet.")))


def product_truth(catalog: DataFrame, stats: DataFrame, placeholder: str) -> DataFrame:
    """(product_id, brand, name, truth): the catalog's brand and name unless they are missing or a placeholder, then those of the statistics."""
    good = lambda c: F.when((F.coalesce(F.trim(c), F.lit("")) != "") & ~F.coalesce(F.lower(F.trim(c)).rlike(placeholder), F.lit(False)), F.trim(c))
    met = catalog.join(stats.withColumnsRenamed({"brand": "s_brand", "name": "s_name"}), "product_id", "left")
    own, lent = good("brand").isNotNull() & good("name").isNotNull(), good("s_brand").isNotNull() | good("s_name").isNotNull()
    truth = F.when(own, "catalog").when(lent, "merged").otherwise("incomplete")
    return met.select("product_id", F.coalesce(good("brand"), good("s_brand")).alias("brand"), F.coalesce(good("name"), good("s_name")).alias("name"), truth.alias("truth"))


def weighted(features: DataFrame, presets: DataFrame) -> DataFrame:
    """(preset, user_id, product_id, score): feature values under each named set of weights, a configured table (preset, feature, weight)."""
    return features.join(F.broadcast(presets), "feature").groupBy("preset", "user_id", "product_id").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))  # presets: a few rows


def held_rows(rows: DataFrame, watermark: Column) -> DataFrame:
    """Rows that came after the watermark had passed them; they are held and mark their product as dirty."""
    return rows.filter(F.col("window_ts") < watermark)


def late_rows(rows: DataFrame, watermark: Column) -> DataFrame:
    """(target_product_id, n_late) of the held rows."""
    return held_rows(rows, watermark).groupBy("target_product_id").agg(F.count(F.lit(1)).alias("n_late"))
