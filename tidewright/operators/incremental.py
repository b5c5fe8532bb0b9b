"""Change capture: versions, merges, dirty sets, cursors and their equivalence with a full run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload(df: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> Column:
    """Hash of all other columns of a row."""
    cols = sorted(c for c in df.columns if c not in (*key, *ignore))
    return F.md5(F.to_json(F.struct(*cols)).cast("binary"))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): added, updated, unchanged or carried (not in new)."""
    o = old.select(*key, payload(old, key).alias("_o"))
    n = new.select(*key, payload(new, key).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "carried").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("updated")
    return o.join(n, key, "full_outer").select(*key, kind.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new over old: the rows of new, and those of old whose key it lacks."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti").select(*new.columns))


def keep_only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in the set."""
    return rows.join(keys.distinct(), keys.columns, "left_semi")


def review_versions(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """(review_id, version, op, payload, active, changed_at) of incoming rows that change something.

    current: review_id, version, payload, active; incoming: review_id, payload, deleted. What is unchanged gives no row.
    """
    both = incoming.select("review_id", F.col("payload").alias("_p"), "deleted").join(current, "review_id", "left")
    op = (
        F.when(F.col("deleted"), F.when(F.coalesce("active", F.lit(False)), "TOMBSTONE"))
        .when(F.col("version").isNull(), "INSERT").when(~F.col("active"), "REACTIVATE").when(F.col("payload") != F.col("_p"), "UPDATE")
    )
    out = both.withColumn("op", op).filter("op IS NOT NULL")
    return out.select("review_id", (F.coalesce("version", F.lit(0)) + 1).alias("version"), "op", F.col("_p").alias("payload"), (F.col("op") != "TOMBSTONE").alias("active"), now.alias("changed_at"))


def fact_changes(open_facts: DataFrame, new_facts: DataFrame) -> DataFrame:
    """(fact_id, op): insert, refresh, reactivate or close. open_facts: fact_id, valid_to; new_facts: fact_id."""
    both = open_facts.select("fact_id", "valid_to", F.lit(1).alias("_o")).join(new_facts.select("fact_id", F.lit(1).alias("_n")).distinct(), "fact_id", "full_outer")
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull() & F.col("valid_to").isNull(), "close").when(F.col("_n").isNull(), None).when(F.col("valid_to").isNull(), "refresh").otherwise("reactivate")
    return both.select("fact_id", op.alias("op")).filter("op IS NOT NULL")


def replace_signals(old: DataFrame, new: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, dirty products) after all signals of the given reviews are replaced."""
    gone = old.join(reviews, "review_id", "left_semi")
    dirty = gone.select("target_product_id").union(new.select("target_product_id")).distinct()
    return old.join(reviews, "review_id", "left_anti").unionByName(new), dirty


def changed_since(rows: DataFrame, since: tuple[object, object], until: object, limit: int | None = None) -> DataFrame:
    """Rows after the cursor (updated_at, id) and not after the start of the run, in total order."""
    ts, ident = since
    after = (F.col("updated_at") > F.lit(ts)) | ((F.col("updated_at") == F.lit(ts)) & (F.col("id") > F.lit(ident)))
    out = rows.filter(after & (F.col("updated_at") <= F.lit(until))).orderBy("updated_at", "id")
    return out if limit is None else out.limit(limit)


def safe_cursor(batch: DataFrame) -> DataFrame:
    """One row: the last (updated_at, id) before the earliest skipped row. batch: updated_at, id, skipped."""
    at = F.struct("updated_at", "id")
    first = batch.agg(F.min(F.when(F.col("skipped"), at)).alias("first"))
    return batch.crossJoin(F.broadcast(first)).filter(F.col("first").isNull() | (at < F.col("first"))).agg(F.max(at).alias("c")).select("c.updated_at", "c.id")  # one row is broadcast


def refresh_products(aggregates: DataFrame, fresh: DataFrame, dirty: DataFrame) -> DataFrame:
    """All rows of dirty products are replaced, so that rows whose signals vanished go too."""
    return aggregates.join(dirty, "target_product_id", "left_anti").unionByName(fresh.join(dirty, "target_product_id", "left_semi"))


def soft_deleted(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """rows with is_active false where nothing was seen for `days`."""
    stale = F.coalesce(F.col("last_seen_at") < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return rows.withColumn("is_active", F.coalesce("is_active", F.lit(True)) & ~stale)


def merge_landing(current: DataFrame, landed: DataFrame, key: list[str], valid: Column, most_rejects: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(merged rows, counts by change). Raises if too large a share of the landed rows is not valid."""
    n, bad = landed.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(valid, F.lit(False)))).first()
    if n and bad > most_rejects * n:
        raise ValueError(f"{bad} of {n} landed rows are not valid")
    good = landed.filter(valid)
    return upsert(current, good, key), changes(current, good, key).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def row_diff(old: DataFrame, new: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """(key, side, changed groups) of rows that were added, removed or changed, by groups of columns."""
    o, n = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("_o")), new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("_n"))
    differ = [F.when(~F.struct(*[F.col(f"_o.{c}") for c in cols]).eqNullSafe(F.struct(*[F.col(f"_n.{c}") for c in cols])), g) for g, cols in groups.items()]
    side = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    out = o.join(n, key, "full_outer").select(key, side.alias("side"), F.concat_ws(",", *differ).alias("groups"))
    return out.filter((F.col("side") != "changed") | (F.col("groups") != "")).withColumn("groups", F.when(F.col("side") == "changed", F.col("groups")).otherwise(""))
