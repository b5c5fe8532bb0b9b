"""Readers of landing files into typed tables. Schemas are declared, never inferred; bad records are kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.ids import review_id, reviewer_id
from tidewright.functions.text import normalized

_SPAN = "array<struct<word:string,entity_group:string,start:int,end:int,sentiment:string>>"
_END = "struct<word:string,entity_group:string,start:int,end:int,sentiment:string>"
REVIEWS = (
    "source_review_key string, drup_dt string, channel string, text string, source_product_id string, source_key_type string, brnd_nm string, prod_nm string, author_key string, "
    f"prd_apal_scr double, ner {_SPAN}, bee {_SPAN}, relation array<struct<subject:{_END},object:{_END},relation:string,source_type:string>>, _corrupt_record string"
)
CATALOG = (
    "ONLINE_PROD_SERIAL_NUMBER string, SOURCE_CHANNEL string, SOURCE_KEY_TYPE string, SOURCE_PRODUCT_ID string, prd_nm string, BRAND_NAME string, SALE_STATUS string, COUNTRY_OF_ORIGIN string, CTGR_L_NAME string, "
    "CTGR_M_NAME string, CTGR_S_NAME string, CTGR_SS_NAME string, SALE_PRICE string, MAIN_INGREDIENT string, MAIN_EFFECT string, REVIEW_COUNT string, REVIEW_SCORE string, _corrupt_record string"
)
STATS = "product_id string, channel string, key_type string, source_product_id string, review_count long, score_count long, avg_score double, snapshot_date string"


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", not lines).json(path)


def read_reviews(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return _json(spark, path, REVIEWS, lines)


def read_catalog(spark: SparkSession, path: str, sale_status: str | None = None, lines: bool = True) -> DataFrame:
    """One row per product: deepest category that is not blank, lists split, numbers null where they don't parse."""
    raw = _json(spark, path, CATALOG, lines).filter("ONLINE_PROD_SERIAL_NUMBER IS NOT NULL")
    if sale_status is not None:
        raw = raw.filter(F.col("SALE_STATUS") == sale_status)
    words = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda c, t: F.expr(f"try_cast(replace({c}, ',', '') AS {t})")
    return raw.select(
        F.col("ONLINE_PROD_SERIAL_NUMBER").alias("product_id"), F.col("SOURCE_CHANNEL").alias("channel"), F.col("SOURCE_KEY_TYPE").alias("key_type"), F.col("SOURCE_PRODUCT_ID").alias("source_product_id"), F.col("prd_nm").alias("name"),
        F.col("BRAND_NAME").alias("brand"), F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("CTGR_SS_NAME", "CTGR_S_NAME", "CTGR_M_NAME", "CTGR_L_NAME")]).alias("category"), F.col("COUNTRY_OF_ORIGIN").alias("country"),
        number("SALE_PRICE", "decimal(18,2)").alias("price"), words("MAIN_INGREDIENT").alias("ingredients"), words("MAIN_EFFECT").alias("effects"), number("REVIEW_COUNT", "bigint").alias("review_count"), number("REVIEW_SCORE", "double").alias("review_score"),
    )


def read_rating_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, product ids with more than one source identity, which are left out). The rating is null without scores."""
    rows = spark.read.schema(STATS).json(path).filter("product_id IS NOT NULL AND channel IS NOT NULL AND source_product_id IS NOT NULL")
    rows = rows.withColumn("avg_score", F.when(F.col("score_count") > 0, F.col("avg_score")))
    twice = rows.groupBy("product_id").agg(F.count_distinct("channel", "key_type", "source_product_id").alias("n")).filter("n > 1").select("product_id")
    return rows.join(twice, "product_id", "left_anti"), twice


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A configured dictionary as CSV with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def reviews_to_rows(raw: DataFrame, source: str) -> dict[str, DataFrame]:
    """Landing reviews as review, ner, bee and rel rows with their ids; the event time falls back to the time of the run."""
    rid = review_id(F.lit(source), "source_review_key", "brnd_nm", "prod_nm", "text", "drup_dt")
    at = F.expr("try_to_timestamp(drup_dt)")
    base = raw.filter("_corrupt_record IS NULL").withColumn("review_id", rid)
    who = reviewer_id(F.lit(source), "author_key", rid)
    review = base.select("review_id", who["id"].alias("reviewer_id"), who["stability"].alias("stability"), "text", F.coalesce(at, F.current_timestamp()).alias("event_at"), F.when(at.isNull(), "run").otherwise("created").alias("event_at_source"), F.col("source_product_id"), F.col("brnd_nm").alias("brand"), F.col("prod_nm").alias("name"))
    spans = lambda c: base.select("review_id", F.posexplode(c).alias("ord", "x")).select("review_id", "ord", "x.*")
    rel = base.select("review_id", F.posexplode("relation").alias("ord", "x")).select("review_id", "ord", F.col("x.subject").alias("subject"), F.col("x.object").alias("object"), "x.relation", "x.source_type")
    return {"review": review, "ner": spans("ner"), "bee": spans("bee"), "rel": rel}


def catalog_concepts(products: DataFrame) -> DataFrame:
    """(product_id, axis, concept): brand, category, country, ingredients and effects of products, in one pass."""
    one = lambda axis, c: F.array(F.struct(F.lit(axis).alias("axis"), normalized(c).alias("concept")))
    many = lambda axis, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(axis).alias("axis"), normalized(x).alias("concept")))
    items = F.concat(one("brand", "brand"), one("category", "category"), one("country", "country"), many("ingredient", "ingredients"), many("goal", "effects"))
    return products.select("product_id", F.explode(items).alias("x")).select("product_id", "x.*").filter("concept <> ''").distinct()


def event_props(events: DataFrame) -> DataFrame:
    """Events with the fields of their JSON column."""
    return events.withColumn("p", F.from_json("props", "k int")).withColumn("k", F.col("p.k")).drop("p")
