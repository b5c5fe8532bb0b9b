"""From the graph of a review to facts: ids of concepts, types put right by dictionaries, polarity and the decision about each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ids import concept_iri, fact_id, qualifier_fingerprint
from tidewright.functions.text import normalized
from tidewright.operators.facts import check_contracts

KEYWORD_CONFIDENCE = 0.8
#: Types that a dictionary may put in place of a wrong one, in this order.
RESCUED = ("Concern", "Goal")
_OF_PHRASES = ("BEE_ATTR", "KEYWORD")


def looked_up(rows: DataFrame, word: str, dictionary: DataFrame, name: str) -> DataFrame:
    """rows with the value of a word as it is written, else of its normal form, null if neither is known. dictionary: (word, value), one row per word."""
    d = dictionary.select(F.col("word").alias("_w"), F.col("value").alias("_v")).where("_w <> '' AND _v <> ''")
    out = rows.withColumn("_w", F.col(word)).join(d, "_w", "left").withColumnRenamed("_v", "_as_is")
    out = out.withColumn("_w", normalized(word)).join(d, "_w", "left")
    return out.withColumn(name, F.coalesce("_as_is", "_v")).drop("_w", "_as_is", "_v")


def mention_concepts(spans: DataFrame, types: DataFrame, date_kind: Column) -> DataFrame:
    """spans with entity_type and concept_id: dates by their kind, known groups by the table, other mentions by their place in the review.

    spans: review_id, ord, word, grp; types: grp, entity_type, concept_type (null: no concept of its own). date_kind: an expression over spans.
    """
    known = spans.withColumn("grp", F.upper("grp")).join(types, "grp", "left")
    text, is_date = normalized("word"), F.col("grp") == "DATE"
    own = F.concat_ws(":", F.lit("mention"), "review_id", F.col("ord").cast("string"))
    concept = F.when(is_date, concept_iri(date_kind, text)).when(F.col("concept_type").isNotNull(), concept_iri(F.col("concept_type"), text)).otherwise(own)
    return known.withColumns({"entity_type": F.when(is_date, date_kind).otherwise(F.coalesce("entity_type", "grp")), "concept_id": concept}).drop("concept_type")


def decision() -> Column:
    """DROP, QUARANTINE, EVIDENCE_ONLY or PROMOTE of an edge whose ends' types are known; the strictest reason wins."""
    of_phrase = F.col("subject_entity_type").isin(*_OF_PHRASES) | F.col("object_entity_type").isin(*_OF_PHRASES)
    hidden = F.coalesce((of_phrase & ~F.col("linked")) | (F.col("evidence_kind") == "BEE_SYNTHETIC"), F.lit(False))
    return F.when(F.col("confidence") < 0.2, "DROP").when(F.col("evidence_kind") == "AUTO_KEYWORD", "QUARANTINE").when(hidden, "EVIDENCE_ONLY").otherwise("PROMOTE")


def entity_iris(entities: DataFrame, reviews: DataFrame, concept_types: DataFrame, attributes: DataFrame, concerns: DataFrame, goals: DataFrame) -> DataFrame:
    """Entities with their type among concepts, their iri, and what the dictionaries of concerns and goals say about their name.

    reviews: review_id, product_iri, reviewer_iri; the target and the reviewer of a review are these, where they are known.
    concept_types: entity_type, concept_type; attributes, concerns, goals: word, value.
    """
    out = entities.join(reviews.select("review_id", "product_iri", "reviewer_iri"), "review_id", "left").join(concept_types, "entity_type", "left")
    for dictionary, name in ((attributes, "_attr"), (concerns, "concern"), (goals, "goal")):
        out = looked_up(out, "name", dictionary, name)
    kind = F.coalesce("concept_type", "entity_type")
    given = F.when(F.col("value") == "review_target", F.nullif(F.col("product_iri"), F.lit(""))).when(F.col("value") == "reviewer", F.nullif(F.col("reviewer_iri"), F.lit("")))
    stand_in = F.coalesce(given, F.concat_ws(":", F.lit("placeholder"), "value", F.coalesce("scope", F.lit(""))))
    attribute = concept_iri(kind, F.coalesce("_attr", normalized("name")))
    iri = F.when(F.col("is_placeholder"), stand_in).when(F.col("entity_type") == "BEE_ATTR", attribute).otherwise(concept_iri(kind, F.col("value")))
    return out.select("review_id", "entity_id", "entity_type", kind.alias("kind"), iri.alias("iri"), "name", "polarity", "concern", "goal")


def _rescued(side: str, allowed: Column) -> Column:
    """(kind, iri, was) of one end: a concern or goal that the contract allows there, where its own type is not allowed; else unchanged."""
    kind = F.col(f"{side}_kind")
    wrong = F.coalesce((F.size(allowed) > 0) & ~F.array_contains(allowed, kind), F.lit(False))
    out = F.struct(kind.alias("kind"), F.col(f"{side}_iri").alias("iri"), F.lit(None).cast("string").alias("was"))
    for target in reversed(RESCUED):
        key = F.col(f"{side}_{target.lower()}")
        put = F.struct(F.lit(target).alias("kind"), concept_iri(target, key).alias("iri"), kind.alias("was"))
        out = F.when(wrong & F.array_contains(allowed, target) & key.isNotNull(), put).otherwise(out)
    return out


def edge_facts(edges: DataFrame, iris: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, contract rejects with reason, edges that make none with their decision).

    edges: as of `review_graph.edges`; iris: as of `entity_iris`; contracts: predicate, subject_types, object_types, lists joined by a bar. An end of
    the wrong type becomes a concern or goal if a dictionary knows its name and the contract allows that; the type it had is kept as a qualifier. Polarity is
    the object's, else the subject's, else the edge's own. The brand of a product is told by the catalog, not by reviews.
    """
    ends = edges.where("edge <> 'OFFICIAL_BRAND'")
    for side in ("subject", "object"):
        own = iris.select("review_id", F.col("entity_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("entity_type", "kind", "iri", "polarity", "concern", "goal")])
        ends = ends.join(own, ["review_id", side])
    ends = ends.withColumns({"decision": decision(), "predicate": F.when(F.col("edge") == "HAS_KEYWORD", F.col("edge")).otherwise(F.lower("edge"))})
    others = ends.where("decision IN ('DROP', 'QUARANTINE')").select("review_id", "edge_id", "decision")
    split = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.split(c, r"\|"))
    rules = contracts.select("predicate", split(F.col("subject_types")).alias("_s"), split(F.col("object_types")).alias("_o"))
    out = ends.where("decision IN ('PROMOTE', 'EVIDENCE_ONLY')").join(rules, "predicate", "left")
    out = out.withColumns({"_subject": _rescued("subject", F.col("_s")), "_object": _rescued("object", F.col("_o"))})
    backed = (F.col("edge") == "HAS_KEYWORD") & (F.col("subject_entity_type") == "BEE_ATTR") & (F.col("object_entity_type") == "KEYWORD") & ~F.coalesce(F.col("evidence_kind").isin("AUTO_KEYWORD", "BEE_SYNTHETIC"), F.lit(False))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    polarity = F.coalesce(blank("object_polarity"), blank("subject_polarity"), F.when(~F.col("sentiment").isin("", "NEU"), F.col("sentiment")))
    was = F.filter(F.array(*[F.struct(F.lit(f"type_resolved_from_{s}").alias("key"), F.col(f"_{s}.was").alias("value")) for s in ("subject", "object")]), lambda x: x["value"].isNotNull())
    out = out.withColumns({"polarity": polarity, "qualifiers": was})
    of_phrase = F.col("subject_entity_type").isin(*_OF_PHRASES) | F.col("object_entity_type").isin(*_OF_PHRASES)
    facts = out.select(
        fact_id("review_id", F.col("_subject.iri"), "predicate", F.col("_object.iri"), "polarity", qualifier_fingerprint("qualifiers")).alias("fact_id"), "review_id", "edge_id",
        F.col("_subject.iri").alias("subject_iri"), "predicate", F.col("_object.iri").alias("object_iri"), F.col("_subject.kind").alias("subject_type"), F.col("_object.kind").alias("object_type"), "polarity",
        F.coalesce("confidence", F.when(backed, KEYWORD_CONFIDENCE)).alias("confidence"), F.when(of_phrase, "BEE").otherwise("REL").alias("source_modality"),
        F.when(backed, "BEE_DICT").otherwise(F.col("evidence_kind")).alias("evidence_kind"), F.when(F.col("decision") == "PROMOTE", "CANONICAL_PROMOTED").otherwise("EVIDENCE_ONLY").alias("fact_status"),
        F.col("_subject.was").alias("subject_was"), F.col("_object.was").alias("object_was"),
    )
    return *check_contracts(facts, contracts), others


def keyword_facts(phrases: DataFrame, found: DataFrame) -> DataFrame:
    """HAS_KEYWORD facts from phrases that a dictionary resolves, beside the graph's own edges.

    phrases: phrase_id, review_id, product_iri, linked, and what `normalize.phrases` adds (attr_id, polarity, confidence); found: phrase_id, keyword_id, as of
    `normalize.keywords`. Phrases of another product, of reviews without one, or under 0.6 sure make none.
    """
    sure = phrases.where("coalesce(product_iri, '') <> '' AND coalesce(linked, true) AND confidence >= 0.6")
    out = sure.join(found, "phrase_id").withColumns({"subject_iri": concept_iri("BEEAttr", "attr_id"), "object_iri": concept_iri("Keyword", "keyword_id"), "predicate": F.lit("HAS_KEYWORD")})
    out = out.withColumn("fact_id", fact_id("review_id", "subject_iri", "predicate", "object_iri", "polarity", F.lit("")))
    one = out.groupBy("fact_id", "review_id", "subject_iri", "predicate", "object_iri", "polarity").agg(F.max("confidence").alias("confidence"), F.min("phrase_id").alias("phrase_id"))
    return one.withColumns({"source_modality": F.lit("BEE"), "evidence_kind": F.lit("BEE_DICT")})
