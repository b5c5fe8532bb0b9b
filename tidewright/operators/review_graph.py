"""The graph of each review: mentions from typed text spans, entities, edges with a confidence by source, and keyword candidates.

All rows of a review meet once, in one exchange by review. What the first, the nearest or the last row of a review decides is
a window inside it, and mentions that mean the same are closed over with array functions, so no step moves rows again.
A review is assumed to fit in a task; reviews of any number are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import normalized
from tidewright.sources.scratch import saved

#: Confidence of a mention by its source, of an edge by its relation.
SOURCE_CONFIDENCE = {"ner": 1.0, "bee": 0.9, "meta": 1.0, "relation": 0.8, "synthetic": 0.4}
SYNTHETIC, NER_BEE, PLAIN = 0.4, 0.8, 1.0
_STAGE = 1 << 40  # ord of a row is less
_TARGET_WORD = "Review Target"


def entity_groups(types: DataFrame, aliases: DataFrame) -> DataFrame:
    """(grp, type, is_bee): the type of each group that is written in spans. types: code, is_bee; aliases: alias, code."""
    own = types.select(F.col("code").alias("grp"), F.when(F.col("is_bee"), "BEE_ATTR").otherwise(F.col("code")).alias("type"), "is_bee")
    named = aliases.join(types, "code", "left").select(F.col("alias").alias("grp"), F.when(F.col("is_bee"), "BEE_ATTR").otherwise(F.col("code")).alias("type"), F.lit(False).alias("_alias"))
    both = named.join(own.select("grp", F.col("is_bee").alias("_own")), "grp", "left").select("grp", "type", F.coalesce("_own", F.lit(False)).alias("is_bee"))
    return both.unionByName(own.join(aliases.select(F.col("alias").alias("grp")), "grp", "left_anti"))


def _tone(raw: Column, sentiments: DataFrame) -> Column:
    """The configured polarity of a sentiment, else its upper case, NEU for none. sentiments: (sentiment, polarity), few rows."""
    known = {r["sentiment"]: r["polarity"] for r in sentiments.select("sentiment", "polarity").collect()}
    pairs = [F.lit(x) for pair in sorted(known.items()) for x in pair]
    found = F.element_at(F.create_map(*pairs), F.trim(raw)) if pairs else F.lit(None).cast("string")
    return F.when(F.coalesce(raw, F.lit("")) == "", "NEU").otherwise(F.coalesce(found, F.upper(raw)))


def hash_id(*parts: Column | str) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, joined by two colons."""
    return F.substring(F.sha2(F.concat_ws("::", *[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def _rows(reviews: DataFrame, spans: DataFrame, phrases: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per span, phrase, brand and end of a relation, and one per review for its target; `at` is their order in the review."""
    none = lambda kind: F.lit(None).cast(kind)

    def row(source: str, stage: int, ord_: Column, word: Column, grp: Column, start: Column, end: Column, sentiment: Column, **more: Column) -> list[Column]:
        own = {"linked": none("boolean"), "attribution": none("string"), "rel": none("long"), "is_object": none("boolean"), "relation": none("string"), "source_type": none("string"), "keywords": none("array<string>"), "product_id": none("string")} | more
        told = {
            "at": (F.lit(stage * _STAGE) + ord_).cast("long"), "source": F.lit(source), "word": F.coalesce(word, F.lit("")), "grp": F.coalesce(grp, F.lit("")),
            "start": start.cast("long"), "end": end.cast("long"), "sentiment": sentiment,
        }
        return [F.col("review_id"), *[c.alias(k) for k, c in (told | own).items()]]

    c = F.col
    named = spans.select(*row("ner", 0, c("ord"), c("word"), c("grp"), c("start"), c("end"), c("sentiment")))
    said = phrases.select(*row("bee", 1, c("ord"), c("word"), c("grp"), c("start"), c("end"), c("sentiment"), linked=c("linked"), attribution=c("attribution")))
    brand = reviews.where("brand <> ''").select(*row("meta", 2, F.lit(0), c("brand"), F.lit("BRD"), none("long"), none("long"), none("string")))
    ends = [
        relations.select(*row("relation", 3, 2 * c("ord") + k, c(f"{e}_word"), c(f"{e}_grp"), c(f"{e}_start"), c(f"{e}_end"), c("sentiment") if k else none("string"),
            rel=c("ord").cast("long"), is_object=F.lit(bool(k)), relation=c("relation"), source_type=c("source_type"), keywords=c("keywords")))
        for k, e in enumerate(("subj", "obj"))
    ]
    target = reviews.select(*row("synthetic", 4, F.lit(0), F.lit(_TARGET_WORD), F.lit("PRD"), none("long"), none("long"), none("string"), product_id=F.coalesce(c("product_id").cast("string"), F.lit("UNKNOWN"))))
    out = target
    for part in (named, said, brand, *ends):
        out = out.unionByName(part)
    return out


def _named(rows: DataFrame) -> DataFrame:
    """Adds `mention`, the `at` of the row that first made the mention that a row means.

    Spans, phrases and the brand are one mention per type, word and place. The end of a relation takes the mention of its type, word and place, else
    the first at its place, else the one of its type and word without a place, else it makes one, which later ends find in the same way.
    """
    review = ["review_id"]
    by_key, by_place, by_word = (Window.partitionBy(*review, *more) for more in (["type", "word", "start", "end"], ["start", "end"], ["type", "word"]))
    first = lambda condition, window: F.min(F.when(condition, F.col("at"))).over(window)
    base, end = F.col("source").isin("ner", "bee", "meta"), F.col("source") == "relation"
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    bare = F.col("start").isNull() & F.col("end").isNull()
    same_type = F.col("type") == F.col("own_type")  # a word that stands for the reviewer or the target has that type, whatever is written
    rows = rows.withColumns({"_key": first(base, by_key), "_place": F.when(whole, first(base, by_place)), "_bare": F.when(same_type, first(base & bare, by_word)), "_bare_end": first(end & bare, by_word)})
    known = F.coalesce(F.when(same_type | ~whole, F.col("_key")), F.col("_place"))
    fallback = F.coalesce("_bare", F.when(same_type & (F.col("_bare_end") < F.col("at")), F.col("_bare_end")))
    rows = rows.withColumns({"_known": known, "_fallback": F.when(~bare, fallback)})
    makes = end & ~bare & F.col("_known").isNull() & F.col("_fallback").isNull()
    rows = rows.withColumns({"_new_key": first(makes, by_key), "_new_place": first(makes & whole, by_place)})
    made = F.when(whole, F.col("_new_place")).otherwise(F.col("_new_key"))
    placed = F.coalesce("_known", F.when(made <= F.col("at"), made), "_fallback")
    mention = F.when(base, F.col("_key")).when(end & bare, F.coalesce("_known", "_bare_end")).when(end, placed).otherwise(F.col("at"))
    return rows.withColumn("mention", mention).drop("_key", "_place", "_bare", "_bare_end", "_known", "_fallback", "_new_key", "_new_place")


def _closed(pairs: Column) -> Column:
    """Map of mention to the smallest mention that pairs join it to; pairs is an array of structs a, b."""
    start = F.transform(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))), lambda m: F.struct(m.alias("node"), m.alias("root")))

    def joined(labels: Column, p: Column) -> Column:
        root = lambda m: F.get(F.filter(labels, lambda x: x["node"] == m), F.lit(0))["root"]
        a, b = root(p["a"]), root(p["b"])
        return F.transform(labels, lambda x: F.struct(x["node"].alias("node"), F.when(x["root"].isin(a, b), F.least(a, b)).otherwise(x["root"]).alias("root")))

    return F.map_from_entries(F.aggregate(pairs, start, joined))


def review_rows(reviews: DataFrame, spans: DataFrame, phrases: DataFrame, relations: DataFrame, groups: DataFrame, placeholders: DataFrame, relation_types: DataFrame, sentiments: DataFrame) -> DataFrame:
    """Every row of every review with its mention, the entity that it means and, for the object of a relation, the edge that it makes; written.

    reviews: review_id, product_id, brand. spans: review_id, ord, word, grp, start, end, sentiment; phrases: the same, linked, attribution. relations: review_id, ord,
    {subj,obj}_{word,grp,start,end}, relation, source_type, sentiment, keywords. groups: as of `entity_groups`. placeholders: word, kind (reviewer or review_target),
    type. relation_types: code, edge. The last four are configured dictionaries; Spark checks their size before it broadcasts them. ord tells rows of one review apart.
    """
    words = placeholders.select(F.col("word").alias("_w"), "kind", F.col("type").alias("_placeholder_type"))
    codes = relation_types.select(F.col("code").alias("relation"), F.col("edge").alias("_edge"))
    rows = _rows(reviews, spans, phrases, relations).join(groups, "grp", "left").withColumn("_w", F.lower(F.trim("word"))).join(words, "_w", "left").join(codes, "relation", "left")
    rows = rows.withColumns({"own_type": F.coalesce("type", "grp"), "is_bee": F.coalesce("is_bee", F.lit(False))})
    rows = rows.withColumn("type", F.coalesce("_placeholder_type", "own_type")).drop("_w", "_placeholder_type").repartition("review_id")
    rows = _named(rows)

    in_review, in_mention, in_relation = (Window.partitionBy(*k) for k in (["review_id"], ["review_id", "mention"], ["review_id", "rel"]))
    last = lambda value, when, window: F.max(F.when(when, F.struct("at", value.alias("v")))).over(window)["v"]
    object_, kind = F.coalesce("is_object", F.lit(False)), F.lower("relation")
    kept = object_ & ~F.coalesce(kind.isin("same_entity", "no_relationship"), F.lit(False))
    of_phrase = (F.coalesce(F.col("source_type"), F.lit("")) == "NER-BeE") | F.col("is_bee")
    rows = rows.withColumns({"_nerbee": kept & of_phrase, "product_id": F.max("product_id").over(in_review), "makes": F.col("at") == F.col("mention")})
    tone = _tone(F.col("sentiment"), sentiments)
    spoken = F.coalesce(F.col("sentiment"), F.lit("")) != ""
    rows = rows.withColumns({
        "tone": F.coalesce(last(tone, F.col("_nerbee") & spoken, in_mention), F.max(F.when(F.col("makes") & (F.col("type") == "BEE_ATTR") & spoken, tone)).over(in_mention)),
        "linked": last(F.col("linked"), (F.col("source") == "bee") & F.col("linked").isNotNull(), in_mention),
        "attribution": last(F.col("attribution"), (F.col("source") == "bee") & F.col("linked").isNotNull(), in_mention),
        "related": F.max(F.col("_nerbee")).over(in_mention),
        "subject": F.max(F.when(~object_, F.col("mention"))).over(in_relation),
        "_first_target": F.min(F.when(F.col("makes") & (F.col("source") != "synthetic") & (F.col("kind") == "review_target"), F.col("at"))).over(in_review),
    })
    rows = rows.where((F.col("source") != "synthetic") | F.col("_first_target").isNull())

    same = F.when(object_ & (kind == "same_entity"), F.struct(F.col("subject").alias("a"), F.col("mention").alias("b")))
    roots = _closed(F.array_sort(F.collect_list(same).over(in_review)))
    rows = rows.withColumn("root", F.coalesce(F.element_at(roots, F.col("mention")), F.col("mention")))
    in_group, of_word = Window.partitionBy("review_id", "root"), Window.partitionBy("review_id", "root", "word")
    priority = F.when(F.col("kind") == "review_target", 1).when(F.col("kind") == "reviewer", 2).otherwise(99)
    rows = rows.withColumn("_often", F.count_if("makes").over(of_word))
    chosen = F.min(F.when(F.col("makes"), F.struct(priority, F.when(priority == 99, -F.col("_often")).otherwise(0), "at"))).over(in_group)["at"]
    rows = rows.withColumns({"_chosen": chosen, "group_at": F.min(F.when(F.col("makes"), F.col("at"))).over(in_group)})

    held = F.col("kind").isNotNull()
    value = F.when(held, F.col("kind")).when(F.col("is_bee"), F.col("grp")).otherwise(normalized("word"))
    entity = F.struct(
        F.when(held, hash_id(F.col("type"), F.col("kind"), F.col("product_id"))).when(F.col("is_bee"), hash_id("BEE_ATTR", normalized("grp"))).otherwise(hash_id(F.col("type"), value)).alias("entity_id"),
        F.when(F.col("is_bee") & ~held, "BEE_ATTR").otherwise(F.col("type")).alias("entity_type"), value.alias("value"), F.when(held, F.col("kind")).when(F.col("is_bee"), F.col("grp")).otherwise(F.col("word")).alias("name"),
        F.when(held, F.col("product_id")).alias("scope"), held.alias("is_placeholder"), F.when(F.col("is_bee") & ~held, F.col("tone")).alias("polarity"), F.when(F.col("is_bee") & ~held, F.col("word")).alias("phrase"),
    )
    rows = rows.withColumn("entity", F.max(F.when(F.col("at") == F.col("_chosen"), entity)).over(in_group))
    is_target = F.col("makes") & ((F.col("at") == F.col("_first_target")) | (F.col("source") == "synthetic"))
    rows = rows.withColumns({
        "subject_entity": F.max(F.when(~object_, F.col("entity.entity_id"))).over(in_relation),
        "target_entity": F.max(F.when(is_target, F.col("entity.entity_id"))).over(in_review),
        "edge": F.when(F.col("_nerbee"), "HAS_ATTRIBUTE").when(kept, F.col("_edge")),
        "edge_tone": F.when(F.col("_nerbee"), "NEU").when(kept, tone),
        "edge_confidence": F.when(F.col("source_type") == "NER-BeE", NER_BEE).otherwise(PLAIN),
    })
    keep = [
        "review_id", "at", "mention", "makes", "source", "type", "grp", "word", "start", "end", "kind", "tone", "linked", "attribution", "related", "keywords", "group_at", "entity", "product_id",
        "subject_entity", "target_entity", "edge", "edge_tone", "edge_confidence", F.col("_nerbee").alias("of_phrase"),
    ]
    return saved(rows.select(*keep))


def mentions(rows: DataFrame) -> DataFrame:
    """(review_id, mention, source, type, word, start, end, placeholder, sentiment, confidence, entity_id) from `review_rows`; mention numbers rise in the order of the review."""
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_CONFIDENCE.items() for x in pair]), F.col("source"))
    return rows.where("makes").select("review_id", "mention", "source", "type", "word", "start", "end", F.col("kind").alias("placeholder"), F.col("tone").alias("sentiment"), sure.alias("confidence"), "entity.entity_id")


def _keywords(rows: DataFrame) -> DataFrame:
    """The keywords that relations give for a phrase, once per review, word and group: review_id, at, keyword, bee entity."""
    said = rows.where("of_phrase").select("review_id", "at", "grp", F.col("entity.entity_id").alias("owner"), F.posexplode("keywords").alias("n", "k")).where("trim(k) <> ''")
    return said.groupBy("review_id", F.trim("k").alias("keyword"), "grp").agg(F.min(F.struct("at", "n", "owner")).alias("x")).select("review_id", "keyword", "x.at", "x.n", "x.owner")


def entities(rows: DataFrame) -> DataFrame:
    """(review_id, entity_id, entity_type, value, name, scope, is_placeholder, polarity, phrases, weight): what the mentions of a review mean.

    The first group of mentions of an entity gives its name and polarity; weight counts groups. Keywords and the brand are entities too.
    """
    plain = lambda kind, word: F.struct(hash_id(kind, normalized(word)).alias("entity_id"), F.lit(kind).alias("entity_type"), normalized(word).alias("value"), F.col(word).alias("name"), F.lit(None).cast("string").alias("scope"), F.lit(False).alias("is_placeholder"), F.lit(None).cast("string").alias("polarity"), F.lit(None).cast("string").alias("phrase"))
    heads = rows.where("makes AND at = group_at").select("review_id", F.struct(F.lit(0).alias("step"), "at", F.lit(0).alias("n")).alias("o"), F.lit(1).alias("w"), "entity.*")
    words = _keywords(rows).select("review_id", F.struct(F.lit(1).alias("step"), "at", "n").alias("o"), F.lit(0).alias("w"), plain("KEYWORD", "keyword").alias("e")).select("review_id", "o", "w", "e.*")
    brand = rows.where("source = 'meta'").select("review_id", F.struct(F.lit(2).alias("step"), "at", F.lit(0).alias("n")).alias("o"), F.lit(0).alias("w"), plain("BRD", "word").alias("e")).select("review_id", "o", "w", "e.*")
    cols = ["entity_type", "value", "name", "scope", "is_placeholder", "polarity"]
    one = heads.unionByName(words).unionByName(brand).groupBy("review_id", "entity_id").agg(
        F.min(F.struct("o", *cols)).alias("x"), F.array_sort(F.collect_list(F.when(F.col("phrase").isNotNull(), F.struct("o", "phrase")))).alias("p"), F.greatest(F.sum("w"), F.lit(1)).cast("long").alias("weight"),
    )
    return one.select("review_id", "entity_id", *[F.col(f"x.{c}").alias(c) for c in cols], F.array_distinct(F.transform("p", lambda x: x["phrase"])).alias("phrases"), "weight")


def edges(rows: DataFrame) -> DataFrame:
    """(review_id, edge_id, subject, object, edge, sentiment, weight, confidence, evidence_kind, linked, attribution) from `review_rows`.

    A phrase that no relation names hangs on the review's target, with little confidence and unlinked. Of equal edges the last one gives
    the confidence. Keywords hang on their phrase's attribute, the brand on the target.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def edge(step: int, subject: Column, object_: Column, kind: Column, tone: Column, sure: Column, evidence: Column, linked: Column, attribution: Column, at: str = "at", n: Column | None = None) -> list[Column]:
        told = {"subject": subject, "object": object_, "edge": kind, "sentiment": tone, "o": F.struct(F.lit(step).alias("step"), F.col(at).alias("at"), (n if n is not None else F.lit(0)).alias("n")), "sure": sure, "kind": evidence, "linked": linked, "attribution": attribution}
        return [F.col("review_id"), *[c.alias(k) for k, c in told.items()]]

    own, neutral = F.col("entity.entity_id"), F.lit("NEU")
    told = rows.where("edge IS NOT NULL").select(*edge(0, F.col("subject_entity"), own, F.col("edge"), F.col("edge_tone"), F.col("edge_confidence"), none("string"), F.col("linked"), F.col("attribution")))
    alone = rows.where("makes AND type = 'BEE_ATTR' AND NOT related")
    guessed = alone.select(*edge(1, F.col("target_entity"), own, F.lit("HAS_ATTRIBUTE"), neutral, F.lit(SYNTHETIC), F.lit("BEE_SYNTHETIC"), F.lit(False), F.lit("unlinked")))
    words = _keywords(rows).select(*edge(2, F.col("owner"), hash_id("KEYWORD", normalized("keyword")), F.lit("HAS_KEYWORD"), neutral, none("double"), none("string"), none("boolean"), none("string"), n=F.col("n")))
    brand = rows.where("source = 'meta'").select(*edge(3, F.col("target_entity"), hash_id("BRD", normalized("word")), F.lit("OFFICIAL_BRAND"), neutral, none("double"), none("string"), none("boolean"), none("string")))
    every = told.unionByName(guessed).unionByName(words).unionByName(brand)
    latest = lambda c, when: F.max(F.when(when, F.struct("o", c)))[c]
    one = every.groupBy("review_id", "subject", "edge", "object", "sentiment").agg(
        F.count(F.lit(1)).alias("weight"), latest("sure", F.col("sure").isNotNull()).alias("confidence"), latest("kind", F.col("kind").isNotNull()).alias("evidence_kind"),
        latest("linked", F.col("linked").isNotNull()).alias("linked"), latest("attribution", F.col("linked").isNotNull()).alias("attribution"),
    )
    return one.select("review_id", hash_id(F.col("subject"), F.col("edge"), F.col("object"), F.col("sentiment")).alias("edge_id"), "subject", "object", "edge", "sentiment", "weight", "confidence", "evidence_kind", "linked", "attribution")


def keyword_candidates(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """(review_id, at, surface, grp, context, reason): phrases that give no keyword and that no dictionary resolves. resolved: distinct normalised texts that one does, column `text`."""
    bare = rows.where("of_phrase AND coalesce(size(keywords), 0) < 1 AND length(word) > 1").select("review_id", "at", "word", "grp", F.lit("relation without keywords").alias("reason"))
    alone = rows.where("makes AND type = 'BEE_ATTR' AND NOT related").select("review_id", "at", "word", "grp", F.lit("phrase without relation").alias("reason"))
    out = bare.unionByName(alone).withColumn("text", normalized("word")).where("text <> ''")
    return out.join(resolved.select("text").distinct(), "text", "left_anti").select("review_id", "at", F.substring("text", 1, 30).alias("surface"), "grp", F.col("word").alias("context"), "reason")
