"""Queries over the graph of reviews: every turn of `conversations` is a review, its words are spans, phrases and ends of relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import normalize as N
from tidewright.operators import review_facts as RF
from tidewright.operators import review_graph as G

_WORDS = "SELECT CAST(conv_id * 1000 + turn AS STRING) AS review_id, CAST({position} AS BIGINT) AS i, {word} AS word FROM {conversations}"
_DUCK_WORDS = _WORDS.format(position="generate_subscripts(string_split(text, ' '), 1) - 1", word="unnest(string_split(text, ' '))", conversations="conversations")

#: A turn in three has no known product; every second one names a brand.
_REVIEWS = """
SELECT CAST(conv_id * 1000 + turn AS STRING) AS review_id, CASE WHEN turn % 3 = 2 THEN NULL ELSE 'p' || CAST(conv_id % 50 AS STRING) END AS product_id,
       CASE turn % 2 WHEN 0 THEN 'Brand ' || CAST(conv_id % 7 AS STRING) END AS brand FROM {conversations}
"""
_GRP = "CASE length({w}) % 6 WHEN 0 THEN 'PRD' WHEN 1 THEN 'B-ING' WHEN 2 THEN 'ING' WHEN 3 THEN 'PER' WHEN 4 THEN 'Scent' ELSE 'CAT' END"
_ATTR = "CASE length({w}) % 4 WHEN 0 THEN 'Scent' WHEN 1 THEN 'Feel' WHEN 2 THEN 'T-Feel' ELSE 'Odd' END"
_START = "CASE WHEN {i} % 5 = 0 THEN NULL ELSE {i} * 10 END"
_END = "CASE WHEN {i} % 10 = 0 THEN NULL ELSE {i} * 10 + 7 END"
_TONE = "CASE i % 4 WHEN 0 THEN 'good' WHEN 1 THEN ' bad' WHEN 2 THEN 'mixed' END"
_SPANS = f"SELECT review_id, i AS ord, word, {_GRP.format(w='word')} AS grp, {_START.format(i='i')} AS start, {_END.format(i='i')} AS \"end\", {_TONE} AS sentiment FROM {{words}} WHERE i % 7 IN (0, 3)"
_PHRASES = f"""
SELECT review_id, i AS ord, word, {_ATTR.format(w='word')} AS grp, {_START.format(i='i')} AS start, {_END.format(i='i')} AS "end", {_TONE} AS sentiment,
       CASE i % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS linked, CASE i % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'unlinked' END AS attribution
FROM {{words}} WHERE i % 7 = 2
"""
#: Subject: the span before. Object: the phrase before that, or the span after; some with another group or place than there.
_RELATIONS = f"""
SELECT review_id, i AS ord, s AS subj_word, CASE i % 4 WHEN 0 THEN 'PER' ELSE {_GRP.format(w='s')} END AS subj_grp, CASE WHEN i % 3 = 0 THEN NULL ELSE {_START.format(i='(i - 1)')} END AS subj_start, {_END.format(i='(i - 1)')} AS subj_end,
       o AS obj_word, CASE WHEN i % 2 = 0 THEN {_ATTR.format(w='o')} ELSE {_GRP.format(w='o')} END AS obj_grp,
       CASE WHEN i % 2 = 0 THEN {_START.format(i='(i - 2)')} ELSE {_START.format(i='(i + 3)')} END AS obj_start, CASE WHEN i % 2 = 0 THEN {_END.format(i='(i - 2)')} ELSE {_END.format(i='(i + 3)')} END AS obj_end,
       CASE i % 6 WHEN 0 THEN 'affects' WHEN 1 THEN 'Same_Entity' WHEN 2 THEN 'uses' WHEN 3 THEN 'no_relationship' WHEN 4 THEN 'odd' ELSE 'has_attribute' END AS relation,
       CASE WHEN i % 5 < 2 THEN 'NER-BeE' WHEN i % 5 > 2 THEN 'NER-NER' END AS source_type, {_TONE} AS sentiment,
       CASE i % 3 WHEN 0 THEN {{listed}}(word, ' ', s) WHEN 1 THEN {{listed}}('') END AS keywords
FROM (SELECT review_id, i, word, COALESCE(LAG(word, 1) OVER w, '') AS s, COALESCE(CASE WHEN i % 2 = 0 THEN LAG(word, 2) OVER w ELSE LEAD(word, 3) OVER w END, '') AS o FROM {{words}} WINDOW w AS (PARTITION BY review_id ORDER BY i)) AS t
WHERE i % 7 = 4
"""
_TYPES = [("PRD", False), ("ING", False), ("PER", False), ("CAT", False), ("Scent", True), ("Feel", True)]
_ALIASES = [("B-ING", "ING"), ("T-Feel", "Feel")]
_HELD = [("it", "review_target", "PRD"), ("this", "review_target", "PRD"), ("he", "reviewer", "PER"), ("de", "reviewer", "PER"), ("review target", "review_target", "PRD")]
_CODES = [("affects", "AFFECTS"), ("uses", "USES"), ("has_attribute", "HAS_ATTRIBUTE")]
_TONES = [("good", "POS"), ("bad", "NEG")]


def _values(rows: list[tuple], columns: str) -> str:
    said = lambda v: str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") AS v({columns})"


def _inputs(spark, d):
    talk = spark.read.parquet(f"{d}/conversations.parquet")
    words = talk.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("review_id"), F.posexplode(F.split("text", " ")).alias("i", "word")).withColumn("i", F.col("i").cast("long"))
    ask = lambda sql: spark.sql(sql.replace('"end"', "`end`").replace("{listed}", "array"), **{k: v for k, v in (("words", words), ("conversations", talk)) if "{" + k + "}" in sql})
    return tuple(ask(sql) for sql in (_REVIEWS, _SPANS, _PHRASES, _RELATIONS))


def _rows(spark, d):
    make = spark.createDataFrame
    groups = G.entity_groups(make(_TYPES, "code string, is_bee boolean"), make(_ALIASES, "alias string, code string"))
    return G.review_rows(*_inputs(spark, d), groups, make(_HELD, "word string, kind string, type string"), make(_CODES, "code string, edge string"), make(_TONES, "sentiment string, polarity string"))


def review_mentions(spark, d):
    return G.mentions(_rows(spark, d)).select("review_id", "mention", "source", "type", "word", F.coalesce("start", F.lit(-1)).alias("begins_at"), F.coalesce("end", F.lit(-1)).alias("ends_at"), "placeholder", "sentiment", "confidence", "entity_id")


def review_entities(spark, d):
    return G.entities(_rows(spark, d)).withColumn("phrases", F.array_join("phrases", "|"))


def review_edges(spark, d):
    return G.edges(_rows(spark, d)).withColumn("linked", F.col("linked").cast("string"))


_KNOWN = [("the",), ("of",), ("and",), ("de",), ("la",)]


def review_keyword_candidates(spark, d):
    return G.keyword_candidates(_rows(spark, d), spark.createDataFrame(_KNOWN, "text string"))


# --- facts --------------------------------------------------------------------------------------------------------
_CONCEPTS = [("BEE_ATTR", "BEEAttr"), ("KEYWORD", "Keyword"), ("BRD", "Brand"), ("CAT", "Category"), ("PRD", "Product"), ("PER", "ReviewerProxy"), ("ING", "Ingredient")]
_ATTRIBUTES = [("Scent", "attr_scent"), ("feel", "attr_feel")]
_CONCERNS = [("the", "concern_dry"), ("in", "concern_oily"), ("la", "concern_red"), ("und", "concern_und")]
_GOALS = [("of", "goal_moist"), ("die", "goal_calm"), ("la", "goal_la"), ("to", "goal_to")]
_CONTRACTS = [("affects", "Product|Ingredient|Concern", "Concern|Goal"), ("uses", "ReviewerProxy|Goal", "Product|Category|Goal"), ("has_attribute", "Product|Ingredient|ReviewerProxy", "BEEAttr|Ingredient"), ("HAS_KEYWORD", "BEEAttr", "Keyword")]


def _facts(spark, d):
    rows, make = _rows(spark, d), spark.createDataFrame
    reviews = _inputs(spark, d)[0].select("review_id", F.when(F.col("product_id").isNotNull(), F.concat(F.lit("product:"), "product_id")).alias("product_iri"), F.concat(F.lit("reviewer_proxy:"), "review_id").alias("reviewer_iri"))
    listed = [make(x, "word string, value string") for x in (_ATTRIBUTES, _CONCERNS, _GOALS)]
    iris = RF.entity_iris(G.entities(rows), reviews, make(_CONCEPTS, "entity_type string, concept_type string"), *listed)
    return RF.edge_facts(G.edges(rows), iris, make(_CONTRACTS, "predicate string, subject_types string, object_types string"))


def review_facts(spark, d):
    return _facts(spark, d)[0]


def review_fact_rejects(spark, d):
    return _facts(spark, d)[1].select("review_id", "edge_id", "reason", "subject_type", "object_type")


_PRODUCT_RULES = [
    ("affects", "Product", "Concern", "", "MASTER", "AFFECTS_CONCERN", "identity", "", 0.0, ""), ("affects", "Product", "Goal", "", "MASTER", "HELPS_GOAL", "identity", "", 0.9, "QUARANTINE"),
    ("has_attribute", "Product", "BEEAttr", "", "BEE_ATTR", "HAS_BEE_ATTR", "identity", "", 0.0, ""), ("HAS_KEYWORD", "BEEAttr", "Keyword", "", "BEE_KEYWORD", "HAS_BEE_KEYWORD", "product_linkage", "BEE_DICT", 0.5, "DROP"),
    ("uses", "ReviewerProxy", "Product", "", "CONTEXT", "USED_BY", "reverse", "", 0.0, ""),
]


def review_signals(spark, d):
    """The facts of reviews through the projection rules, up to serving signals."""
    from tidewright.operators import facts as K
    from tidewright.plans.more_queries import rules

    products = _inputs(spark, d)[0].select("review_id", F.concat(F.lit("product:"), "product_id").alias("product_iri"))
    facts = _facts(spark, d)[0].join(products, "review_id")
    made = K.project(facts, spark.createDataFrame(_PRODUCT_RULES, rules(spark).schema))[0]
    return made.select("fact_id", "review_id", "target_product_id", "signal_family", "edge_type", "dst_id", "polarity", "source_confidence")


_SURFACES = [("th", "kw_th"), ("er", "kw_er"), ("tion", "kw_tion"), ("la", "kw_la")]


def review_keyword_facts(spark, d):
    reviews, _, phrases, _ = _inputs(spark, d)
    make = spark.createDataFrame
    rows = phrases.join(reviews, "review_id").select(F.concat_ws("-", "review_id", F.col("ord").cast("string")).alias("phrase_id"), "review_id", F.concat(F.lit("product:"), "product_id").alias("product_iri"), "linked", F.col("word").alias("phrase"), F.col("grp").alias("attr"), "sentiment")
    tone = make([("good", "POS"), ("bad", "NEG")], "sentiment string, polarity string")
    said = N.phrases(rows, make([("Scent", "attr_scent"), ("Feel", "attr_feel")], "attr string, attr_id string"), tone, make([("not", "negator")], "term string, kind string"))
    out = RF.keyword_facts(said, N.keywords(rows, make(_SURFACES, "surface string, keyword_id string")))
    return out.select("fact_id", "review_id", "subject_iri", "object_iri", "polarity", "confidence", "phrase_id")


_ENDINGS = ["ation", "tion", "ing", "ent", "en", "er", "e", "s"]
_CONTRACTED = [("ea", "eau"), ("i", "ie")]
_NEGATING = [("not", "negator"), ("nicht", "negator"), ("un", "negating_start"), ("xyz", "negating_part")]
_STEM_SURFACES = [("Anim", "kw_anim"), ("reau", "kw_reau"), ("thes", "kw_thes"), ("onder", "kw_onder"), ("schie", "kw_schie"), ("ed", "kw_ed")]


def stem_keywords(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("phrase_id"), F.col("text").alias("phrase"))
    make = spark.createDataFrame
    endings, words = make(list(zip(_ENDINGS, range(len(_ENDINGS)), strict=True)), "ending string, ord int"), make(_NEGATING, "term string, kind string")
    return N.stem_keywords(rows, make(_STEM_SURFACES, "surface string, keyword_id string"), endings, _CONTRACTED, words)


_ENTITY_TYPES = [("B-ING", "Ingredient", "Ingredient"), ("ING", "Ingredient", "Ingredient"), ("CAT", "Category", "Category"), ("SCENT", "Color", None)]


def mention_concepts(spark, d):
    _, spans, _, _ = _inputs(spark, d)
    types = spark.createDataFrame(_ENTITY_TYPES, "grp string, entity_type string, concept_type string")
    dated = spans.withColumn("grp", F.when(F.col("grp") == "PER", "date").otherwise(F.col("grp")))
    kind = F.when(F.col("word").rlike("^[aeiou]"), "Frequency").otherwise("TemporalContext")
    return RF.mention_concepts(dated, types, kind).select("review_id", "ord", "entity_type", "concept_id")


# --- the same in SQL ----------------------------------------------------------------------------------------------
def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def _hid(*parts: str) -> str:
    return "substr(sha256(concat_ws('::', " + ", ".join(f"COALESCE({p}, '')" for p in parts) + ")), 1, 32)"


_S = 1 << 40
_INPUT_SQL = "words AS (" + _DUCK_WORDS + "), reviews AS (" + _REVIEWS.format(conversations="conversations") + "), spans AS (" + _SPANS.format(words="words") + "), phrases AS (" + _PHRASES.format(words="words") + "), relations AS (" + _RELATIONS.format(words="words", listed="list_value") + ")"
_ROW_SQL = f"""
WITH RECURSIVE {_INPUT_SQL},
types AS (SELECT * FROM {_values(_TYPES, "code, is_bee")}), aliases AS (SELECT * FROM {_values(_ALIASES, "alias, code")}),
held AS (SELECT * FROM {_values(_HELD, "w, kind, held_type")}), codes AS (SELECT * FROM {_values(_CODES, "relation, edge")}), tones AS (SELECT * FROM {_values(_TONES, "t, polarity")}),
raw AS (
  SELECT review_id, ord AS "at", 'ner' AS source, word, grp, start, "end", sentiment, NULL::BOOLEAN AS linked, NULL AS attribution, NULL::BIGINT AS rel, NULL::BOOLEAN AS is_object, NULL AS relation, NULL AS source_type, NULL::VARCHAR[] AS keywords FROM spans
  UNION ALL SELECT review_id, {_S} + ord, 'bee', word, grp, start, "end", sentiment, linked, attribution, NULL, NULL, NULL, NULL, NULL FROM phrases
  UNION ALL SELECT review_id, {2 * _S}, 'meta', brand, 'BRD', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM reviews WHERE brand <> ''
  UNION ALL SELECT review_id, {3 * _S} + 2 * ord, 'relation', subj_word, subj_grp, subj_start, subj_end, NULL, NULL, NULL, ord, FALSE, relation, source_type, keywords FROM relations
  UNION ALL SELECT review_id, {3 * _S} + 2 * ord + 1, 'relation', obj_word, obj_grp, obj_start, obj_end, sentiment, NULL, NULL, ord, TRUE, relation, source_type, keywords FROM relations
  UNION ALL SELECT review_id, {4 * _S}, 'synthetic', 'Review Target', 'PRD', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM reviews
), typed AS (
  SELECT raw.*, COALESCE(product_id, 'UNKNOWN') AS product_id, kind, COALESCE(own.is_bee, FALSE) AS is_bee, edge AS code,
         CASE WHEN COALESCE(named.is_bee, own.is_bee) THEN 'BEE_ATTR' ELSE COALESCE(named.code, grp) END AS own_type,
         COALESCE(held_type, CASE WHEN COALESCE(named.is_bee, own.is_bee) THEN 'BEE_ATTR' ELSE COALESCE(named.code, grp) END) AS type,
         source IN ('ner', 'bee', 'meta') AS base, source = 'relation' AS is_end, start IS NULL AND "end" IS NULL AS bare, start IS NOT NULL AND "end" IS NOT NULL AS whole,
         CASE WHEN COALESCE(sentiment, '') = '' THEN 'NEU' ELSE COALESCE(polarity, upper(sentiment)) END AS said
  FROM raw JOIN reviews USING (review_id) LEFT JOIN types own ON own.code = grp LEFT JOIN aliases ON alias = grp LEFT JOIN types named ON named.code = aliases.code
  LEFT JOIN held ON w = lower(trim(word)) LEFT JOIN codes ON codes.relation = raw.relation LEFT JOIN tones ON t = trim(sentiment)
), known AS (
  SELECT *, CASE WHEN type = own_type OR NOT whole THEN MIN("at") FILTER (base) OVER k END AS same_key, CASE WHEN whole THEN MIN("at") FILTER (base) OVER p END AS same_place,
         CASE WHEN type = own_type THEN MIN("at") FILTER (base AND bare) OVER n END AS bare_base, MIN("at") FILTER (is_end AND bare) OVER n AS bare_end, MIN("at") FILTER (base) OVER k AS first_key
  FROM typed WINDOW k AS (PARTITION BY review_id, type, word, start, "end"), p AS (PARTITION BY review_id, start, "end"), n AS (PARTITION BY review_id, type, word)
), waiting AS (
  SELECT *, COALESCE(same_key, same_place) AS found, CASE WHEN NOT bare THEN COALESCE(bare_base, CASE WHEN type = own_type AND bare_end < "at" THEN bare_end END) END AS fallback FROM known
), making AS (
  SELECT *, MIN("at") FILTER (is_end AND NOT bare AND found IS NULL AND fallback IS NULL) OVER (PARTITION BY review_id, type, word, start, "end") AS new_key,
         MIN("at") FILTER (is_end AND whole AND found IS NULL AND fallback IS NULL) OVER (PARTITION BY review_id, start, "end") AS new_place FROM waiting
), named AS (
  SELECT *, CASE WHEN base THEN first_key WHEN is_end AND bare THEN COALESCE(found, bare_end) WHEN is_end THEN COALESCE(found, CASE WHEN CASE WHEN whole THEN new_place ELSE new_key END <= "at" THEN CASE WHEN whole THEN new_place ELSE new_key END END, fallback) ELSE "at" END AS mention FROM making
), flagged AS (
  SELECT * EXCLUDE (linked, attribution), "at" = mention AS makes, linked AS own_linked, attribution AS own_attribution, COALESCE(is_object, FALSE) AND COALESCE(lower(relation) NOT IN ('same_entity', 'no_relationship'), TRUE) AS kept FROM named
), nerbee AS (SELECT *, kept AND (COALESCE(source_type, '') = 'NER-BeE' OR is_bee) AS of_phrase FROM flagged
), toned AS (
  SELECT *, COALESCE(arg_max(said, "at") FILTER (of_phrase AND COALESCE(sentiment, '') <> '') OVER m, MAX(said) FILTER (makes AND type = 'BEE_ATTR' AND COALESCE(sentiment, '') <> '') OVER m) AS tone,
         arg_max(own_linked, "at") FILTER (source = 'bee' AND own_linked IS NOT NULL) OVER m AS linked, arg_max(own_attribution, "at") FILTER (source = 'bee' AND own_linked IS NOT NULL) OVER m AS attribution,
         bool_or(of_phrase) OVER m AS related, MAX(mention) FILTER (NOT COALESCE(is_object, FALSE)) OVER (PARTITION BY review_id, rel) AS subject,
         MIN("at") FILTER (makes AND source <> 'synthetic' AND kind = 'review_target') OVER (PARTITION BY review_id) AS first_target
  FROM nerbee WINDOW m AS (PARTITION BY review_id, mention)
), live AS (SELECT * FROM toned WHERE source <> 'synthetic' OR first_target IS NULL
), pairs AS (SELECT review_id, subject AS a, mention AS b FROM live WHERE is_object AND lower(relation) = 'same_entity'
), links AS (SELECT review_id, a, b FROM pairs UNION SELECT review_id, b, a FROM pairs
), reach AS (SELECT review_id, a AS node, a AS root FROM links UNION SELECT r.review_id, l.b, r.root FROM reach r JOIN links l ON l.review_id = r.review_id AND l.a = r.node
), roots AS (SELECT review_id, node, MIN(root) AS root FROM reach GROUP BY ALL
), rooted AS (SELECT live.*, COALESCE(roots.root, mention) AS root FROM live LEFT JOIN roots ON roots.review_id = live.review_id AND node = mention
), counted AS (SELECT *, COUNT(*) FILTER (makes) OVER (PARTITION BY review_id, root, word) AS often, MIN("at") FILTER (makes) OVER (PARTITION BY review_id, root) AS group_at FROM rooted
), heads AS (
  SELECT review_id, root, "at" AS chosen, kind IS NOT NULL AS is_placeholder, CASE WHEN kind IS NULL AND is_bee THEN 'BEE_ATTR' ELSE type END AS entity_type,
         CASE WHEN kind IS NOT NULL THEN kind WHEN is_bee THEN grp ELSE {_norm("word")} END AS value, CASE WHEN kind IS NOT NULL THEN kind WHEN is_bee THEN grp ELSE word END AS name,
         CASE WHEN kind IS NOT NULL THEN product_id END AS scope, CASE WHEN kind IS NULL AND is_bee THEN tone END AS polarity, CASE WHEN kind IS NULL AND is_bee THEN word END AS phrase,
         CASE WHEN kind IS NOT NULL THEN {_hid("type", "kind", "product_id")} WHEN is_bee THEN {_hid("'BEE_ATTR'", _norm("grp"))} ELSE {_hid("type", _norm("word"))} END AS entity_id
  FROM counted WHERE makes
  QUALIFY ROW_NUMBER() OVER (PARTITION BY review_id, root ORDER BY CASE kind WHEN 'review_target' THEN 1 WHEN 'reviewer' THEN 2 ELSE 99 END, CASE WHEN kind IS NULL THEN -often ELSE 0 END, "at") = 1
), graph AS (
  SELECT c.*, h.* EXCLUDE (review_id, root), MAX(h.entity_id) FILTER (NOT COALESCE(is_object, FALSE)) OVER (PARTITION BY c.review_id, rel) AS subject_entity,
         MAX(h.entity_id) FILTER (makes AND ("at" = first_target OR source = 'synthetic')) OVER (PARTITION BY c.review_id) AS target_entity,
         CASE WHEN of_phrase THEN 'HAS_ATTRIBUTE' WHEN kept THEN code END AS edge, CASE WHEN of_phrase THEN 'NEU' WHEN kept THEN said END AS edge_tone, CASE WHEN source_type = 'NER-BeE' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS edge_confidence
  FROM counted c JOIN heads h ON h.review_id = c.review_id AND h.root = c.root
), spoken AS (SELECT review_id, "at", grp, entity_id AS owner, unnest(keywords) AS k, generate_subscripts(keywords, 1) - 1 AS n FROM graph WHERE of_phrase
), keywords AS (SELECT review_id, trim(k) AS keyword, "at", n, owner FROM spoken WHERE trim(k) <> '' QUALIFY ROW_NUMBER() OVER (PARTITION BY review_id, trim(k), grp ORDER BY "at", n, owner) = 1
), candidate_entities AS (
  SELECT review_id, 0 AS step, "at", 0 AS n, 1 AS w, entity_id, entity_type, value, name, scope, is_placeholder, polarity, phrase FROM graph WHERE makes AND "at" = group_at
  UNION ALL SELECT review_id, 1, "at", n, 0, {_hid("'KEYWORD'", _norm("keyword"))}, 'KEYWORD', {_norm("keyword")}, keyword, NULL, FALSE, NULL, NULL FROM keywords
  UNION ALL SELECT review_id, 2, "at", 0, 0, {_hid("'BRD'", _norm("word"))}, 'BRD', {_norm("word")}, word, NULL, FALSE, NULL, NULL FROM graph WHERE source = 'meta'
), first_phrases AS (SELECT review_id, entity_id, phrase, MIN((step, "at", n)) AS o FROM candidate_entities WHERE phrase IS NOT NULL GROUP BY ALL
), said_phrases AS (SELECT review_id, entity_id, string_agg(phrase, '|' ORDER BY o) AS phrases FROM first_phrases GROUP BY ALL
), entities AS (
  SELECT c.review_id, c.entity_id, c.entity_type, c.value, c.name, c.scope, c.is_placeholder, c.polarity, COALESCE(phrases, '') AS phrases, CAST(GREATEST(weight, 1) AS BIGINT) AS weight
  FROM (SELECT *, SUM(w) OVER (PARTITION BY review_id, entity_id) AS weight FROM candidate_entities QUALIFY ROW_NUMBER() OVER (PARTITION BY review_id, entity_id ORDER BY step, "at", n) = 1) c LEFT JOIN said_phrases USING (review_id, entity_id)
), every_edge AS (
  SELECT review_id, subject_entity AS subject, entity_id AS object, edge, edge_tone AS sentiment, (0, "at", 0) AS o, edge_confidence AS sure, NULL AS evidence, linked, attribution FROM graph WHERE edge IS NOT NULL
  UNION ALL SELECT review_id, target_entity, entity_id, 'HAS_ATTRIBUTE', 'NEU', (1, "at", 0), 0.4, 'BEE_SYNTHETIC', FALSE, 'unlinked' FROM graph WHERE makes AND type = 'BEE_ATTR' AND NOT related
  UNION ALL SELECT review_id, owner, {_hid("'KEYWORD'", _norm("keyword"))}, 'HAS_KEYWORD', 'NEU', (2, "at", n), NULL, NULL, NULL, NULL FROM keywords
  UNION ALL SELECT review_id, target_entity, {_hid("'BRD'", _norm("word"))}, 'OFFICIAL_BRAND', 'NEU', (3, "at", 0), NULL, NULL, NULL, NULL FROM graph WHERE source = 'meta'
), edges AS (
  SELECT review_id, {_hid("subject", "edge", "object", "sentiment")} AS edge_id, subject, object, edge, sentiment, COUNT(*) AS weight, arg_max(sure, o) FILTER (sure IS NOT NULL) AS confidence, arg_max(evidence, o) FILTER (evidence IS NOT NULL) AS evidence_kind,
         arg_max(linked, o) FILTER (linked IS NOT NULL) AS linked, arg_max(attribution, o) FILTER (linked IS NOT NULL) AS attribution
  FROM every_edge GROUP BY review_id, subject, object, edge, sentiment
)
"""
_MENTIONS_SQL = _ROW_SQL + """
SELECT review_id, mention, source, type, word, COALESCE(start, -1) AS begins_at, COALESCE("end", -1) AS ends_at, kind AS placeholder, tone AS sentiment,
       CASE source WHEN 'bee' THEN 0.9 WHEN 'relation' THEN 0.8 WHEN 'synthetic' THEN 0.4 ELSE 1.0 END AS confidence, entity_id FROM graph WHERE makes
"""
_CANDIDATES_SQL = _ROW_SQL + f"""
SELECT review_id, "at", substr({_norm("word")}, 1, 30) AS surface, grp, word AS context, reason FROM (
  SELECT review_id, "at", word, grp, 'relation without keywords' AS reason FROM graph WHERE of_phrase AND COALESCE(len(keywords), 0) < 1 AND length(word) > 1
  UNION ALL SELECT review_id, "at", word, grp, 'phrase without relation' FROM graph WHERE makes AND type = 'BEE_ATTR' AND NOT related)
WHERE {_norm("word")} <> '' AND {_norm("word")} NOT IN ('the', 'of', 'and', 'de', 'la')
"""


def _put_right(side: str) -> str:
    wrong = f"NOT list_contains({side[0]}t, {side}_kind)"
    return f"CASE WHEN {wrong} AND list_contains({side[0]}t, 'Concern') AND {side}_concern IS NOT NULL THEN 'Concern' WHEN {wrong} AND list_contains({side[0]}t, 'Goal') AND {side}_goal IS NOT NULL THEN 'Goal' END AS {side}_new"


_FACT_SQL = _ROW_SQL.rstrip() + f""",
concepts AS (SELECT * FROM {_values(_CONCEPTS, "entity_type, concept")}), attributes AS (SELECT * FROM {_values(_ATTRIBUTES, "word, v")}), concerns AS (SELECT * FROM {_values(_CONCERNS, "word, v")}),
goals AS (SELECT * FROM {_values(_GOALS, "word, v")}), contracts AS (SELECT predicate, string_split(s, '|') AS st, string_split(o, '|') AS ot FROM {_values(_CONTRACTS, "predicate, s, o")}),
iris AS (
  SELECT e.review_id, entity_id, e.entity_type, COALESCE(concept, e.entity_type) AS kind, polarity, COALESCE(c1.v, c2.v) AS concern, COALESCE(g1.v, g2.v) AS goal,
         CASE WHEN is_placeholder AND value = 'review_target' AND product_id IS NOT NULL THEN 'product:' || product_id WHEN is_placeholder AND value = 'reviewer' THEN 'reviewer_proxy:' || e.review_id
              WHEN is_placeholder THEN 'placeholder:' || value || ':' || COALESCE(scope, '') WHEN e.entity_type = 'BEE_ATTR' THEN 'concept:' || COALESCE(concept, e.entity_type) || ':' || COALESCE(a1.v, a2.v, {_norm("name")})
              ELSE 'concept:' || COALESCE(concept, e.entity_type) || ':' || value END AS iri
  FROM entities e JOIN reviews USING (review_id) LEFT JOIN concepts ON concepts.entity_type = e.entity_type LEFT JOIN attributes a1 ON a1.word = name LEFT JOIN attributes a2 ON a2.word = {_norm("name")}
  LEFT JOIN concerns c1 ON c1.word = name LEFT JOIN concerns c2 ON c2.word = {_norm("name")} LEFT JOIN goals g1 ON g1.word = name LEFT JOIN goals g2 ON g2.word = {_norm("name")}
), ends AS (
  SELECT e.*, CASE WHEN edge = 'HAS_KEYWORD' THEN edge ELSE lower(edge) END AS predicate, st, ot, s.entity_type IN ('BEE_ATTR', 'KEYWORD') OR o.entity_type IN ('BEE_ATTR', 'KEYWORD') AS of_words,
         edge = 'HAS_KEYWORD' AND s.entity_type = 'BEE_ATTR' AND o.entity_type = 'KEYWORD' AND COALESCE(evidence_kind NOT IN ('AUTO_KEYWORD', 'BEE_SYNTHETIC'), TRUE) AS backed,
         s.kind AS subject_kind, s.iri AS subject_own, s.concern AS subject_concern, s.goal AS subject_goal, o.kind AS object_kind, o.iri AS object_own, o.concern AS object_concern, o.goal AS object_goal,
         COALESCE(o.polarity, s.polarity, CASE WHEN e.sentiment NOT IN ('', 'NEU') THEN e.sentiment END) AS polarity
  FROM edges e JOIN iris s ON s.review_id = e.review_id AND s.entity_id = subject JOIN iris o ON o.review_id = e.review_id AND o.entity_id = object LEFT JOIN contracts ON contracts.predicate = CASE WHEN edge = 'HAS_KEYWORD' THEN edge ELSE lower(edge) END
  WHERE edge <> 'OFFICIAL_BRAND' AND COALESCE(confidence, 1) >= 0.2
), rescued AS (SELECT *, {_put_right("subject")}, {_put_right("object")} FROM ends
), told AS (
  SELECT *, CASE subject_new WHEN 'Concern' THEN 'concept:Concern:' || subject_concern WHEN 'Goal' THEN 'concept:Goal:' || subject_goal ELSE subject_own END AS subject_iri,
         CASE object_new WHEN 'Concern' THEN 'concept:Concern:' || object_concern WHEN 'Goal' THEN 'concept:Goal:' || object_goal ELSE object_own END AS object_iri,
         COALESCE(subject_new, subject_kind) AS subject_type, COALESCE(object_new, object_kind) AS object_type, CASE WHEN subject_new IS NOT NULL THEN subject_kind END AS subject_was, CASE WHEN object_new IS NOT NULL THEN object_kind END AS object_was FROM rescued
), all_facts AS (
  SELECT 'fact:' || md5(concat_ws('|', review_id, subject_iri, predicate, object_iri, COALESCE(polarity, ''), CASE WHEN subject_was IS NULL AND object_was IS NULL THEN ''
           ELSE md5(concat_ws('|', 'type_resolved_from_object:' || object_was, 'type_resolved_from_subject:' || subject_was)) END)) AS fact_id,
         review_id, edge_id, subject_iri, predicate, object_iri, subject_type, object_type, polarity, COALESCE(confidence, CASE WHEN backed THEN 0.8 END) AS confidence, CASE WHEN of_words THEN 'BEE' ELSE 'REL' END AS source_modality,
         CASE WHEN backed THEN 'BEE_DICT' ELSE evidence_kind END AS evidence_kind, CASE WHEN (of_words AND NOT linked) OR evidence_kind = 'BEE_SYNTHETIC' THEN 'EVIDENCE_ONLY' ELSE 'CANONICAL_PROMOTED' END AS fact_status, subject_was, object_was,
         CASE WHEN st IS NULL THEN 'unknown predicate' WHEN NOT list_contains(st, subject_type) THEN 'subject type' WHEN NOT list_contains(ot, object_type) THEN 'object type' END AS reason FROM told
), facts AS (SELECT * EXCLUDE (reason) FROM all_facts WHERE reason IS NULL)
"""
_SIGNAL_SQL = _FACT_SQL + """
SELECT fact_id, review_id, CASE WHEN predicate = 'uses' THEN object_iri WHEN predicate = 'HAS_KEYWORD' THEN CASE WHEN NOT unknown THEN 'product:p' || known END ELSE subject_iri END AS target_product_id,
       CASE predicate WHEN 'affects' THEN 'MASTER' WHEN 'has_attribute' THEN 'BEE_ATTR' WHEN 'HAS_KEYWORD' THEN 'BEE_KEYWORD' ELSE 'CONTEXT' END AS signal_family,
       CASE WHEN predicate = 'has_attribute' THEN 'HAS_BEE_ATTR' WHEN predicate = 'HAS_KEYWORD' THEN 'HAS_BEE_KEYWORD' WHEN predicate = 'uses' THEN 'USED_BY' WHEN object_type = 'Concern' THEN 'AFFECTS_CONCERN' ELSE 'HELPS_GOAL' END AS edge_type,
       CASE WHEN predicate = 'uses' THEN subject_iri ELSE object_iri END AS dst_id, polarity, confidence AS source_confidence
FROM (SELECT *, CAST(CAST(review_id AS BIGINT) // 1000 % 50 AS VARCHAR) AS known, CAST(review_id AS BIGINT) % 1000 % 3 = 2 AS unknown FROM facts) t
WHERE fact_status <> 'EVIDENCE_ONLY' AND ((predicate = 'affects' AND subject_type = 'Product' AND (object_type = 'Concern' OR (object_type = 'Goal' AND confidence >= 0.9))) OR (predicate = 'has_attribute' AND subject_type = 'Product' AND object_type = 'BEEAttr')
  OR (predicate = 'HAS_KEYWORD' AND evidence_kind = 'BEE_DICT' AND confidence >= 0.5) OR (predicate = 'uses' AND subject_type = 'ReviewerProxy' AND object_type = 'Product'))
"""
_KEYWORD_FACT_SQL = f"""
WITH {_INPUT_SQL}, surfaces AS (SELECT * FROM {_values(_SURFACES, "surface, keyword_id")}), said AS (
  SELECT review_id || '-' || CAST(ord AS VARCHAR) AS phrase_id, review_id, {_norm("word")} AS t, CASE grp WHEN 'Scent' THEN 'attr_scent' WHEN 'Feel' THEN 'attr_feel' ELSE 'bee_attr_' || {_norm("grp")} END AS attr_id, CASE WHEN grp IN ('Scent', 'Feel') THEN 1.0 ELSE 0.7 END AS sure,
         CASE trim(sentiment) WHEN 'good' THEN 'POS' WHEN 'bad' THEN 'NEG' ELSE sentiment END AS tone, len(list_filter(string_split({_norm("word")}, ' '), lambda x: x = 'not')) % 2 = 1 AS odd
  FROM phrases JOIN reviews USING (review_id) WHERE product_id IS NOT NULL AND COALESCE(linked, TRUE)
), met AS (
  SELECT *, 'concept:BEEAttr:' || attr_id AS subject_iri, 'concept:Keyword:' || keyword_id AS object_iri, CASE WHEN odd AND tone = 'POS' THEN 'NEG' WHEN odd AND tone = 'NEG' THEN 'POS' ELSE tone END AS polarity FROM said JOIN surfaces ON contains(t, surface)
)
SELECT 'fact:' || md5(concat_ws('|', review_id, subject_iri, 'HAS_KEYWORD', object_iri, COALESCE(polarity, ''), '')) AS fact_id, review_id, subject_iri, object_iri, polarity, MAX(sure)::DOUBLE AS confidence, MIN(phrase_id) AS phrase_id FROM met GROUP BY ALL
"""
_STEM_SQL = f"""
WITH t AS (SELECT conv_id * 1000 + turn AS phrase_id, {_norm("text")} AS text FROM conversations), w AS (SELECT phrase_id, text, unnest(string_split(text, ' ')) AS token FROM t),
bad AS (SELECT DISTINCT phrase_id FROM w WHERE token IN ('not', 'nicht') OR starts_with(token, 'un') OR contains(text, 'xyz')), said AS (SELECT DISTINCT phrase_id, token FROM w WHERE phrase_id NOT IN (SELECT phrase_id FROM bad)),
endings AS (SELECT * FROM (VALUES {", ".join(f"('{e}', {k})" for k, e in enumerate(_ENDINGS))}) AS v(ending, ord)),
cut AS (SELECT token, substr(token, 1, length(token) - length(ending)) AS stem FROM (SELECT DISTINCT token FROM said) s JOIN endings ON ends_with(token, ending) AND length(token) - length(ending) >= 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY token ORDER BY ord) = 1),
known AS (SELECT * FROM cut UNION SELECT token, substr(stem, 1, length(stem) - length(tail)) || becomes FROM (SELECT * FROM cut UNION SELECT DISTINCT token, token FROM said WHERE length(token) >= 3) x JOIN (VALUES {", ".join(map(str, _CONTRACTED))}) AS c(tail, becomes) ON ends_with(stem, tail)),
surfaces AS (SELECT lower(surface) AS surface, keyword_id FROM {_values(_STEM_SURFACES, "surface, keyword_id")})
SELECT DISTINCT phrase_id, keyword_id FROM said JOIN known USING (token) JOIN surfaces ON contains(stem, surface) OR contains(surface, stem) WHERE length(stem) >= 2
"""
_CONCEPT_SQL = f"""
WITH {_INPUT_SQL}, dated AS (SELECT review_id, ord, {_norm("word")} AS t, word, CASE grp WHEN 'PER' THEN 'DATE' ELSE upper(grp) END AS g FROM spans),
kinds AS (SELECT *, CASE WHEN regexp_matches(word, '^[aeiou]') THEN 'Frequency' ELSE 'TemporalContext' END AS d, CASE WHEN g IN ('B-ING', 'ING') THEN 'Ingredient' WHEN g = 'CAT' THEN 'Category' END AS c FROM dated)
SELECT review_id, ord, CASE WHEN g = 'DATE' THEN d WHEN g = 'SCENT' THEN 'Color' ELSE COALESCE(c, g) END AS entity_type,
       CASE WHEN g = 'DATE' THEN 'concept:' || d || ':' || t WHEN c IS NOT NULL THEN 'concept:' || c || ':' || t ELSE 'mention:' || review_id || ':' || CAST(ord AS VARCHAR) END AS concept_id FROM kinds
"""

QUERIES = {
    "review_mentions": (review_mentions, _MENTIONS_SQL),
    "review_entities": (review_entities, _ROW_SQL + "SELECT * FROM entities"),
    "review_edges": (review_edges, _ROW_SQL + "SELECT * REPLACE (CAST(linked AS VARCHAR) AS linked) FROM edges"),
    "review_keyword_candidates": (review_keyword_candidates, _CANDIDATES_SQL),
    "review_facts": (review_facts, _FACT_SQL + "SELECT * FROM facts"),
    "review_fact_rejects": (review_fact_rejects, _FACT_SQL + "SELECT review_id, edge_id, reason, subject_type, object_type FROM all_facts WHERE reason IS NOT NULL"),
    "review_signals": (review_signals, _SIGNAL_SQL),
    "review_keyword_facts": (review_keyword_facts, _KEYWORD_FACT_SQL),
    "stem_keywords": (stem_keywords, _STEM_SQL),
    "mention_concepts": (mention_concepts, _CONCEPT_SQL),
}
