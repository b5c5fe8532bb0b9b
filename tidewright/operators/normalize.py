"""Normalisation of mentions, phrases, relations and categories against dictionaries given as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import ladder, normalized
from tidewright.operators.search import contained

def _listed(dictionary: DataFrame, kind: str) -> list[str]:
    """Terms of one kind of a configured table (term, kind); its rows are few."""
    return sorted(r["term"] for r in dictionary.filter(F.col("kind") == kind).select("term").distinct().collect())


def negations(tokens: Column, words: list[str], starts: list[str]) -> Column:
    """How many tokens negate: those that are one of the words or begin with one of the starts."""
    begins = lambda t: F.exists(F.array(*map(F.lit, starts)).cast("array<string>"), lambda s: t.startswith(s))
    return F.size(F.filter(tokens, lambda t: t.isin(words) | begins(t)))


def phrases(rows: DataFrame, attributes: DataFrame, sentiments: DataFrame, words: DataFrame) -> DataFrame:
    """Adds attr_id, polarity, negated, intensity and confidence to rows of (phrase, attr, sentiment).

    attributes: (attr, attr_id); sentiments: (sentiment, polarity), both small dictionaries whose size Spark checks before it
    broadcasts them. words: (term, kind), a configured table of the kinds negator, negating_start, weak and strong. An odd number of
    negating words turns POS and NEG round. Unknown attributes get an id of their text and 0.7.
    """
    tokens, weak, strong = F.split(normalized("phrase"), " "), _listed(words, "weak"), _listed(words, "strong")
    odd = negations(tokens, _listed(words, "negator"), _listed(words, "negating_start")) % 2 == 1
    out = rows.join(attributes, "attr", "left").withColumn("_s", F.lower(F.trim("sentiment"))).join(sentiments.select(F.col("sentiment").alias("_s"), F.col("polarity").alias("_p")), "_s", "left")
    raw = F.coalesce("_p", F.nullif("sentiment", F.lit("")))
    turned = F.when(odd & (raw == "NEG"), "POS").when(odd & (raw == "POS"), "NEG").otherwise(raw)
    degree = F.filter(tokens, lambda t: t.isin(weak + strong))
    return out.withColumns({
        "negated": odd, "polarity": turned, "confidence": F.when(F.col("attr_id").isNull(), 0.7).otherwise(1.0),
        "intensity": F.when(F.size(degree) == 0, 1.0).when(F.get(degree, F.lit(0)).isin(weak), 0.4).otherwise(1.5),
        "attr_id": F.coalesce("attr_id", F.concat(F.lit("bee_attr_"), normalized("attr"))),
    }).drop("_s", "_p")


def keywords(rows: DataFrame, dictionary: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(phrase_id, keyword_id): dictionary surfaces inside a phrase; once each after aliases. dictionary: (surface, keyword_id). Each distinct phrase is looked at once."""
    own = rows.select("phrase_id", normalized("phrase").alias("text"))
    met = contained(own.select("text").distinct(), dictionary.select(F.col("surface").alias("word")).distinct())
    met = own.join(met, "text").join(dictionary.withColumnRenamed("surface", "word"), "word").select("phrase_id", "keyword_id")
    if aliases is not None:
        met = met.join(aliases, F.col("keyword_id") == F.col("alias"), "left").select("phrase_id", F.coalesce("canonical", "keyword_id").alias("keyword_id"))
    return met.distinct()


def stems(tokens: DataFrame, endings: DataFrame, contractions: list[tuple[str, str]], shortest: int = 2) -> DataFrame:
    """(token, stem): what is left of a token without its first ending, as it is and with its contracted tail written out; the whole token written out too.

    tokens: token, distinct; endings: (ending, ord), a configured table that a token's ends are looked up in; contractions: (tail, what it stands for).
    Stems under `shortest` letters are none.
    """
    ends = tokens.where("token <> ''").select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("_from"))
    tail = ends.select("token", F.expr("substring(token, _from)").alias("ending"))
    kept = tail.join(endings, "ending").where(F.length("token") - F.length("ending") >= shortest)
    first = kept.groupBy("token").agg(F.min_by("ending", "ord").alias("ending"))
    bare = first.select("token", F.expr("substring(token, 1, length(token) - length(ending))").alias("stem"), F.lit(shortest).alias("least")).unionByName(tokens.select("token", F.col("token").alias("stem"), F.lit(shortest + 1).alias("least")))
    full = lambda end, becomes: F.when(F.endswith("stem", F.lit(end)) & (F.length("stem") >= F.col("least")), F.concat(F.expr(f"substring(stem, 1, length(stem) - {len(end)})"), F.lit(becomes)))
    forms = F.array(F.when(F.col("least") == shortest, F.col("stem")), *[full(*c) for c in contractions])
    return bare.select("token", F.explode(forms).alias("stem")).where((F.length("stem") >= shortest)).distinct()


def stem_keywords(rows: DataFrame, dictionary: DataFrame, endings: DataFrame, contractions: list[tuple[str, str]], words: DataFrame, shortest: int = 2) -> DataFrame:
    """(phrase_id, keyword_id): surfaces that hold a stem of one of the phrase's words or stand inside it; none for a phrase that negates.

    words: (term, kind) with the kinds negator (a whole word), negating_start and negating_part (anywhere). Tokens, stems and surfaces are looked at once
    each; both directions are equi-joins.
    """
    own, parts = rows.select("phrase_id", normalized("phrase").alias("text")), _listed(words, "negating_part")
    tokens = F.split("text", " ")
    no = negations(tokens, _listed(words, "negator"), _listed(words, "negating_start")) > 0
    for part in parts:
        no = no | F.contains("text", F.lit(part))
    said = own.where(~no).select("phrase_id", F.explode(F.array_distinct(tokens)).alias("token"))
    known = stems(said.select("token").distinct(), endings, contractions, shortest)
    stem, surface = known.select("stem").distinct(), dictionary.select(normalized("surface").alias("_s")).where("_s <> ''").distinct()
    inside = contained(stem.withColumnRenamed("stem", "text"), surface.withColumnRenamed("_s", "word")).select(F.col("text").alias("stem"), F.col("word").alias("_s"))
    around = contained(surface.withColumnRenamed("_s", "text"), stem.withColumnRenamed("stem", "word")).select(F.col("word").alias("stem"), F.col("text").alias("_s"))
    met = inside.unionByName(around).distinct().join(dictionary.select(normalized("surface").alias("_s"), "keyword_id"), "_s").select("stem", "keyword_id")
    return said.join(known, "token").join(met, "stem").select("phrase_id", "keyword_id").distinct()


def flat_aliases(aliases: DataFrame, most_steps: int = 32) -> DataFrame:
    """(alias, canonical) with chains followed to their end. Raises on a cycle. A configured table: its rows are few."""
    table = {r["alias"]: r["canonical"] for r in aliases.select("alias", "canonical").collect()}
    out = []
    for alias in table:
        end, steps = table[alias], 0
        while end in table:
            end, steps = table[end], steps + 1
            if steps > most_steps:
                raise ValueError(f"aliases run in a circle at {alias}")
        out.append((alias, end))
    return aliases.sparkSession.createDataFrame(out, "alias string, canonical string")


def dates(text: Column, patterns: DataFrame) -> Column:
    """(kind, value, context) of a date mention. patterns: (role, name, pattern, ord), a configured table: the patterns of the role
    kind are tried in order, and what none of them fits has a context, by those of the role context."""
    rows = patterns.orderBy("ord").collect()
    tried = lambda role: [(r["name"], r["pattern"]) for r in rows if r["role"] == role]
    value = normalized(text)
    kind = ladder(text, tried("kind"), "TemporalContext")
    return F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "TemporalContext", ladder(value, tried("context"), "general")).alias("context"))


def relations(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds predicate and action. mapping: (relation, predicate, action); what it lacks is quarantined."""
    m = mapping.select(F.lower(F.trim("relation")).alias("_r"), "predicate", "action")
    return rows.withColumn("_r", F.lower(F.trim("relation"))).join(m, "_r", "left").withColumn("action", F.coalesce("action", F.lit("QUARANTINE"))).drop("_r")


def derived(rows: DataFrame, dictionary: DataFrame, suffixes: list[tuple[str, str]]) -> DataFrame:
    """Adds concept and how it was found: exact word, else the first pattern, else quarantine. dictionary: (word, concept)."""
    d = dictionary.select(F.col("word").alias("_w"), "concept")
    out = rows.withColumn("_w", normalized("object_text")).join(d, "_w", "left")
    guess = ladder(F.col("_w"), suffixes)
    how = F.when(F.col("concept").isNotNull(), "exact").when(guess.isNotNull(), "pattern").otherwise("quarantine")
    return out.withColumns({"how": how, "concept": F.coalesce("concept", guess)}).drop("_w")


def category_groups(products: DataFrame, columns: list[str], groups: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """Adds grp, the first group whose pattern the joined columns hold."""
    return products.withColumn("grp", ladder(normalized(F.concat_ws(" ", *columns)), groups, other))


def concept_ids(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Adds concept_id: prefix off, then the alias if there is one. aliases: (alias, canonical)."""
    key = F.regexp_replace(normalized(column), r"^concept:[^:]*:", "")
    return rows.withColumn("_k", key).join(aliases.select(F.col("alias").alias("_k"), "canonical"), "_k", "left").withColumn("concept_id", F.coalesce("canonical", "_k")).drop("_k", "canonical")


def user_facts(profiles: DataFrame, paths: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """(user_id, edge_type, dst_id, scope, source) from arrays of nested profiles, in one pass. paths: (column path, edge, scope, source)."""
    def facts(path: str, edge: str, scope: str | None, source: str) -> Column:
        told = lambda v: F.struct(F.lit(edge).alias("edge_type"), normalized(v).alias("dst_id"), F.lit(scope).cast("string").alias("scope"), F.lit(source).alias("source"))
        return F.transform(F.coalesce(F.col(path), F.array()), told)

    items = [facts(*path) for path in paths]
    return profiles.select("user_id", F.explode(F.concat(*items)).alias("x")).select("user_id", "x.*").filter("dst_id <> ''")


def bee_facts(rows: DataFrame) -> DataFrame:
    """A product-attribute fact for each phrase and an attribute-keyword fact for each of its keywords. rows: product_iri, attr_id, keyword_ids, polarity, review_id."""
    one = F.struct(F.col("product_iri").alias("subject"), F.lit("HAS_ATTRIBUTE").alias("predicate"), F.concat(F.lit("concept:BEEAttr:"), "attr_id").alias("object"))
    more = F.transform(F.coalesce("keyword_ids", F.array()), lambda k: F.struct(F.concat(F.lit("concept:BEEAttr:"), F.col("attr_id")).alias("subject"), F.lit("HAS_KEYWORD").alias("predicate"), F.concat(F.lit("concept:Keyword:"), k).alias("object")))
    return rows.select("review_id", "polarity", F.explode(F.concat(F.array(one), more)).alias("f")).select("review_id", "polarity", "f.*").distinct()


def unused_terms(defined: DataFrame, used: DataFrame) -> DataFrame:
    """Terms that are defined and never made."""
    return defined.distinct().join(used.distinct(), defined.columns, "left_anti")


def first_in_order(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
