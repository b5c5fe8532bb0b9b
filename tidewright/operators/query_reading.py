"""What the texts of a table of queries ask for and rule out, and the products that answer them.

Names are looked up by equi-joins on letters, so no step compares every query with every name. Texts that are null or empty give no
rows; rows with a null id are ignored; repeated rows count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import normalized
from tidewright.operators.profiles import top_n
from tidewright.operators.search import contained, resolve
from tidewright.sources.scratch import saved

_LETTERS = 16  # names of one catalog often begin alike
_AFTER, _BEFORE = "\u0001", "\u0002"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


@dataclass(frozen=True)
class Catalog:
    """products: product_id, name, brand, category, group (all but the id may be null); ingredients: product_id, ingredient;
    ingredient_words: surface, ingredient; group_words: surface, group, whole (whether the word is the name of the whole group)."""

    products: DataFrame
    ingredients: DataFrame
    ingredient_words: DataFrame
    group_words: DataFrame

    def axis(self, column: str) -> DataFrame:
        """The distinct normalised values of a column of products, as `surface`."""
        return self.products.select(normalized(column).alias("surface")).where("length(surface) > 1").distinct()

    @cached_property
    def held(self) -> DataFrame:
        """The distinct ingredients of products, found once."""
        return saved(self.ingredients.select("ingredient").distinct())

    def words(self) -> DataFrame:
        """(axis, key, surface): everything a query can name."""
        return self._words

    @cached_property
    def _words(self) -> DataFrame:
        plain = [self.axis(c).select(F.lit(a).alias("axis"), F.col("surface").alias("key"), "surface") for a, c in (("product", "name"), ("brand", "brand"), ("category", "category"))]
        known = self.ingredient_words.join(self.held, "ingredient", "left_semi")
        plain.append(self.group_words.select(F.lit("group"), F.col("group"), normalized("surface")))
        plain.append(known.select(F.lit("ingredient"), F.col("ingredient"), normalized("surface")))
        out = plain[0]
        for x in plain[1:]:
            out = out.union(x)
        return saved(out.where("length(surface) > 1").distinct())

    def attributes(self) -> DataFrame:
        """(axis, key, product_id): everything a product can be asked for by."""
        p = self.products
        rows = [p.select(F.lit(a).alias("axis"), value.alias("key"), "product_id") for a, value in (("product", normalized("name")), ("brand", normalized("brand")), ("category", normalized("category")), ("group", F.col("group")))]
        rows.append(self.ingredients.select(F.lit("ingredient"), F.col("ingredient"), "product_id"))
        out = rows[0]
        for x in rows[1:]:
            out = out.union(x)
        return out.where("key IS NOT NULL AND product_id IS NOT NULL").distinct()


def _any_of(words: list[str]) -> str:
    return "(" + "|".join(f"\\Q{w}\\E" for w in words) + ")"


def negation_spans(queries: DataFrame, behind: list[str], apart: list[str], ahead: list[str], longest: int = 4) -> DataFrame:
    """(query_id, place, marker, word, n, surface): per negation the 1 to `longest` words that it may rule out; `word` is the nearest one.

    `behind` follow the word with or without a space, `apart` follow it after a space or hyphen, `ahead` stand before it as words of their
    own. A stretch ends at another marker. All negations of a text count.
    """
    text = normalized("text")
    for words, pattern, sign in ((behind, r"(?<=[\p{L}\p{N}])\s*", _AFTER), (apart, r"(?<=[\p{L}\p{N}])[\s-]+", _AFTER)):
        if words:
            text = F.regexp_replace(text, pattern + _any_of(words), f" {sign}$1 ")
    if ahead:
        text = F.regexp_replace(text, r"(?<!\S)" + _any_of(ahead) + r"(?=\s)", f"{_BEFORE}$1")
    marks = lambda w: F.startswith(w, F.lit(_AFTER)) | F.startswith(w, F.lit(_BEFORE))
    rows = queries.where("query_id IS NOT NULL").select("query_id", F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("words"))
    rows = rows.select("query_id", "words", F.posexplode("words").alias("place", "marker")).where(marks(F.col("marker")))
    before = F.startswith("marker", F.lit(_BEFORE))
    rows = rows.select("*", before.alias("before"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"))
    start = F.when(F.col("before"), F.col("place") + 2).otherwise(F.col("place") + 1 - F.col("n"))
    stretch = rows.where(start >= 1).withColumn("stretch", F.slice("words", F.greatest(start, F.lit(1)), F.col("n")))
    stretch = stretch.where((F.size("stretch") == F.col("n")) & ~F.exists("stretch", marks))
    nearest = F.when(F.col("before"), F.element_at("stretch", 1)).otherwise(F.element_at("stretch", -1))
    trimmed = lambda c: F.regexp_replace(c, _EDGES, "")
    found = stretch.select("query_id", "place", F.substring("marker", 2, 1 << 20).alias("marker"), trimmed(nearest).alias("word"), "n", trimmed(F.array_join("stretch", " ")).alias("surface"))
    return found.where("surface <> '' AND word <> ''").distinct()


def _inside(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(text, word) by `contained`, from columns named surface."""
    return contained(texts.select(F.col("surface").alias("text")).distinct(), words.select(F.col("surface").alias("word")).distinct(), _LETTERS)


def _reverse(asked: DataFrame, names: DataFrame, hidden: DataFrame, cap: int) -> DataFrame:
    """(surface, key): names that an asked surface is a part of, where these are at most `cap`. names: surface, key, n."""
    met = _inside(names, asked.join(hidden, "surface", "left_anti")).where("text <> word").join(names.withColumnRenamed("surface", "text"), "text")
    few = met.groupBy("word").agg(F.sum("n").alias("_n")).where(F.col("_n") <= cap)
    return met.join(few, "word", "left_semi").select(F.col("word").alias("surface"), "key")


def _names(catalog: Catalog) -> DataFrame:
    return catalog.products.select(normalized("name").alias("surface"), "product_id").where("length(surface) > 1").distinct().groupBy("surface").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.col("surface"))


def _browsed(catalog: Catalog) -> DataFrame:
    """Surfaces that name many products at once and so never one of them: brands, categories, group words."""
    return catalog.axis("brand").union(catalog.axis("category")).union(catalog.group_words.select(normalized("surface"))).distinct()


def exclusions(spans: DataFrame, catalog: Catalog, cap: int = 10) -> DataFrame:
    """(query_id, place, word, axis, key, surface): what each negation rules out.

    Precedence is product, brand, category or group, ingredient; a word that one of them has taken is not asked for on the next. Within one the
    longest stretch wins. A product is meant by its whole name in the stretch, or by a part of at most `cap` product names that is no
    brand, category or group word; a brand only by its whole name; a category by a part of its name (the key is that part), a whole
    group by its name, and by one of its words only if neither fits; an ingredient by one of its words inside the nearest word, or if
    there is none by a part of at most `cap` ingredients.
    """
    asked = spans.where("length(surface) > 1").select("surface").distinct()
    names = _names(catalog)
    product = _inside(asked, names).select(F.col("text").alias("surface"), F.col("word").alias("key")).union(_reverse(asked, names, _browsed(catalog), cap)).distinct()
    brand = asked.join(catalog.axis("brand"), "surface").select("surface", F.col("surface").alias("key"))
    part = _inside(catalog.axis("category"), asked).select(F.col("word").alias("surface"), F.col("word").alias("key")).distinct()
    group_words = catalog.group_words.select(normalized("surface").alias("surface"), F.col("group").alias("key"), "whole")
    group = asked.join(group_words, "surface")
    nearest = spans.select(F.col("word").alias("surface")).where("length(surface) > 1").distinct()
    words = catalog.words().where("axis = 'ingredient'")
    direct = resolve(nearest.select(F.col("surface").alias("query_id"), F.col("surface").alias("text")), words, cap=1 << 30, longest_gram=_LETTERS).select(F.col("query_id").alias("surface"), "key")
    known = catalog.held.select(normalized("ingredient").alias("surface"), F.col("ingredient").alias("key"), F.lit(1).alias("n")).where("length(surface) > 1").distinct()
    part_of = _reverse(nearest.join(direct.select("surface").distinct(), "surface", "left_anti"), known, _browsed(catalog).limit(0), cap)

    def step(found: DataFrame, axis: str, order: int, fallback: int, layer: int) -> DataFrame:
        return found.select("surface", "key", F.lit(axis).alias("axis"), F.lit(order).alias("order"), F.lit(fallback).alias("fallback"), F.lit(layer).alias("layer"))

    long = step(product, "product", 1, 0, 0).union(step(brand, "brand", 2, 0, 0)).union(step(part, "category", 3, 0, 1))
    long = long.union(step(group.where("whole"), "group", 3, 0, 0)).union(step(group.where("NOT whole"), "group", 3, 1, 0)).distinct()
    by_word = step(direct.union(part_of), "ingredient", 4, 0, 0).distinct()
    rows = spans.select("query_id", "place", "word", "n", "surface").join(long, "surface").select("query_id", "place", "word", "n", "surface", "axis", "key", "order", "fallback", "layer")
    rows = rows.union(spans.where("n = 1").select("query_id", "place", "word", "n", F.col("word").alias("surface")).join(by_word, "surface").select("query_id", "place", "word", "n", "surface", "axis", "key", "order", "fallback", "layer"))
    rows = saved(rows.withColumn("best", F.struct("order", "fallback", (-F.col("n")).alias("n"), "layer")))
    won = rows.groupBy("query_id", "place", "word").agg(F.min("best").alias("best"))
    taken = won.groupBy("query_id", "word").agg(F.min("best.order").alias("order"))
    return rows.join(won, ["query_id", "place", "word", "best"], "left_semi").join(taken, ["query_id", "word", "order"], "left_semi").select("query_id", "place", "word", "axis", "key", "surface").distinct()


def excluded_keys(excluded: DataFrame, catalog: Catalog) -> DataFrame:
    """(query_id, axis, key) as products carry them: a ruled-out part of a category name is every category that has it."""
    plain = excluded.where("axis <> 'category'").select("query_id", "axis", "key")
    parts = excluded.where("axis = 'category'").select("query_id", F.col("key").alias("word")).distinct()
    labels = _inside(catalog.axis("category"), parts.select(F.col("word").alias("surface")))
    return plain.union(parts.join(labels, "word").select("query_id", F.lit("category"), F.col("text"))).distinct()


def readings(queries: DataFrame, catalog: Catalog, excluded: DataFrame, others: DataFrame | None = None, cap: int = 10) -> tuple[DataFrame, DataFrame]:
    """(query_id, axis, key, surface), all and those that stand. others: axis, key, surface of further axes.

    A longer surface hides those inside it on its axis. A whole text that is a part of at most `cap` product names means these. What a
    query rules out doesn't stand, nor do categories that carry the name of a group ruled out, nor products of another brand where a brand
    is asked for (products of no known brand do).
    """
    words = catalog.words()
    found = resolve(queries, words if others is None else words.unionByName(others), cap=1 << 30, longest_gram=_LETTERS)
    text = queries.select("query_id", normalized("text").alias("surface")).where("length(surface) > 1")
    whole = text.join(_reverse(text.select("surface").distinct(), _names(catalog), _browsed(catalog), cap), "surface")
    found = saved(found.union(whole.select("query_id", F.lit("product"), "key", "surface")).where("query_id IS NOT NULL").distinct())
    titles = catalog.group_words.where("whole").select(F.lit("group").alias("axis"), F.col("group").alias("key"), normalized("surface").alias("label"))
    gone = excluded_keys(excluded, catalog)
    gone = gone.union(gone.join(titles, ["axis", "key"]).select("query_id", F.lit("category"), "label")).distinct()
    stand = found.join(gone, ["query_id", "axis", "key"], "left_anti")
    brands = stand.where("axis = 'brand'").select("query_id", F.col("key").alias("brand"))
    made_by = catalog.products.select(normalized("name").alias("key"), normalized("brand").alias("brand")).distinct()
    named = stand.where("axis = 'product'").select("query_id", "key").distinct().join(brands.select("query_id").distinct(), "query_id", "left_semi")
    fits = named.join(made_by, "key").join(brands.withColumn("asked", F.lit(True)), ["query_id", "brand"], "left").where(F.col("brand").isNull() | (F.col("brand") == "") | F.col("asked"))
    other = named.join(fits, ["query_id", "key"], "left_anti").withColumn("axis", F.lit("product"))
    return found, stand.join(other, ["query_id", "axis", "key"], "left_anti")


def unread(queries: DataFrame, found: DataFrame, stand: DataFrame, spans: DataFrame, excluded: DataFrame, stems: list[str]) -> DataFrame:
    """(query_id, word, negated): negated words that rule out nothing, and words of two or more letters that nothing reflects.

    A word is reflected if it is part of a surface found or of a negation, or the other way round; words with a stem of `stems` only ask.
    A negated word is not told if it is part of an ingredient that stands or holds one that is ruled out.
    """
    near = F.col("near")
    lost = spans.select("query_id", "place", "word").distinct().join(excluded.select("query_id", "word").distinct(), ["query_id", "word"], "left_anti").select("query_id", "word").distinct()
    handled = stand.where("axis = 'ingredient'").select("query_id", F.col("surface").alias("s"), F.lit(True).alias("wider"))
    handled = handled.union(excluded.where("axis = 'ingredient'").select("query_id", "word", F.lit(False)))
    handled = handled.groupBy("query_id").agg(F.collect_set(F.struct("s", "wider")).alias("near"))
    told = lambda x: F.when(x["wider"], F.contains(x["s"], F.col("word"))).otherwise(F.contains(F.col("word"), x["s"]))
    lost = lost.join(handled, "query_id", "left").where(near.isNull() | ~F.exists(near, told)).select("query_id", "word", F.lit(True).alias("negated"))
    owned = found.select("query_id", "surface").union(spans.select("query_id", "word")).union(spans.select("query_id", "marker"))
    owned = owned.groupBy("query_id").agg(F.collect_set("surface").alias("near"))
    words = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(F.split(normalized("text"), " "))).alias("word")).where("length(word) > 1")
    for stem in stems:
        words = words.where(~F.contains("word", F.lit(stem)))
    met = F.exists(near, lambda s: F.contains(F.col("word"), s) | F.contains(s, F.col("word")))
    rest = words.join(owned, "query_id", "left").where(near.isNull() | ~met).select("query_id", "word", F.lit(False).alias("negated"))
    return lost.union(rest.join(lost.select("query_id", "word"), ["query_id", "word"], "left_anti").select("query_id", "word", "negated")).distinct()


def needs(stand: DataFrame, catalog: Catalog) -> DataFrame:
    """(query_id, family, axis, key): the keys of products that meet each ingredient asked for. A family is one surface of the query: any of its
    ingredients meets it, also those of the same surface that a shorter way to the query took, and so does its name or theirs in a product's name."""
    asked = stand.where("axis = 'ingredient'").select("query_id", F.col("surface").alias("family")).distinct()
    told = catalog.words().where("axis = 'ingredient'").select(F.col("surface").alias("family"), "key")
    keys = saved(asked.select("family").distinct().join(told, "family"))
    said = keys.select("family", normalized("key").alias("word")).union(asked.select("family", F.col("family"))).where("length(word) > 1").distinct()
    named = said.join(_inside(catalog.axis("name"), said.select(F.col("word").alias("surface"))), "word").select("family", F.lit("product").alias("axis"), F.col("text").alias("key"))
    return asked.join(keys.select("family", F.lit("ingredient").alias("axis"), "key").union(named).distinct(), "family").select("query_id", "family", "axis", "key")


def _flag(role: str) -> Column:
    return F.max(F.col("role") == role)


def answers(stand: DataFrame, excluded: DataFrame, catalog: Catalog, n: int = 20, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, product_id, pinned, hits, rank) and (query_id, n_families, n_matched, applied, relaxed).

    Products by the number of keys that they share with a query, those it names first; none that it rules out. Where ingredients are asked
    for, only products that meet all of them; if no product does, this condition alone is given up and the query is marked relaxed.
    n_matched counts the products that meet it. extra: axis, key, product_id of further axes. Queries that ask for the same are answered once;
    asked and ruled-out keys meet the products in one join and one aggregate.
    """
    rows = stand.select("query_id", "axis", "key", F.when(F.col("axis") == "product", "pin").otherwise("want").alias("role"), F.lit("").alias("family"))
    rows = rows.union(excluded_keys(excluded, catalog).select("query_id", "axis", "key", F.lit("not"), F.lit("")))
    rows = saved(rows.union(needs(stand, catalog).select("query_id", "axis", "key", F.lit("need"), "family")).distinct())
    sets = saved(rows.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("axis", "key", "role", "family"))).alias("asks")).withColumn("asked", F.md5(F.to_json("asks").cast("binary"))))
    asks = saved(sets.groupBy("asked").agg(F.first("asks").alias("asks")).select("asked", F.inline("asks")))
    families = asks.groupBy("asked").agg(F.count_distinct(F.when(F.col("role") == "need", F.col("family"))).alias("n_families"))
    attributes = catalog.attributes() if extra is None else catalog.attributes().unionByName(extra)
    hits = asks.join(attributes, ["axis", "key"]).groupBy("asked", "product_id").agg(
        F.count_if(F.col("role").isin("want", "pin")).cast("int").alias("hits"), _flag("pin").cast("int").alias("pinned"), _flag("not").alias("out"),
        F.size(F.collect_set(F.when(F.col("role") == "need", F.col("family")))).alias("met"),
    )
    hits = saved(hits.where("NOT out").join(families, "asked").withColumn("passes", F.col("met") == F.col("n_families")).drop("met", "out", "n_families"))
    state = families.join(hits.where("passes").groupBy("asked").agg(F.count(F.lit(1)).alias("n_matched")), "asked", "left")
    state = saved(state.select("asked", "n_families", F.when(F.col("n_families") > 0, F.coalesce("n_matched", F.lit(0))).otherwise(0).cast("long").alias("n_matched")))
    state = state.withColumn("applied", (F.col("n_families") > 0) & (F.col("n_matched") > 0)).withColumn("relaxed", (F.col("n_families") > 0) & (F.col("n_matched") == 0))
    open_to = hits.join(state.select("asked", "applied"), "asked").where("hits > 0 AND (passes OR NOT applied)")
    best = top_n(open_to.select("asked", "product_id", "pinned", "hits"), ["asked"], [F.desc("pinned"), F.desc("hits"), F.asc("product_id")], n)
    link = sets.select("query_id", "asked")
    return link.join(best, "asked").drop("asked"), link.join(state, "asked").drop("asked")


def profile_classes(queries: DataFrame, triggers: DataFrame) -> DataFrame:
    """(query_id, class): the parts of a user's own profile that a text refers to. triggers: class, phrase."""
    q = queries.select("query_id", normalized("text").alias("text")).where("query_id IS NOT NULL")
    t = triggers.select("class", normalized("phrase").alias("word")).where("word <> ''").distinct()
    return q.join(contained(q.select("text").distinct(), t.select("word").distinct()), "text").join(t, "word").select("query_id", "class").distinct()
