"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def hashed(*parts: Column | str) -> Column:
    """md5 of the parts joined by a bar; nulls count as empty."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]).cast("binary"))


def review_id(source: Column | str, key: Column | str, *fallback: Column | str) -> Column:
    """review:{source}:{key}, or the hash of the fallback columns where the key is blank."""
    return F.concat(F.lit("review:"), _text(source), F.lit(":"), F.coalesce(F.nullif(_text(key), F.lit("")), hashed(*fallback)))


def reviewer_id(source: Column | str, author: Column | str, review: Column | str) -> Column:
    """(id, stability): stable where the author is known, else local to the review."""
    known = _text(author) != ""
    stable = F.concat(F.lit("reviewer_proxy:"), _text(source), F.lit(":"), _text(author))
    return F.struct(F.when(known, stable).otherwise(F.concat(F.lit("reviewer_proxy:"), _text(review))).alias("id"), F.when(known, "STABLE").otherwise("REVIEW_LOCAL").alias("stability"))


def product_iri(c: Column | str) -> Column:
    return F.concat(F.lit("product:"), _text(c))


def concept_iri(kind: Column | str, c: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("concept:"), kind, F.lit(":"), _text(c))


def qualifier_fingerprint(qualifiers: Column | str) -> Column:
    """Hash of an array of (key, value) structs whatever their order; empty for none."""
    q = F.col(qualifiers) if isinstance(qualifiers, str) else qualifiers
    pairs = F.array_sort(F.transform(q, lambda x: F.struct(_text(x["key"]).alias("key"), _text(x["value"]).alias("value"))))
    joined = F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit(":"), x["value"])), "|")
    return F.when(F.coalesce(F.size(q), F.lit(0)) <= 0, F.lit("")).otherwise(F.md5(joined.cast("binary")))


def fact_id(review: Column | str, subject: Column | str, predicate: Column | str, obj: Column | str, polarity: Column | str, fingerprint: Column | str) -> Column:
    return F.concat(F.lit("fact:"), hashed(review, subject, predicate, obj, polarity, fingerprint))


def signal_id(review: Column | str, product: Column | str, edge: Column | str, dst: Column | str, polarity: Column | str, version: Column | str, negated: Column | None = None, fingerprint: Column | None = None) -> Column:
    """Negation and fingerprint join the hash only where they are not blank."""
    extra = [F.when(_text(c) != "", F.concat(F.lit(tag), _text(c))) for c, tag in ((negated, "neg:"), (fingerprint, "qfp:")) if c is not None]
    return F.concat(F.lit("signal:"), F.md5(F.concat_ws("|", *[_text(p) for p in (review, product, edge, dst, polarity, version)], *extra).cast("binary")))


def join_key(c: Column | str) -> Column:
    """The bare key of concept:T:x and product:x."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, "^(concept:[^:]*:|product:)", "")
