"""Text normalisation and small scalar scores as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode composition; Spark has no function for it."""
    return F.pandas_udf(_compose, "string")(c)


def normalized(c: Column | str, compose: bool = False) -> Column:
    """Lower case, outer space off, inner space single; NFC too if asked for."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(nfc(c) if compose else c), r"\s+", " "))


def without_brand(name: Column | str, brand: Column | str) -> Column:
    """A normalised name without bracketed parts and without its brand in front."""
    name, brand = (normalized(F.col(x) if isinstance(x, str) else x) for x in (name, brand))
    bare = F.trim(F.regexp_replace(name, r"\([^)]*\)", " "))
    cut = F.trim(F.substring(bare, F.length(brand) + 1, F.lit(1 << 20)))
    return normalized(F.when((F.length(brand) > 0) & F.startswith(bare, brand), cut).otherwise(bare))


def freshness(reviews_30d: Column) -> Column:
    n = F.coalesce(reviews_30d, F.lit(0))
    return F.when(n > 10, 1.0).when(n > 3, 0.6).when(n > 0, 0.3).otherwise(0.0)


def popularity(reviews: Column) -> Column:
    return F.least(F.log1p(F.greatest(F.coalesce(reviews, F.lit(0)), F.lit(0)).cast("double")) / F.log(F.lit(1001.0)), F.lit(1.0))


def rating_over_four(rating: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(rating, F.lit(0.0)) - 4))


def shrinkage(reviews: Column) -> Column:
    """n / (n + 10), and 0.1 without reviews."""
    n = F.coalesce(reviews, F.lit(0))
    return F.when(n > 0, n / (n + 10)).otherwise(0.1)


def ladder(text: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first pattern that the text holds."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out if other is None else out.otherwise(other)
