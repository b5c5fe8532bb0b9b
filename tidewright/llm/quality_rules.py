"""Quality rules: minimum-covariance-determinant outliers per language and source.

Statistic vectors of each (language, source) group get the centre and scatter of least determinant among subsets of 75 % of
its rows. All groups and four deterministic starts go through concentration steps together: distances under the current
estimate, the 75 % quantile of them, and the moments of the rows below it. The starts, in units of the median deviation
from the median: the median with these deviations, the covariances of the hyperbolic tangents and of the directions, and the
moments of the half nearest to the median. A start goes on until its determinant no longer falls; the least determinant
wins, and its estimate is fitted once more on the rows within the 0.975 quantile. Scatter has a floor per
statistic, from the spread over all rows, so that a statistic most rows of a group share does not make tiny deviations
outliers; it stays under what the statistic's range can exceed, so that each statistic can reject alone. A row is rejected
when its squared distance, scaled so that the group's median is that of a chi-square, exceeds the cutoff.
Groups under `min_group` rows are pooled by language, and if still too small, all together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents, small, written
from tidewright.llm.text_stats import with_counts

#: Statistic and the greatest floor of its standard deviation. The cutoff lies at 5.07 deviations; x1, x2 and x4 reach log1p(100), x3 log1p(50).
STATS = {"x0": 0.5, "x1": 0.4, "x2": 0.6, "x3": 0.5, "x4": 0.4}
_P = len(STATS)
#: Fixed values for five statistics: the median, the 0.975 and the 0.9999 quantile of the chi-square distribution.
CHI_MEDIAN, CHI_WITHIN, CHI_CUTOFF = 4.3515, 12.8325, 25.7448
_ESTIMATE = "grp string, start int, m array<double>, p array<double>, logdet double"


def transformed(counts: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda x, n: F.log1p(100 * F.col(x) / n)
    return counts.withColumns({
        "x0": F.col("word_chars") / words, "x1": share("n_symbols", chars), "x2": share("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        "x3": share("n_repeat_words", words), "x4": share("n_upper", chars),
    })


def _grouped(rows: DataFrame, min_group: int) -> DataFrame:
    """Adds grp, the group whose estimate a row is held against; null is a language and a source of its own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = rows.withColumns({"_l": name("lang"), "_s": name("source")})
    fine = written(rows.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n")))
    left = fine.filter(F.col("n") < min_group).groupBy("_l").agg(F.sum("n").alias("pool"))
    grp = F.when(F.col("n") >= min_group, F.concat_ws("\u0001", F.lit("source"), "_l", "_s")).when(F.col("pool") >= min_group, F.concat_ws("\u0001", F.lit("language"), "_l")).otherwise("rest")
    return rows.join(small(written(fine.join(left, "_l", "left").select("_l", "_s", grp.alias("grp")))), ["_l", "_s"]).drop("_l", "_s")


def _distance() -> Column:
    """Squared Mahalanobis distance under the joined estimate (m: centre, p: inverse scatter, row by row)."""
    d = [F.col(x) - F.col("m")[i] for i, x in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(_P):
        for j in range(_P):
            total = total + d[i] * d[j] * F.col("p")[i * _P + j]
    return total


def _floors(rows: DataFrame) -> dict[str, float]:
    """Floor of each statistic: the 0.9 quantile of the distance to the median over all rows, as a deviation, in bounds of STATS."""
    names = list(STATS)
    middle = rows.agg(*[F.percentile_approx(x, 0.5, 1000).alias(x) for x in names]).first()
    wide = rows.agg(*[F.percentile_approx(F.abs(F.col(x) - F.lit(middle[x])), 0.9, 1000).alias(x) for x in names]).first()
    return {x: min(most, max(most * 2 / 3, (wide[x] or 0.0) / 1.645)) for x, most in STATS.items()}


def _estimates(moments: DataFrame, least: dict[str, float]) -> DataFrame:
    """Centre, inverse scatter and its log determinant from n, the sums s and the sums of products q, around `at` in units of `by` if these are given."""
    floors = np.diag(np.array(list(least.values())) ** 2)

    def invert(batches):
        for t in batches:
            m, p, logdet = [], [], []
            for n, s, q, at, by in zip(t["n"], t["s"], t["q"], t["at"], t["by"], strict=True):
                mean, by = np.array(s) / n, np.array(by)
                cov = (np.array(q).reshape(_P, _P) / n - np.outer(mean, mean)) * np.outer(by, by) + floors
                m.append(np.array(at) + mean * by)
                p.append(np.linalg.inv(cov).ravel())
                logdet.append(np.linalg.slogdet(cov)[1])
            yield pd.DataFrame({"grp": t["grp"], "start": t["start"], "m": m, "p": p, "logdet": logdet})

    return moments.mapInPandas(invert, _ESTIMATE)


def _moments(rows: DataFrame, columns: list[Column], at: Column | None = None, by: Column | None = None) -> DataFrame:
    rows = rows.select("grp", "start", *[c.alias(f"v{i}") for i, c in enumerate(columns)], (at if at is not None else F.array_repeat(F.lit(0.0), _P)).alias("at"), (by if by is not None else F.array_repeat(F.lit(1.0), _P)).alias("by"))
    names = [f"v{i}" for i in range(_P)]
    out = rows.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in names], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a in names for b in names], F.any_value("at").alias("at"), F.any_value("by").alias("by"))
    return out.select("grp", "start", "n", F.array(*names).alias("s"), F.array(*[a + b for a in names for b in names]).alias("q"), "at", "by")


def _starts(rows: DataFrame, floors: dict[str, float]) -> DataFrame:
    """The estimates that concentration begins with."""
    names = list(STATS)
    middle = small(written(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).cast("double").alias(f"c{x}") for x in names])))
    spread = rows.join(middle, "grp").groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"c{x}")), 0.5, 1000).alias(f"d{x}") for x in names])
    unit = spread.join(middle, "grp").select("grp", F.array(*[f"c{x}" for x in names]).alias("at"), F.array(*[F.sqrt(F.pow(1.4826 * F.col(f"d{x}"), 2) + floors[x] ** 2) for x in names]).alias("by"))
    unit = small(written(unit))
    z = rows.join(unit, "grp").select("grp", "at", "by", *[((F.col(x) - F.col("at")[i]) / F.col("by")[i]).alias(f"z{i}") for i, x in enumerate(names)])
    z = z.withColumn("norm", F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P))))
    half = small(written(z.groupBy("grp").agg(F.percentile_approx("norm", 0.5, 1000).alias("half"))))
    zs = [F.col(f"z{i}") for i in range(_P)]
    parts = [
        (1, z, [F.tanh(c) for c in zs]), (2, z, [c / F.greatest("norm", F.lit(1e-9)) for c in zs]), (3, z.join(half, "grp").filter("norm <= half"), zs),
    ]
    found = [_estimates(_moments(part.withColumn("start", F.lit(k)), columns, F.col("at"), F.col("by")), floors) for k, part, columns in parts]
    plain = F.array(*[1 / F.pow(F.col("by")[i], 2) if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    logdet = sum(2 * F.log(F.col("by")[i]) for i in range(_P))
    first = unit.select("grp", F.lit(0).alias("start"), F.col("at").alias("m"), plain.alias("p"), logdet.alias("logdet"))
    return written(first.unionByName(found[0]).unionByName(found[1]).unionByName(found[2]))


def minimum_determinant(rows: DataFrame, floors: dict[str, float], keep_share: float = 0.75, least_fall: float = 1e-3) -> DataFrame:
    """(grp, start, m, p, logdet): the estimate of least determinant of each group. rows: grp and the columns of STATS, written.

    A step cannot raise the determinant but for the error of the quantile; a start whose log determinant falls by less than
    `least_fall` is done, so the steps come to an end.
    """
    names = [F.col(x) for x in STATS]
    estimate, done = _starts(rows, floors).withColumn("logdet", F.lit(float("inf"))), None
    while True:
        far = rows.join(small(estimate), "grp").withColumn("d", _distance())
        limit = small(written(far.groupBy("grp", "start").agg(F.percentile_approx("d", keep_share, 1000).alias("limit"))))
        new = _estimates(_moments(far.join(limit, ["grp", "start"]).filter("d <= limit"), names), floors)
        before = estimate.select("grp", "start", F.col("m").alias("m0"), F.col("p").alias("p0"), F.col("logdet").alias("logdet0"))
        step = written(new.join(before, ["grp", "start"]).withColumn("falls", F.col("logdet") < F.col("logdet0") - least_fall))
        better = lambda c: F.when(F.col("logdet") < F.col("logdet0"), F.col(c)).otherwise(F.col(f"{c}0")).alias(c)
        ended = step.filter("NOT falls").select("grp", "start", better("m"), better("p"), better("logdet"))
        done = ended if done is None else done.unionByName(ended)
        estimate = step.filter("falls").select("grp", "start", "m", "p", "logdet")
        if not estimate.count():
            break
    done = written(done)
    return done.groupBy("grp").agg(F.min_by(F.struct("start", "m", "p", "logdet"), F.struct("logdet", "start")).alias("x")).select("grp", "x.*")


def _scaled(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with `distance` under the estimate, scaled so that a group's median is at most that of the chi-square, and the group's `size`."""
    far = rows.join(small(estimate), "grp").withColumn("d", _distance()).drop("start", "m", "p", "logdet")
    scale = small(written(far.groupBy("grp").agg(F.percentile_approx("d", 0.5, 1000).alias("mid"), F.count(F.lit(1)).alias("size"))))
    # The scatter's floor makes distances small, so the scale is never below 1: it only widens what is accepted.
    return far.join(scale, "grp").withColumn("distance", F.col("d") * F.least(F.lit(1.0), CHI_MEDIAN / F.greatest("mid", F.lit(1e-9)))).drop("d", "mid")


def outliers(counts: DataFrame, min_group: int = 50, keep_share: float = 0.75) -> DataFrame:
    """counts with `distance` (scaled, squared) and `rejected`. Rows of base failures should be left out by the caller.

    Null languages and sources form groups of their own. A pool of fewer than `min_group` rows says nothing about its rows and rejects
    none. Equal rows have equal distances; an empty table gives no rows.
    """
    rows = written(_grouped(transformed(counts), min_group).select(*counts.columns, *STATS, "grp"))
    floors, vectors = _floors(rows), rows.select("grp", *STATS)
    best = written(minimum_determinant(vectors, floors, keep_share))
    within = _scaled(vectors, best).filter(F.col("distance") <= CHI_WITHIN).withColumn("start", F.lit(0))
    final = written(_estimates(_moments(within, [F.col(x) for x in STATS]), floors))
    return _scaled(rows, final).withColumn("rejected", (F.col("size") >= min_group) & (F.col("distance") > CHI_CUTOFF)).select(*counts.columns, "grp", "distance", "rejected")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, min_group: int = 50) -> DataFrame:
    """One row per document row: the counts, base_failed, distance and kept. Extra columns of docs are not looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    counts = written(with_counts(rows, ["doc_id", "lang", "source"]).withColumn("base_failed", base_failed()))
    held = outliers(counts.filter("NOT base_failed"), min_group)
    return held.withColumn("kept", ~F.col("rejected")).drop("rejected", "grp").unionByName(counts.filter("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)}))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, base_failed, kept and distance of each document row."""
    return apply_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
