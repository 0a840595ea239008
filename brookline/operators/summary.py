"""Summaries of series and what is fitted to them: aggregates with partial sums, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arith import INF
from .series import along

# Relative load by hour of day.
PROFILES = {
    "weekday-office": [0.18, 0.16, 0.15, 0.15, 0.2, 0.3, 0.45, 0.7, 0.95, 1.15, 1.25, 1.3, 1.25, 1.15, 1.05, 1.0, 0.95, 0.85, 0.65, 0.5, 0.38, 0.3, 0.25, 0.2],
    "three-shift": [0.9, 0.9, 0.9, 0.92, 0.95, 0.98, 1.0, 1.03, 1.06, 1.1, 1.12, 1.15, 1.12, 1.08, 1.05, 1.02, 1.0, 0.98, 0.96, 0.94, 0.92, 0.9, 0.9, 0.9],
    "hub-rush-hour": [0.2, 0.18, 0.17, 0.17, 0.2, 0.35, 0.7, 1.2, 1.4, 1.25, 1.0, 0.85, 0.8, 0.85, 0.95, 1.1, 1.35, 1.5, 1.35, 1.0, 0.65, 0.4, 0.3, 0.22],
}
SLOTS = 12  # of five minutes in an hour


def describe(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """Count, least, greatest, mean, sum, population deviation, exact percentiles and the first bin of the peak."""
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.sum(x).alias("total"), F.stddev_pop(x).alias("deviation"),
        *[F.percentile(x, F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)],
        F.min_by("bin", F.struct(-F.col(x), "bin")).alias("peak_bin"),
    )


def periodicity(df: DataFrame, x: str, period: int, keys: Sequence[str]) -> DataFrame:
    """score: 1 less the change from one period before, relative to what there is; null for under two periods."""
    lagged = df.withColumn("_p", F.lag(x, period).over(along(keys)))
    seen = F.col("_p").isNotNull()
    miss, size, n = F.sum(F.when(seen, F.abs(F.col(x) - F.col("_p")))), F.sum(F.when(seen, F.abs(F.col(x)))), F.count("*")
    score = F.when((n >= 2 * period) & (size > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - miss / size)))
    return lagged.groupBy(*keys).agg(score.alias("score")).withColumn("periodic", F.coalesce(F.col("score") >= 0.85, F.lit(False)))


def detect_period(df: DataFrame, x: str, bins_per_day: int, keys: Sequence[str]) -> DataFrame:
    """The better of a day and a week as the period of each series: label, period, score (null if neither says anything)
    and whether the series is periodic. Both lags share one sort."""
    found = df
    for label, period in (("daily", bins_per_day), ("weekly", 7 * bins_per_day)):
        found = found.withColumn(f"_{label}", F.lag(x, period).over(along(keys)))

    def scored(label: str, period: int) -> Column:
        before = F.col(f"_{label}")
        miss, size = F.sum(F.when(before.isNotNull(), F.abs(F.col(x) - before))), F.sum(F.when(before.isNotNull(), F.abs(F.col(x))))
        score = F.when((F.count("*") >= 2 * period) & (size > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - miss / size)))
        return F.coalesce(score, F.lit(0.0))

    out = found.groupBy(*keys).agg(scored("daily", bins_per_day).alias("_d"), scored("weekly", 7 * bins_per_day).alias("_w"))
    day, week = (F.col("_d") >= F.col("_w")) & (F.col("_d") > 0), F.col("_w") > 0
    return out.select(
        *keys,
        F.when(day, "daily").when(week, "weekly").alias("label"),
        F.when(day, bins_per_day).when(week, 7 * bins_per_day).cast("long").alias("period"),
        F.when(day, F.col("_d")).when(week, F.col("_w")).alias("score"),
        (F.greatest("_d", "_w") >= 0.85).alias("periodic"),
    )


def fit_pmf(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """Relative frequencies of the values, rounded half to even to six decimals."""
    counted = df.groupBy(*keys, F.bround(x, 6).alias("value")).agg(F.count("*").alias("n"))
    return counted.select(*keys, "value", (F.col("n") / F.sum("n").over(W.partitionBy(*keys))).alias("probability"))


def pmf_moments(pmf: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.col("probability") / F.sum("probability").over(W.partitionBy(*keys))
    out = pmf.withColumn("p", p).groupBy(*keys).agg(F.sum(F.col("value") * F.col("p")).alias("mean"), F.sum(F.col("value") * F.col("value") * F.col("p")).alias("square"))
    variance = F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))
    return out.select(*keys, "mean", variance.alias("variance"), F.when(F.col("mean") != 0, F.sqrt(variance) / F.abs("mean")).otherwise(0.0).alias("cv"))


def normalise_profile(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """x with a mean of one in each key."""
    mean = F.avg(x).over(W.partitionBy(*keys))
    return df.withColumn("weight", F.when(mean != 0, F.try_divide(F.col(x), mean)).otherwise(0.0))


def resample_profile(df: DataFrame, weights: str, n: int) -> DataFrame:
    """The array column `weights` (m values) read at n even places, linearly in between: rows with bin and weight."""
    m = F.size(weights)
    at = F.col("bin") / F.lit(float(n)) * (m - 1)
    lo = F.floor(at).cast("int")
    value = lambda i: F.element_at(weights, F.least(i, m - 1) + 1)
    rows = df.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    between = value(lo) + (value(lo + 1) - value(lo)) * (at - lo)
    return rows.withColumn("weight", F.when(m == n, value(F.col("bin"))).otherwise(between)).drop(weights)


def built_in_profile(spark: SparkSession, name: str, bins: int) -> DataFrame:
    """Rows (bin, weight) of a profile of PROFILES over a grid: hours in slots of five minutes, resampled, mean one."""
    if name.lower() not in PROFILES or bins < 1:
        raise ValueError(f"there is no profile {name!r} of {bins} bins")
    hourly = F.array(*map(F.lit, PROFILES[name.lower()]))
    day = spark.range(1).select("id", F.flatten(F.transform(hourly, lambda x: F.array_repeat(x, SLOTS))).alias("weights"))
    return normalise_profile(resample_profile(day, "weights", bins), "weight", ["id"]).select("bin", "weight")


def fill_gaps(df: DataFrame, x: str, missing: str = "ignore", invalid: str = "zero") -> DataFrame:
    """x with a policy for absent and for non-finite values, and what was done as `gap`.

    missing: "ignore", "warn" or "zero". invalid: "zero" or "keep"."""
    v = F.col(x)
    bad = F.isnan(v) | (F.abs(v) == INF)
    gap = F.when(v.isNull(), None if missing == "ignore" else "data_gap").when(bad, "nan_fill" if invalid == "zero" else "nan_detected")
    value = F.when(v.isNull(), F.lit(0.0) if missing == "zero" else v).when(bad, F.lit(0.0) if invalid == "zero" else v).otherwise(v)
    return df.withColumn("gap", gap).withColumn(x, value)
