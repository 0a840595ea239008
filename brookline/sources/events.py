"""Raw events binned onto a grid: one partial aggregate over the scan, then empty bins filled with zero.

Entities' grids are filled by a window per entity (each bin brings the empty ones after it), not by a join with entities x
bins: the counts are shuffled by entity once, and the windows of later operators find them partitioned so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPOCH = "2024-01-01 00:00:00"
#: Which events stand for which series.
ROLES = {"view": "arrivals", "click": "served", "error": "errors", "purchase": "purchases", "signup": "signups"}


def bin_of(ts, unit: str = "HOUR", start: str = EPOCH):
    return F.timestamp_diff(unit, F.lit(start).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def fill_bins(counts: DataFrame, by: Sequence[str], values: Sequence[str], bins: int) -> DataFrame:
    """counts (by..., bin, values...) with every bin from 0 to bins - 1 of each key; values are 0 where there were none."""
    order = W.partitionBy(*by).orderBy("bin")
    first = F.when(F.lag("bin").over(order).isNull(), F.lit(0).cast("long")).otherwise(F.col("bin"))
    reach = counts.withColumns({"_first": first, "_last": F.coalesce(F.lead("bin").over(order), F.lit(bins).cast("long")) - 1})
    rows = reach.withColumn("_at", F.explode(F.sequence("_first", "_last")))
    here = F.col("_at") == F.col("bin")
    return rows.select(*by, F.col("_at").alias("bin"), *[F.when(here, F.col(v).cast("double")).otherwise(0.0).alias(v) for v in values])


def binned(spark: SparkSession, sf_dir: str, bins: int = 720, unit: str = "HOUR", by: Sequence[str] = ()) -> DataFrame:
    """(scenario_id[, by...], bin, arrivals, served, errors, purchases, signups) for every bin of each entity with events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(bin_of(F.col("ts"), unit).alias("bin"), "event_type", *by)
    counts = events.where(F.col("bin").between(0, bins - 1)).groupBy(*by, "bin").agg(*[F.count_if(F.col("event_type") == t).alias(r) for t, r in ROLES.items()])
    roles = list(ROLES.values())
    if by:
        filled = fill_bins(counts, by, roles, bins)
    else:
        grid = spark.range(bins).select(F.col("id").alias("bin"))
        filled = grid.join(counts, "bin", "left").select("bin", *[F.coalesce(r, F.lit(0)).cast("double").alias(r) for r in roles])
    return filled.select(F.lit(0).cast("long").alias("scenario_id"), *by, "bin", *roles)


def span_of(spark: SparkSession, sf_dir: str, unit: str = "HOUR") -> tuple[str, int]:
    """The grid that the events themselves give: the start of the first one's unit, and how many units reach to the last."""
    at = F.col("ts").cast("timestamp_ntz")
    lo, hi = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_trunc(unit, F.min(at)).cast("timestamp_ntz").cast("string"), F.max(at)).first()
    if lo is None:
        return EPOCH, 0
    bins = spark.range(1).select(F.timestamp_diff(unit, F.lit(lo).cast("timestamp_ntz"), F.lit(hi)) + 1).first()[0]
    return lo, int(bins)


def binned_whole(spark: SparkSession, sf_dir: str, unit: str = "HOUR", by: Sequence[str] = ()) -> DataFrame:
    """binned() on the grid of span_of(): no event is left out, whenever it was. Rows also have the start of their bin."""
    start, bins = span_of(spark, sf_dir, unit)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(bin_of(F.col("ts"), unit, start).alias("bin"), "event_type", *by)
    roles = list(ROLES.values())
    counts = events.where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(*[F.count_if(F.col("event_type") == t).alias(r) for t, r in ROLES.items()])
    if by:
        filled = fill_bins(counts, by, roles, bins)
    else:
        filled = spark.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", *[F.coalesce(r, F.lit(0)).cast("double").alias(r) for r in roles])
    return filled.select(F.lit(0).cast("long").alias("scenario_id"), *by, "bin", F.timestamp_add(unit, F.col("bin").cast("int"), F.lit(start).cast("timestamp_ntz")).alias("bin_start"), *roles)


def by_type(spark: SparkSession, sf_dir: str, bins: int = 720, unit: str = "HOUR") -> DataFrame:
    """(scenario_id, class_id, bin, value): the events of each type, as classes of one flow; empty bins are zero."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(bin_of(F.col("ts"), unit).alias("bin"), F.col("event_type").alias("class_id"))
    counts = events.where(F.col("bin").between(0, bins - 1)).groupBy("class_id", "bin").agg(F.count("*").alias("value"))
    return fill_bins(counts, ["class_id"], ["value"], bins).select(F.lit(0).cast("long").alias("scenario_id"), "class_id", "bin", "value")


def outside(spark: SparkSession, sf_dir: str, bins: int = 720, unit: str = "HOUR") -> DataFrame:
    """How many events lie before the grid or after it, which binned() leaves out: (events, before, after), one row."""
    at = spark.read.parquet(f"{sf_dir}/events.parquet").select(bin_of(F.col("ts"), unit).alias("bin"))
    return at.agg(F.count("*").alias("events"), F.count_if(F.col("bin") < 0).alias("before"), F.count_if(F.col("bin") >= bins).alias("after"))
