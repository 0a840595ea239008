"""Class algebra: what an expression does to the classes of its operands.

A classed series is long: (scenario_id, bin, class_id, total, value), class_id null on the one row of a bin without
classes. Rules work on Columns; joins are on (scenario_id, bin[, class_id])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arith import ceil, fin, fires, floor, floored_mod, round_away, safe_div
from .series import convolve, queue_depth, shift

BIN = ["scenario_id", "bin"]
KEYS = [*BIN, "class_id"]
SERIES = ("scenario_id", "class_id")


def norm(df: DataFrame) -> DataFrame:
    """Classes rescaled to their bin's total where they sum to something else."""
    s = F.sum("value").over(W.partitionBy(*BIN))
    return df.withColumn("value", F.when((s > 0) & (F.abs(s - F.col("total")) > 1e-9), F.col("total") * F.col("value") / s).otherwise(F.col("value")))


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    """a + b or a - b over the union of the classes, a missing class counting 0."""
    ta, tb = (x.groupBy(*BIN).agg(F.max("total").alias(n)) for x, n in ((a, "ta"), (b, "tb")))
    both = a.where("class_id is not null").select(*KEYS, F.col("value").alias("va")).join(b.where("class_id is not null").select(*KEYS, F.col("value").alias("vb")), KEYS, "full")
    out = both.join(ta.join(tb, BIN), BIN)
    return norm(out.select(*KEYS, (F.col("ta") + sign * F.col("tb")).alias("total"), (F.coalesce("va", F.lit(0.0)) + sign * F.coalesce("vb", F.lit(0.0))).alias("value")))


def times(classed: DataFrame, other: DataFrame) -> DataFrame:
    """The classed side by the other's total."""
    t = other.groupBy(*BIN).agg(fin(F.max("total")).alias("t"))
    return classed.join(t, BIN).select(*KEYS, (F.col("total") * F.col("t")).alias("total"), (F.col("value") * F.col("t")).alias("value"))


def over(classed: DataFrame, other: DataFrame) -> DataFrame:
    """The left side's classes scaled as its total is."""
    t = other.groupBy(*BIN).agg(F.max("total").alias("t"))
    total = safe_div("total", "t")
    scaled = F.when(F.abs(F.col("total")) < 1e-9, 0.0).otherwise(F.col("value") * F.try_divide(total, F.col("total")))
    return classed.join(t, BIN).select(*KEYS, total.alias("total"), scaled.alias("value"))


def shifted(a: DataFrame, lag: int) -> DataFrame:
    return a.select(*KEYS, shift("total", lag, SERIES).alias("total"), shift("value", lag, SERIES).alias("value"))


def convolved(a: DataFrame, kernel: list[float]) -> DataFrame:
    return a.select(*KEYS, convolve("total", kernel, SERIES).alias("total"), convolve("value", kernel, SERIES).alias("value"))


def chosen(a: DataFrame, b: DataFrame, least: bool = True) -> DataFrame:
    """MIN or MAX: the classes of the side that gives the result, scaled to it. The left side comes first if both do, and
    a side with classes before one without."""
    pick = F.least if least else F.greatest
    ta, tb = (x.groupBy(*BIN).agg(F.max("total").alias(f"t{n}"), F.count("class_id").alias(f"n{n}")) for x, n in ((a, "a"), (b, "b")))
    result = pick("ta", "tb")
    left = F.when(F.col("na") == 0, False).when(F.col("nb") == 0, True).otherwise((F.abs(F.col("ta") - result) < 1e-9) | (F.abs(F.col("tb") - result) >= 1e-9))
    bins = ta.join(tb, BIN).select(*BIN, result.alias("result"), left.alias("left"))
    rows = a.join(bins, BIN).where("left").select(*KEYS, "result", "value").unionByName(b.join(bins, BIN).where("not left").select(*KEYS, "result", "value"))
    s = F.sum("value").over(W.partitionBy(*BIN))
    value = F.when(F.col("result") <= 0, 0.0).otherwise(safe_div(F.col("result") * F.col("value"), s))
    return norm(rows.where("class_id is not null").select(*KEYS, F.col("result").alias("total"), value.alias("value")))


def clamped(a: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """CLAMP by MIN with the upper bound, then MAX with the lower one."""
    return chosen(chosen(a, high), low, least=False)


def pulsed(amplitude: DataFrame, period: int, phase: int = 0) -> DataFrame:
    """PULSE of a classed amplitude: total and classes at its bins, 0 elsewhere."""
    on = fires(F.col("bin"), period, phase)
    return amplitude.select(*KEYS, F.when(on, F.col("total")).otherwise(0.0).alias("total"), F.when(on, F.col("value")).otherwise(0.0).alias("value"))


def each(a: DataFrame, f: str) -> DataFrame:
    """FLOOR, CEIL or ROUND of total and classes alike; classes need not sum to the total then."""
    fn = {"floor": floor, "ceil": ceil, "round": round_away}[f]
    return a.select(*KEYS, fn("total").alias("total"), fn("value").alias("value"))


def remainder(a: DataFrame, divisor: float) -> DataFrame:
    zero = F.lit(0.0)
    f = lambda x: zero if abs(divisor) <= 1e-9 else floored_mod(x, divisor)
    return norm(a.select(*KEYS, f("total").alias("total"), f("value").alias("value")))


def queued(inflow: DataFrame, outflow: DataFrame, init: float = 0.0) -> DataFrame:
    """Backlog by class: each class's own queue, made to sum to the whole's. A class starts with its part of the initial
    depth by the first inflow (evenly if nothing flows in); an initial depth of nothing is taken to be that inflow."""
    rows = inflow.select(*KEYS, F.col("total").alias("ti"), F.col("value").alias("vi")).join(outflow.select(*KEYS, F.col("total").alias("to"), F.col("value").alias("vo")), KEYS)
    first = F.when(F.col("bin") == 0, F.greatest(fin("vi"), F.lit(0.0)))
    begin, mine = F.sum(first).over(W.partitionBy("scenario_id")), F.max(first).over(W.partitionBy(*SERIES))
    classes = F.size(F.collect_set("class_id").over(W.partitionBy("scenario_id")))
    depth = F.lit(float(init)) if abs(init) >= 1e-9 else begin
    rows = rows.withColumn("start", F.when(begin > 0, depth * mine / begin).otherwise(F.lit(float(init)) / classes))
    whole = queue_depth(rows, F.col("ti"), F.col("to"), init, "total", SERIES)
    return norm(queue_depth(whole, F.col("vi"), F.col("vo"), F.col("start"), "value", SERIES).select(*KEYS, "total", "value"))


def gated(a: DataFrame, allowed: Column) -> DataFrame:
    """An outflow that a schedule cuts to `allowed`: classes scale alike."""
    return a.select(*KEYS, allowed.alias("total"), (F.col("value") * safe_div(allowed, "total")).alias("value"))


def first_of(*given: DataFrame) -> DataFrame:
    """Classes from several makers (scenario_id, bin, class_id, total, value); of each key the first one that has it counts."""
    ranked = [df.select(*KEYS, "total", "value", F.lit(i).alias("rank")) for i, df in enumerate(given)]
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df)
    best = rows.groupBy(*KEYS).agg(F.min_by(F.struct("total", "value"), "rank").alias("x"))
    return best.select(*KEYS, "x.total", "x.value")
