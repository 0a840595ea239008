"""Operators over the bins of a series: shift, convolution, queues, gates, feedback, streaks, carry-forward.

`keys` name what a series belongs to (scenario, entity, class); windows are always partitioned by them, so a plan scales
with the number of series. All operators that share keys share one exchange and one sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arith import fin, fires

KEYS, CHUNK = ("scenario_id",), 128


def along(keys: Sequence[str] = KEYS, order: str = "bin"):
    return W.partitionBy(*keys).orderBy(order)


def so_far(keys: Sequence[str] = KEYS, order: str = "bin"):
    return along(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def shift(x: Column | str, lag: int, keys: Sequence[str] = KEYS) -> Column:
    """x of `lag` bins before, 0 before the start."""
    if lag < 0:
        raise ValueError("a lag is not negative")
    x = F.col(x) if isinstance(x, str) else x
    return F.lag(x, lag, 0.0).over(along(keys)) if lag else x


def lagged_or_null(x: str, lag: int, keys: Sequence[str] = KEYS) -> Column:
    return F.lag(x, lag).over(along(keys))


def convolve(x: Column | str, kernel: Sequence[float], keys: Sequence[str] = KEYS) -> Column:
    """Causal convolution of the finite values of x."""
    total, x = F.lit(0.0), fin(x)
    for i, k in enumerate(kernel):
        if k:
            total = total + F.lit(float(k)) * shift(x, i, keys)
    return total


def echo(x: Column | str, kernel: Sequence[float], keys: Sequence[str] = KEYS) -> Column:
    """convolve(), but null where no finite value of x contributes: bins whose weights meet only nulls, NaN or no bin."""
    x = F.col(x) if isinstance(x, str) else x
    sample = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    lags = [(float(k), F.lag(sample, i).over(along(keys)) if i else sample) for i, k in enumerate(kernel) if k]
    if not lags:
        return F.lit(None).cast("double")
    total = sum((F.lit(k) * F.coalesce(v, F.lit(0.0)) for k, v in lags), F.lit(0.0))
    return F.when(F.coalesce(*[v for _, v in lags]).isNotNull(), total)


def queue_depth(df: DataFrame, inflow: Column, outflow: Column, init: Column | float = 0.0, name: str = "queue", keys: Sequence[str] = KEYS) -> DataFrame:
    """Q[t] = max(0, Q[t-1] + in - out). Two cumulative windows over one sort: S less the lowest S so far, if below 0."""
    run = F.sum(fin(inflow) - fin(outflow)).over(so_far(keys))
    start = init if isinstance(init, Column) else F.lit(float(init))
    out = df.withColumn("_s", start + run)
    return out.withColumn(name, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(so_far(keys))) + 0.0).drop("_s")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(df: DataFrame, inputs: dict[str, Column], start: dict[str, Column], step: Callable[[Column, Callable[[str], Column]], dict[str, Column] | Column], outputs: dict[str, str], keys: Sequence[str] = KEYS, kinds: dict[str, str] | None = None) -> DataFrame:
    """A recurrence as a fold over each series' bins, by Spark's own functions: step(state, x) gives each part of the new
    state (or a struct of them) from the state before and from the bin's columns (x of an input's name, or of "bin"); outputs name parts of the
    state as columns, of type double or what kinds says. One array per series (10 000 bins at most in a grid) carries all other columns along, so df is
    read once and nothing is joined back. Results are gathered in chunks of CHUNK bins, so that no long array is copied
    for every bin. Columns must be of types that can be ordered."""
    names = list(outputs.values())
    others = [c for c in df.columns if c not in keys and c not in names and c != "bin"]
    packed = df.withColumns({f"_in_{k}": c for k, c in inputs.items()}).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", *others, *[f"_in_{k}" for k in inputs]))).alias("_x"))
    of = lambda n: (kinds or {}).get(n, "double")
    kind = f"array<struct<{','.join(f'{n}:{of(n)}' for n in names)}>>"
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_x") - 1) / CHUNK).cast("int")), lambda i: F.slice(F.col("_x"), i * CHUNK + 1, CHUNK))

    def one(t: Column, x: Column) -> Column:
        after = step(t["s"], lambda n: x["bin"] if n == "bin" else x[f"_in_{n}"])
        after = after if isinstance(after, Column) else F.struct(*[c.alias(k) for k, c in after.items()])
        return let(after, lambda n: F.struct(n.alias("s"), F.concat(t["got"], F.array(F.struct(*[n[k].cast(of(v)).alias(v) for k, v in outputs.items()]))).alias("got")))

    def some(t: Column, chunk: Column) -> Column:
        walked = F.aggregate(chunk, F.struct(t["s"].alias("s"), F.array().cast(kind).alias("got")), one)
        return let(walked, lambda w: F.struct(w["s"].alias("s"), F.concat(t["got"], F.array(w["got"])).alias("got")))

    seed = F.struct(F.struct(*[c.alias(k) for k, c in start.items()]).alias("s"), F.array().cast(f"array<{kind}>").alias("got"))
    walked = packed.select(*keys, "_x", F.flatten(F.aggregate(chunks, seed, some, lambda t: t["got"])).alias("_r"))
    rows = walked.select(*keys, F.inline(F.arrays_zip("_x", "_r")))
    return rows.select(*[c if c in keys else F.col(f"_x.{c}") for c in df.columns if c not in names], *[f"_r.{n}" for n in names])


def queue_with_limit(df: DataFrame, inflow: str, outflow: str, limit: Column | float, init: float = 0.0, name: str = "queue", overflow: str = "overflow", keys: Sequence[str] = KEYS) -> DataFrame:
    """A queue that holds `limit` at most; what is beyond it is the overflow of the bin. A limit that is not finite is none."""
    bound = limit if isinstance(limit, Column) else F.lit(float(limit))
    cap = F.when(bound.isNull() | F.isnan(bound), F.lit(float("inf"))).otherwise(F.greatest(bound, F.lit(0.0)))

    def step(a: Column, x: Callable[[str], Column]) -> dict[str, Column]:
        free = F.greatest(F.lit(0.0), a["q"] + x("i") - x("o"))
        return {"q": F.least(free, x("cap")), "over": F.greatest(F.lit(0.0), free - x("cap"))}

    return fold(df, {"i": fin(inflow), "o": fin(outflow), "cap": cap}, {"q": F.lit(float(init)), "over": F.lit(0.0)}, step, {"q": name, "over": overflow}, keys)


def gate(x: Column | str, period: int, phase: int = 0, capacity: Column | None = None, at: Column | None = None) -> Column:
    """Outflow through a schedule: only at its bins (at: the bin, else the column), up to the capacity where that is finite."""
    x = fin(x)
    through = x if capacity is None else F.when(capacity.isNull() | F.isnan(capacity), x).otherwise(F.least(x, capacity))
    return F.when(fires(F.col("bin") if at is None else at, period, phase % period), through).otherwise(0.0)


def back_pressure(df: DataFrame, arrivals: str, served: str, capacity: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Arrivals throttled by how full the queue was a bin before: columns queue and effective."""

    def step(a: Column, x: Callable[[str], Column]) -> dict[str, Column]:
        through = x("i") * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), a["q"] / float(capacity))))
        return {"q": F.greatest(F.lit(0.0), a["q"] + through - x("o")), "e": through}

    return fold(df, {"i": fin(arrivals), "o": fin(served)}, {"q": F.lit(0.0), "e": F.lit(0.0)}, step, {"q": "queue", "e": "effective"}, keys)


def carry_forward(x: Column, keys: Sequence[str] = KEYS) -> Column:
    """The last value so far that is not null."""
    return F.last(x, ignorenulls=True).over(so_far(keys))


def between(df: DataFrame, start: int, end: int, most: int = 500) -> DataFrame:
    """Bins start..end. Applied after windows, which need the bins before."""
    if not 0 <= start <= end or end - start + 1 > most:
        raise ValueError(f"a range has 1 to {most} bins")
    return df.where(F.col("bin").between(start, end))


def longest_streaks(df: DataFrame, holds: dict[str, Column], keys: Sequence[str] = KEYS, least: int = 3) -> DataFrame:
    """Per key and name the longest run of bins at which the named condition is true, the first of equals, if it has
    `least` bins or more: rows (keys, name, start_bin, end_bin, length). One pass over df for all conditions."""
    flags = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in holds.items()]), lambda x: x["holds"])
    true = df.select(*keys, "bin", F.explode(flags).alias("_f")).select(*keys, "bin", F.col("_f.name").alias("name"))
    by = [*keys, "name"]
    runs = true.withColumn("_g", F.col("bin") - F.row_number().over(along(by))).groupBy(*by, "_g").agg(F.min("bin").alias("start_bin"), F.max("bin").alias("end_bin"), F.count("*").alias("length"))
    best = runs.groupBy(*by).agg(F.max_by(F.struct("start_bin", "end_bin", "length"), F.struct("length", -F.col("start_bin"))).alias("_b"))
    return best.select(*by, "_b.*").where(F.col("length") >= least)


def longest_streak(df: DataFrame, holds: Column, keys: Sequence[str] = KEYS, least: int = 3) -> DataFrame:
    return longest_streaks(df, {"": holds}, keys, least).drop("name")


def growth_streak(df: DataFrame, x: str, keys: Sequence[str] = KEYS, least: int = 3) -> DataFrame:
    """The longest run of increases; it starts at the bin before the first of them."""
    grown = df.withColumn("_d", F.col(x) - F.lag(x).over(along(keys)))
    return longest_streak(grown, F.col("_d") > 0, keys, least).withColumn("start_bin", F.col("start_bin") - 1)


def stationarity(df: DataFrame, x: str, keys: Sequence[str] = KEYS, tolerance: float = 0.25, least: int = 4) -> DataFrame:
    """Means of both halves of a series and whether they differ by more than the tolerance of the larger."""
    halves = df.select(*keys, "bin", x, F.count("*").over(W.partitionBy(*keys)).alias("n")).where(F.col("n") >= least)
    first, second = F.avg(F.when(F.col("bin") < F.floor(F.col("n") / 2), F.col(x))), F.avg(F.when(F.col("bin") >= F.floor(F.col("n") / 2), F.col(x)))
    out = halves.groupBy(*keys).agg(first.alias("first_mean"), second.alias("second_mean"))
    top = F.greatest(F.abs("first_mean"), F.abs("second_mean"))
    return out.withColumn("non_stationary", F.coalesce(F.try_divide(F.abs(F.col("first_mean") - F.col("second_mean")), top) > tolerance, F.lit(False)))
