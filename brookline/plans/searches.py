"""Searches for every entity of a frame of data at once: sensitivity, goal seeking and bounded Nelder-Mead.

A search's state is a row per entity. In a round each unsettled entity's next points join its data, the model is evaluated
for all of them in one job, and native Columns walk each row on; entities that have settled leave. The driver sees how
many are left, nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import let
from ..sources.shared import cut
from .compiler import evaluate
from .model import ModelError, nodes_of


def mean_at(model: dict, data: DataFrame, points: DataFrame, keys: Sequence[str], parameters: Sequence[str], metric: str) -> DataFrame:
    """points (keys..., point, parameters...) with `mean`: the metric's mean over the bins of the entity's data (its finite
    ones; 0 if there are none). Each point is a run of the model, all in one job."""
    if bad := [p for p in parameters if nodes_of(model).get(p, {}).get("kind", "const" if p in nodes_of(model) else "") != "const"]:
        raise ModelError(f"{bad[0]} is not a constant of the model")
    rows = data.drop(*parameters).join(points, list(keys))
    done = evaluate(data.sparkSession, model, data=rows, keys=[*keys, "point"])
    if metric not in done.columns:
        raise ModelError(f"the model makes no series {metric}")
    means = done.groupBy(*keys, "point").agg(F.avg(metric).alias("mean"))
    return points.join(means, [*keys, "point"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def sensitivity_each(model: dict, data: DataFrame, keys: Sequence[str], bases: DataFrame, metric: str, part: float = 0.05) -> DataFrame:
    """Rows (keys..., parameter, base, gradient, rank): central differences of the metric's mean by each column of bases (keys...,
    parameters...), steepest first; 0 where the base is 0. One job of two runs per entity and parameter."""
    names = [c for c in bases.columns if c not in keys]
    sides = [(i, p, s) for i, p in enumerate(names) for s in (-1, 1)]
    moved = [F.struct(F.lit(2 * i + (s > 0)).alias("point"), *[(F.col(n) * F.lit(1 + s * part) if n == p else F.col(n)).cast("double").alias(n) for n in names]) for i, p, s in sides]
    points = bases.select(*keys, F.explode(F.array(*moved)).alias("_p")).select(*keys, "_p.*")
    got = mean_at(model, data, points, keys, names, metric)
    pair = got.groupBy(*keys, F.floor(F.col("point") / 2).cast("int").alias("i")).agg(F.max(F.when(F.col("point") % 2 == 1, F.col("mean"))).alias("up"), F.max(F.when(F.col("point") % 2 == 0, F.col("mean"))).alias("down"))
    long = bases.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("parameter"), F.col(p).cast("double").alias("base")) for i, p in enumerate(names)])).alias("_b")).select(*keys, "_b.*")
    # Both perturbed values are made as the runs had them, so that the difference is between the very points.
    width = F.col("base") * F.lit(1 + part) - F.col("base") * F.lit(1 - part)
    slope = F.when(F.col("base") == 0, 0.0).otherwise(F.try_divide(F.col("up") - F.col("down"), width))
    order = F.array_sort(F.collect_list(F.struct((-F.abs("gradient")).alias("k"), "parameter", "base", "gradient")))
    ranked = long.join(pair, [*keys, "i"]).withColumn("gradient", slope).groupBy(*keys).agg(order.alias("_r"))  # a row per parameter
    return ranked.select(*keys, F.posexplode("_r").alias("rank", "_x")).select(*keys, "_x.parameter", "_x.base", "_x.gradient", (F.col("rank") + 1).alias("rank"))


def _by_point(got: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per entity with an array `means` in the order of its points, which are as few as a round has."""
    rows = got.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("point", "mean"))).alias("_m"))
    return rows.select(*keys, F.transform("_m", lambda x: x["mean"]).alias("means"))


def goal_seek_each(model: dict, data: DataFrame, keys: Sequence[str], goals: DataFrame, parameter: str, metric: str, tolerance: float = 1e-6, most: int = 50, depth: int = 3) -> DataFrame:
    """Rows (keys..., value, mean, converged, iterations, low, high): by bisection, for every row of goals (keys..., target, low, high)
    the value at which the metric's mean meets the target. Ends that meet it are taken as they are; where both ends lie on one
    side of the target, the closer one is given, not converged. A round evaluates the 2 ** depth - 1 midpoints that
    the next `depth` halvings can reach."""
    size = (1 << depth) - 1
    ends = goals.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.col(c).cast("double").alias(parameter)) for i, c in enumerate(("low", "high"))])).alias("_p")).select(*keys, "_p.*")
    data = cut(data)  # every round reads it
    start = goals.join(_by_point(mean_at(model, data, ends, keys, [parameter], metric), keys), list(keys))
    off = [F.col("means")[i] - F.col("target") for i in (0, 1)]
    met = [F.abs(x) < tolerance for x in off]
    same = F.signum(off[0]) == F.signum(off[1])
    first = F.when(met[0], True).when(met[1], False).when(same, F.abs(off[0]) <= F.abs(off[1]))  # whether the lower end is the answer
    state = start.select(
        *keys, F.col("target").cast("double").alias("target"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.signum(off[0]).alias("sign"), F.when(first, F.col("low")).otherwise(F.col("high")).cast("double").alias("value"),
        F.when(first, F.col("means")[0]).otherwise(F.col("means")[1]).alias("mean"), (met[0] | met[1]).alias("converged"), (met[0] | met[1] | same).alias("settled"), F.lit(0).alias("iterations"),
    )
    state = cut(state)

    def midpoints(low: Column, high: Column) -> Column:
        """The midpoints as a heap: below place i are 2 * i of the lower half and 2 * i + 1 of the upper one."""
        spans: list[tuple[Column, Column]] = [(low, high)]
        out: list[Column] = []
        for _ in range(depth):
            halves = []
            for a, b in spans:
                out.append((a + b) / 2)
                halves += [(a, out[-1]), (out[-1], b)]
            spans = halves
        return F.array(*out)

    def walk(s: Column, means: Column) -> Column:
        def one(t: Column, _: Column) -> Column:
            def at(middle: Column) -> Column:
                mean = F.get(means, t["place"] - 1)
                hit = F.abs(mean - t["target"]) < tolerance
                up = ~hit & (F.signum(mean - t["target"]) == t["sign"])  # the lower end moves up
                n = t["iterations"] + 1
                moved = F.struct(
                    t["target"].alias("target"), F.when(up, middle).otherwise(t["low"]).alias("low"), F.when(~hit & ~up, middle).otherwise(t["high"]).alias("high"), t["sign"].alias("sign"), middle.alias("value"), mean.alias("mean"),
                    hit.alias("converged"), (hit | (n >= most)).alias("settled"), n.alias("iterations"), (t["place"] * 2 + up.cast("int")).alias("place"),
                )
                return F.when(t["settled"], t).otherwise(moved)

            return let((t["low"] + t["high"]) / 2, at)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), s, one)

    fields = ["target", "low", "high", "sign", "value", "mean", "converged", "settled", "iterations"]
    finished = [state.where("settled")]
    for _ in range(-(-most // depth)):
        state = state.where("not settled")
        if state.isEmpty():
            break
        points = state.select(*keys, F.posexplode(midpoints(F.col("low"), F.col("high"))).alias("point", parameter))
        got = _by_point(mean_at(model, data, points, keys, [parameter], metric), keys)
        here = F.struct(*[F.col(c) for c in fields], F.lit(1).alias("place"))
        state = cut(state.join(got, list(keys)).select(*keys, walk(here, F.slice("means", 1, size)).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in fields]))
        finished.append(state.where("settled"))
    return reduce(DataFrame.unionByName, finished).select(*keys, "value", "mean", "converged", "iterations", "low", "high")


def optimise_each(model: dict, data: DataFrame, keys: Sequence[str], entities: DataFrame, bounds: dict[str, tuple[float, float]], metric: str, maximise: bool = False, tolerance: float = 1e-4, most: int = 200) -> DataFrame:
    """Rows (keys..., parameters..., mean, converged, iterations): by Nelder-Mead within bounds, for every entity (keys...) the values that
    make the metric's mean least (or greatest). It begins at the middle of the bounds and, for each parameter, at 5 % of
    its range beside it, and ends when the best and the worst point differ by less than the tolerance. A round evaluates
    all that its step can ask for: reflection, expansion, both contractions and the shrunk simplex."""
    names, sign = sorted(bounds), -1.0 if maximise else 1.0
    n = len(names)
    low, high = [float(bounds[p][0]) for p in names], [float(bounds[p][1]) for p in names]
    middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    first = [middle] + [[min(max(v + (0.05 * (high[d] - low[d]) if d == i else 0.0), low[d]), high[d]) for d, v in enumerate(middle)] for i in range(n)]
    vertex = "struct<f:double,i:int,x:array<double>>"

    def evaluated(rows: DataFrame, tried: Column) -> DataFrame:
        """rows with means, in the order of the arrays of values in `tried`."""
        points = rows.select(*keys, F.posexplode(tried).alias("point", "_x")).select(*keys, "point", *[F.col("_x")[d].alias(p) for d, p in enumerate(names)])
        return rows.join(_by_point(mean_at(model, data, points, keys, names, metric), keys), list(keys))

    def ordered(points: Column) -> Column:
        """Vertices by value; of equal ones the one that was before."""
        return F.array_sort(F.transform(points, lambda v, k: F.struct(v["f"].alias("f"), k.alias("i"), v["x"].alias("x"))))

    data = cut(data)  # every round reads it
    begin = F.array(*[F.array(*map(F.lit, x)) for x in first])
    start = evaluated(entities.select(*keys).distinct(), begin)
    simplex = ordered(F.zip_with(begin, "means", lambda x, f: F.struct((F.lit(sign) * f).alias("f"), F.lit(0).alias("i"), x.alias("x"))))
    state = cut(start.select(*keys, simplex.cast(f"array<{vertex}>").alias("s"), F.lit(0).alias("iterations")).withColumn("settled", F.col("s")[n]["f"] - F.col("s")[0]["f"] < tolerance))
    finished = [state.where("settled")]

    def held(d: int, x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(low[d])), F.lit(high[d]))

    def candidates() -> Column:
        s, worst = F.col("s"), F.col("s")[n]["x"]
        centre = [sum((s[i]["x"][d] for i in range(n)), F.lit(0.0)) / n for d in range(n)]
        along = lambda k: F.array(*[held(d, centre[d] + F.lit(k) * (centre[d] - worst[d])) for d in range(n)])
        shrunk = [F.array(*[held(d, s[0]["x"][d] + 0.5 * (s[i]["x"][d] - s[0]["x"][d])) for d in range(n)]) for i in range(1, n + 1)]
        return F.array(along(1.0), along(2.0), along(0.5), along(-0.5), *shrunk)

    for _ in range(most):
        state = state.where("not settled")
        if state.isEmpty():
            break
        tried = evaluated(state.withColumn("_t", candidates()), F.col("_t"))
        point = lambda k: F.struct((F.lit(sign) * F.col("means")[k]).alias("f"), F.lit(n).alias("i"), F.col("_t")[k].alias("x"))
        value = lambda k: F.lit(sign) * F.col("means")[k]
        best, second, worst = (F.col("s")[i]["f"] for i in (0, n - 1, n))
        new = (
            F.when(value(0) < best, F.when(value(1) < value(0), point(1)).otherwise(point(0)))
            .when(value(0) < second, point(0))
            .when(value(0) < worst, F.when(value(2) <= value(0), point(2)))
            .otherwise(F.when(value(3) < worst, point(3)))
        )
        replaced = F.concat(F.slice("s", 1, n), F.array(new))
        shrunk = F.concat(F.slice("s", 1, 1), F.array(*[point(4 + i) for i in range(n)]))
        moved = tried.select(*keys, ordered(F.when(new.isNotNull(), replaced).otherwise(shrunk).cast(f"array<{vertex}>")).cast(f"array<{vertex}>").alias("s"), (F.col("iterations") + 1).alias("iterations"))
        state = cut(moved.withColumn("settled", F.col("s")[n]["f"] - F.col("s")[0]["f"] < tolerance))
        finished.append(state.where("settled"))
    rows = reduce(DataFrame.unionByName, [*finished, state.where("not settled")])
    return rows.select(*keys, *[F.col("s")[0]["x"][d].alias(p) for d, p in enumerate(names)], (F.lit(sign) * F.col("s")[0]["f"]).alias("mean"), F.col("settled").alias("converged"), "iterations")
