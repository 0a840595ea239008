"""Parameter analyses: many scenarios of a model in one job. Only the few numbers of a search's next step reach the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compiler import evaluate
from .model import ModelError, nodes_of

Points = Sequence[dict[str, float]]
Evaluator = Callable[[Points], list[float]]


def scenario_rows(spark: SparkSession, points: Points) -> DataFrame:
    rows = [(i, s, None, float(v)) for i, p in enumerate(points) for s, v in p.items()]
    return spark.createDataFrame(rows, "scenario_id long, series string, bin long, value double")


def sweep(spark: SparkSession, model: dict, parameter: str, values: Sequence[float], series: Sequence[str] | None = None) -> DataFrame:
    """The model once per value of a constant: (scenario_id, parameter_value, bin, series...)."""
    if nodes_of(model).get(parameter, {}).get("kind", "const") != "const" or parameter not in nodes_of(model):
        raise ModelError(f"{parameter} is not a constant of the model")
    rows = scenario_rows(spark, [{parameter: v} for v in values])
    df = evaluate(spark, model, rows).join(F.broadcast(rows.select("scenario_id", F.col("value").alias("parameter_value"))), "scenario_id")
    return df.select("scenario_id", "parameter_value", "bin", *series) if series else df


def sweep_frame(base: DataFrame, values: DataFrame) -> DataFrame:
    """A frame of data once per row of values (scenario_id, ...), which is as small as the sweep."""
    return base.drop("scenario_id").crossJoin(F.broadcast(values))


def means(spark: SparkSession, model: dict, metric: str) -> Evaluator:
    """Evaluates points (parameter values) in one job: each one's mean of a series over bins, 0 if there is none."""

    def run(points: Points) -> list[float]:
        df = evaluate(spark, model, scenario_rows(spark, points))
        if metric not in df.columns:
            return [0.0] * len(points)
        got = {r.scenario_id: r.m for r in df.groupBy("scenario_id").agg(F.avg(metric).alias("m")).collect()}  # a row per point
        return [got.get(i) or 0.0 for i in range(len(points))]

    return run


def sensitivity(spark: SparkSession, model: dict, metric: str, parameters: Sequence[str], part: float = 0.05) -> DataFrame:
    """Central differences of a metric's mean by each constant, the steepest first; one job of two scenarios each."""
    bases = {p: float(nodes_of(model)[p]["values"][0]) for p in parameters if nodes_of(model).get(p, {}).get("kind", "") == "const"}
    moving = [p for p, b in bases.items() if b]
    got = means(spark, model, metric)([{p: bases[p] * (1 + s * part)} for p in moving for s in (-1, 1)]) if moving else []
    rows = [(p, bases[p], (got[2 * i + 1] - got[2 * i]) / (2 * part * bases[p])) for i, p in enumerate(moving)] + [(p, 0.0, 0.0) for p in bases if p not in moving]
    return spark.createDataFrame(rows, "parameter string, base double, gradient double").orderBy(F.abs("gradient").desc(), "parameter")


def goal_seek(at: Callable[[Sequence[float]], list[float]], target: float, low: float, high: float, tolerance: float = 1e-6, most: int = 50, depth: int = 3) -> dict:
    """The value between low and high at which a monotone metric meets a target, by bisection.

    `at` evaluates many values in one job: the 2 ** depth - 1 midpoints that the next `depth` halvings can reach are
    evaluated together, then walked."""
    f_low, f_high = at([low, high])
    trace: list[tuple[float, float, float, float]] = []
    for x, f in ((low, f_low), (high, f_high)):
        if abs(f - target) <= tolerance:
            return {"value": x, "metric": f, "converged": True, "iterations": 0, "trace": trace}
    if (f_low - target) * (f_high - target) > 0:
        x, f = min(((low, f_low), (high, f_high)), key=lambda p: abs(p[1] - target))
        return {"value": x, "metric": f, "converged": False, "iterations": 0, "trace": trace}
    rising = f_low < f_high
    x, f = low, f_low
    while len(trace) < most:
        points, spans = [], [(low, high)]
        for _ in range(depth):
            points += [(a + b) / 2 for a, b in spans]
            spans = [half for a, b in spans for half in ((a, (a + b) / 2), ((a + b) / 2, b))]
        known = dict(zip(points, at(points), strict=True))
        for _ in range(depth):
            x = (low + high) / 2
            f = known[x]
            if (f < target) == rising:
                low = x
            else:
                high = x
            trace.append((x, f, low, high))
            if abs(f - target) <= tolerance or len(trace) == most:
                return {"value": x, "metric": f, "converged": abs(f - target) <= tolerance, "iterations": len(trace), "trace": trace}
    return {"value": x, "metric": f, "converged": False, "iterations": len(trace), "trace": trace}


def optimise(at: Evaluator, bounds: dict[str, tuple[float, float]], maximise: bool = False, tolerance: float = 1e-4, most: int = 200) -> dict:
    """Bounded Nelder-Mead. A step's candidates (reflection, expansion, both contractions) are evaluated in one job."""
    names = sorted(bounds)
    sign = -1.0 if maximise else 1.0
    held = lambda x: [min(max(v, bounds[n][0]), bounds[n][1]) for v, n in zip(x, names, strict=True)]
    score = lambda xs: [sign * v for v in at([dict(zip(names, x, strict=True)) for x in xs])]
    middle = [(bounds[n][0] + bounds[n][1]) / 2 for n in names]
    points = [middle] + [held([v + (0.05 * (bounds[n][1] - bounds[n][0]) if n == m else 0) for v, n in zip(middle, names, strict=True)]) for m in names]
    simplex = sorted(zip(score(points), points, strict=True))
    trace = []
    for step in range(most):
        spread = max(math.dist(simplex[0][1], p) for _, p in simplex)
        if abs(simplex[-1][0] - simplex[0][0]) <= tolerance and spread <= tolerance * max(1.0, max(map(abs, simplex[0][1]))):
            break
        centre = [sum(p[i] for _, p in simplex[:-1]) / (len(simplex) - 1) for i in range(len(names))]
        worst = simplex[-1]
        along = lambda k, c=centre, w=worst[1]: held([a + k * (a - b) for a, b in zip(c, w, strict=True)])
        tried = [along(1.0), along(2.0), along(0.5), along(-0.5)]
        reflect, expand, outside, inside = zip(score(tried), tried, strict=True)
        if simplex[0][0] <= reflect[0] < simplex[-2][0]:
            new = reflect
        elif reflect[0] < simplex[0][0]:
            new = min(expand, reflect)
        else:
            new = min(outside, inside)
        if new[0] < worst[0]:
            simplex = sorted([*simplex[:-1], new])
        else:
            shrunk = [[(a + b) / 2 for a, b in zip(simplex[0][1], p, strict=True)] for _, p in simplex[1:]]
            simplex = sorted([simplex[0], *zip(score(shrunk), shrunk, strict=True)])
        trace.append((step + 1, sign * simplex[0][0], dict(zip(names, simplex[0][1], strict=True))))
    return {"value": sign * simplex[0][0], "parameters": dict(zip(names, simplex[0][1], strict=True)), "iterations": len(trace), "trace": trace}


class Session:
    """A compiled model that is evaluated again and again under overrides."""

    def __init__(self, spark: SparkSession, model: dict) -> None:
        from .compiler import plan

        self.spark, self.model, self.levels = spark, model, plan(model)
        self.last: DataFrame | None = None

    def parameters(self) -> dict[str, float]:
        return {i: float(n["values"][0]) for i, n in nodes_of(self.model).items() if n.get("kind", "const") == "const"}

    def eval(self, **overrides: float) -> DataFrame:
        if self.last is not None:
            self.last.unpersist()
        self.last = evaluate(self.spark, self.model, scenario_rows(self.spark, [overrides]) if overrides else None).persist()
        return self.last

    def series(self, name: str) -> DataFrame:
        return (self.last if self.last is not None else self.eval()).select("bin", name)
