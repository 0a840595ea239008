"""From a model to one DataFrame plan: series in order of dependence, one select per level of it.

The driver only orders names (graphlib); Catalyst plans the rest. A scenario table overrides constants, so that a whole
sweep is one job with scenario_id in every partition of a window."""

from __future__ import annotations

import graphlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import fin, safe_div
from ..functions.metrics import retry_kernel
from ..functions.rng import Pmf
from ..operators.series import convolve, fold, gate, let, queue_depth, queue_with_limit
from ..sources.shared import fresh
from . import class_vectors as cv
from .class_vectors import Step, arrivals_by_class, class_ids, class_series, is_vector, vector
from .expr import parse, reach, references, to_column, to_sql
from .model import UNIT_MS, ModelError, nodes_of, queue_series, schema_errors, snake, topology

KEYS = ("scenario_id",)
#: Scenarios whose overrides are sent to every task that has data.
MOST_SENT = 100_000


def steps_of(model: dict) -> list[Step]:
    out: list[Step] = []
    inflow_of: dict[str, str] = {}
    members: dict[str, list[dict]] = {}
    by_class = arrivals_by_class(model)
    routed = {x["target"] for n in nodes_of(model).values() if n.get("kind") == "router" for x in n["router"]["routes"]}
    for i, n in nodes_of(model).items():
        kind = n.get("kind", "const")
        if i in routed and kind != "router":
            continue  # what a router sends there takes the place of the node's own values
        if kind == "const":
            out.append(Step("const", [i], set(), spec={"values": list(map(float, n["values"]))}))
        elif kind == "pmf":
            out.append(Step("const", [i], set(), spec={"values": [Pmf(n["pmf"]["values"], n["pmf"]["probabilities"]).mean]}))
        elif kind == "expr":
            tree = parse(n["expr"])
            same, past = references(tree)
            out.append(Step("expr", [i], same, past, {"tree": tree}))
        elif kind == "router":
            r = n["router"]
            source, routes = r["inputs"]["queue"], r["routes"]
            if not any(x.get("classes") for x in routes) and sum(float(x.get("weight", 1)) for x in routes) <= 0:
                raise ModelError(f"{i}: the weights of its routes sum to nothing")
            named = [c for x in routes for c in x.get("classes") or []]
            if unknown := [c for c in named if c not in by_class.get(source, class_ids(model))]:
                raise ModelError(f"{i}: class {unknown[0]} is not among the traffic arrivals of {source}")
            needs = {source, *(class_series(source, c) for c in named if source in by_class), *({vector(source)} if named and source not in by_class else ())}
            out.append(Step("router", list(dict.fromkeys(x["target"] for x in routes)), needs, spec={"source": source, "routes": routes, "ids": class_ids(model)}))
    for node, rates in by_class.items():
        out += [Step("const", [class_series(node, c)], set(), spec={"values": [v]}) for c, v in rates.items() if class_series(node, c) not in nodes_of(model)]
    for t in topology(model, "nodes"):
        s = t.get("semantics") or {}
        for c in t.get("constraints") or []:
            members.setdefault(c, []).append(t)
        failed = s.get("failures") or s.get("errors")
        if failed and s.get("retryEcho") and s["retryEcho"] not in nodes_of(model):
            kernel = retry_kernel(s.get("retryKernel"))[0]
            out.append(Step("expr", [s["retryEcho"]], {failed} if kernel[0] else set(), {failed}, {"column": (failed, kernel)}))
        if t.get("kind") == "sink" and s.get("arrivals") and s.get("served") and s["served"] not in nodes_of(model):
            out.append(Step("expr", [s["served"]], {s["arrivals"]}, spec={"tree": parse(s["arrivals"])}))  # a sink serves all that comes
        if t.get("kind") in ("serviceWithBuffer", "queue", "dlq") and s.get("arrivals"):
            inflow_of[t["id"]] = s["arrivals"]
    caps: dict[str, list[str]] = {}
    for c in topology(model, "constraints"):
        rows = [m for m in members.get(c["id"], []) if m["id"] in inflow_of]
        if rows:
            demand, cap = [inflow_of[m["id"]] for m in rows], c["semantics"]["served"]
            names = [f"{m['id']}__{c['id']}" for m in rows]
            out.append(Step("allocate", names, {*demand, cap}, spec={"demand": demand, "capacity": cap}))
            for m, name in zip(rows, names, strict=True):
                caps.setdefault(m["id"], []).append(name)
    into = {t["id"]: [u["id"] for u in topology(model, "nodes") if u.get("wipOverflow") == t["id"]] for t in topology(model, "nodes")}
    for t in topology(model, "nodes"):
        if t["id"] not in inflow_of:
            continue
        s, depth = t["semantics"], queue_series(t)
        sched, limit = t.get("dispatchSchedule"), t.get("wipLimit")
        spec = {
            "inflow": [inflow_of[t["id"]]], "caps": caps.get(t["id"], []), "over": [f"{u}__overflow" for u in into[t["id"]]], "out": s.get("served"), "loss": s.get("errors"),
            "init": float((t.get("initialCondition") or {}).get("queueDepth", 0)), "limit": limit, "schedule": sched, "capacity": (sched or {}).get("capacitySeries"),
        }
        needs = {*spec["inflow"], *spec["caps"], *spec["over"], *(x for x in (spec["out"], spec["loss"], spec["capacity"], limit if isinstance(limit, str) else None) if x)}
        makes = [depth, f"{t['id']}__overflow"] if limit is not None else [depth]
        out.append(Step("queue", makes, needs, spec=spec))
    return out


def plan(model: dict, with_classes: bool = False) -> list[list[Step]]:
    """Steps in levels; a level needs only what is before it. A cycle through lags alone is one step of kind "loop".
    with_classes adds the classes of all series; those that a router needs are there anyway."""
    if errors := schema_errors(model):
        raise ModelError("; ".join(errors))
    steps = steps_of(model)
    if with_classes or any(is_vector(x) for s in steps for x in s.needs):
        steps += cv.class_steps(model, steps, topology(model, "nodes"))
    maker = {m: i for i, s in enumerate(steps) for m in s.makes}
    for s in steps:
        if unknown := {x for x in s.needs | s.past if x not in maker}:
            raise ModelError(f"{', '.join(s.makes)} needs {', '.join(sorted(unknown))}, which nothing makes")
    # Reachability over all references finds the cycles that lags close.
    graph = {i: {maker[x] for x in s.needs | s.past} for i, s in enumerate(steps)}

    def reach(i: int) -> set[int]:
        seen, todo = set(), [i]
        while todo:
            for j in graph[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen

    reached = {i: reach(i) for i in graph}
    loops: dict[int, frozenset[int]] = {i: frozenset(j for j in reached[i] if i in reached[j]) for i in graph if i in reached[i]}
    merged: list[Step] = []
    home: dict[int, int] = {}
    for i, s in enumerate(steps):
        if i in home:
            continue
        ring = loops.get(i, frozenset([i]))
        for j in ring:
            home[j] = len(merged)
        if i not in loops:
            merged.append(s)
            continue
        inside = {m for j in ring for m in steps[j].makes}
        inner = graphlib.TopologicalSorter({j: {maker[x] for x in steps[j].needs if x in inside} for j in ring})
        try:
            order = list(inner.static_order())
        except graphlib.CycleError:
            raise ModelError(f"{', '.join(sorted(inside))} depend on each other within a bin") from None
        merged.append(Step("loop", sorted(inside), {x for j in ring for x in steps[j].needs | steps[j].past} - inside, spec={"steps": [steps[j] for j in order]}))
    maker = {m: i for i, s in enumerate(merged) for m in s.makes}
    sorter = graphlib.TopologicalSorter({i: {maker[x] for x in s.needs | s.past} for i, s in enumerate(merged)})
    sorter.prepare()
    levels = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        levels.append([merged[i] for i in ready])
        sorter.done(*ready)
    return levels


def _changing(steps: list[Step], given: set[str]) -> dict[str, list[float]]:
    """Constants whose value is not the same in all bins."""
    return {s.makes[0]: s.spec["values"] for s in steps if s.kind == "const" and s.makes[0] not in given and len(set(s.spec["values"])) > 1}


def _sum(names: list[str], at: Callable[[str], Column] = F.col) -> Column:
    out = F.lit(0.0)
    for n in names:
        out = out + fin(at(n))
    return out


def _columns(step: Step, at: Callable[[str], Column] = F.col, keys: Sequence[str] = KEYS) -> dict[str, Column]:
    """The Columns of a step that is a projection; at gives the series of the same bin."""
    if step.kind == "const":
        return {step.makes[0]: F.lit(step.spec["values"][0])}
    if step.kind == "expr":
        if "column" in step.spec:
            return {step.makes[0]: convolve(*step.spec["column"], keys)}
        return {step.makes[0]: F.expr(to_sql(step.spec["tree"], keys))}
    if step.kind == "router":
        routes, source, out = step.spec["routes"], step.spec["source"], {}
        explicit = lambda c: class_series(source, c) in step.needs
        own = lambda r: sum((fin(at(class_series(source, c)) if explicit(c) else at(vector(source))[step.spec["ids"].index(c)]) for c in r["classes"]), F.lit(0.0))
        by_class = [(r["target"], own(r)) for r in routes if r.get("classes")]
        weighted = [(r["target"], float(r.get("weight", 1))) for r in routes if not r.get("classes")]
        taken, total = sum((v for _, v in by_class), F.lit(0.0)), sum(w for _, w in weighted)
        for target in step.makes:
            fixed = sum((v for t, v in by_class if t == target), F.lit(0.0))
            w = sum(w for t, w in weighted if t == target)
            out[target] = fixed + ((at(source) - taken) * (w / total) if w else F.lit(0.0))
        return out
    demand = [F.when(fin(at(d)) > 0, fin(at(d))).otherwise(0.0) for d in step.spec["demand"]]
    total, cap = sum(demand[1:], demand[0]), at(step.spec["capacity"])
    return {n: F.when(cap <= 0, 0.0).when(total <= cap, d).otherwise(safe_div(cap * d, total)) for n, d in zip(step.makes, demand, strict=True)}


def _entering(spec: dict, at: Callable[[str], Column] = F.col) -> Column:
    """What a queue's constraints let in of its own inflow."""
    return F.least(*[at(c) for c in spec["caps"]], *[at(x) for x in spec["inflow"]]) if spec["caps"] else _sum(spec["inflow"], at)


def _flows(spec: dict, at: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """What enters a queue in a bin, and what leaves it. at gives the series of the same bin, and the bin."""
    own = _entering(spec, at)
    out = F.lit(0.0)
    if spec["out"]:
        cap = at(spec["capacity"]) if spec["capacity"] else None
        sched = spec["schedule"]
        out = gate(at(spec["out"]), int(sched["periodBins"]), int(sched.get("phaseOffset", 0)), cap, at("bin")) if sched else fin(at(spec["out"]))
    return own + _sum(spec["over"], at), out + (fin(at(spec["loss"])) if spec["loss"] else F.lit(0.0))


def _queue(df: DataFrame, step: Step, keys: Sequence[str]) -> DataFrame:
    s = step.spec
    inflow, gone = _flows(s)
    if s["limit"] is None:
        return queue_depth(df, inflow, gone, s["init"], step.makes[0], keys)
    df = df.withColumn("_i", inflow).withColumn("_o", gone)
    limit = F.col(s["limit"]) if isinstance(s["limit"], str) else float(s["limit"])
    return queue_with_limit(df, "_i", "_o", limit, s["init"], *step.makes, keys).drop("_i", "_o")


def _loop(df: DataFrame, step: Step, keys: Sequence[str]) -> DataFrame:
    """Series of a cycle that lags close, as one fold over the bins of each scenario. The state holds of each series that is
    looked back at its last values, as many as the greatest lag, nearest first."""
    steps, need = step.spec["steps"], sorted(step.needs)
    back: dict[str, int] = {}
    for s in steps:
        if s.kind == "classes":
            for n, k in _class_reach(s).items():
                back[n] = max(k, back.get(n, 0))
        elif s.kind == "queue":
            back[s.makes[0]] = max(1, back.get(s.makes[0], 0))
        elif s.kind == "expr":
            name, kernel = s.spec.get("column", (None, []))
            for n, k in ({name: len(kernel) - 1} if name else reach(s.spec["tree"])).items():
                back[n] = max(k, back.get(n, 0))
    back = {n: k for n, k in back.items() if k}

    def made_by(s: Step, now: dict[str, Column], past: Callable[[str, int], Column]) -> dict[str, Column]:
        if s.kind == "classes":
            value = lambda n: cv.Value(now[n], now[vector(n)] if n in s.spec["has"] and vector(n) in now else None)
            return cv.in_fold(s, value, past, lambda: _entering(s.spec["queue"], now.__getitem__))
        if s.kind == "expr":
            if "column" in s.spec:
                name, kernel = s.spec["column"]
                lagged = lambda i: F.when(past("bin", i) >= 0, past(name, i)).otherwise(0.0)
                return {s.makes[0]: sum((F.lit(float(k)) * fin(lagged(i)) for i, k in enumerate(kernel) if k), F.lit(0.0))}
            return {s.makes[0]: to_column(s.spec["tree"], past=past)}
        if s.kind != "queue":
            return _columns(s, now.__getitem__)
        inflow, gone = _flows(s.spec, now.__getitem__)
        before = F.when(now["bin"] > 0, past(s.makes[0], 1)).otherwise(float(s.spec["init"]))
        free = F.greatest(F.lit(0.0), before + inflow - gone)
        limit = s.spec["limit"]
        if limit is None:
            return {s.makes[0]: free}
        limit = now[limit] if isinstance(limit, str) else F.lit(float(limit))
        cap = F.when(limit.isNull() | F.isnan(limit), F.lit(float("inf"))).otherwise(F.greatest(limit, F.lit(0.0)))
        return {s.makes[0]: F.least(free, cap), s.makes[1]: F.greatest(F.lit(0.0), free - cap)}

    def one(a: Column, x: Callable[[str], Column]) -> Column:
        def go_on(i: int, now: dict[str, Column]) -> Column:
            if i == len(steps):
                kept = [F.slice(F.concat(F.array(now[n].cast(_kind(n))), a[f"_{n}"]), 1, k).alias(f"_{n}") for n, k in back.items()]
                return F.struct(*kept, *[now[m].alias(m) for m in step.makes])

            def past(name: str, lag: int) -> Column:
                if name == "bin":
                    return now["bin"] - lag
                return F.get(a[f"_{name}"], F.lit(lag - 1)) if lag else now[name]

            made = made_by(steps[i], now, past)
            value = F.struct(*[c.cast(_kind(n)).alias(n) for n, c in made.items()])
            return let(value, lambda v: go_on(i + 1, {**now, **{n: v[n] for n in made}}))

        return go_on(0, {"bin": x("bin"), **{n: x(n) for n in need}})

    start = {f"_{n}": F.array().cast(f"array<{_kind(n)}>") for n in back} | {m: F.lit(None).cast(_kind(m)) if is_vector(m) else F.lit(0.0) for m in step.makes}
    return fold(df, {n: F.col(n) for n in need}, start, one, {m: m for m in step.makes}, keys, {m: _kind(m) for m in step.makes})


def _kind(name: str) -> str:
    return "array<double>" if is_vector(name) else "double"


def _class_reach(s: Step) -> dict[str, int]:
    """How many bins back a step of classes looks, at series and their vectors."""
    if s.spec["rule"] == "queue":
        return {f"{s.spec['of'][0]}__raw": 1}
    own = reach(s.spec["tree"]) if s.spec["rule"] == "tree" else {s.spec["source"]: len(s.spec["kernel"]) - 1} if s.spec["rule"] == "kernel" else {}
    return own | {vector(n): k for n, k in own.items() if n in s.spec["has"]}


def grid(spark: SparkSession, bins: int, scenarios: DataFrame | None = None) -> DataFrame:
    """A row per scenario and bin, with the scenarios' other columns. Scenarios are dealt out before their bins are, so that
    windows over them find them partitioned."""
    base = spark.range(bins).select(F.col("id").alias("bin"))
    return (spark.range(1).select(F.lit(0).cast("long").alias("scenario_id")) if scenarios is None else scenarios).crossJoin(F.broadcast(base))


def scenario_table(overrides: DataFrame, constants: Sequence[str]) -> DataFrame:
    """A row per scenario of overrides (scenario_id, series, bin, value): _e<i> is what it gives the i-th constant for every bin,
    _b<i> a map of what it gives for single bins. One aggregate, and all that evaluation needs of the overrides."""
    named = lambda c: F.col("series") == c
    every = [F.max(F.when(named(c) & F.col("bin").isNull(), F.col("value"))).alias(f"_e{i}") for i, c in enumerate(constants)]
    cells = lambda c: F.collect_list(F.when(named(c) & F.col("bin").isNotNull(), F.struct(F.col("bin").cast("long").alias("k"), F.col("value").alias("v"))))
    return overrides.groupBy("scenario_id").agg(*every, *[F.map_from_entries(cells(c)).alias(f"_b{i}") for i, c in enumerate(constants)])


def evaluate(spark: SparkSession, model: dict, overrides: DataFrame | None = None, data: DataFrame | None = None, keys: Sequence[str] = KEYS, derived: bool = False, with_classes: bool = False) -> DataFrame:
    """The model's series as a wide frame (scenario_id, bin, ...). with_classes adds the classes of each series that has any as
    a column <series>__classes (an array in the order of class_ids(model)).

    data: a frame (keys..., bin, series...) of measured series; the model is evaluated for each of its keys, and its columns
    stand for the constants of their names. derived adds the evaluator's own columns of each topology node.

    overrides: rows (scenario_id, series, bin, value) replace constants, for every bin where bin is null; unknown series
    are ignored. Each scenario is evaluated; without overrides there is scenario 0."""
    levels, bins = plan(model, with_classes), int(model["grid"]["bins"])
    constants = [m for level in levels for s in level if s.kind == "const" for m in s.makes]
    said = None if overrides is None else overrides.agg(F.collect_set(F.when(F.col("series").isin(*constants), F.col("series"))).alias("series"), F.count_distinct("scenario_id").alias("n")).first()
    named = [c for c in constants if said and c in said.series]
    shared, own = (levels, []) if overrides is None else _parted(levels, set(named))
    given = set() if data is None else set(data.columns)
    if overrides is None:
        df = _made(spark, grid(spark, bins) if data is None else data, shared, bins, given, keys)
    else:
        # What no override reaches is made once, for each key or, without data, for the grid, whose rows are few.
        few = tuple(k for k in keys if k != "scenario_id")
        base = _made(spark, (spark.range(bins).select(F.col("id").alias("bin")) if data is None else data.drop("scenario_id")), shared, bins, given, few)
        table = scenario_table(overrides, named)
        df = table.crossJoin(F.broadcast(base)) if data is None else base.crossJoin(F.broadcast(table) if said.n <= MOST_SENT else table)
        at = {c: i for i, c in enumerate(named)}
        held = lambda c, x: F.coalesce(F.try_element_at(f"_b{at[c]}", F.col("bin")), F.col(f"_e{at[c]}"), x)
        df = _made(spark, df, own, bins, given, keys, {c: (lambda x, c=c: held(c, x)) for c in named})
        df = df.drop(*[f"_{k}{i}" for i in at.values() for k in "eb"]).select(*keys, "bin", *[c for c in df.columns if c not in (*keys, "bin") and not c.startswith(("_e", "_b"))])
    return df.withColumns(derived_columns(model, df.columns)) if derived else df


def _parted(levels: list[list[Step]], changed: set[str]) -> tuple[list[list[Step]], list[list[Step]]]:
    """Levels of the steps that none of these constants reaches, and of the others."""
    reached, apart, own = set(changed), [], []
    for level in levels:
        mine = [s for s in level if (s.needs | s.past | set(s.makes)) & reached]
        reached |= {m for s in mine for m in s.makes}
        apart.append([s for s in level if s not in mine])
        own.append(mine)
    return apart, own


def _made(spark: SparkSession, df: DataFrame, levels: list[list[Step]], bins: int, given: set[str], keys: Sequence[str], held: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """df with the series of these levels. given: constants that df has; held: what overrides make of some constants."""
    held = held or {}
    changing = _changing([s for level in levels for s in level], given)
    if changing:  # one row per bin of the grid
        table = spark.createDataFrame(pa.table({"bin": pa.array(range(bins), pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in changing.items()}}))
        df = df.join(F.broadcast(table), "bin").select(*df.columns, *changing)
    there = given | set(changing)
    made_here = {m for level in levels for s in level for m in s.makes}
    if first := {c: f(F.col(c)) for c, f in held.items() if c in there and c in made_here}:
        df = df.withColumns(first)
    for level in levels:
        flat = [s for s in level if s.kind in ("const", "expr", "router", "allocate")]
        made = {n: c for s in flat for n, c in _columns(s, keys=keys).items() if s.kind != "const" or n not in there}
        if made:
            df = df.withColumns({n: held[n](c) if n in held else c for n, c in made.items()})
        for s in level:
            if s.kind == "classes":
                df = cv.add_vectors(df, s, keys, _entering(s.spec["queue"]) if s.spec["rule"] == "queue" else None)
            df = _queue(df, s, keys) if s.kind == "queue" else _loop(df, s, keys) if s.kind == "loop" else df
    return df


@dataclass
class Staged:
    """A model's series in tables of bounded width: where[series] is the number of its table in the folder."""

    spark: SparkSession
    folder: str
    where: dict[str, int]
    keys: tuple[str, ...]

    def series(self, names: Sequence[str]) -> DataFrame:
        """(keys..., bin, names...): columns of the tables that have them, joined where they are several."""
        tables: dict[int, list[str]] = {}
        for n in names:
            tables.setdefault(self.where[n], []).append(n)
        out = None
        for i, own in tables.items():
            part = self.spark.read.parquet(f"{self.folder}/{i}").select(*self.keys, "bin", *own)
            out = part if out is None else out.join(part, [*self.keys, "bin"])
        return out.select(*self.keys, "bin", *names)

    def long(self) -> DataFrame:
        """(keys..., bin, series_id, value) of all series."""
        parts = []
        for i in sorted(set(self.where.values())):
            own = [n for n, k in self.where.items() if k == i]
            parts.append(self.spark.read.parquet(f"{self.folder}/{i}").unpivot([*self.keys, "bin"], own, "series_id", "value"))
        return reduce(DataFrame.unionByName, parts)


def stages_of(levels: list[list[Step]], width: int) -> list[list[list[Step]]]:
    """Levels cut into stages of about `width` series, each of levels of its own, which need only earlier ones. Constants are no
    part of a stage's width and wait for none: each stage makes those that it needs."""
    constants = {s.makes[0]: s for level in levels for s in level if s.kind == "const"}
    stages, now, n = [], {}, 0
    for i, level in enumerate(levels):
        for s in level:
            if s.kind == "const":
                continue
            if n and n + len(s.makes) > width:
                stages.append(now)
                now, n = {}, 0
            now.setdefault(i, []).append(s)
            n += len(s.makes)
    stages.append(now)
    out, met = [], set()
    for now in stages:
        wanted = {x for own in now.values() for s in own for x in s.needs | s.past} & set(constants)
        met |= wanted
        out.append([[constants[c] for c in constants if c in wanted], *[now[k] for k in sorted(now)]])
    rest = [constants[c] for c in constants if c not in met]
    return out + [[rest[lo : lo + width]] for lo in range(0, len(rest), width)]


def evaluate_staged(spark: SparkSession, model: dict, width: int = 400, data: DataFrame | None = None, keys: Sequence[str] = KEYS) -> Staged:
    """A model of any width: cut into stages of about `width` series, each written as a table, which holds its own series and
    those of earlier stages that later ones need. No plan is wider than a stage and what lives through it."""
    levels, bins, folder_ = plan(model), int(model["grid"]["bins"]), fresh(spark, "stages")
    given = set() if data is None else set(data.columns)
    stages = stages_of(levels, width)
    fixed = {s.makes[0] for level in levels for s in level if s.kind == "const"} - given
    makes = [[m for level in stage for s in level for m in s.makes] for stage in stages]
    needs = [{n for level in stage for s in level for n in s.needs | s.past} | {m for m in own if m in given} for stage, own in zip(stages, makes, strict=True)]
    frame, where, live = grid(spark, bins) if data is None else data, {}, given - set(keys) - {"bin"}
    for i, stage in enumerate(stages):
        done = _made(spark, frame, stage, bins, given & set(frame.columns), keys)
        live = (live | set(makes[i])) & set().union(*needs[i + 1 :]) - fixed
        own = [m for m in makes[i] if m not in where]
        kept = done.select(*dict.fromkeys([*keys, "bin", *own, *sorted(live)]))
        kept.write.parquet(f"{folder_}/{i}")
        where |= dict.fromkeys(own, i)
        frame = spark.read.schema(kept.schema).parquet(f"{folder_}/{i}").select(*keys, "bin", *sorted(live))
    return Staged(spark, folder_, where, tuple(keys))


def derived_columns(model: dict, there: Sequence[str]) -> dict[str, Column]:
    """The evaluator's derived columns, 0 where a metric is not defined, of the topology nodes whose series are there."""
    grid_, out = model["grid"], {}
    bin_ms = float(grid_.get("binSize", 1)) * UNIT_MS[str(grid_["binUnit"]).lower()]

    def variation(name: str | None) -> float:
        node = nodes_of(model).get(name or "", {})
        if node.get("kind") != "pmf":
            return 0.0
        return Pmf(node["pmf"]["values"], node["pmf"]["probabilities"]).cv

    for t in topology(model, "nodes"):
        s, kind, name = t.get("semantics") or {}, t.get("kind", "serviceWithBuffer").lower(), snake(t["id"])
        made: dict[str, Column] = {}
        has = lambda k: bool(s.get(k)) and s[k] in there  # noqa: B023, E731
        if has("served") and has("capacity"):
            capacity = F.col(s["capacity"])
            if s.get("parallelism"):
                capacity = made["effective_capacity"] = capacity * (F.col(s["parallelism"]) if isinstance(s["parallelism"], str) else float(s["parallelism"]))
            made["utilization"] = safe_div(s["served"], capacity)
        if kind in ("servicewithbuffer", "queue", "dlq") and has("served") and queue_series(t) in there:
            made["q_ratio"] = safe_div(queue_series(t), s["served"])
            made["queue_time_ms"] = made["q_ratio"] * bin_ms
            made["latency_min"] = made["queue_time_ms"] / 60000
        if kind in ("servicewithbuffer", "service") and has("processingTimeMsSum") and has("servedCount"):
            made["service_time_ms"] = safe_div(s["processingTimeMsSum"], s["servedCount"])
        if "queue_time_ms" in made or "service_time_ms" in made:
            made["cycle_time_ms"] = made.get("queue_time_ms", F.lit(0.0)) + made.get("service_time_ms", F.lit(0.0))
        if "queue_time_ms" in made and "service_time_ms" in made:
            made["flow_efficiency"] = safe_div(made["service_time_ms"], made["cycle_time_ms"])
        if "utilization" in made and "service_time_ms" in made:
            # As the evaluator has it, one_minus_rho holds rho less one.
            made["one_minus_rho"] = made["utilization"] - 1
            ca, cs = variation(s.get("arrivals")), variation(s.get("processingTimeMsSum"))
            made["kingman_wq"] = safe_div(made["utilization"], -made["one_minus_rho"]) * ((ca * ca + cs * cs) / 2) * made["service_time_ms"]
        out |= {f"{name}_{k}": c for k, c in made.items()}
    return out


def long_form(df: DataFrame, series: list[str]) -> DataFrame:
    """(scenario_id, bin, series_id, value) of the series of a wide frame."""
    return df.unpivot(["scenario_id", "bin"], series, "series_id", "value")


def by_class(df: DataFrame, model: dict, keys: Sequence[str] = KEYS) -> DataFrame:
    """The series by class of a model that was evaluated with_classes: (scenario_id, bin, series_id, class_id, total, value)."""
    return cv.class_rows(df, model, steps_of(model), topology(model, "nodes"), keys)
