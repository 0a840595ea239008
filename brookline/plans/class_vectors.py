"""Classes through a model as vectors: beside a series a column `<series>__classes`, an array with the value of each class.

Which series have classes, and by which rule, follows from the model alone. Each rule is a step of the model's plan, like
those that make the series themselves: a projection, a window over the sorted bins, or a part of the fold of a cycle. So
all classes of all series come of the pass that evaluates the model; nothing is joined, and a router can send out classes
that an expression made.

Rules: a node with class arrivals has those, rescaled to its series. An expression does to the classes of its operands what
its functions do (`Walk`). A router's targets get the classes of its routes, and by weight those without a route. What a
constraint lets in is split as what asked for it. A queue's classes are each class's own backlog from what enters, leaves
through the schedule and is lost, rescaled to the depth, and its overflow is split alike. What a serviceWithBuffer
node serves or loses has, if nothing else gives it classes, those of its arrivals."""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arith
from ..functions.arith import fin, safe_div
from ..operators.series import along, gate, let, so_far
from .expr import number, references, whole

TOLERANCE = 1e-9


@dataclass
class Step:
    """One thing to make: series `makes` from series `needs` (of the same bin) and `past` (of earlier bins)."""

    kind: str
    makes: list[str]
    needs: set[str]
    past: set[str] = field(default_factory=set)
    spec: dict = field(default_factory=dict)


def class_series(node: str, class_id: str) -> str:
    return f"{node}__class_{class_id}"


def vector(series: str) -> str:
    """The column of a series' classes."""
    return f"{series}__classes"


def is_vector(name: str) -> bool:
    return name.endswith(("__classes", "__raw"))


def arrivals_by_class(model: dict) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for a in (model.get("traffic") or {}).get("arrivals") or []:
        out.setdefault(a["nodeId"], {})[a["classId"]] = float(a["pattern"]["ratePerBin"])
    return out


def class_ids(model: dict) -> list[str]:
    """All classes, in the order of a vector's elements."""
    named = [c["id"] for c in model.get("classes") or []] + [a["classId"] for a in (model.get("traffic") or {}).get("arrivals") or []]
    return list(dict.fromkeys(named))


# --- what has classes ---------------------------------------------------------------------------------------------------


def _carries(node: ast.AST, classed: set[str]) -> bool:
    """Whether an expression has classes when these names have."""
    if isinstance(node, ast.Name):
        return node.id in classed
    if isinstance(node, ast.Call):
        name, args = node.func.id.upper(), node.args
        if name in ("STEP",):
            return False  # what is on or off is of no class
        if name == "MOD":
            return _carries(args[0], classed) and not _carries(args[1], classed)
        if name == "PULSE":
            return len(args) > 2 and _carries(args[2], classed)
        return any(_carries(a, classed) for a in (args[:1] if name in ("SHIFT", "CONV") else args))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Div):
        return _carries(node.left, classed)
    return any(_carries(c, classed) for c in ast.iter_child_nodes(node))


def _sources(step: Step, series: str) -> list[str]:
    """The series whose classes a step's series would get its own from."""
    if step.kind == "expr":
        return [step.spec["column"][0]] if "column" in step.spec else sorted(set().union(*references(step.spec["tree"])))
    if step.kind == "router":
        return [step.spec["source"]]
    if step.kind == "allocate":
        return [step.spec["demand"][step.makes.index(series)]]
    if step.kind == "queue":
        s = step.spec
        return [*s["inflow"], *s["over"], *(x for x in (s["out"], s["loss"]) if x)]
    return []


def _members(step: Step, series: str, of: dict[str, list[str]]) -> list[str]:
    """The classes that a series has."""
    have = {c for n in _sources(step, series) for c in of.get(n, [])}
    if step.kind == "router":
        routes = [r for r in step.spec["routes"] if r["target"] == series]
        named = {c for r in step.spec["routes"] for c in r.get("classes") or []}
        have = {c for r in routes for c in r.get("classes") or []} | (have - named if any(not r.get("classes") for r in routes) else set())
    return sorted(have)


def classed(model: dict, steps: list[Step], topology_nodes: Sequence[dict]) -> tuple[dict[str, str], dict[str, list[str]]]:
    """The rule of every series that has classes ("own": its step's), and which classes it has."""
    rule: dict[str, str] = dict.fromkeys(arrivals_by_class(model), "given")
    members = {n: sorted(rates) for n, rates in arrivals_by_class(model).items()}
    if not rule:
        return {}, {}
    while True:
        before = len(rule)
        for step in steps:
            for s in step.makes:
                there = _carries(step.spec["tree"], set(rule)) if "tree" in step.spec else any(n in rule for n in _sources(step, s))
                if s not in rule and step.kind != "const" and there:
                    rule[s] = "own"
        if len(rule) > before:
            continue
        for t in topology_nodes:
            s = t.get("semantics") or {}
            for target in (s.get("served"), s.get("errors")):
                if t.get("kind") == "serviceWithBuffer" and target and s.get("arrivals") in rule and target not in rule:
                    rule[target] = s["arrivals"]
        if len(rule) == before:
            break
    maker = {s: step for step in steps for s in step.makes}
    for _ in rule:  # classes reach along references, however long the way
        for s, r in rule.items():
            if r == "own":
                members[s] = _members(maker[s], s, members)
            elif r != "given":
                members[s] = members.get(r, [])
    return rule, members


def class_steps(model: dict, steps: list[Step], topology_nodes: Sequence[dict]) -> list[Step]:
    """A step for the classes of each series that has any."""
    rule, members = classed(model, steps, topology_nodes)
    maker = {s: step for step in steps for s in step.makes}
    ids, out = class_ids(model), []

    def there(names: set[str]) -> set[str]:
        return {vector(n) for n in names if n in rule}

    def add(series: list[str], same: set[str], past: set[str] = frozenset(), **spec) -> None:
        out.append(Step("classes", [vector(s) for s in series], {*series, *same, *there(same)}, {*past, *there(past)}, {"ids": ids, "of": series, "has": set(rule), **spec}))

    for s, r in rule.items():
        if r == "given":
            add([s], {class_series(s, c) for c in members[s]}, rule="given")
        elif r != "own":
            add([s], {r}, rule="like", source=r)
        elif maker[s].kind == "expr" and "column" in maker[s].spec:
            source, kernel = maker[s].spec["column"]
            add([s], {source} if kernel[0] else set(), {source}, rule="kernel", source=source, kernel=kernel)
        elif maker[s].kind == "expr":
            same, past = references(maker[s].spec["tree"])
            add([s], same, past, rule="tree", tree=maker[s].spec["tree"])
        elif maker[s].kind == "router":
            add([s], {maker[s].spec["source"]}, rule="router", routes=maker[s].spec["routes"], source=maker[s].spec["source"])
        elif maker[s].kind == "allocate":
            source = maker[s].spec["demand"][maker[s].makes.index(s)]
            add([s], {source}, rule="like", source=source)
    for step in steps:
        if step.kind == "queue" and any(rule.get(s) == "own" for s in step.makes):
            add([s for s in step.makes if rule.get(s) == "own"], set(step.needs), rule="queue", queue=step.spec, members=members[step.makes[0]])
    return out


# --- vectors ------------------------------------------------------------------------------------------------------------


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def total_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + fin(x))


def norm(v: Column, total: Column) -> Column:
    """v rescaled to the total where it sums to something else; where it sums to nothing it stays."""
    return let(v, lambda x: let(total_of(x), lambda s: F.when((s > 0) & (F.abs(s - total) > TOLERANCE), F.transform(x, lambda c: c * total / s)).otherwise(x)))


def scaled(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: F.lit(k) * fin(x))


def plus(a: Column | None, b: Column | None, sign: float = 1.0) -> Column | None:
    if b is None:
        return a
    if a is None:
        return F.transform(b, lambda y: F.lit(sign) * y)
    return F.zip_with(a, b, lambda x, y: x + F.lit(sign) * y)


class Value(NamedTuple):
    total: Column
    classes: Column | None = None


class Walk:
    """The classes of an expression. Over a frame, shifts are windows, and what is shifted becomes a column of it first;
    within a fold, past(name, back) gives a name's value or vector (or "bin") so many bins before."""

    def __init__(self, n: int, has: set[str], df: DataFrame | None = None, keys: Sequence[str] = (), past: Callable[[str, int], Column] | None = None):
        self.n, self.has, self.df, self.keys, self.past, self.temporary = n, has, df, keys, past, []

    def at(self, back: int) -> Column:
        return self.past("bin", back) if self.past else F.col("bin")

    def name(self, series: str, back: int = 0) -> Value:
        get = (lambda x: self.past(x, back)) if self.past else F.col
        return Value(get(series), get(vector(series)) if series in self.has else None)

    def kept(self, v: Value) -> Value:
        """v as columns of the frame, for a window to look at."""
        if self.past:
            return v
        out = []
        for c in v:
            if c is not None:
                name = f"_w{len(self.temporary)}"
                self.df = self.df.withColumn(name, c)
                self.temporary.append(name)
                c = F.col(name)
            out.append(c)
        return Value(*out)

    def earlier(self, node: ast.expr, lag: int, back: int) -> Value:
        if not lag:
            return self.walk(node, back)
        if self.past:
            v, there = self.walk(node, back + lag), self.at(back + lag) >= 0
            return Value(F.when(there, v.total).otherwise(0.0), None if v.classes is None else F.when(there, v.classes).otherwise(zeros(self.n)))
        v = self.kept(self.walk(node, 0)) if not isinstance(node, ast.Name) else self.name(node.id)
        order = along(self.keys)
        return Value(F.lag(v.total, lag, 0.0).over(order), None if v.classes is None else F.coalesce(F.lag(v.classes, lag).over(order), zeros(self.n)))

    def kernel(self, node: ast.expr, kernel: Sequence[float], back: int = 0) -> Value:
        total, made = F.lit(0.0), None
        if not self.past and not isinstance(node, ast.Name):
            v = self.kept(self.walk(node, 0))
            parts = [Value(F.lag(v.total, i, 0.0).over(along(self.keys)) if i else v.total, None if v.classes is None else F.coalesce(F.lag(v.classes, i).over(along(self.keys)), zeros(self.n)) if i else v.classes) for i in range(len(kernel))]
        else:
            parts = [self.earlier(node, i, back) for i in range(len(kernel))]
        for k, v in zip(kernel, parts, strict=True):
            if k:
                total = total + F.lit(float(k)) * fin(v.total)
                made = plus(made, None if v.classes is None else scaled(v.classes, float(k)))
        return Value(total, made)

    def chosen(self, a: Value, b: Value, least: bool) -> Value:
        """MIN or MAX: the classes of the side that gives the result, scaled to it; the left side if both do."""
        result = F.least(a.total, b.total) if least else F.greatest(a.total, b.total)
        if a.classes is None and b.classes is None:
            return Value(result)
        side = a.classes if b.classes is None else b.classes if a.classes is None else F.when((F.abs(a.total - result) < TOLERANCE) | (F.abs(b.total - result) >= TOLERANCE), a.classes).otherwise(b.classes)
        parts = let(side, lambda x: let(total_of(x), lambda s: F.when(s <= 0, zeros(self.n)).otherwise(F.transform(x, lambda c: F.when(result <= 0, 0.0).otherwise(c * safe_div(result, s))))))
        return self.kept(Value(result, norm(parts, result)))

    def walk(self, node: ast.expr, back: int = 0) -> Value:
        if isinstance(node, ast.Constant):
            return Value(F.lit(float(node.value)))
        if isinstance(node, ast.Name):
            return self.name(node.id, back)
        if isinstance(node, ast.UnaryOp):
            v = self.walk(node.operand, back)
            return v if not isinstance(node.op, ast.USub) else Value(F.lit(0.0) - v.total, None if v.classes is None else F.transform(v.classes, lambda x: -x))
        if isinstance(node, ast.List):
            return Value(F.element_at(F.array(*[F.lit(number(x)) for x in node.elts]), (self.at(back) + 1).cast("int")))
        if isinstance(node, ast.BinOp):
            a, b = self.walk(node.left, back), self.walk(node.right, back)
            if isinstance(node.op, ast.Add | ast.Sub):
                sign = 1.0 if isinstance(node.op, ast.Add) else -1.0
                total, made = a.total + F.lit(sign) * b.total, plus(a.classes, b.classes, sign)
                return Value(total) if made is None else self.kept(Value(total, norm(made, total)))
            if isinstance(node.op, ast.Mult):
                side, other = (a, b) if a.classes is not None else (b, a)
                return Value(a.total * b.total, None if side.classes is None else F.transform(side.classes, lambda x: x * fin(other.total)))
            total = safe_div(a.total, b.total)
            part = lambda x: F.when(F.abs(a.total) < TOLERANCE, 0.0).otherwise(x * safe_div(total, a.total))
            return Value(total, None if a.classes is None else F.transform(a.classes, part))
        name, args = node.func.id.upper(), node.args
        if name == "SHIFT":
            return self.earlier(args[0], whole(args[1], 0), back)
        if name == "CONV":
            return self.kernel(args[0], [number(x) for x in args[1].elts] if isinstance(args[1], ast.List) else [number(args[1])], back)
        if name == "PULSE":
            on = arith.fires(self.at(back), whole(args[0], 1), whole(args[1], 0) if len(args) > 1 else 0)
            v = self.walk(args[2], back) if len(args) > 2 else Value(F.lit(1.0))
            return Value(F.when(on, v.total).otherwise(0.0), None if v.classes is None else F.when(on, v.classes).otherwise(zeros(self.n)))
        values = [self.walk(a, back) for a in args]
        if name in ("MIN", "MAX"):
            return self.chosen(*values, name == "MIN")
        if name == "CLAMP":
            return self.chosen(self.chosen(values[0], values[2], True), values[1], False)
        if name == "STEP":
            return Value(arith.step(values[0].total, values[1].total))
        if name == "MOD":
            a, b = values
            total = arith.floored_mod(a.total, b.total)
            if a.classes is None or b.classes is not None:
                return Value(total)
            left = F.transform(a.classes, lambda x: F.when(F.abs(b.total) <= TOLERANCE, 0.0).otherwise(arith.floored_mod(x, b.total)))
            return self.kept(Value(total, norm(left, total)))
        f = {"FLOOR": arith.floor, "CEIL": arith.ceil, "ROUND": arith.round_away}[name]
        return Value(f(values[0].total), None if values[0].classes is None else F.transform(values[0].classes, f))


# --- rules --------------------------------------------------------------------------------------------------------------


def _routed(ids: list[str], routes: list[dict], target: str, source: Column) -> Column:
    """A target's classes before they are rescaled: those of its routes, and its part of those without a route."""
    named = {c for r in routes for c in r.get("classes") or []}
    own = {c for r in routes if r["target"] == target for c in r.get("classes") or []}
    weights = [(r["target"], float(r.get("weight", 1))) for r in routes if not r.get("classes")]
    total = sum(w for _, w in weights)
    part = sum(w for t, w in weights if t == target) / total if total > 0 else 0.0
    return F.array(*[source[i] if c in own else source[i] * F.lit(part) if c not in named else F.lit(0.0) for i, c in enumerate(ids)])


def _through(spec: dict, out: Value, at: Callable[[str], Column]) -> Column | None:
    """The classes of a queue's outflow as its schedule lets them through."""
    sched = spec["schedule"]
    if out.classes is None or not sched:
        return out.classes
    allowed = gate(out.total, int(sched["periodBins"]), int(sched.get("phaseOffset", 0)), at(spec["capacity"]) if spec["capacity"] else None, at("bin"))
    return F.transform(out.classes, lambda x: F.when(fin(out.total) > TOLERANCE, x * safe_div(allowed, out.total)).otherwise(0.0))


def _change(step: Step, value: Callable[[str], Value], at: Callable[[str], Column], entering: Column) -> tuple[Column, Column]:
    """By class what enters a queue in a bin, and what leaves it or is lost. entering: what its constraints let in."""
    s, n = step.spec["queue"], len(step.spec["ids"])
    come = None
    for name in s["inflow"]:
        v = value(name).classes
        come = plus(come, norm(v, entering) if v is not None and s["caps"] else v)
    for name in s["over"]:
        come = plus(come, value(name).classes)
    gone = _through(s, value(s["out"]), at) if s["out"] else None
    if s["loss"]:
        gone = plus(gone, value(s["loss"]).classes)
    clean = lambda v: zeros(n) if v is None else F.transform(v, fin)
    return clean(come), clean(gone)


def _begin(init: float, come: Column, members: list[str], ids: list[str]) -> Column:
    """Each class's start: its part of the initial depth by the first bin's inflow, evenly if nothing flows in then; an initial
    depth of nothing is taken to be that inflow."""
    even = F.array(*[F.lit(init / len(members) if c in members and members else 0.0) for c in ids])
    positive = F.transform(come, lambda x: F.greatest(x, F.lit(0.0)))
    depth = (lambda s: s) if abs(init) < TOLERANCE else (lambda s: F.lit(init))
    return let(total_of(positive), lambda s: F.when(s > 0, F.transform(positive, lambda x: depth(s) * x / s)).otherwise(even))


def in_fold(step: Step, value: Callable[[str], Value], past: Callable[[str, int], Column], entering: Callable[[], Column]) -> dict[str, Column]:
    """A step's vectors within a fold."""
    s, ids = step.spec, step.spec["ids"]
    at = lambda name: past(name, 0)
    if s["rule"] == "queue":
        come, gone = _change(step, value, at, entering())
        raw = f"{s['of'][0]}__raw"
        before = F.when(past("bin", 0) > 0, past(raw, 1)).otherwise(_begin(s["queue"]["init"], come, s["members"], ids))
        now = F.zip_with(before, F.zip_with(come, gone, lambda a, b: a - b), lambda q, d: F.greatest(F.lit(0.0), q + d))
        return {vector(o): norm(now, at(o)) for o in s["of"]} | {raw: now}
    return {vector(s["of"][0]): _vector(step, Walk(len(ids), s["has"], past=past), at)}


def _vector(step: Step, walk: Walk, at: Callable[[str], Column]) -> Column:
    s, ids = step.spec, step.spec["ids"]
    target = s["of"][0]
    if s["rule"] == "given":
        return norm(F.array(*[fin(at(class_series(target, c))) if class_series(target, c) in step.needs else F.lit(0.0) for c in ids]), at(target))
    if s["rule"] == "like":
        return norm(walk.name(s["source"]).classes, at(target))
    if s["rule"] == "router":
        return norm(_routed(ids, s["routes"], target, walk.name(s["source"]).classes), at(target))
    if s["rule"] == "kernel":
        return walk.kernel(ast.Name(s["source"]), s["kernel"]).classes
    return walk.walk(s["tree"]).classes


def add_vectors(df: DataFrame, step: Step, keys: Sequence[str], entering: Column | None) -> DataFrame:
    """df with a step's vectors, by projections and windows."""
    s, ids, names = step.spec, step.spec["ids"], df.columns
    walk = Walk(len(ids), s["has"], df, keys)
    if s["rule"] != "queue":
        made = _vector(step, walk, F.col)
        return walk.df.withColumn(step.makes[0], made).select(*names, *step.makes)
    come, gone = _change(step, walk.name, F.col, entering)
    df = df.withColumns({"_come": come, "_gone": gone})
    order = so_far(keys)
    df = df.withColumn("_begin", _begin(s["queue"]["init"], F.first("_come").over(order), s["members"], ids))
    df = df.withColumns({f"_s{i}": F.col("_begin")[i] + F.sum(F.col("_come")[i] - F.col("_gone")[i]).over(order) for i in range(len(ids))})
    raw = F.array(*[F.col(f"_s{i}") - F.least(F.lit(0.0), F.min(f"_s{i}").over(order)) for i in range(len(ids))])
    return df.withColumn("_raw", raw).select(*names, *[norm(F.col("_raw"), F.col(o)).alias(vector(o)) for o in s["of"]])


def class_rows(df: DataFrame, model: dict, steps: list[Step], topology_nodes: Sequence[dict], keys: Sequence[str]) -> DataFrame:
    """(keys..., bin, series_id, class_id, total, value) of an evaluated model with its vectors: one pass, no join."""
    ids, members = class_ids(model), classed(model, steps, topology_nodes)[1]
    cells = [F.struct(F.lit(n).alias("series_id"), F.lit(c).alias("class_id"), F.col(n).cast("double").alias("total"), F.col(vector(n))[ids.index(c)].alias("value")) for n, own in members.items() for c in own]
    return df.select(*keys, "bin", F.explode(F.array(*cells)).alias("_c")).select(*keys, "bin", "_c.*")
