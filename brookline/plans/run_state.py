"""The state of an evaluated model: its topology's nodes by role with derived metrics, its edges with what flows on them,
latency along flows, and warnings.

All of it comes from the wide frame that the model's evaluation gives, a row per key and bin, in which what a node or an
edge needs from others stands in the same row: edge flows, what a router sends and latency along flows are projections in
topological order, lags are windows over the sorts that the evaluation has made. One explode then gives node rows, another
edge rows. Warnings need no further exchange, as a node's rows lie where their key's do: what looks along a node's bins (queues made again, streaks, halves,
presence) are windows over a node's rows, all codes of a row are one array, and a last aggregate gathers them by code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import metrics as M
from ..functions.arith import fin, fires, is_finite
from ..operators.checks import FIRST, TOLERANCE
from ..operators.series import echo, gate, lagged_or_null, queue_with_limit, shift
from ..operators.state import WITH_QUEUE, WITH_SERVICE
from .class_vectors import class_ids, classed, plus, vector
from .compiler import KEYS, evaluate, steps_of
from .model import bin_ms, nodes_of, queue_series, topology

#: Roles of a node's semantics and the columns that hold their series.
ROLES = {
    "arrivals": "arrivals", "served": "served", "errors": "errors", "attempts": "attempts", "failures": "failures", "exhaustedFailures": "exhausted_failures", "retryEcho": "retry_echo",
    "retryBudgetRemaining": "retry_budget_remaining", "queueDepth": "queue_depth", "capacity": "capacity", "externalDemand": "external_demand", "processingTimeMsSum": "processing_time_ms_sum", "servedCount": "served_count",
}
METRICS = ("utilization", "queue_time_ms", "latency_min", "service_time_ms", "cycle_time_ms", "flow_efficiency", "throughput_ratio", "retry_tax", "flow_latency_ms")
#: Edge types along which latency adds up, and what a terminal edge's measure reads.
LATENCY_EDGES = ("throughput", "effort", "dependency")
FAILURES = {"errors": "errors", "failures": "failures", "exhaustedfailures": "exhaustedFailures"}
INFO = (
    "missing_capacity_series", "capacity_all_zero", "missing_dependency_arrivals", "missing_dependency_served", "missing_served_series", "missing_queue_depth_series", "missing_processing_time_series", "missing_served_count_series",
    "dependency_missing_effort_edges", "dependency_retry_pressure_missing", "dispatch_missing_served_series", "dispatch_never_releases", "queue_latency_gate_closed", "queue_latency_unreported",
)
#: Codes that name every bin, not the first ones alone.
ALL_BINS = ("queue_latency_gate_closed", "queue_latency_unreported")


@dataclass(frozen=True)
class Edge:
    edge_id: str
    source: str
    target: str
    kind: str
    measure: str
    weight: float
    factor: float
    lag: int
    plain: bool  # it leaves by the port "out" or by none


def edges_of(model: dict) -> list[Edge]:
    out = []
    for e in topology(model, "edges"):
        s, t = str(e.get("source") or e.get("from")), str(e.get("target") or e.get("to"))
        port = s.split(":", 1)[1].lower() if ":" in s else ""
        plain, kind = port in ("", "out"), str(e.get("type") or e.get("edgeType") or "throughput").lower()
        measure = str(e.get("measure") or ("served" if plain else port)).lower()
        weight, factor = e.get("weight"), e.get("multiplier") if e.get("multiplier") is not None else e.get("weight")
        out.append(Edge(e.get("id") or f"{s}->{t}", s.split(":")[0], t.split(":")[0], "throughput" if kind == "topology" else kind, measure, float(weight) if weight is not None and float(weight) > 0 else 1.0, 1.0 if factor is None else float(factor), int(e.get("lag") or 0), plain))
    return out


def flow_order(model: dict) -> list[str]:
    """The topology's nodes, sources first; as they are declared if they form a cycle."""
    ids = [t["id"] for t in topology(model, "nodes")]
    pairs = [(e.source, e.target) for e in edges_of(model) if e.kind in LATENCY_EDGES and e.source in ids and e.target in ids]
    open_ = {i: sum(t == i for _, t in pairs) for i in ids}
    ready = [i for i in ids if not open_[i]]
    for i in ready:  # grows on the way
        for s, t in pairs:
            if s == i:
                open_[t] -= 1
                if not open_[t]:
                    ready.append(t)
    return ready if len(ready) == len(ids) else ids


class _Model:
    """What the state needs to know of a model and of a frame that its evaluation gave."""

    def __init__(self, model: dict, there: Sequence[str]) -> None:
        self.model, self.there, self.nodes, self.edges = model, set(there), topology(model, "nodes"), edges_of(model)
        self.by_id = {t["id"]: t for t in self.nodes}
        self.routers = {i: n["router"] for i, n in nodes_of(model).items() if n.get("kind") == "router"}
        self.ids = class_ids(model)
        found = classed(model, steps_of(model), self.nodes)[1] if self.ids else {}
        self.members = {s: own for s, own in found.items() if vector(s) in self.there}

    def role(self, node: dict | None, role: str) -> str | None:
        """The series of a node's role, if the frame has it."""
        if not node:
            return None
        name = queue_series(node) if role == "queueDepth" and (node.get("kind") in WITH_QUEUE or (node.get("semantics") or {}).get(role)) else (node.get("semantics") or {}).get(role)
        return name if isinstance(name, str) and name in self.there else None

    def flow(self, e: Edge) -> tuple[str, float] | None:
        """The series and the part of it that flows on an edge: what a router sends to its target, else the source's served
        by weight among the source's edges of this type."""
        if not e.plain or e.measure not in ("served", "attempts", "load") or e.kind not in ("throughput", "effort") or e.kind == "throughput" and e.measure != "served":
            return None
        if e.source in self.routers:
            wanted = (self.by_id.get(e.target, {}).get("semantics") or {}).get("arrivals")
            return (wanted, 1.0) if e.kind == "throughput" and wanted in self.there and any(r["target"] == wanted for r in self.routers[e.source]["routes"]) else None
        served = self.role(self.by_id.get(e.source), "served")
        if not served:
            return None
        like = [x for x in self.edges if x.source == e.source and x.kind == e.kind and (e.kind == "effort" or x.plain and x.measure == "served")]
        return served, e.weight / sum(x.weight for x in like)

    def flow_edges(self, node: str, side: str) -> list[Edge]:
        """Edges whose flows a node's own measure has to match."""
        return [e for e in self.edges if getattr(e, side) == node and e.plain and e.measure == "served" and e.kind == "throughput"]


def _flow(m: _Model, e: Edge) -> Column:
    found = m.flow(e)
    return F.lit(None).cast("double") if found is None else F.col(found[0]) * F.lit(found[1])


def _scaled(m: _Model, e: Edge, role: str) -> Column | None:
    name = m.role(m.by_id.get(e.source), role)
    return F.col(name) * F.lit(e.factor) if name else None


def _descriptors(node: dict) -> tuple[bool, bool]:
    kind = node.get("kind", "service")
    return kind in WITH_QUEUE, kind in WITH_SERVICE


def _metrics(m: _Model, node: dict, ms: float) -> dict[str, Column]:
    """A node's derived metrics but latency along flows, null where they are not defined."""
    get = lambda role: F.col(n) if (n := m.role(node, role)) else F.lit(None).cast("double")
    queue, service = _descriptors(node)
    null = F.lit(None).cast("double")
    out = {"utilization": M.utilization(get("served"), _capacity(m, node)), "queue_time_ms": M.queue_time_ms(get("queueDepth"), get("served"), ms) if queue else null}
    out["latency_min"] = out["queue_time_ms"] / 60000
    out["service_time_ms"] = M.service_time_ms(get("processingTimeMsSum"), get("servedCount")) if service else null
    out["cycle_time_ms"] = M.cycle_time_ms(out["queue_time_ms"], out["service_time_ms"])
    out["flow_efficiency"] = M.flow_efficiency(out["service_time_ms"], out["cycle_time_ms"])
    out["throughput_ratio"] = M.throughput_ratio(get("served"), get("arrivals"))
    tried = M.attempts(get("attempts"), get("served"), get("failures"), get("errors"))
    return out | {"retry_tax": M.retry_tax(tried, get("served"))}


def _capacity(m: _Model, node: dict) -> Column:
    name, p = m.role(node, "capacity"), (node.get("semantics") or {}).get("parallelism")
    if not name:
        return F.lit(None).cast("double")
    return M.effective_capacity(F.col(name), None if p is None else F.col(p) if isinstance(p, str) else F.lit(float(p)))


def _open(node: dict) -> Column | None:
    sched = node.get("dispatchSchedule")
    return fires(F.col("bin"), int(sched["periodBins"]), int(sched.get("phaseOffset") or 0) % int(sched["periodBins"])) if sched else None


def _wide(df: DataFrame, m: _Model, keys: Sequence[str]) -> DataFrame:
    """df with a column _f<i> for the flow of each edge, _c<i> and _l<i> for each node's cycle time and latency along flows, and
    _q<i> for the depth that a node with a limit should have."""
    ms, at = float(bin_ms(m.model["grid"])), {t["id"]: i for i, t in enumerate(m.nodes)}
    df = df.withColumns({f"_f{i}": _flow(m, e) for i, e in enumerate(m.edges)} | {f"_c{i}": _metrics(m, t, ms)["cycle_time_ms"] for i, t in enumerate(m.nodes)})
    level: dict[str, int] = {}
    coming: dict[str, list[tuple[int, str]]] = {}
    for node in flow_order(m.model):
        coming[node] = [(i, e.source) for i, e in enumerate(m.edges) if e.target == node and e.kind in LATENCY_EDGES and e.source in level]
        level[node] = 1 + max((level[s] for _, s in coming[node]), default=-1)
    for depth in sorted(set(level.values())):
        df = df.withColumns({f"_l{at[n]}": _latency(m, m.by_id[n], at, coming[n]) for n, d in level.items() if d == depth})
    for i, t in enumerate(m.nodes):
        a, s, limit = m.role(t, "arrivals"), m.role(t, "served"), t.get("wipLimit")
        if limit is not None and a and s and m.role(t, "queueDepth"):
            given = F.col(limit) if isinstance(limit, str) else float(limit)
            start = float((t.get("initialCondition") or {}).get("queueDepth", 0))
            df = queue_with_limit(df.withColumns({"_in": _inflow(m, t), "_out": _outflow(m, t)}), "_in", "_out", given, start, f"_q{i}", "_over", keys).drop("_in", "_out", "_over")
    return df


def _latency(m: _Model, node: dict, at: dict[str, int], coming: list[tuple[int, str]]) -> Column:
    """Cycle time and the mean of what comes before, weighted by flow; null where nothing is carried."""
    base = F.col(f"_c{at[node['id']]}")
    if coming:
        counts = lambda i, s: F.col(f"_l{at[s]}").isNotNull() & (F.col(f"_f{i}") > 0)
        flow = sum((F.when(counts(i, s), F.col(f"_f{i}")).otherwise(0.0) for i, s in coming), F.lit(0.0))
        weighted = sum((F.when(counts(i, s), F.col(f"_f{i}") * F.col(f"_l{at[s]}")).otherwise(0.0) for i, s in coming), F.lit(0.0))
        up = F.when(flow > 0, F.round(F.try_divide(weighted, flow), 6))
        base = F.when(base.isNotNull() | up.isNotNull(), F.coalesce(base, F.lit(0.0)) + F.coalesce(up, F.lit(0.0)))
    carried = m.role(node, "arrivals" if node.get("kind") == "sink" else "served")
    asked = (node.get("semantics") or {}).get("arrivals" if node.get("kind") == "sink" else "served")
    return base if not asked else F.when(F.col(carried) > 0, base) if carried else F.lit(None).cast("double")


def _inflow(m: _Model, node: dict) -> Column:
    """What enters a queue: its arrivals as its constraints let them in, and what overflows to it."""
    parts = [F.col(m.role(node, "arrivals"))]
    caps = [F.col(f"{node['id']}__{c}") for c in node.get("constraints") or [] if f"{node['id']}__{c}" in m.there]
    over = [F.col(f"{u['id']}__overflow") for u in m.nodes if u.get("wipOverflow") == node["id"] and f"{u['id']}__overflow" in m.there]
    return sum((fin(x) for x in over), fin(F.least(*parts, *caps) if caps else parts[0]))


def _outflow(m: _Model, node: dict) -> Column:
    """What leaves a queue: what its schedule lets through of served, and its errors."""
    sched, out = node.get("dispatchSchedule"), F.col(m.role(node, "served"))
    if sched:
        cap = sched.get("capacitySeries")
        out = gate(out, int(sched["periodBins"]), int(sched.get("phaseOffset") or 0), F.col(cap) if cap in m.there else None)
    lost = m.role(node, "errors")
    return fin(out) + (fin(lost) if lost else F.lit(0.0))


# --- node rows ----------------------------------------------------------------------------------------------------------


def _edge_sum(m: _Model, node: str, side: str, keys: Sequence[str]) -> Column | None:
    """The sum of a node's flows on one side (arriving ones after their lag); None unless every edge has a flow."""
    edges = m.flow_edges(node, side)
    if not edges or any(m.flow(e) is None for e in edges):
        return None
    return sum((shift(f"_f{m.edges.index(e)}", e.lag if side == "target" else 0, keys) for e in edges), F.lit(0.0))


def _class_gap(m: _Model, node: dict, side: str, keys: Sequence[str]) -> Column | None:
    """The greatest difference, among classes, of a node's own measure and of its edges' flows on one side."""
    own = m.role(node, "served" if side == "source" else "arrivals")
    edges = [e for e in m.flow_edges(node["id"], side) if (f := m.flow(e)) and f[0] in m.members]
    if own not in m.members or not edges:
        return None
    total = None
    for e in edges:
        series, part = m.flow(e)
        v = F.col(vector(series)) if side == "source" or not e.lag else F.coalesce(lagged_or_null(vector(series), e.lag, keys), F.array_repeat(F.lit(0.0), len(m.ids)))
        total = plus(total, _times(v, part))
    return F.array_max(F.zip_with(F.col(vector(own)), total, lambda a, b: F.abs(a - b)))


def _times(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(k))


def _static(m: _Model, node: dict) -> list[str]:
    """Codes that follow from the model, whatever the data."""
    i, kind, s, out = node["id"], node.get("kind", "service"), node.get("semantics") or {}, []
    into, away = [e for e in m.edges if e.target == i], [e for e in m.edges if e.source == i]
    out += ["edge_behavior_violation_lag"] * any(e.lag > 0 for e in away)
    if kind == "dlq":
        out += ["dlq_non_terminal_inbound"] * any(e.kind != "terminal" for e in into) + ["dlq_non_terminal_outbound"] * any(e.kind != "terminal" for e in away)
    if kind == "dependency":
        effort = [e for e in into if e.kind == "effort"]
        out += ["dependency_missing_effort_edges"] * (not effort)
        out += ["dependency_retry_pressure_missing"] * (bool(effort) and bool(s.get("errors")) and not any((m.by_id.get(e.source, {}).get("semantics") or {}).get("attempts") for e in effort))
    limits = {c["id"]: c.get("semantics") or {} for c in topology(m.model, "constraints")}
    for c in node.get("constraints") or []:
        out += [f"constraint_missing_{r}" for r in ("arrivals", "served") if c in limits and limits[c].get(r) not in m.there]
    sched = node.get("dispatchSchedule") or {}
    out += ["dispatch_capacity_missing"] * (bool(sched.get("capacitySeries")) and sched["capacitySeries"] not in m.there)
    for side, role in (("source", "served"), ("target", "arrivals")):
        own, flows = m.members.get(m.role(node, role) or ""), [m.flow(e) for e in m.flow_edges(i, side)]
        carried = {c for f in flows if f and f[0] in m.members for c in m.members[f[0]]}
        out += ["edge_class_partial_coverage"] * (bool(own) and bool(carried) and bool(set(own) - carried))
    return list(dict.fromkeys(out))


def _uncovered(m: _Model, node: dict) -> list[tuple[str, str]]:
    """Codes of classes that arrive at a node but are missing in what it serves or loses, and the series that must not be zero
    for that to matter."""
    come, out = m.members.get(m.role(node, "arrivals") or "", []), []
    for role in ("served", "errors"):
        target = m.role(node, role)
        if come and target:
            have = m.members.get(target, [])
            if not have:
                out.append((f"class_series_missing_{role}", target))
            elif set(come) - set(have):
                out.append((f"class_series_partial_{role}", target))
    return out


_PAIR = "struct<code:string,amount:double>"


def _found(pairs: Sequence[tuple[str, Column]]) -> Column:
    """An array of the codes whose amount is over the tolerance."""
    some = [F.struct(F.lit(code).alias("code"), x.cast("double").alias("amount")) for code, x in pairs]
    return F.filter(F.array(*some), lambda x: (x["amount"] > TOLERANCE) & ~F.isnan(x["amount"])) if some else F.array().cast(f"array<{_PAIR}>")


def _node(m: _Model, i: int, node: dict, keys: Sequence[str]) -> dict[str, Column]:
    kind, (queue, _), sched = node.get("kind", "service"), _descriptors(node), node.get("dispatchSchedule")
    null, s = F.lit(None).cast("double"), node.get("semantics") or {}
    out = {c: F.col(n).cast("double") if (n := m.role(node, r)) else null for r, c in ROLES.items()}
    failed = m.role(node, "failures") or m.role(node, "errors")
    if not m.role(node, "retryEcho") and s.get("retryEcho") is None and s.get("retryKernel") and failed:
        out["retry_echo"] = echo(failed, M.retry_kernel(s["retryKernel"])[0], keys)  # null where nothing finite contributes
    made = _metrics(m, node, float(bin_ms(m.model["grid"])))
    open_, sla = _open(node), s.get("slaMinutes") or s.get("slaMin")
    status = M.gate_status(F.lit(True), open_, out["queue_depth"], out["served"]) if sched and queue else F.lit(None).cast("string")
    service = kind in ("serviceWithBuffer",) or not queue
    colour = F.lit("dlq") if kind == "dlq" else M.load_colour(made["utilization"]) if service else M.queue_colour(made["latency_min"], F.lit(float(sla))) if sla else F.lit("gray")
    checked = m.role(node, "arrivals") and m.role(node, "served") and m.role(node, "queueDepth")
    sums = {side: _edge_sum(m, node["id"], side, keys) for side in ("source", "target")}
    wide = [("edge_flow_mismatch_outgoing", F.abs(out["served"] - sums["source"])) if sums["source"] is not None else None, ("edge_flow_mismatch_incoming", F.abs(out["arrivals"] - sums["target"])) if sums["target"] is not None else None]
    wide += [("edge_class_mismatch", gap) if (gap := _class_gap(m, node, side, keys)) is not None else None for side in ("source", "target")]
    into, away = [e for e in m.edges if e.target == node["id"]], [e for e in m.edges if e.source == node["id"]]
    return {
        "node_id": F.lit(node["id"]), "kind": F.lit(kind), "topology": F.lit(True), "value": null, **out, "effective_capacity": _capacity(m, node), **made, "flow_latency_ms": F.col(f"_l{i}"),
        "colour": colour, "queue_status": status, "edges_out": null if sums["source"] is None else sums["source"], "edges_in": null if sums["target"] is None else sums["target"],
        "gate_open": open_ if open_ is not None else F.lit(None).cast("boolean"), "sla_minutes": F.lit(float(sla) if sla else None).cast("double"),
        "_made": F.col(f"_q{i}") if f"_q{i}" in m.there else null, "_in": _inflow(m, node) if checked else null, "_out": _outflow(m, node) if checked else null,
        "_init": F.lit(float((node.get("initialCondition") or {}).get("queueDepth", 0))), "_retries": F.lit(s.get("maxAttempts") is not None), "_scheduled": F.lit(bool(sched)),
        "_terminal": F.lit(kind == "queue" and bool(into) and all(e.kind == "terminal" for e in into) and not away), "_declared": F.array(*[F.lit(ROLES[r]) for r in ROLES if s.get(r)]).cast("array<string>"),
        "_static": F.array(*map(F.lit, _static(m, node))).cast("array<string>"), "_codes": _found([w for w in wide if w]),
        "_once": _found([(code, F.abs(F.col(series))) for code, series in (_uncovered(m, node) if kind != "serviceWithBuffer" else [])]),
    }


def _router_codes(m: _Model, name: str) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """Per bin how far a router's targets are from what enters it, by class; and, for the whole run, classes without a route."""
    router = m.routers[name]
    source, routes = router["inputs"]["queue"], router["routes"]
    if source not in m.members:
        return [], []
    own = F.col(vector(source))
    named = {c for r in routes for c in r.get("classes") or []}
    lost = [c for c in m.members[source] if c not in named] if all(r.get("classes") for r in routes) else []
    total = None
    for target in dict.fromkeys(r["target"] for r in routes):
        if target in m.members:
            total = plus(total, F.col(vector(target)))
    leaks = F.array_max(F.zip_with(own, total, lambda a, b: F.abs(a - b))) if total is not None else F.array_max(F.transform(own, F.abs))
    return [("router_class_leakage", leaks)], [("router_missing_class_route", F.greatest(*[F.abs(own[m.ids.index(c)]) for c in lost], F.lit(0.0)))] if lost else []


def node_rows(df: DataFrame, model: dict, keys: Sequence[str] = KEYS, internal: bool = False) -> DataFrame:
    """Rows (keys..., bin, node_id, kind, topology, value, role columns, derived metrics, colour, queue_status, edges_out, edges_in,
    gate_open, sla_minutes): a row per bin for every node of the topology, and one with its value for every other series of the
    model (topology is false there). internal keeps the columns that warnings are made of."""
    m = _Model(model, df.columns)
    wide = _wide(df, m, keys)
    m.there |= set(wide.columns)
    rows = [_node(m, i, t, keys) for i, t in enumerate(m.nodes)]
    null, flag = F.lit(None).cast("double"), F.lit(False)
    empty = {
        "topology": flag, **{c: null for c in ROLES.values()}, "effective_capacity": null, **{x: null for x in METRICS}, "colour": F.lit(None).cast("string"), "queue_status": F.lit(None).cast("string"), "edges_out": null, "edges_in": null,
        "gate_open": F.lit(None).cast("boolean"), "sla_minutes": null, "_made": null, "_in": null, "_out": null, "_init": F.lit(0.0), "_retries": flag, "_scheduled": flag, "_terminal": flag, "_declared": F.array().cast("array<string>"),
        "_static": F.array().cast("array<string>"), "_codes": F.array().cast(f"array<{_PAIR}>"), "_once": F.array().cast(f"array<{_PAIR}>"),
    }
    for i, n in nodes_of(model).items():
        if i not in m.by_id and (i in m.there or i in m.routers):
            bins, once = _router_codes(m, i) if i in m.routers else ([], [])
            rows.append(empty | {"node_id": F.lit(i), "kind": F.lit(n.get("kind", "const")), "value": F.col(i).cast("double") if i in m.there else null, "_codes": _found(bins), "_once": _found(once)})
    known = {x for s in steps_of(model) for x in s.makes} | set(keys) | {"bin"}
    if odd := [c for c in df.columns if c not in known and not c.endswith("__classes")]:
        rows.append(empty | {"node_id": F.lit("engine"), "kind": F.lit("engine"), "value": null, "_static": F.array(F.lit("post_eval_injection")), "_declared": F.array(*map(F.lit, odd))})
    names = list(dict.fromkeys(["node_id", "kind", "topology", "value", *ROLES.values(), "effective_capacity", *METRICS, *empty]))
    # Windows cannot stand within an explode: the structs are columns first.
    wide = wide.select(*keys, "bin", *[F.struct(*[r[c].alias(c) for c in names]).alias(f"_n{i}") for i, r in enumerate(rows)])
    long = wide.select(*keys, "bin", F.explode(F.array(*[f"_n{i}" for i in range(len(rows))])).alias("_n")).select(*keys, "bin", "_n.*")
    return long if internal else long.where(F.col("kind") != "engine").drop(*[c for c in names if c.startswith("_")])


def edge_rows(df: DataFrame, model: dict, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows (keys..., bin, edge_id, source, target, kind, flow, attempts_volume, failures_volume, retry_volume, retry_rate, classes): what
    is on each edge in each bin, null where its type or measure has none. classes maps class ids to their part of the flow.

    Attempts and failures of effort edges come `lag` bins late. What a target's retries bring comes over its throughput edges by
    their flow, evenly where nothing flows; over an effort edge it is what is tried beyond the flow."""
    m = _Model(model, df.columns)
    wide, null = df.withColumns({f"_f{i}": _flow(m, e) for i, e in enumerate(m.edges)}), F.lit(None).cast("double")
    if not m.edges:
        return wide.limit(0).select(*keys, "bin", *[F.lit(None).cast("string").alias(c) for c in ("edge_id", "source", "target", "kind")], *[null.alias(c) for c in ("flow", "attempts_volume", "failures_volume", "retry_volume", "retry_rate")], F.lit(None).cast("map<string,double>").alias("classes"))
    structs = []
    for i, e in enumerate(m.edges):
        flow, late = F.col(f"_f{i}"), lambda x, e=e: x if x is None or not e.lag else F.lag(x, e.lag).over(W.partitionBy(*keys).orderBy("bin"))
        tried, failed, rate, again = None, None, null, null
        if e.kind == "effort" and e.plain:
            node = m.by_id.get(e.source)
            tried, failed = late(_scaled(m, e, "attempts")), late(_scaled(m, e, "failures" if m.role(node, "failures") else "errors"))
            if tried is not None and failed is not None:
                a, b = m.role(node, "attempts"), m.role(node, "failures") or m.role(node, "errors")
                rate = late(F.when(F.col(a) > 0, F.col(b) / F.col(a)))
            if tried is not None:
                again = F.when(tried.isNotNull(), F.greatest(tried - F.coalesce(flow, F.lit(0.0)), F.lit(0.0)))
        elif e.kind == "terminal" and e.measure in FAILURES:
            failed = _scaled(m, e, FAILURES[e.measure])
        elif e.kind == "throughput" and (echo := m.role(m.by_id.get(e.target), "retryEcho")) and m.flow(e):
            like = [F.greatest(fin(f"_f{j}"), F.lit(0.0)) for j, x in enumerate(m.edges) if x.target == e.target and x.kind == "throughput" and m.flow(x)]
            total = sum(like[1:], like[0])
            again = F.col(echo) * F.when(total > 0, F.try_divide(F.greatest(fin(flow), F.lit(0.0)), total)).otherwise(F.lit(1.0 / len(like)))
        found = m.flow(e)
        parts = F.lit(None).cast("map<string,double>")
        if found and found[0] in m.members:
            own = m.members[found[0]]
            parts = F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*[F.col(vector(found[0]))[m.ids.index(c)] * F.lit(found[1]) for c in own]))
        cells = {"edge_id": F.lit(e.edge_id), "source": F.lit(e.source), "target": F.lit(e.target), "kind": F.lit(e.kind), "flow": flow, "attempts_volume": tried if tried is not None else null, "failures_volume": failed if failed is not None else null, "retry_volume": again, "retry_rate": rate, "classes": parts}
        structs.append(F.struct(*[c.alias(n) for n, c in cells.items()]))
    wide = wide.select(*keys, "bin", *[s.alias(f"_e{i}") for i, s in enumerate(structs)])
    return wide.select(*keys, "bin", F.explode(F.array(*[f"_e{i}" for i in range(len(structs))])).alias("_e")).select(*keys, "bin", "_e.*")


# --- warnings -----------------------------------------------------------------------------------------------------------


def _bin_codes() -> list[tuple[str, Column]]:
    """By code, how far a bin of a node row is from where it must be."""
    c, kind = F.col, F.col("kind")
    names = {"queue_depth": "queue", "retry_budget_remaining": "retry_budget"}
    out = [(f"{names.get(x, x)}_negative", -c(x)) for x in ("arrivals", "served", "errors", "attempts", "failures", "exhausted_failures", "queue_depth", "retry_echo", "retry_budget_remaining")]
    out += [
        ("served_exceeds_arrivals", F.when(~kind.isin("serviceWithBuffer", "dependency"), c("served") - c("arrivals"))), ("served_exceeds_capacity", F.when(kind.isin("service", "router", "serviceWithBuffer"), c("served") - c("effective_capacity"))),
        ("errors_exceed_arrivals", c("errors") - c("arrivals")), ("attempts_below_arrivals", c("arrivals") - c("attempts")), ("failures_exceed_attempts", c("failures") - c("attempts")),
        ("exhausted_exceeds_failures", c("exhausted_failures") - c("failures")), ("exhausted_exceeds_errors", F.when(c("failures").isNull(), c("exhausted_failures") - c("errors"))), ("queue_depth_mismatch", F.abs(c("queue_depth") - c("_again"))),
    ]
    off = F.abs(c("attempts") - c("served") - F.coalesce("failures", "errors"))
    out.append(("attempts_conservation_mismatch", F.when(off > 1e-4, off)))
    stuck = ~kind.isin("dlq", "serviceWithBuffer") & ~c("_terminal") & (c("served") <= TOLERANCE) & is_finite(c("queue_depth")) & is_finite(c("served"))
    return [*out, ("queue_latency_gate_closed", F.when(stuck & c("_scheduled"), F.abs("queue_depth"))), ("queue_latency_unreported", F.when(stuck & ~c("_scheduled"), F.abs("queue_depth")))]


def _run_codes(has: Callable[[str], Column]) -> list[tuple[str, Column]]:
    """By code, whether it holds for a node's whole run. has: whether a column has a value in any bin."""
    kind, dependency = F.col("kind"), F.col("kind") == "dependency"
    lacks = lambda x: ~has(x)
    wants = lambda x, *kinds: kind.isin(*kinds) | F.array_contains("_declared", x)
    serves = ("service", "serviceWithBuffer", "router")
    return [
        ("missing_capacity_series", wants("capacity", *serves) & lacks("capacity")), ("missing_exhausted_failures_series", F.col("_retries") & lacks("exhausted_failures")), ("missing_retry_budget_series", F.col("_retries") & lacks("retry_budget_remaining")),
        ("capacity_all_zero", ~(F.col("_retries") & lacks("retry_budget_remaining")) & (F.col("_top") <= TOLERANCE)), ("missing_dependency_arrivals", dependency & lacks("arrivals")), ("missing_dependency_served", dependency & lacks("served")),
        ("missing_served_series", ~dependency & wants("served", *serves) & lacks("served")), ("missing_queue_depth_series", wants("queue_depth", "queue", "dlq") & lacks("queue_depth")),
        ("missing_processing_time_series", wants("processing_time_ms_sum", *serves) & lacks("processing_time_ms_sum")), ("missing_served_count_series", wants("served_count", *serves) & lacks("served_count")),
        ("dispatch_missing_served_series", F.col("_scheduled") & lacks("served")), ("dispatch_never_releases", F.col("_scheduled") & has("served") & (F.col("_come") > TOLERANCE) & (F.col("_gone") <= TOLERANCE)),
    ]


def warnings(nodes: DataFrame, keys: Sequence[str] = KEYS, least: int = 3, tolerance: float = 0.25) -> DataFrame:
    """Rows (keys..., node_id, code, severity, bins, worst, n, start_bin, end_bin) of node rows with their internal columns: what the
    bins of a node break (the first bins of each code, the greatest amount, how many), what a run lacks, the longest streaks
    of a growing queue, of overload and of latency over the SLA, and arrivals that are not stationary."""
    by = [*keys, "node_id"]
    order, all_ = W.partitionBy(*by).orderBy("bin"), W.partitionBy(*by)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    c, present = F.col, ("arrivals", "served", "capacity", "exhausted_failures", "retry_budget_remaining", "queue_depth", "processing_time_ms_sum", "served_count")
    df = nodes.withColumns({
        "_sum": c("_init") + F.sum(fin("_in") - fin("_out")).over(so_far), "_grown": c("queue_depth") > F.lag("queue_depth").over(order), "_bins": F.count("*").over(all_), "_last": F.max("bin").over(all_), "_first": F.min("bin").over(all_),
        "_top": F.max(F.abs("effective_capacity")).over(all_), "_come": F.sum(F.greatest(fin("arrivals"), F.lit(0.0))).over(all_), "_gone": F.sum(F.greatest(fin("served"), F.lit(0.0))).over(all_),
        **{f"_has_{x}": F.max(c(x).isNotNull()).over(all_) for x in present},
    })
    runs = {"backlog_growth_streak": c("_grown"), "backlog_overload_ratio": (c("effective_capacity") > 0) & (c("arrivals") / c("effective_capacity") > 1), "backlog_age_risk": c("latency_min") > c("sla_minutes")}
    half = c("bin") - c("_first") < F.floor(c("_bins") / 2)
    df = df.withColumns({
        "_again": F.coalesce("_made", F.when(c("_in").isNotNull(), c("_sum") - F.least(F.lit(0.0), F.min("_sum").over(so_far)))),
        **{f"_since_{k}": F.max(F.when(~F.coalesce(x, F.lit(False)), c("bin"))).over(so_far) for k, x in runs.items()},
        "_early": F.avg(F.when(half, c("arrivals"))).over(all_), "_late": F.avg(F.when(~half, c("arrivals"))).over(all_), "_once_all": F.flatten(F.collect_list("_once").over(all_)),
    })
    length = {k: c("bin") - F.coalesce(f"_since_{k}", c("_first") - 1) for k in runs}
    df = df.withColumns({f"_best_{k}": F.max(F.when(n > 0, F.struct(n.alias("n"), (-c("bin")).alias("end")))).over(all_) for k, n in length.items()})
    one = lambda code, amount=None, bin_=None, start=None, end=None: F.struct(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), (F.lit(None) if amount is None else amount).cast("double").alias("amount"), (F.lit(None) if bin_ is None else bin_).cast("long").alias("at"), (F.lit(None) if start is None else start).cast("long").alias("start"), (F.lit(None) if end is None else end).cast("long").alias("end"))
    per_bin = F.transform(F.concat(_found(_bin_codes()), "_codes"), lambda x: one(x["code"], x["amount"], c("bin")))
    streaks = []
    for k in runs:
        best = c(f"_best_{k}")
        start = -best["end"] - best["n"] + 1 - (1 if k == "backlog_growth_streak" else 0)  # growth starts at the bin before its first increase
        streaks.append(F.when((best["n"] >= least) & (c("queue_time_ms").isNotNull() | F.array_contains(F.array(*map(F.lit, WITH_QUEUE)), c("kind"))), one(k, None, None, start, -best["end"])))
    apart = F.coalesce(F.try_divide(F.abs(c("_early") - c("_late")), F.greatest(F.abs("_early"), F.abs("_late"))) > tolerance, F.lit(False)) & (c("_bins") >= 4) & c("kind").isin(*WITH_QUEUE)
    whole = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), one(code)) for code, x in _run_codes(lambda x: c(f"_has_{x}"))], *streaks, F.when(apart, one("littles-law-non-stationary"))))
    whole = F.concat(F.when(c("topology"), whole).otherwise(F.slice(whole, 1, 0)), F.transform("_static", lambda x: one(x)), F.transform(F.array_distinct(F.transform("_once_all", lambda x: x["code"])), lambda x: one(x)))
    codes = F.concat(per_bin, F.when(c("bin") == c("_last"), whole).otherwise(F.slice(whole, 1, 0)))
    found = df.select(*by, F.explode(codes).alias("_w")).select(*by, "_w.*").groupBy(*by, "code")
    out = found.agg(F.array_sort(F.collect_set("at")).alias("_bins"), F.max("amount").alias("worst"), F.count("*").alias("n"), F.min("start").alias("start_bin"), F.min("end").alias("end_bin"))
    bins = F.when(c("code") == "attempts_conservation_mismatch", F.slice("_bins", 1, 1)).when(c("code").isin(*ALL_BINS), c("_bins")).otherwise(F.slice("_bins", 1, FIRST))
    return out.select(*by, "code", F.when(c("code").isin(*INFO), "info").otherwise("warning").alias("severity"), bins.alias("bins"), "worst", "n", "start_bin", "end_bin")


# --- one call -----------------------------------------------------------------------------------------------------------


class State(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame


def state_of(df: DataFrame, model: dict, keys: Sequence[str] = KEYS) -> State:
    """Node rows, edge rows and warnings of a model that evaluate() has evaluated (with_classes, for those of classes)."""
    return State(node_rows(df, model, keys), edge_rows(df, model, keys), warnings(node_rows(df, model, keys, internal=True), keys))


def analyse(spark, model: dict) -> list[tuple[str, str, str]]:
    """The third tier of validation: (node_id, code, severity) of a model evaluated by itself, in order."""
    df = evaluate(spark, model, with_classes=bool(class_ids(model)))
    found = warnings(node_rows(df, model, internal=True)).select("node_id", "code", "severity").distinct()
    return [tuple(r) for r in found.sort("node_id", "code").collect()]
