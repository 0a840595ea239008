"""Models: checked dictionaries (from YAML, JSON or Python) that the compiler makes DataFrames of."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import Pmf
from .expr import IDENTIFIER, ExpressionError, parse, references

UNIT_MS = {"minutes": 60_000, "hours": 3_600_000, "days": 86_400_000, "weeks": 604_800_000}


class ModelError(ValueError):
    pass


def load(text: str) -> dict[str, Any]:
    """A model from JSON, or from YAML where a YAML library is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ModelError("not JSON, and no YAML library is installed") from None
        return yaml.safe_load(text)


def substitute(template: str, parameters: dict[str, dict], values: dict[str, Any] | None = None) -> str:
    """${name} by values or defaults, within each parameter's bounds."""
    values, out = values or {}, template
    if unknown := set(values) - set(parameters):
        raise ModelError(f"unknown parameters: {sorted(unknown)}")
    for name, p in parameters.items():
        v = values.get(name, p.get("default"))
        if v is None:
            raise ModelError(f"parameter {name} has neither value nor default")
        if isinstance(v, (int, float)) and (v < p.get("min", v) or v > p.get("max", v)):
            raise ModelError(f"parameter {name}: {v} is out of bounds")
        out = out.replace(f"${{{name}}}", json.dumps(v) if isinstance(v, list) else str(v))
    if left := re.search(r"\$\{(\w+)\}", out):
        raise ModelError(f"no parameter {left[1]}")
    return out


def bin_ms(grid: dict) -> int:
    return int(grid["binSize"]) * UNIT_MS[str(grid["binUnit"]).lower()]


def bin_times(spark: SparkSession, grid: dict) -> DataFrame:
    """(bin, bin_start, bin_ms): starts are left ends, in UTC; null where the grid has no start."""
    ms = bin_ms(grid)
    start = F.lit(grid["start"]).cast("timestamp") if grid.get("start") else F.lit(None).cast("timestamp")
    at = F.timestamp_millis(F.unix_millis(start) + F.col("id") * ms)
    return spark.range(int(grid["bins"])).select(F.col("id").alias("bin"), at.alias("bin_start"), F.lit(float(ms)).alias("bin_ms"))


def nodes_of(model: dict) -> dict[str, dict]:
    return {n["id"]: n for n in model.get("nodes") or []}


def topology(model: dict, part: str) -> list[dict]:
    return ((model.get("topology") or {}).get(part)) or []


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def queue_series(node: dict) -> str:
    """The id of the depth series that a topology node makes."""
    given = (node.get("semantics") or {}).get("queueDepth")
    return given if given and given != "self" else f"{snake(node['id'])}_queue"


def schema_errors(model: dict) -> list[str]:
    """Tier one: what can be seen without compiling."""
    out: list[str] = []
    grid = model.get("grid") or {}
    bins = grid.get("bins")
    if not isinstance(bins, int) or not 1 <= bins <= 10_000:
        return ["grid.bins is a whole number from 1 to 10000"]
    if not 1 <= int(grid.get("binSize", 0)) <= 1000:
        out.append("grid.binSize is a whole number from 1 to 1000")
    if str(grid.get("binUnit", "")).lower() not in UNIT_MS:
        out.append(f"grid.binUnit is one of {', '.join(UNIT_MS)}")
    start = grid.get("start")
    if start and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)", str(start)):
        out.append("grid.start is a UTC time as in 2024-01-01T00:00:00Z")
    seen: set[str] = set()
    for n in model.get("nodes") or []:
        i = str(n.get("id", ""))
        if not IDENTIFIER.match(i):
            out.append(f"node id {i!r} is not a name")
        if i.lower() in seen:
            out.append(f"node id {i} occurs twice")
        seen.add(i.lower())
        kind = n.get("kind", "const")
        if kind == "const" and len(n.get("values") or []) != bins:
            out.append(f"{i}: {len(n.get('values') or [])} values for {bins} bins")
        elif kind == "expr":
            try:
                parse(str(n.get("expr", "")))
            except ExpressionError as e:
                out.append(f"{i}: {e}")
        elif kind == "pmf":
            p = n.get("pmf") or {}
            try:
                Pmf(p.get("values") or [], p.get("probabilities") or [])
            except ValueError as e:
                out.append(f"{i}: {e}")
        elif kind not in ("const", "expr", "pmf", "router", "serviceWithBuffer"):
            out.append(f"{i}: unknown kind {kind}")
    classes = {c["id"] for c in model.get("classes") or []}
    for a in (model.get("traffic") or {}).get("arrivals") or []:
        if classes and a.get("classId") not in classes:
            out.append(f"traffic names the class {a.get('classId')}, which is not declared")
    topo = {t["id"]: t for t in topology(model, "nodes")}
    for t in topo.values():
        target = t.get("wipOverflow")
        if target and target != "loss" and target not in topo:
            out.append(f"{t['id']}: overflow to {target}, which is no node")
        at, path = t["id"], []
        while at in topo and at not in path:
            path.append(at)
            at = topo[at].get("wipOverflow") or ""
        if at in path:
            out.append(f"{t['id']}: overflow goes in a circle")
        if any(c not in {x["id"] for x in topology(model, "constraints")} for c in t.get("constraints") or []):
            out.append(f"{t['id']}: unknown constraint")
    return list(dict.fromkeys(out))


def validate(model: dict, tier: str = "compile", spark: SparkSession | None = None) -> list[str]:
    """Errors up to a tier: "schema"; "compile", which also orders the series and follows references and starts; or "analyse",
    which evaluates a model without errors and adds its warnings (node: code)."""
    found = schema_errors(model)
    if not found and tier != "schema":
        from .compiler import plan

        found = initial_condition_errors(model) + reference_errors(model)
        try:
            plan(model)
        except (ModelError, ExpressionError) as e:
            found.append(str(e))
    if not found and tier == "analyse":
        from .run_state import analyse

        found = [f"{node}: {code}" for node, code, _ in analyse(spark or SparkSession.active(), model)]
    return found


def initial_condition_errors(model: dict) -> list[str]:
    """Series that look at their own past need the initial condition of the topology node whose queue they are. A value `initial` of
    a series itself is none: nothing reads it, so it is an error."""
    starts = {queue_series(t) for t in topology(model, "nodes") if (t.get("initialCondition") or {}).get("queueDepth") is not None}
    own = [i for i, n in nodes_of(model).items() if n.get("kind") == "expr" and i in references(parse(n["expr"]))[1]]
    ignored = [f"{i}: a series takes no initial value; the topology's initialCondition does" for i, n in nodes_of(model).items() if "initial" in n]
    return ignored + [f"{i}: it looks at its own past and has no initial value" for i in own if i not in starts]


def reference_errors(model: dict) -> list[str]:
    """Outputs, topology semantics, edges and constraints that name what nothing makes."""
    from .compiler import steps_of

    try:
        known = {m for s in steps_of(model) for m in s.makes}
    except (ModelError, ExpressionError):
        return []  # the order of series says what is wrong
    names = [str(o.get("series") or "*") for o in model.get("outputs") or []]
    out = [f"output {n} is no series" for n in names if "*" not in n and n.lower() not in {k.lower() for k in known}]
    topo = {t["id"] for t in topology(model, "nodes")}
    for t in topology(model, "nodes"):
        for role, name in (t.get("semantics") or {}).items():
            if isinstance(name, str) and name not in known and name != "self" and not name.startswith("file:") and role not in ("queueDepth", "retryEcho", "aliases"):
                out.append(f"{t['id']}: {role} is {name}, which is no series")
    for e in topology(model, "edges"):
        for end in ("source", "target", "from", "to"):
            at = str(e[end]).split(":")[0] if e.get(end) else None
            if at and at not in topo:
                out.append(f"edge {e.get('id')}: {end} is {at}, which is no node")
    return out


def model_hash(model: dict) -> str:
    """The same for models that differ in order of keys, comments or layout alone."""
    return hashlib.sha256(json.dumps(model, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def run_id(template: str, model: dict) -> str:
    return f"run_{re.sub(r'[^A-Za-z0-9]+', '-', template).strip('-').lower()}_{model_hash(model)[:16]}"


def outputs(model: dict, available: list[str]) -> list[str]:
    """Series that a model's outputs name: exactly (in any case), by prefix/*, or all of them; none named means all."""
    wanted: list[str] = []
    for o in model.get("outputs") or []:
        s = str(o["series"]).lower()
        wanted += [a for a in available if s == "*" or a.lower() == s or s.endswith("/*") and a.lower().startswith(s[:-1])]
    return list(dict.fromkeys(wanted)) or available
