"""A model's graph as small tables, and the series that its topology implies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .expr import parse, references
from .model import nodes_of, queue_series, topology


def graph(spark: SparkSession, model: dict, mode: str = "full", kinds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the topology's in mode "operational"; with the series and what they refer to in mode "full"."""
    nodes = [(t["id"], t.get("kind", "service"), "topology") for t in topology(model, "nodes")]
    edges = [(e.get("id") or f"{e['source']}->{e['target']}", e["source"].split(":")[0], e["target"].split(":")[0], e.get("type", "throughput"), float(e.get("weight", 1.0))) for e in topology(model, "edges")]
    if mode == "full":
        for i, n in nodes_of(model).items():
            nodes.append((i, n.get("kind", "const"), "series"))
            if n.get("kind") == "expr":
                same, past = references(parse(n["expr"]))
                edges += [(f"{s}->{i}", s, i, "lagged" if s in past else "reference", 1.0) for s in sorted(same | past)]
            elif n.get("kind") == "router":
                edges += [(f"{i}->{r['target']}", i, r["target"], "route", float(r.get("weight", 1.0))) for r in n["router"]["routes"]]
        for t in topology(model, "nodes"):
            s = t.get("semantics") or {}
            edges += [(f"{s[r]}->{t['id']}", s[r], t["id"], r, 1.0) for r in ("arrivals", "served", "errors") if s.get(r)]
    if kinds:
        nodes = [n for n in nodes if n[1] in kinds]
    known = {n[0] for n in nodes}
    edges = [e for e in edges if e[1] in known and e[2] in known]
    return spark.createDataFrame(nodes, "node_id string, kind string, layer string"), spark.createDataFrame(edges, "edge_id string, source string, target string, type string, weight double")


def levels(model: dict) -> dict[str, int]:
    """Each topology node's place in topological order: 0 without predecessors. Nodes of a cycle come after all others, in
    the order in which they are declared."""
    ids = [t["id"] for t in topology(model, "nodes")]
    before: dict[str, set[str]] = {i: set() for i in ids}
    for e in topology(model, "edges"):
        s, t = e["source"].split(":")[0], e["target"].split(":")[0]
        if s in before and t in before and s != t:
            before[t].add(s)
    out: dict[str, int] = {}
    while ready := [i for i in ids if i not in out and before[i] <= set(out)]:
        out |= {i: max((out[b] + 1 for b in before[i]), default=0) for i in ready}
    top = max(out.values(), default=-1)
    return out | {i: top + 1 + k for k, i in enumerate(i for i in ids if i not in out)}


def implied(model: dict) -> dict[str, str]:
    """Series that no node of the model makes but its topology asks for: depths, retry echoes, what sinks serve."""
    made, out = set(nodes_of(model)), {}
    for t in topology(model, "nodes"):
        s = t.get("semantics") or {}
        if t.get("kind") in ("serviceWithBuffer", "queue", "dlq") and s.get("arrivals") and queue_series(t) not in made:
            out[queue_series(t)] = "queue"
        if s.get("retryEcho") and s["retryEcho"] not in made:
            out[s["retryEcho"]] = "retry_echo"
        if t.get("kind") == "sink" and s.get("served") and s["served"] not in made:
            out[s["served"]] = "sink_served"
    return out
