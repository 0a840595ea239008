"""Fixture models: a folder with a model (a window and a topology whose semantics name files) and the files' series.

The model comes as model.json (or model.yaml, where a YAML library is installed); all files are read at once, strictly, and
stand as the constants of the model that it becomes, so that a fixture's state is that of any evaluated model."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import ModelError, load
from ..plans.run_state import ROLES
from .series_files import _on_grid, get_text, resolve


def model_of(document: dict[str, Any]) -> tuple[dict, dict[str, str]]:
    """The model of a fixture document, and the reference of each series that it reads. Nodes need arrivals and served; a weight
    of 0 counts 1; references to one file are one series."""
    window, topology = document.get("window"), document.get("topology")
    if not window:
        raise ModelError("the fixture has no window")
    if not topology:
        raise ModelError("the fixture has no topology")
    names: dict[str, str] = {}

    def named(uri: str) -> str:
        return names.setdefault(uri, f"s{len(names)}")

    nodes = []
    for n in topology.get("nodes") or []:
        if not n.get("id"):
            raise ModelError("a fixture node has no id")
        given = n.get("semantics")
        if not given:
            raise ModelError(f"{n['id']}: the fixture node has no semantics")
        for role in ("arrivals", "served"):
            if not str(given.get(role) or "").strip():
                raise ModelError(f"{n['id']}: the fixture node has no {role}")
        semantics = {r: named(given[r]) if str(given[r]).startswith("file:") else given[r] for r in ROLES if str(given.get(r) or "").strip()}
        if given.get("slaMinutes") is not None:
            semantics["slaMinutes"] = float(given["slaMinutes"])
        nodes.append({k: v for k, v in {**n, "semantics": semantics}.items() if v not in (None, "")})
    edges = []
    for e in topology.get("edges") or []:
        if not e.get("source") or not e.get("target"):
            raise ModelError("a fixture edge has no source or no target")
        edges.append({**e, "weight": float(e.get("weight") or 0) or 1.0})
    bins = int(window["bins"])
    grid = {"bins": bins, "binSize": int(window["binSize"]), "binUnit": window.get("binUnit") or "minutes"} | ({"start": window["startTimeUtc"]} if window.get("startTimeUtc") else {})
    constants = [{"id": s, "kind": "const", "values": [0.0] * bins} for s in names.values()]
    return {"grid": grid, "nodes": constants, "topology": {"nodes": nodes, "edges": edges, "constraints": []}}, {s: uri for uri, s in names.items()}


def load_fixture(spark: SparkSession, folder: str, file: str = "model.json") -> tuple[dict, DataFrame]:
    """(model, frame): the frame has scenario_id 0, bin and the series that the fixture's files hold."""
    model, sources = model_of(load(get_text(spark, f"{folder}/{file}")))
    frame = _on_grid(spark, {s: resolve(uri, folder) for s, uri in sources.items()}, int(model["grid"]["bins"]))
    return model, frame.select(F.lit(0).cast("long").alias("scenario_id"), "*")
