"""Results as they are read: what a node is, which metrics it has, one bin of all nodes, or a window as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M

# What each kind of node is, and which metrics sum over bins.
CATEGORIES = {"service": "service", "serviceWithBuffer": "service", "queue": "queue", "dlq": "dlq", "router": "router", "dependency": "dependency", "sink": "sink", "const": "constant", "expr": "expression", "pmf": "expression"}
WITH_QUEUE, WITH_SERVICE, COMPUTED = ("serviceWithBuffer", "queue", "dlq"), ("service", "serviceWithBuffer", "sink"), ("const", "expr", "pmf", "router")
SUMS, MEANS = ("arrivals", "served", "errors", "attempts", "failures", "flow"), ("utilization", "latency_min", "service_time_ms", "cycle_time_ms", "flow_efficiency", "throughput_ratio")


def _of(kind: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[kind], F.lit(default))


def describe_nodes(topology: DataFrame) -> DataFrame:
    """topology (node_id, kind) with category, has_queue, has_service and identity."""
    kind = F.col("kind")
    queue, service = kind.isin(*WITH_QUEUE), kind.isin(*WITH_SERVICE)
    identity = F.when(queue & service, "service_with_buffer").when(queue, "queue").when(service, "service").otherwise(_of(kind, CATEGORIES, "unknown"))
    return topology.withColumns({"category": _of(kind, CATEGORIES, "unknown"), "has_queue": queue, "has_service": service, "identity": identity})


def with_metrics(nodes: DataFrame, bin_ms: float) -> DataFrame:
    """nodes (arrivals, served, queue_depth, capacity, processing_time_ms_sum, served_count) with their derived metrics."""
    df = nodes.withColumns({"queue_time_ms": M.queue_time_ms("queue_depth", "served", bin_ms), "service_time_ms": M.service_time_ms("processing_time_ms_sum", "served_count"), "utilization": M.utilization("served", "capacity")})
    df = df.withColumn("cycle_time_ms", M.cycle_time_ms(F.col("queue_time_ms"), F.col("service_time_ms")))
    return df.withColumns({"flow_efficiency": M.flow_efficiency(F.col("service_time_ms"), F.col("cycle_time_ms")), "latency_min": F.col("queue_time_ms") / 60000, "throughput_ratio": M.throughput_ratio("served", "arrivals")})


def emitted(df: DataFrame, metrics: Sequence[str], by: str = "node_id") -> DataFrame:
    """Which metrics have a value in any bin."""
    return df.groupBy(by).agg(*[F.coalesce(F.max(F.col(m).isNotNull()), F.lit(False)).alias(m) for m in metrics])


def aggregation(metric: str) -> str:
    return "sum" if metric in SUMS else "avg" if metric in MEANS else "unknown"


#: How the metrics that the state derives are to be aggregated, and where each comes from; a depth is explicit where it is given.
DERIVED = {"latency_min": "avg", "service_time_ms": "avg", "flow_latency_ms": "avg", "queue_time_ms": "avg", "cycle_time_ms": "avg", "flow_efficiency": "avg", "utilization": "unknown", "throughput_ratio": "unknown"}


def series_metadata(nodes: DataFrame, by: Sequence[str] = ("node_id",), given: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., metric, aggregation, origin) of the derived metrics that have a value in any bin of a node, and of its depth:
    explicit for the nodes in given, derived for others."""
    has = nodes.groupBy(*by).agg(*[F.max(F.col(m).isNotNull()).alias(m) for m in DERIVED if m in nodes.columns], F.max(F.col("queue_depth").isNotNull()).alias("queue_depth"))
    row = lambda m, how, origin: F.when(F.col(m), F.struct(F.lit(m).alias("metric"), F.lit(how).cast("string").alias("aggregation"), origin.alias("origin")))
    origin = F.when(F.col("node_id").isin(*given), "explicit").otherwise("derived") if given else F.lit("derived")
    rows = [row(m, how, F.lit("derived")) for m, how in DERIVED.items() if m in nodes.columns] + [row("queue_depth", None, origin)]
    return has.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("m")).select(*by, "m.*")


def snapshot(df: DataFrame, bin_: int) -> DataFrame:
    return df.where(F.col("bin") == bin_)


def window(df: DataFrame, start: int, end: int, series: Sequence[str], by: Sequence[str] = ("node_id",), mode: str = "full", most: int = 500) -> DataFrame:
    """One row per node with an array per series over bins start..end; "operational" leaves computed kinds out."""
    if not 0 <= start <= end or end - start + 1 > most:
        raise ValueError(f"a window has 1 to {most} bins")
    some = df.where(F.col("bin").between(start, end))
    if mode == "operational":
        some = some.where(~F.col("kind").isin(*COMPUTED))
    rows = F.array_sort(F.collect_list(F.struct("bin", *series)))
    packed = some.groupBy(*by).agg(rows.alias("_r"))
    return packed.select(*by, *[F.col("_r").getField(s).alias(s) for s in series])  # a field of an array of structs is an array


def keep_edges(edges: DataFrame, ids: Sequence[str] = (), metrics: Sequence[str] = (), class_ids: Sequence[str] = ()) -> DataFrame:
    """Edge series (edge_id, metric, class_id) by lists in any case; an empty list keeps all."""
    for column, wanted in (("edge_id", ids), ("metric", metrics), ("class_id", class_ids)):
        if wanted:
            edges = edges.where(F.lower(column).isin(*[w.lower() for w in wanted]))
    return edges


def class_metrics(nodes: DataFrame, classes: DataFrame, bin_ms: float, keys: Sequence[str] = ("scenario_id", "node_id", "bin")) -> DataFrame:
    """with_metrics() by class. classes: keys, class_id and the same measures; a node and bin without rows of a class of its
    own counts as one class "*" with the node's totals. A row of class "*" beside others is left out."""
    named = classes.where("class_id <> '*'").select(*keys, "class_id", *[c for c in nodes.columns if c not in keys])
    has = named.select(*keys).distinct()
    whole = nodes.join(has, list(keys), "left_anti").withColumn("class_id", F.lit("*"))
    return with_metrics(named.unionByName(whole), bin_ms)
