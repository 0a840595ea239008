"""Routers, shared capacity, classes and edge flows: joins with small dimension tables and shares over groups.

Dimension tables come from a model (routes, edges, members of constraints). They join by their keys; Spark broadcasts
them where their measured size allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arith import fin, safe_div
from ..sources.shared import fresh

BIN = ("scenario_id", "bin")


def share(x: Column | str, *by: str, tolerance: float = 1e-15) -> Column:
    """x over the sum of x in its group; 0 where the sum is nothing."""
    x = F.col(x) if isinstance(x, str) else x
    total = F.sum(x).over(W.partitionBy(*by))
    return F.when(F.abs(total) < tolerance, 0.0).otherwise(F.try_divide(x, total))


def route(source: DataFrame, routes: DataFrame, class_flow: DataFrame | None = None, keys: Sequence[str] = BIN) -> DataFrame:
    """Flow by target. source: keys, router, value. routes: router, target, weight (null for class routes), class_id.
    class_flow: keys, router, class_id, value. Class routes take their classes' flow; what remains goes by weight. Routes
    to one target add up."""
    weighted = routes.where("class_id is null").groupBy("router", "target").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    weighted = weighted.withColumn("fraction", share("weight", "router"))
    rest = source.select(*keys, "router", F.col("value").alias("left"))
    by_class = None
    if class_flow is not None:
        named = routes.where("class_id is not null").select("router", "target", "class_id")
        by_class = class_flow.join(named, ["router", "class_id"]).groupBy(*keys, "router", "target").agg(F.sum("value").alias("flow"))
        taken = by_class.groupBy(*keys, "router").agg(F.sum("flow").alias("taken"))
        rest = rest.join(taken, [*keys, "router"], "left").withColumn("left", F.col("left") - F.coalesce("taken", F.lit(0.0)))
    flows = rest.join(weighted, "router").select(*keys, "target", (F.col("left") * F.col("fraction")).alias("flow"))
    if by_class is not None:
        flows = flows.unionByName(by_class.select(*keys, "target", "flow"))
    return flows.groupBy(*keys, "target").agg(F.sum("flow").alias("flow"))


def unrouted_classes(class_flow: DataFrame, routes: DataFrame) -> DataFrame:
    """Classes with flow that a router of class routes alone has no route for."""
    only = routes.groupBy("router").agg(F.max(F.col("class_id").isNull().cast("int")).alias("open")).where("open = 0").select("router")
    return class_flow.where("value > 0").select("router", "class_id").distinct().join(only, "router", "left_semi").join(routes.select("router", "class_id"), ["router", "class_id"], "left_anti")


def router_leakage(source: DataFrame, flows: DataFrame, router_of: DataFrame, keys: Sequence[str] = BIN) -> DataFrame:
    """Per router the greatest difference of what enters and what its targets get."""
    out = flows.join(router_of, "target").groupBy(*keys, "router").agg(F.sum("flow").alias("out"))
    both = source.join(out, [*keys, "router"], "left")
    return both.groupBy("router").agg(F.max(F.abs(F.col("value") - F.coalesce("out", F.lit(0.0)))).alias("leakage"))


def allocate(demand: DataFrame, keys: Sequence[str] = ("scenario_id", "constraint_id", "bin")) -> DataFrame:
    """Shares of a capacity by demand: demand where all of it fits, else capacity * demand / total.

    demand: keys, node_id, demand, capacity. Adds allocated."""
    d = F.when(fin("demand") > 0, F.col("demand")).otherwise(0.0)
    total = F.sum(d).over(W.partitionBy(*keys))
    given = F.when(F.col("capacity") <= 0, 0.0).when(total <= F.col("capacity"), d).otherwise(safe_div(F.col("capacity") * d, total))
    return demand.withColumn("allocated", given)


def enforce(nodes: DataFrame, members: DataFrame, capacities: DataFrame, column: str = "arrivals") -> DataFrame:
    """nodes (scenario_id, node_id, bin, ...) with `column` held to the least allocation among a node's constraints.

    members: constraint_id, node_id. capacities: scenario_id, constraint_id, bin, capacity. column is "arrivals" for
    limits on what enters queues, "served" for limits on what leaves; members alone are touched."""
    demand = nodes.join(members, "node_id").join(capacities, ["scenario_id", "constraint_id", "bin"]).select("scenario_id", "constraint_id", "node_id", "bin", F.col(column).alias("demand"), "capacity")
    least = allocate(demand).groupBy("scenario_id", "node_id", "bin").agg(F.min("allocated").alias("_cap"))
    held = F.when(F.col("_cap") + 1e-6 < F.col(column), F.col("_cap")).otherwise(F.col(column))
    return nodes.join(least, ["scenario_id", "node_id", "bin"], "left").withColumn(column, held).drop("_cap")


def normalise_classes(classes: DataFrame, by: Sequence[str] = BIN) -> DataFrame:
    """classes (by..., class_id, total, value): values rescaled to the total where they sum to anything."""
    return classes.withColumn("value", F.col("total") * share(F.col("value"), *by))


def class_coverage(classes: DataFrame, declared: Sequence[str], tolerance: float = 1.0, node: str = "node_id") -> DataFrame:
    """Per node: missing, partial or full coverage of its bins by classes, and whether all declared classes occur."""
    per_bin = classes.groupBy(node, "scenario_id", "bin").agg(F.max("total").alias("total"), F.sum(F.coalesce("value", F.lit(0.0))).alias("parts"), F.count("value").alias("n"), F.collect_set("class_id").alias("ids"))
    ok = F.abs(F.col("total") - F.col("parts")) <= tolerance
    out = per_bin.groupBy(node).agg(F.sum(F.col("n")).alias("n"), F.sum((~ok).cast("long")).alias("open_bins"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    missing = F.array_except(F.array(*[F.lit(c) for c in declared]), F.col("ids"))
    return out.select(node, F.when(F.col("n") == 0, "missing").when((F.col("open_bins") > 0) | (F.size(missing) > 0), "partial").otherwise("full").alias("coverage"), "open_bins", F.array_join(missing, ",").alias("missing_classes"))


def edge_flow(nodes: DataFrame, edges: DataFrame, measure: str = "served") -> DataFrame:
    """flow of each edge: what its source serves, by weight among the source's edges (a weight of 0 or less counts 1)."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    parts = edges.withColumn("fraction", w / F.sum(w).over(W.partitionBy("source")))
    flow = nodes.select("scenario_id", F.col("node_id").alias("source"), "bin", F.col(measure).alias("amount"))
    return parts.join(flow, "source").withColumn("flow", F.col("amount") * F.col("fraction")).drop("amount")


def edge_effort(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Effort edges: attempts and failures times multiplier (or weight), `lag` bins later, and their ratio.

    The lag is the edge's; both measures of bin - lag move to bin, null where that is before the start."""
    m = F.coalesce("multiplier", "weight", F.lit(1.0))
    back = nodes.select("scenario_id", F.col("node_id").alias("source"), F.col("bin").alias("from_bin"), "attempts", "failures")
    at = nodes.select("scenario_id", F.col("node_id").alias("source"), "bin").join(edges, "source").withColumn("from_bin", F.col("bin") - F.coalesce("lag", F.lit(0)))
    out = at.join(back, ["scenario_id", "source", "from_bin"], "left")
    return out.select("scenario_id", "edge_id", "source", "target", "bin", (F.col("attempts") * m).alias("attempts_volume"), (F.col("failures") * m).alias("failures_volume"), F.when(F.col("attempts") > 0, F.col("failures") / F.col("attempts")).alias("retry_rate"))


def retry_split(flows: DataFrame, echo: DataFrame) -> DataFrame:
    """A target's retry echo (scenario_id, target, bin, retry_echo) over its incoming edges by flow; evenly if none flows."""
    by = W.partitionBy("scenario_id", "target", "bin")
    flow = F.greatest(F.col("flow"), F.lit(0.0))
    total, n = F.sum(flow).over(by), F.count("*").over(by)
    part = F.when(total > 0, F.try_divide(flow, total)).otherwise(F.lit(1.0) / n)
    return flows.join(echo, ["scenario_id", "target", "bin"]).withColumn("retry_volume", F.col("retry_echo") * part)


def router_edge_flow(flows: DataFrame, edges: DataFrame, router_of: DataFrame) -> DataFrame:
    """A router's edges carry what its targets get. router_of: router, target; edges: edge_id, source (router), target."""
    named = edges.join(router_of.select(F.col("router").alias("source"), "target"), ["source", "target"], "left_semi")
    return named.join(flows, "target").select("scenario_id", "edge_id", "source", "target", "bin", "flow")


def terminal_failures(nodes: DataFrame, edges: DataFrame, measure: str = "failures") -> DataFrame:
    """failures_volume of terminal edges: the source's failures (or errors, or exhausted ones) times multiplier or weight."""
    amount = nodes.select("scenario_id", F.col("node_id").alias("source"), "bin", F.col(measure).alias("amount"))
    return edges.join(amount, "source").select("scenario_id", "edge_id", "bin", (F.col("amount") * F.coalesce("multiplier", "weight", F.lit(1.0))).alias("failures_volume"))


def effort_retries(efforts: DataFrame) -> DataFrame:
    """retry_volume of effort edges: attempts beyond the flow."""
    return efforts.withColumn("retry_volume", F.greatest(F.col("attempts_volume") - F.col("flow"), F.lit(0.0)))


def hold(nodes: DataFrame, limits: str = "limits", column: str = "served") -> DataFrame:
    """enforce() of nodes that say themselves which constraints they stand under: limits is an array of (constraint_id, capacity).
    One exchange by constraint and bin, one by node and bin; nothing is joined."""
    keys, others = ["scenario_id", "node_id", "bin"], [c for c in nodes.columns if c not in ("scenario_id", "node_id", "bin", limits)]
    each = nodes.withColumn("_l", F.explode_outer(limits)).withColumns({"constraint_id": F.col("_l.constraint_id"), "demand": F.col(column), "capacity": F.col("_l.capacity")})
    least = allocate(each).groupBy(*keys).agg(F.min(F.when(F.col("constraint_id").isNotNull(), F.col("allocated"))).alias("_cap"), *[F.first(c).alias(c) for c in others])
    held = F.when(F.col("_cap") + 1e-6 < F.col(column), F.col("_cap")).otherwise(F.col(column))
    return least.withColumn(column, held).select(*keys, *others)


def limit_at_query(nodes: DataFrame, members: DataFrame, capacities: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constraints applied to results: served held to the least allocation, and edge flows scaled as their sources' served
    (which they get as source_served)."""
    held = enforce(nodes.withColumn("_before", F.col("served")), members, capacities, "served")
    ratio = F.when(F.col("_before") > 0, F.try_divide("_after", "_before")).otherwise(1.0)
    change = held.select("scenario_id", F.col("node_id").alias("source"), "bin", "_before", F.col("served").alias("_after"))
    scaled = flows.join(change, ["scenario_id", "source", "bin"]).withColumn("flow", F.col("flow") * ratio).withColumn("source_served", F.col("_after")).drop("_before", "_after")
    return held.drop("_before"), scaled


def edge_class_mismatch(nodes: DataFrame, flows: DataFrame, side: str, tolerance: float = 1e-6) -> DataFrame:
    """Bins at which a class's value at a node and the sum of its edges differ. nodes: node_id, class_id, value; flows:
    source, target, class_id, flow."""
    total = flows.groupBy("scenario_id", F.col(side).alias("node_id"), "class_id", "bin").agg(F.sum("flow").alias("edges"))
    both = nodes.join(total, ["scenario_id", "node_id", "class_id", "bin"])
    return both.where(F.abs(F.col("value") - F.col("edges")) > tolerance).select("scenario_id", "node_id", "class_id", "bin", F.col("value").alias("expected"), "edges")


def edge_mismatch(nodes: DataFrame, flows: DataFrame, side: str, measure: str, tolerance: float = 1e-6, lags: DataFrame | None = None) -> DataFrame:
    """Bins at which a node's measure and the sum of its edges on one side ("source" or "target") differ. lags (edge_id, lag):
    an edge's flow counts so many bins later, and what would come from before the start counts 0."""
    if lags is not None:
        last = nodes.groupBy("scenario_id").agg(F.max("bin").alias("_last"))
        late = flows.join(lags.select("edge_id", F.greatest(F.coalesce("lag", F.lit(0)), F.lit(0)).alias("_lag")), "edge_id", "left")
        late = late.withColumn("bin", F.col("bin") + F.coalesce("_lag", F.lit(0))).join(last, "scenario_id").where("bin <= _last")
        every = flows.select("scenario_id", F.col(side), "bin", F.lit(0.0).alias("flow"))
        flows = late.select("scenario_id", F.col(side), "bin", "flow").unionByName(every)
    total = flows.groupBy("scenario_id", F.col(side).alias("node_id"), "bin").agg(F.sum("flow").alias("edges"))
    return nodes.join(total, ["scenario_id", "node_id", "bin"]).where(F.abs(F.col(measure) - F.col("edges")) > tolerance).select("scenario_id", "node_id", "bin", F.col(measure).alias("expected"), "edges")


def router_warnings(class_flow: DataFrame, routes: DataFrame, source: DataFrame, flows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows (router, code, detail): classes without a route, and routers whose targets do not get what enters them."""
    lost = unrouted_classes(class_flow, routes).groupBy("router").agg(F.array_join(F.array_sort(F.collect_set("class_id")), ",").alias("detail"))
    leaks = router_leakage(source, flows, routes.select("router", "target").distinct()).where(F.col("leakage") > tolerance)
    return lost.select("router", F.lit("router_missing_class_route").alias("code"), "detail").unionByName(leaks.select("router", F.lit("router_class_leakage").alias("code"), F.round("leakage", 6).cast("string").alias("detail")))


def flow_latency(nodes: DataFrame, flows: DataFrame, levels: int) -> DataFrame:
    """Latency of a flow up to and through each node: its cycle time and the flow-weighted mean of its predecessors'.

    nodes: scenario_id, node_id, bin, level, cycle_ms, carried (what it serves; nothing carried, no latency). flows: source,
    target, flow, by scenario and bin. level is a node's place in topological order, 0 to levels - 1; a flow that does not
    lead to a later level (one that closes a cycle) counts for nothing.

    Nodes and flows are written once, parted by level. A level that is done pushes what it gives along its own flows, parted
    by the level that it is for; so each node, flow and gift is read once, however many levels there are."""
    keys, spark, root = ["scenario_id", "bin"], nodes.sparkSession, fresh(nodes.sparkSession, "latency")
    typed = lambda df, **kinds: df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    nodes = typed(nodes, scenario_id="long", bin="long", level="int", cycle_ms="double", carried="double")
    nodes.select(*keys, "node_id", "cycle_ms", "carried", "level").write.partitionBy("level").parquet(f"{root}/nodes")
    place = nodes.groupBy("node_id").agg(F.max("level").alias("_l"))
    end = lambda side: place.select(F.col("node_id").alias(side), F.col("_l").alias(f"{side}_level"))
    led = typed(flows, scenario_id="long", bin="long", flow="double").where("flow > 0").select(*keys, "source", "target", "flow").join(end("source"), "source").join(end("target"), "target").where("source_level < target_level")
    led.write.partitionBy("source_level").parquet(f"{root}/flows")
    kind = dict(nodes.dtypes)["node_id"]
    given = f"scenario_id long, bin long, target {kind}, flow double, weighted double, source_level int, target_level int"
    known = spark.read.schema(f"scenario_id long, bin long, node_id {kind}, cycle_ms double, carried double, level int").parquet(f"{root}/nodes")
    ways = spark.read.schema(f"scenario_id long, bin long, source {kind}, target {kind}, flow double, target_level int, source_level int").parquet(f"{root}/flows")
    for level in range(levels):
        own = known.where(F.col("level") == level)
        if level:
            come = spark.read.schema(given).parquet(f"{root}/given").where(F.col("target_level") == level)
            mean = come.groupBy(*keys, F.col("target").alias("node_id")).agg((F.sum("weighted") / F.sum("flow")).alias("upstream"))
            own = own.join(mean, [*keys, "node_id"], "left")
        else:
            own = own.withColumn("upstream", F.lit(None).cast("double"))
        base = F.when(F.col("cycle_ms").isNotNull() | F.col("upstream").isNotNull(), F.coalesce("cycle_ms", F.lit(0.0)) + F.coalesce("upstream", F.lit(0.0)))
        own.select(*keys, "node_id", F.when(F.col("carried") > 0, base).alias("latency")).write.parquet(f"{root}/done/{level}")
        if level + 1 < levels:
            late = spark.read.schema(f"scenario_id long, bin long, node_id {kind}, latency double").parquet(f"{root}/done/{level}").where("latency is not null").withColumnRenamed("node_id", "source")
            gifts = ways.where(F.col("source_level") == level).join(late, [*keys, "source"])
            gifts.select(*keys, "target", "flow", (F.col("flow") * F.round("latency", 6)).alias("weighted"), "target_level").write.partitionBy("target_level").parquet(f"{root}/given/source_level={level}")
    return spark.read.schema(f"scenario_id long, bin long, node_id {kind}, latency double").parquet(*[f"{root}/done/{i}" for i in range(levels)])
