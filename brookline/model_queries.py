"""Queries that evaluate models over each user's days, and of checks and metrics that need more than one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import metrics as M
from .functions.arith import fires
from .operators import checks, routing, state
from .plans.class_vectors import class_series
from .plans.compiler import by_class, evaluate
from .queries import _FOUND, _artifacts, _edges, _found, _nodes, hours, query, r6, users
from .sources import registry, series_files
from .sources.events import outside
from .sources.shared import fresh

DAYS, BY = 30, ("scenario_id", "user_id")


def user_model(*nodes: dict, topology: list[dict] = (), constraints: list[dict] = (), **more) -> dict:
    """A model of a user's 30 days: the counts of the events are its constants."""
    counts = [{"id": i, "kind": "const", "values": [0.0] * DAYS} for i in ("arrivals", "served", "errors", "purchases", "signups")]
    return {"grid": {"bins": DAYS, "binSize": 1, "binUnit": "days"}, "nodes": [*counts, *nodes], "topology": {"nodes": list(topology), "edges": [], "constraints": list(constraints)}, **more}


def expr(name: str, text: str, **more) -> dict:
    return {"id": name, "kind": "expr", "expr": text, **more}


def run(spark, sf, model: dict, overrides: DataFrame | None = None, derived: bool = False, with_classes: bool = False) -> DataFrame:
    return evaluate(spark, model, overrides, users(spark, sf), BY, derived, with_classes)


def work(arrivals: str, served: str, **more) -> dict:
    semantics = {"arrivals": arrivals, "served": served, "queueDepth": "backlog"} | more.pop("semantics", {})
    return {"id": "Work", "kind": "serviceWithBuffer", "semantics": semantics, **more}


_RETRIES = "0.6 * coalesce(lag(errors, 1) over w, 0) + 0.3 * coalesce(lag(errors, 2) over w, 0) + 0.1 * coalesce(lag(errors, 3) over w, 0)"


@query(f"with recursive $U, r as (select *, ({_RETRIES})::double as retries from u window w as (partition by user_id order by bin)), q as (select user_id, bin, retries, greatest(0, arrivals + retries - served)::double as backlog from r where bin = 0 union all select r.user_id, r.bin, r.retries, greatest(0, q.backlog + r.arrivals + r.retries - r.served) from q join r on r.user_id = q.user_id and r.bin = q.bin + 1) select user_id, bin, round(retries, 6) as retries, round(backlog, 6) as backlog from q")
def model_run(spark, sf):
    """A queue with retries, for every user."""
    m = user_model(expr("retries", "CONV(errors, [0, 0.6, 0.3, 0.1])"), expr("inflow", "arrivals + retries"), topology=[work("inflow", "served")])
    return run(spark, sf, m).select("user_id", "bin", r6("retries").alias("retries"), r6("backlog").alias("backlog"))


@query("with recursive $U, q as (select user_id, bin, 0::double as out, arrivals as effective, least(9, arrivals)::double as backlog from u where bin = 0 union all select user_id, bin, out, effective, least(9, greatest(0, b + effective - out)) from (select *, case when bin % 3 = 1 then least(b + effective, 2 + signups) else 0 end as out from (select u.user_id, u.bin, u.signups, q.backlog as b, u.arrivals * (1 - least(1, q.backlog / 8)) as effective from q join u on u.user_id = q.user_id and u.bin = q.bin + 1))) select user_id, bin, round(effective, 6) as effective, round(backlog, 6) as backlog from q")
def model_cycle_gate(spark, sf):
    """A cycle: a queue that throttles its own inflow, with a schedule that has a capacity series, and a limit given as a series."""
    m = user_model(
        expr("effective", "arrivals * (1 - MIN(1, SHIFT(backlog, 1) / 8))"), expr("wanted", "SHIFT(backlog, 1) + effective"), expr("gatecap", "2 + signups"), expr("most", "9 + 0 * arrivals"),
        topology=[work("effective", "wanted", dispatchSchedule={"periodBins": 3, "phaseOffset": 1, "capacitySeries": "gatecap"}, wipLimit="most")],
    )
    return run(spark, sf, m).select("user_id", "bin", r6("effective").alias("effective"), r6("backlog").alias("backlog"))


@query("with recursive $U, q as (select user_id, bin, arrivals as own, least(case when arrivals <= 2 then arrivals else 2 end, arrivals)::double as backlog from u where bin = 0 union all select user_id, bin, own, greatest(0, b + case when own <= 2 then own else 2 end - served) from (select u.user_id, u.bin, u.served, q.backlog as b, u.arrivals + 0.25 * q.backlog as own from q join u on u.user_id = q.user_id and u.bin = q.bin + 1)) select user_id, bin, round(own, 6) as inflow, round(case when bin = 0 then greatest(0, backlog - 0) else backlog end, 6) as backlog from q")
def model_cycle_constraint(spark, sf):
    """A constraint on a queue within a cycle."""
    m = user_model(
        expr("inflow", "arrivals + 0.25 * SHIFT(backlog, 1)"), expr("two", "2 + 0 * arrivals"), expr("out", "served * STEP(SHIFT(one, 1), 1)"), expr("one", "1 + 0 * arrivals"),
        topology=[work("inflow", "out", constraints=["c"])], constraints=[{"id": "c", "semantics": {"arrivals": "inflow", "served": "two"}}],
    )
    return run(spark, sf, m).select("user_id", "bin", r6("inflow").alias("inflow"), r6("backlog").alias("backlog"))


@query("with $U, v as (select user_id, bin, round(least(arrivals, 3), 6) as gold, round((arrivals + errors - least(arrivals, 3)) * 0.75, 6) as plain, round((arrivals + errors - least(arrivals, 3)) * 0.25, 6) as spill from u) select * from v")
def model_class_routes(spark, sf):
    """Class routes take the class's own series, here an expression; the rest goes by weight."""
    m = user_model(
        expr("source", "arrivals + errors"), expr(class_series("source", "vip"), "MIN(arrivals, 3)"),
        {"id": "r", "kind": "router", "router": {"inputs": {"queue": "source"}, "routes": [{"target": "gold", "classes": ["vip"]}, {"target": "plain", "weight": 3}, {"target": "spill", "weight": 1}]}},
        classes=[{"id": "vip"}], traffic={"arrivals": [{"nodeId": "source", "classId": "vip", "pattern": {"kind": "constant", "ratePerBin": 1.0}}]},
    )
    return run(spark, sf, m).select("user_id", "bin", r6("gold").alias("gold"), r6("plain").alias("plain"), r6("spill").alias("spill"))


@query("with $U select user_id, bin, series_id, class_id, round(case series_id when 'arrivals' then arrivals else least(arrivals, served) end * case class_id when 'new' then 0.75 else 0.25 end, 6) as value from u, (values ('arrivals'), ('done')) s(series_id), (values ('new'), ('old')) c(class_id)")
def model_classes(spark, sf):
    """A node's series and what depends on it, split as its class arrivals are."""
    m = user_model(expr("done", "MIN(arrivals, served)"), traffic={"arrivals": [{"nodeId": "arrivals", "classId": c, "pattern": {"kind": "constant", "ratePerBin": v}} for c, v in (("new", 3.0), ("old", 1.0))]})
    rows = by_class(run(spark, sf, m, with_classes=True), m, BY).where(F.col("series_id").isin("arrivals", "done"))
    return rows.select("user_id", "bin", "series_id", "class_id", r6("value").alias("value"))


@query("with recursive $U, o as (select scenario_id, u.*, case when scenario_id = 2 and bin = 3 then 50 when scenario_id = 2 then 2 else served end as s from u, (values (1), (2)) t(scenario_id)), q as (select scenario_id, user_id, bin, greatest(0, arrivals - s)::double as backlog from o where bin = 0 union all select o.scenario_id, o.user_id, o.bin, greatest(0, q.backlog + o.arrivals - o.s) from q join o on o.scenario_id = q.scenario_id and o.user_id = q.user_id and o.bin = q.bin + 1) select scenario_id, user_id, bin, backlog from q")
def model_overrides(spark, sf):
    """Two scenarios of every user in one job: as measured, and with what is served set for all days and for one."""
    m = user_model({"id": "capacity", "kind": "const", "values": [-1.0] * DAYS}, expr("out", "served + STEP(capacity, 0) * (capacity - served)"), topology=[work("arrivals", "out")])
    rows = spark.createDataFrame([(1, "unknown", None, 0.0), (2, "capacity", None, 2.0), (2, "capacity", 3, 50.0)], "scenario_id long, series string, bin long, value double")
    return run(spark, sf, m, rows).select("scenario_id", "user_id", "bin", "backlog")


@query("with recursive $U, q as (select user_id, bin, greatest(0, arrivals - served)::double as q from u where bin = 0 union all select u.user_id, u.bin, greatest(0, q.q + u.arrivals - u.served) from q join u on u.user_id = q.user_id and u.bin = q.bin + 1), d as (select user_id, bin, case when signups = 0 then 0 else served / (2 * signups) end as utilization, case when served = 0 then 0 else q / served end as q_ratio, case when purchases = 0 then 0 else errors / purchases end as service_time_ms from q join u using (user_id, bin)) select user_id, bin, round(utilization, 6) as utilization, round(q_ratio, 6) as q_ratio, round(q_ratio * 1440, 4) as latency_min, round(case when q_ratio * 86400000 + service_time_ms = 0 then 0 else service_time_ms / (q_ratio * 86400000 + service_time_ms) end, 6) as flow_efficiency, round(utilization - 1, 6) as one_minus_rho, round(case when utilization = 1 then 0 else utilization / (1 - utilization) * 0 end, 6) + 0.0 as kingman_wq from d")
def model_derived(spark, sf):
    """The evaluator's own derived columns of a node."""
    m = user_model(topology=[work("arrivals", "served", semantics={"capacity": "signups", "parallelism": 2, "processingTimeMsSum": "errors", "servedCount": "purchases"})])
    d = run(spark, sf, m, derived=True)
    names = ["utilization", "q_ratio", "latency_min", "flow_efficiency", "one_minus_rho", "kingman_wq"]
    return d.select("user_id", "bin", *[(F.round(f"work_{n}", 4) + 0.0 if n == "latency_min" else r6(f"work_{n}")).alias(n) for n in names])


@query("with $U, c as (select user_id, bin, unnest(case when user_id % 2 = 0 then ['a', 'b'] else ['*'] end) as class_id, arrivals, served, errors from u), m as (select user_id, bin, class_id, case class_id when 'a' then arrivals when 'b' then errors else arrivals end as n, case class_id when 'a' then served when 'b' then errors else served end as s from c) select user_id, bin, class_id, round(case when s > 0 then n / s * 86400000 end, 4) as queue_time_ms, round(case when n <> 0 then least(1, s / n) end, 6) as throughput_ratio from m")
def class_metrics(spark, sf):
    """Metrics by class where a node has classes, of all of it as class * where it has none."""
    n = users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", "arrivals", "served", "errors")
    whole = lambda df, a, s: df.select("scenario_id", "node_id", "bin", F.col(a).alias("arrivals"), F.col(s).alias("served"), F.col(a).alias("queue_depth"), F.lit(1.0).alias("capacity"), F.lit(1.0).alias("processing_time_ms_sum"), F.lit(1.0).alias("served_count"))
    even = n.where("node_id % 2 = 0")
    classes = whole(even, "arrivals", "served").withColumn("class_id", F.lit("a")).unionByName(whole(even, "errors", "errors").withColumn("class_id", F.lit("b"))).unionByName(whole(n, "arrivals", "served").withColumn("class_id", F.lit("*")))
    got = state.class_metrics(whole(n, "arrivals", "served"), classes, 86_400_000.0)
    return got.select(F.col("node_id").alias("user_id"), "bin", "class_id", F.round("queue_time_ms", 4).alias("queue_time_ms"), r6("throughput_ratio").alias("throughput_ratio"))


@query("with $U select user_id, round(avg(case when bin % 4 = 1 then (served > 0)::int end), 6) as adherence, case when count(case when bin % 4 = 1 then 1 end) > 0 then 'ok' else 'noEvents' end as status, 'unavailable' as age_status from u group by 1")
def sla_schedule_adherence(spark, sf):
    a = M.schedule_adherence("served", fires(F.col("bin"), 4, 1))
    return users(spark, sf).groupBy("user_id").agg(r6(F.avg(a)).alias("adherence"), M.sla_status("scheduleAdherence", a).alias("status"), F.max(M.sla_status("backlogAge", a)).alias("age_status"))


@query("with $U select user_id, bin, round(case when errors > 0 and purchases + errors > 0 then errors / (purchases + errors) when purchases > 0 then 0 end, 6) as flow_efficiency, served + errors as attempts, round(case when served + errors > 0 then errors / (served + errors) end, 6) as retry_tax from u")
def node_efforts(spark, sf):
    """Flow efficiency, attempts that are not given, and the retry tax on them."""
    df = users(spark, sf).withColumn("cycle", F.col("purchases") + F.col("errors"))
    df = df.withColumn("attempts", M.attempts(F.lit(None).cast("double"), "served", F.lit(None).cast("double"), "errors"))
    return df.select("user_id", "bin", r6(M.flow_efficiency(F.col("errors"), F.col("cycle"))).alias("flow_efficiency"), "attempts", r6(M.retry_tax("attempts", "served")).alias("retry_tax"))


@query("with $U, e as (select user_id as s, user_id + hop as t, hop from (select distinct user_id from u), (values (1), (2)) h(hop)), f as (select t as node_id, bin + hop - 1 as bin, served * case hop when 1 then 0.75 else 0.25 end as flow from e join u on u.user_id = e.s), g as (select node_id, bin, sum(flow) as edges from (select * from f where bin < 30 union all select t, bin, 0 from e join u on u.user_id = e.s) group by 1, 2) select node_id, g.bin, arrivals as expected, round(edges, 6) as edges from g join u on u.user_id = g.node_id and u.bin = g.bin where abs(arrivals - edges) > 1e-6")
def warn_edge_mismatch_lagged(spark, sf):
    """Conservation over edges of which every second one takes a bin."""
    n, e = _nodes(spark, sf), _edges(spark, sf)
    lags = e.select("edge_id", (F.col("target") - F.col("source") - 1).alias("lag"))
    w = routing.edge_mismatch(n, routing.edge_flow(n, e), "target", "arrivals", lags=lags)
    return w.select("node_id", "bin", "expected", r6("edges").alias("edges"))


_CODES = {
    "served_exceeds_capacity": ("served", "effective_capacity"), "errors_exceed_arrivals": ("errors", "arrivals"), "attempts_below_arrivals": ("arrivals", "attempts"),
    "failures_exceed_attempts": ("failures", "attempts"), "exhausted_exceeds_failures": ("exhausted_failures", "failures"), "exhausted_exceeds_errors": ("exhausted_failures", "errors"),
}
_PAIRS = " union all ".join(f"select user_id, bin, '{c}' as code, {a} - {b} as x from n" for c, (a, b) in _CODES.items())
_NEGATIVE = " union all ".join(f"select user_id, bin, '{c}_negative' as code, -{c} as x from n" for c in ("served", "errors", "attempts", "failures", "exhausted_failures", "retry_echo"))


def _pairs(spark, sf) -> DataFrame:
    return users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", "arrivals", (F.col("served") - 1).alias("served"), (F.col("errors") - F.col("signups")).alias("errors"), (F.col("purchases") - 1).alias("effective_capacity"), (F.col("arrivals") - F.col("purchases")).alias("attempts"), (F.col("errors") - 1).alias("failures"), (F.col("signups") - 1).alias("exhausted_failures"), (F.col("signups") - F.col("purchases")).alias("retry_echo"))


_N = "n as (select user_id, bin, arrivals, served - 1 as served, errors - signups as errors, purchases - 1 as effective_capacity, arrivals - purchases as attempts, errors - 1 as failures, signups - 1 as exhausted_failures, signups - purchases as retry_echo from u)"


@query(f"with $U, {_N} select user_id as node_id, code, {_FOUND} from ({_PAIRS}) where x > 1e-6 group by 1, 2")
def warn_pairs(spark, sf):
    """Capacity, errors, attempts, failures and exhausted failures against each other."""
    return _found(checks.check(_pairs(spark, sf)).where(F.col("code").isin(*_CODES)))


@query(f"with $U, {_N} select user_id as node_id, code, {_FOUND} from ({_NEGATIVE}) where x > 1e-6 group by 1, 2")
def warn_negatives(spark, sf):
    return _found(checks.check(_pairs(spark, sf)).where(F.col("code").endswith("_negative")))


@query(f"with $U, {_N}, x as (select user_id, bin, abs(attempts - served - failures) as x from n where abs(attempts - served - failures) > 1e-4), y as (select user_id, min(bin) as bin, arg_min(x, bin) as x from x group by 1) select user_id as node_id, 'attempts_conservation_mismatch' as code, bin::varchar as bins, round(x, 6) as worst, 1::bigint as n from y")
def warn_attempts(spark, sf):
    """Of attempts that are neither served nor failed, the first bin."""
    return _found(checks.check(_pairs(spark, sf)).where("code = 'attempts_conservation_mismatch'"))


_GRAPH = "k as (select distinct user_id as id, ['service', 'dlq', 'dependency'][user_id % 3 + 1] as kind from events), e as (select k.id as s, k.id + hop as t, case when (k.id + hop) % 2 = 0 then 'terminal' else 'effort' end as type, (k.id + hop) % 4 as lag from k, (values (1), (2)) h(hop))"


@query(
    f"with {_GRAPH} select distinct * from (select t as node_id, 'dlq_non_terminal_inbound' as code from e join k on k.id = t where k.kind = 'dlq' and type <> 'terminal' union all select s, 'dlq_non_terminal_outbound' from e join k on k.id = s where k.kind = 'dlq' and type <> 'terminal'"
    " union all select s, 'edge_behavior_violation_lag' from e where lag > 0 union all select id, 'dependency_missing_effort_edges' from k where kind = 'dependency' and id not in (select t from e where type = 'effort')"
    " union all select id, 'dependency_retry_pressure_missing' from k where kind = 'dependency' and id % 2 = 1 and id in (select t from e where type = 'effort') and id not in (select t from e join k on k.id = s where type = 'effort' and s % 5 = 0))"
)
def warn_edge_rules(spark, sf):
    """Dead-letter queues, lags and dependencies of a graph of users."""
    n = users(spark, sf).select(F.col("user_id").alias("node_id")).distinct()
    kind = F.element_at(F.array(F.lit("service"), F.lit("dlq"), F.lit("dependency")), (F.col("node_id") % 3 + 1).cast("int"))
    nodes = n.select("node_id", kind.alias("kind"), (F.col("node_id") % 2 == 1).alias("errors"), (F.col("node_id") % 5 == 0).alias("attempts"))
    e = _edges(spark, sf).select("source", "target", F.when(F.col("target") % 2 == 0, "terminal").otherwise("effort").alias("type"), (F.col("target") % 4).alias("lag"))
    return checks.edge_rules(e, nodes)


@query("with n as (select distinct user_id from events) select 'c' || user_id as constraint_id, unnest(list_filter([case when user_id % 2 = 0 then 'constraint_missing_arrivals' end, case when user_id % 3 = 0 then 'constraint_missing_served' end], lambda x: x is not null)) as code from n")
def warn_constraints(spark, sf):
    n = users(spark, sf).select("user_id").distinct()
    lacks = lambda k: F.when(F.col("user_id") % k != 0, F.lit("series"))
    return checks.constraint_errors(n.select(F.concat(F.lit("c"), F.col("user_id")).alias("constraint_id"), lacks(2).alias("arrivals"), lacks(3).alias("served")))


@query("with c as (select user_id as router, event_type as class_id from events group by 1, 2), l as (select router, string_agg(class_id, ',' order by class_id) as detail from c where class_id in ('purchase', 'signup') group by 1), t as (select user_id as router, date_diff('day', timestamp '2024-01-01', ts) as bin, count(*) filter (where event_type in ('purchase', 'signup')) as lost from events group by 1, 2) select router, 'router_missing_class_route' as code, detail from l union all select router, 'router_class_leakage', max(lost)::double::varchar from t group by 1 having max(lost) > 0")
def warn_router(spark, sf):
    """Each user a router with routes for views, clicks and errors only: classes without one, and what leaks."""
    flow = users(spark, sf).select("scenario_id", F.col("user_id").alias("router"), "bin", F.col("arrivals").alias("view"), F.col("served").alias("click"), F.col("errors").alias("error"), F.col("purchases").alias("purchase"), F.col("signups").alias("signup"))
    classes = flow.unpivot(["scenario_id", "router", "bin"], ["view", "click", "error", "purchase", "signup"], "class_id", "value")
    named = flow.select("router").distinct().select("router", F.explode(F.array(*map(F.lit, ("view", "click", "error")))).alias("class_id"))
    routes = named.select("router", F.concat_ws(":", "router", "class_id").alias("target"), F.lit(None).cast("double").alias("weight"), "class_id")
    source = classes.groupBy("scenario_id", "router", "bin").agg(F.sum("value").alias("value"))
    flows = routing.route(source, routes, classes)
    return routing.router_warnings(classes, routes, source, flows)


@query("with n as (select user_id, list((value - 20) / 100 order by event_id) as k from events group by 1), c as (select user_id, k[1:32] as k, len(k) as n from n), d as (select user_id, n, len(k) as m, list_filter(k, lambda x: x >= 0) as f from c) select user_id as node_id, 'retry_kernel_policy' as code, array_to_string(list_filter([case when n > 32 then 'trimmed' end, case when len(f) < m then 'replaced' end, case when list_sum(f) > 1 then 'scaled' end], lambda x: x is not null), ',') as detail from d where n > 32 or len(f) < m or list_sum(f) > 1")
def warn_kernel(spark, sf):
    """Retry kernels taken from the values of each user's events: too long ones, ones with negative terms, too heavy ones."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value")
    # The rule reads 32 terms at most and sees whether there are more, so 33 of a user's events are all that is gathered.
    first = e.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).where("n <= 33")
    k = first.groupBy(F.col("user_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: (x["value"] - 20) / 100).alias("kernel"))
    return checks.kernel_warnings(k)


@query("with n as (select distinct user_id from events) select user_id as node_id, case when user_id % 3 = 0 then 'telemetry_sources_missing' else 'telemetry_sources_unresolved' end as code, case when user_id % 3 = 0 then 's' || user_id else 'f' || user_id end as detail from n where user_id % 3 = 0 or user_id % 3 = 1 union all select user_id, 'value_series_missing', 's' || user_id from (select user_id from events group by 1 having count(*) filter (where event_type = 'purchase') = 0)")
def warn_sources(spark, sf):
    """Series without a source, with one that is not there, and series without a value."""
    u = users(spark, sf)
    name = lambda c: F.concat(F.lit(c), F.col("user_id"))
    n = u.select("user_id").distinct()
    declared = n.select(F.col("user_id").alias("node_id"), name("s").alias("series_id"), F.when(F.col("user_id") % 3 != 0, name("f")).alias("source"))
    there = n.where("user_id % 3 = 2").select(name("f").alias("source"))
    values = u.select(name("s").alias("series_id"), "bin", F.when(F.col("purchases") > 0, F.col("purchases")).alias("value"))
    return checks.source_warnings(declared, there).unionByName(checks.missing_values(declared.select("node_id", "series_id"), values))


@query("select count(*) as events, count(*) filter (where date_diff('hour', timestamp '2024-01-01', ts) < 0) as before, count(*) filter (where date_diff('hour', timestamp '2024-01-01', ts) >= 480) as after from events")
def grid_outside(spark, sf):
    """Events that a grid of 20 days leaves out."""
    return outside(spark, sf, 480)


@query("with d as (select event_type as kind, user_id from events group by 1, 2) select 'e:' || kind as node_id, kind, case kind when 'view' then 'unknown' else 'unknown' end as category, count(*) as users from d group by 1, 2")
def node_kinds(spark, sf):
    """Descriptors of nodes that the event types name; none is a kind of the model."""
    n = by_type_nodes(spark, sf)
    return state.describe_nodes(n).select("node_id", "kind", "category").join(n.select("node_id", "users"), "node_id").select("node_id", "kind", "category", "users")


def by_type_nodes(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id").distinct()
    return e.groupBy(F.concat(F.lit("e:"), F.col("event_type")).alias("node_id"), F.col("event_type").alias("kind")).agg(F.count("*").alias("users"))


@query("with $H, l as (select bin, s as series_id, c as class_id, v as value from (select bin, unnest(['arrivals@web', 'queue@web@gold']) as s, unnest(['DEFAULT', 'gold']) as c, unnest([arrivals, served]) as v from h)) select series_id, class_id, bin, value from l")
def run_parquet(spark, sf):
    """A run written with its outputs alone, and read again."""
    wide = hours(spark, sf).select("scenario_id", "bin", F.col("arrivals").alias("arrivals@web"), F.col("served").alias("queue@web@gold"), F.col("errors").alias("errors@web"))
    root = fresh(spark, "runs")
    series_files.write_run(wide, wide.columns[2:], root, "r", {"outputs": [{"series": "arrivals@web"}, {"series": "QUEUE@web@gold"}]})
    return series_files.read_run(spark, root, "r").select("series_id", "class_id", "bin", "value")


@query("with $H select s as series_id, 'DEFAULT' as class_id, bin, v as value from (select bin, unnest(['arrivals', 'served']) as s, unnest([arrivals, served]) as v from h)")
def run_csv(spark, sf):
    """A run as files per series, and read again in one read."""
    root = fresh(spark, "runs")
    series_files.write_csv_run(hours(spark, sf).select("scenario_id", "bin", "arrivals", "served"), ["arrivals", "served"], root, "r")
    return series_files.read_csv_run(spark, root, "r")


@query("with $U, n as (select user_id, bin, unnest(['view', 'click']) as c, unnest([arrivals, served]) as v from u) select user_id as node_id, 'partial' as coverage, 'refund' as missing_classes, (select count(*) from n m where m.user_id = n.user_id and v = 0) as gaps, 2 as schema_version from n group by 1")
def capture_classes(spark, sf):
    """Telemetry by class with zeros as gaps, filled again, and how far the classes cover each node."""
    long = users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", F.col("arrivals").alias("view"), F.col("served").alias("click")).unpivot(["scenario_id", "node_id", "bin"], ["view", "click"], "class_id", "v")
    total = F.sum("v").over(W.partitionBy("scenario_id", "node_id", "bin"))
    broken = long.withColumn("total", total).withColumn("value", F.when(F.col("v") > 0, F.col("v"))).drop("v")
    return series_files.capture_classes(broken, ["view", "click", "refund"], fresh(spark, "capture")).select("node_id", "coverage", "missing_classes", "gaps", "schema_version")


_RELATED = "p as (select a.o_orderkey as id, b.o_orderkey as other, a.o_orderdate as x, b.o_orderdate as y from orders a join orders b on a.o_custkey = b.o_custkey union select a.o_orderkey, b.o_orderkey, a.o_orderdate, b.o_orderdate from orders a join orders b on a.o_orderdate = b.o_orderdate union select a.o_orderkey, b.o_orderkey, a.o_orderdate, b.o_orderdate from orders a join orders b on a.o_custkey % 97 = b.o_custkey % 97 and abs(date_diff('day', a.o_orderdate, b.o_orderdate)) < 3)"


@query(f"with {_RELATED} select id, rank, other, gap::bigint as gap from (select id, other, abs(epoch(x) - epoch(y)) as gap, row_number() over (partition by id order by abs(epoch(x) - epoch(y)), other) as rank from p where id <> other) where rank <= 5")
def related_models(spark, sf):
    """Related runs, a shared model within three days among the reasons."""
    runs = _artifacts(spark, sf, (F.col("o_custkey") % 97).alias("model_id"))
    return registry.related(runs, model_hours=72).select("id", F.col("rank").cast("long").alias("rank"), "other", "gap")


@query("with t as (select o_custkey as c from orders where o_orderkey in (1, 2, 3)) select o_orderkey as id, o_orderpriority as title from orders where o_orderstatus <> 'P' and o_custkey in (select c from t) and o_orderkey not in (1, 2, 3)")
def registry_related(spark, sf):
    """A search among what is related to some artifacts."""
    return registry.search(_artifacts(spark, sf), related_to=[1, 2, 3]).select("id", "title")


@query("with $H, k as (select bin, unnest(['a', 'b']) as class_id, unnest([arrivals, served]) as value, arrivals + served as total from h), m as (select bin, class_id, case when total > 0 then least(total, 8) * value / total else 0 end as value from k), s as (select m.bin, m.class_id, m.value + coalesce(lag(k.value) over (partition by k.class_id order by k.bin), 0) as value from m join k using (bin, class_id)) select bin, 'capped' as series_id, class_id, round(value, 6) as value from m union all select bin, 'sum', class_id, round(value, 6) from s union all select bin, 'scaled', class_id, round(value * 2, 6) from m")
def model_class_algebra(spark, sf):
    """Classes through the expressions of a model: the least of two, a sum with a shift, a product."""
    h = hours(spark, sf)
    consts = [{"id": i, "kind": "const", "values": [0.0] * 720} for i in ("arrivals", "served", "errors", "purchases", "signups")]
    m = {
        "grid": {"bins": 720, "binSize": 1, "binUnit": "hours"}, "classes": [{"id": "a"}, {"id": "b"}],
        "nodes": [*consts, expr("source", "arrivals + served"), expr(class_series("source", "a"), "arrivals"), expr(class_series("source", "b"), "served"), expr("capped", "MIN(source, 8)"), expr("sum", "capped + SHIFT(source, 1)"), expr("scaled", "2 * capped")],
        "traffic": {"arrivals": [{"nodeId": "source", "classId": c, "pattern": {"kind": "constant", "ratePerBin": 1.0}} for c in "ab"]},
    }
    rows = by_class(evaluate(spark, m, data=h, with_classes=True), m).where(F.col("series_id").isin("capped", "sum", "scaled"))
    return rows.select("bin", "series_id", "class_id", r6("value").alias("value"))
