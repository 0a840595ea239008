"""Queries from events through a model to its state: nodes with metrics, edges with flows, latency along them, and warnings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .model_queries import BY, expr, run, user_model
from .operators import checks, state
from .operators.series import echo
from .plans.compiler import evaluate
from .plans.run_state import edge_rows, node_rows, warnings
from .queries import hours, query, r6, users
from .sources import series_files
from .sources.events import binned_whole
from .sources.fixtures import load_fixture
from .sources.shared import fresh

DAY_MS = 86_400_000.0


def two_queues() -> dict:
    """What a service with a buffer serves goes to a queue, by three parts of four, and a day later to a dead-letter queue."""
    m = user_model(
        expr("moved", "served * 0.75"), expr("rest", "served * 0.25"),
        topology=[
            {"id": "A", "kind": "serviceWithBuffer", "semantics": {"arrivals": "arrivals", "served": "served", "capacity": "purchases", "parallelism": 2, "processingTimeMsSum": "errors", "servedCount": "purchases"}, "initialCondition": {"queueDepth": 1}},
            {"id": "B", "kind": "queue", "semantics": {"arrivals": "moved", "served": "signups", "slaMinutes": 1440}}, {"id": "D", "kind": "dlq", "semantics": {"arrivals": "rest", "served": "errors"}},
        ],
    )
    m["topology"]["edges"] = [{"id": "ab", "source": "A:out", "target": "B:in", "weight": 3}, {"id": "ad", "source": "A", "target": "D", "weight": 1, "lag": 1}, {"id": "at", "source": "A:served", "target": "D", "type": "terminal", "measure": "errors", "multiplier": 0.5}]
    return m


def nodes(spark, sf):
    m = two_queues()
    return node_rows(run(spark, sf, m), m, BY)


#: The same in SQL: s has a user's day with the depths of the three queues, n a row per node, with the latency along flows.
_S = """q as (select user_id, bin, greatest(0, 1 + arrivals - served) as qa, greatest(0, served * 0.75 - signups) as qb, greatest(0, served * 0.25 - errors) as qd from u where bin = 0
    union all select u.user_id, u.bin, greatest(0, qa + arrivals - served), greatest(0, qb + served * 0.75 - signups), greatest(0, qd + served * 0.25 - errors) from q join u on u.user_id = q.user_id and u.bin = q.bin + 1),
    s as materialized (select u.*, qa, qb, qd, case when purchases > 0 then served / (2 * purchases) end as util, case when served > 0 then qa / served * 86400000.0 end as ta, case when purchases > 0 then errors / purchases end as sa, case when signups > 0 then qb / signups * 86400000.0 end as tb, case when errors > 0 then qd / errors * 86400000.0 end as td from u join q using (user_id, bin)),
    l as materialized (select *, case when served > 0 then ta + coalesce(sa, 0) end as la, case when ta is not null or sa is not null then coalesce(ta, 0) + coalesce(sa, 0) end as ca from s),
    n as materialized (select user_id, bin, 'A' as node_id, arrivals, served, 2 * purchases as cap, qa as depth, util, ta as queue_ms, ca as cycle_ms, la as flow_ms, null::double as sla, case when util is null then 'gray' when util < 0.7 then 'green' when util < 0.9 then 'yellow' else 'red' end as colour from l
    union all select user_id, bin, 'B', served * 0.75, signups, null, qb, null, tb, tb, case when signups > 0 then tb + coalesce(round(la, 6), 0) end, 1440, case when tb is null then 'gray' when tb / 60000 <= 1440 then 'green' when tb / 60000 <= 2160 then 'yellow' else 'red' end from l
    union all select user_id, bin, 'D', served * 0.25, errors, null, qd, null, td, td, case when errors > 0 then td + coalesce(round(la, 6), 0) end, null, 'dlq' from l)"""


def ms(x: str):
    return F.round(x, 3) + 0.0


@query(f"with recursive $U, {_S} select user_id, bin, node_id, round(depth, 6) as queue_depth, round(util, 6) as utilization, round(cycle_ms, 3) as cycle_time_ms, round(flow_ms, 3) as flow_latency_ms, colour from n")
def model_state(spark, sf):
    """A model's nodes in every bin."""
    return nodes(spark, sf).where("topology").select("user_id", "bin", "node_id", r6("queue_depth").alias("queue_depth"), r6("utilization").alias("utilization"), ms("cycle_time_ms").alias("cycle_time_ms"), ms("flow_latency_ms").alias("flow_latency_ms"), "colour")


@query(f"with recursive $U, {_S} select user_id, node_id, kind, queue_depth, value from (select user_id, node_id, case node_id when 'A' then 'serviceWithBuffer' when 'B' then 'queue' else 'dlq' end as kind, round(depth, 6) as queue_depth, null::double as value from n where bin = 29 union all select user_id, c, k, null, round(v, 6) from (select user_id, unnest(['arrivals', 'served', 'errors', 'purchases', 'signups', 'moved', 'rest']) as c, unnest(['const', 'const', 'const', 'const', 'const', 'expr', 'expr']) as k, unnest([arrivals, served, errors, purchases, signups, served * 0.75, served * 0.25]) as v from s where bin = 29))")
def model_state_snapshot(spark, sf):
    """The last day of all nodes, those that the model computes with their values."""
    return state.snapshot(nodes(spark, sf), 29).select("user_id", "node_id", "kind", r6("queue_depth").alias("queue_depth"), r6("value").alias("value"))


@query(f"with recursive $U, {_S} select user_id, node_id, array_to_string(list(round(depth, 3)::varchar order by bin), ',') as depths, list(round(coalesce(flow_ms, -1), 3) order by bin)[7] as last_flow, count(*) as bins from n where bin between 10 and 16 group by 1, 2")
def model_state_window(spark, sf):
    """A week of the topology's nodes, an array per series."""
    w = state.window(nodes(spark, sf), 10, 16, ["queue_depth", "flow_latency_ms"], ("user_id", "node_id"), "operational")
    depths = F.array_join(F.transform("queue_depth", lambda x: F.round(x, 3).cast("string")), ",")
    return w.select("user_id", "node_id", depths.alias("depths"), F.round(F.coalesce(F.col("flow_latency_ms")[6], F.lit(-1.0)), 3).alias("last_flow"), F.size("queue_depth").cast("long").alias("bins"))


@query("with $U select user_id, bin, e as edge_id, k as kind, round(f, 6) as flow, round(x, 6) as failures_volume from (select user_id, bin, unnest(['ab', 'ad', 'at']) as e, unnest(['throughput', 'throughput', 'terminal']) as k, unnest([served * 0.75, served * 0.25, null]) as f, unnest([null, null, null]::double[]) as x from u)")
def model_edges(spark, sf):
    """A model's edges in every bin: those by the port out share what the source serves; the node gives no errors to end."""
    m = two_queues()
    return edge_rows(run(spark, sf, m), m, BY).select("user_id", "bin", "edge_id", "kind", r6("flow").alias("flow"), r6("failures_volume").alias("failures_volume"))


_STREAKS = """g as (select user_id, node_id, bin, depth > lag(depth) over w as g1, arrivals / nullif(cap, 0) > 1 as g2, queue_ms / 60000 > sla as g3 from n window w as (partition by user_id, node_id order by bin)),
    r as (select user_id, node_id, k, min(bin) as lo, max(bin) as hi, count(*) as len from (select user_id, node_id, bin, k, bin - row_number() over (partition by user_id, node_id, k order by bin) as i from (select user_id, node_id, bin, unnest(['backlog_growth_streak', 'backlog_overload_ratio', 'backlog_age_risk']) as k, unnest([g1, g2, g3]) as h from g) where h) group by user_id, node_id, k, i having count(*) >= 3),
    b as (select user_id, node_id, k as code, lo, hi from (select *, row_number() over (partition by user_id, node_id, k order by len desc, lo) as rank from r) where rank = 1)"""
_BINS = " union all ".join([
    "select user_id, node_id, 'served_exceeds_capacity' as code, bin, served - cap as x from n", "select user_id, node_id, 'served_exceeds_arrivals', bin, served - arrivals from n where node_id <> 'A'",
    "select user_id, node_id, 'queue_latency_unreported', bin, case when served <= 1e-6 then depth end from n where node_id = 'B'",
    "select user_id, 'D', 'edge_flow_mismatch_incoming', bin, abs(served * 0.25 - coalesce(lag(served * 0.25) over (partition by user_id order by bin), 0)) from u",
])


@query(
    f"with recursive $U, {_S}, {_STREAKS}, c as ({_BINS}), h as (select user_id, node_id, avg(arrivals) filter (where bin < 15) as e, avg(arrivals) filter (where bin >= 15) as l from n group by 1, 2)"
    " select user_id, node_id, code, case when code = 'queue_latency_unreported' then 'info' else 'warning' end as severity, array_to_string(case when code = 'queue_latency_unreported' then list_sort(list(bin)) else list_sort(list(bin))[1:5] end, ',') as bins, round(max(x), 6) as worst, count(*) as n, null::bigint as start_bin, null::bigint as end_bin from c where x > 1e-6 group by 1, 2, 3"
    " union all select user_id, node_id, code, 'warning', '', null, 1, lo - (code = 'backlog_growth_streak')::int, hi from b"
    " union all select user_id, node_id, 'littles-law-non-stationary', 'warning', '', null, 1, null, null from h where abs(e - l) / nullif(greatest(abs(e), abs(l)), 0) > 0.25"
    " union all select user_id, 'A', 'capacity_all_zero', 'info', '', null, 1, null, null from u group by 1, 2 having max(purchases) <= 1e-6"
    " union all select distinct user_id, c, k, 'warning', '', null::double, 1, null::bigint, null::bigint from u, (values ('A', 'edge_behavior_violation_lag'), ('D', 'dlq_non_terminal_inbound')) t(c, k)"
)
def model_warnings(spark, sf):
    """All warnings of the model's run for every user, in one plan."""
    m = two_queues()
    found = warnings(node_rows(run(spark, sf, m), m, BY, internal=True), BY)
    return found.select("user_id", "node_id", "code", "severity", F.array_join("bins", ",").alias("bins"), r6("worst").alias("worst"), "n", "start_bin", "end_bin")


@query(
    "with $U, x as (select *, errors + signups as n2, case when arrivals > 0 then 1 else 0 end as one from u) select user_id, node_id, code, case when bins is null then '' else bins end as bins, round(worst, 6) as worst, n from ("
    " select user_id, 'r' as node_id, 'router_class_leakage' as code, array_to_string(list_sort(list(bin))[1:5], ',') as bins, max(greatest(errors, signups)) as worst, count(*) as n from x where greatest(errors, signups) > 1e-6 group by 1"
    " union all select user_id, 'r', 'router_missing_class_route', '', null, 1 from x group by 1 having max(n2) > 1e-6"
    " union all select user_id, 'T', 'class_series_missing_errors', '', null, 1 from x group by 1 having max(purchases) > 1e-6)"
)
def model_class_warnings(spark, sf):
    """A router without a route for two classes, and a service that loses what has no classes though its arrivals have."""
    m = user_model(
        expr("all", "arrivals + errors + signups"), {"id": "r", "kind": "router", "router": {"inputs": {"queue": "all"}, "routes": [{"target": "gold", "classes": ["web"]}]}}, expr("done", "gold"),
        topology=[{"id": "T", "kind": "service", "semantics": {"arrivals": "gold", "served": "done", "errors": "purchases"}}],
        traffic={"arrivals": [{"nodeId": n, "classId": c, "pattern": {"kind": "constant", "ratePerBin": 1.0}} for n, c in (("arrivals", "web"), ("errors", "bot"), ("signups", "new"))]},
    )
    found = warnings(node_rows(run(spark, sf, m, with_classes=True), m, BY, internal=True), BY).where(F.col("code").like("%class%"))
    return found.select("user_id", "node_id", "code", F.array_join("bins", ",").alias("bins"), r6("worst").alias("worst"), "n")


@query("with $U, f as (select user_id, bin, case when errors > 0 then errors end as x from u), l as (select *, lag(x, 1) over w as a, lag(x, 2) over w as b, lag(x, 3) over w as c from f window w as (partition by user_id order by bin)) select user_id, bin, round(case when coalesce(a, b, c) is not null then 0.6 * coalesce(a, 0) + 0.3 * coalesce(b, 0) + 0.1 * coalesce(c, 0) end, 6) as echo from l")
def retry_echo(spark, sf):
    """What comes again of each user's failures, days without any being no values: null where nothing contributes."""
    df = users(spark, sf).withColumn("failures", F.when(F.col("errors") > 0, F.col("errors")))
    return df.select("user_id", "bin", r6(echo("failures", [0, 0.6, 0.3, 0.1], ("user_id",))).alias("echo"))


@query(f"with recursive $U, {_S}, e as (select user_id, node_id, max(util is not null) as utilization, max(queue_ms is not null) as queue, max(cycle_ms is not null) as cycle, max(flow_ms is not null) as flow, max(case when node_id = 'A' then sa is not null else false end) as service, max(case when node_id = 'A' then sa is not null and cycle_ms > 0 else false end) as eff, max(arrivals <> 0) as ratio from (select n.*, sa from n join s using (user_id, bin)) group by 1, 2), r as (select user_id, node_id, unnest(['latency_min', 'queue_time_ms', 'cycle_time_ms', 'flow_latency_ms', 'service_time_ms', 'flow_efficiency', 'utilization', 'throughput_ratio', 'queue_depth']) as metric, unnest(['avg', 'avg', 'avg', 'avg', 'avg', 'avg', 'unknown', 'unknown', null]) as aggregation, unnest([queue, queue, cycle, flow, service, eff, utilization, ratio, true]) as has from e) select user_id, node_id, metric, aggregation, case when metric = 'queue_depth' and node_id = 'B' then 'explicit' else 'derived' end as origin from r where has")
def model_series_metadata(spark, sf):
    """Which derived metrics each user's nodes have, how they aggregate and where they come from."""
    return state.series_metadata(nodes(spark, sf).where("topology"), ("user_id", "node_id"), ["B"])


@query("with $U, t as (select user_id, bin, arrivals as v from u where user_id % 7 <> 0), c as (select user_id, bin, 'a' as k, arrivals * 0.5 as v from u where user_id % 3 <> 0 union all select user_id, bin, 'b', arrivals * 0.5 + case when bin = 3 and user_id % 5 = 0 then 1 else 0 end from u where user_id % 3 <> 0 and user_id % 4 <> 1), n as (select distinct user_id from u), h as (select n.user_id, user_id % 7 <> 0 as total, user_id % 3 <> 0 as a, user_id % 3 <> 0 and user_id % 4 <> 1 as b from n), o as (select t.user_id, min(t.bin) as bin from t join (select user_id, bin, sum(v) as s from c group by 1, 2) x using (user_id, bin) where abs(t.v - s) > greatest(1e-6, abs(t.v) * 1e-6) group by 1) select user_id::varchar as node_id, 'class_totals_missing' as code, null as detail from h where not total and a union all select user_id::varchar, 'class_series_missing', null from h where total and not a union all select user_id::varchar, 'class_series_partial', 'b' from h where total and a and not b union all select user_id::varchar, 'class_conservation_mismatch', bin::varchar from o")
def telemetry_classes(spark, sf):
    """Telemetry by class of every user: totals, classes or one class missing, and sums that are not the total."""
    u = users(spark, sf).withColumnRenamed("user_id", "node_id").where("node_id is not null")
    totals = u.where("node_id % 7 <> 0").select("node_id", "bin", F.col("arrivals").alias("value"))
    half = F.col("arrivals") * 0.5
    classes = u.where("node_id % 3 <> 0").select("node_id", F.lit("a").alias("class_id"), "bin", half.alias("value"))
    b = u.where("node_id % 3 <> 0 and node_id % 4 <> 1").select("node_id", F.lit("b").alias("class_id"), "bin", (half + F.when((F.col("bin") == 3) & (F.col("node_id") % 5 == 0), 1.0).otherwise(0.0)).alias("value"))
    return checks.telemetry_class_errors(totals, classes.unionByName(b), ["a", "b"])


@query("with s as (select date_trunc('day', min(ts)) as lo, date_diff('day', date_trunc('day', min(ts)), max(ts)) + 1 as n from events), g as (select unnest(range(n)) as bin, lo from s), c as (select date_diff('day', lo, ts) as bin, count(*) filter (where event_type = 'view') as a, count(*) filter (where event_type = 'click') as b from events, s group by 1) select g.bin, lo + to_days(g.bin::int) as bin_start, coalesce(a, 0)::double as arrivals, coalesce(b, 0)::double as served from g left join c using (bin)")
def grid_of_events(spark, sf):
    """Days on a grid that begins and ends where the events do."""
    return binned_whole(spark, sf, "DAY").select("bin", "bin_start", "arrivals", "served")


# --- runs ---------------------------------------------------------------------------------------------------------------


def hourly(**more) -> dict:
    counts = [{"id": i, "kind": "const", "values": [0.0] * 720} for i in ("arrivals", "served", "errors", "purchases", "signups")]
    nodes_ = [*counts, *more.pop("nodes", [])]
    return {"grid": {"bins": 720, "binSize": 1, "binUnit": "hours"}, "nodes": nodes_, "topology": {"nodes": more.pop("topology", []), "edges": more.pop("edges", []), "constraints": []}, **more}


@query("with $H select series_id, bin, value, 720::bigint as bins from (select bin, unnest(['arrivals', 'served', 'moved']) as series_id, unnest([arrivals, served, served * 0.5]) as value from h)")
def run_directory(spark, sf):
    """A run as a directory of series files with JSON beside them, read back with its grid, and strictly."""
    m = hourly(nodes=[expr("moved", "served * 0.5")], outputs=[{"series": s} for s in ("arrivals", "served", "moved")])
    root = fresh(spark, "dir")
    df = evaluate(spark, m, data=hours(spark, sf))
    series_files.write_run_dir(df, df.columns[2:], root, m)
    grid, rows = series_files.read_run_dir(spark, root)
    return rows.withColumn("bins", F.lit(grid["bins"]).cast("long"))


@query("with $H, c as (select bin, arrivals as a, errors as e, arrivals + errors as n, served as s, case when arrivals + errors > 0 then served * arrivals / (arrivals + errors) else 0 end as sa from h), l as (select unnest(['inflow', 'inflow', 'inflow', 'edge_ab_flowVolume', 'edge_ab_flowVolume', 'edge_ab_flowVolume', 'q']) as series_id, unnest(['DEFAULT', 'web', 'bot', 'DEFAULT', 'web', 'bot', 'DEFAULT']) as class_id, unnest([n, a, e, s, sa, case when n > 0 then s - sa else 0 end, null]) as value from c) select series_id, class_id, count(*) as points, round(sum(value), 4) + 0.0 as total, 'full' as coverage, true as same from l where series_id <> 'q' group by 1, 2")
def run_with_classes(spark, sf):
    """A run with its classes and edges in a committed sink, its digests checked again."""
    m = hourly(
        nodes=[expr("inflow", "arrivals + errors")], classes=[{"id": "bot"}, {"id": "web"}], outputs=[{"series": "inflow"}], edges=[{"id": "ab", "source": "A", "target": "B"}],
        topology=[{"id": "A", "kind": "serviceWithBuffer", "semantics": {"arrivals": "inflow", "served": "served"}}, {"id": "B", "kind": "sink", "semantics": {"arrivals": "served"}}],
        traffic={"arrivals": [{"nodeId": n, "classId": c, "pattern": {"kind": "constant", "ratePerBin": 1.0}} for n, c in (("arrivals", "web"), ("errors", "bot"))]},
    )
    root = fresh(spark, "runs")
    about = series_files.write_model_run(evaluate(spark, m, data=hours(spark, sf), with_classes=True), m, root, "r")
    same = not series_files.verify_run(spark, root, "r")
    rows = series_files.read_run(spark, root, "r").groupBy("series_id", "class_id").agg(F.count("*").alias("points"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))
    return rows.withColumns({"coverage": F.lit(about["class_coverage"]), "same": F.lit(same)})


@query("with $H select 'S' as node_id, bin, arrivals, served, case when arrivals <> 0 then round(least(1, served / arrivals), 6) end as throughput_ratio from h union all select 'T', bin, served, errors, case when served <> 0 then round(least(1, errors / served), 6) end from h")
def fixture_state(spark, sf):
    """A fixture folder of series files and a window model, read back and shown as nodes."""
    root = fresh(spark, "fixture")
    series_files.write_run_dir(hours(spark, sf), ["arrivals", "served", "errors"], root, hourly())
    at = lambda s: f"file:series/{s}.csv"
    document = {
        "window": {"bins": 720, "binSize": 1, "binUnit": "hours", "startTimeUtc": "2024-01-01T00:00:00Z"},
        "topology": {"nodes": [{"id": "S", "kind": "service", "semantics": {"arrivals": at("arrivals"), "served": at("served")}}, {"id": "T", "kind": "service", "semantics": {"arrivals": at("served"), "served": at("errors")}}], "edges": [{"source": "S", "target": "T", "weight": 0}]},
    }
    series_files.put_text(spark, f"{root}/model.json", json.dumps(document))
    model, frame = load_fixture(spark, root)
    return node_rows(frame, model).where("topology").select("node_id", "bin", "arrivals", "served", r6("throughput_ratio").alias("throughput_ratio"))
