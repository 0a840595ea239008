"""Queries of the flow operators over the event and order tables, each with SQL that says the same another way.

Series: views arrive, clicks serve, errors fail. `hours` is one series over 720 hours, `users` a series per user over 30
days, which is the axis that grows with the data; all windows are per user there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import arith as A
from .functions import metrics as M
from .functions.rng import Pmf
from .operators import checks, classes, routing, series, state, summary
from .plans import scenarios
from .plans.expr import to_column
from .plans.graph import graph
from .sources import registry
from .sources.events import ROLES, binned, by_type
from .sources.series_files import export_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_COUNTS = ", ".join(f"coalesce(e.{r}, 0)::double as {r}" for r in ("arrivals", "served", "errors", "purchases", "signups"))
_PIVOT = ", ".join(f"count(*) filter (where event_type = '{t}') as {r}" for t, r in (("view", "arrivals"), ("click", "served"), ("error", "errors"), ("purchase", "purchases"), ("signup", "signups")))
HOURS = f"h as (select g.bin, {_COUNTS} from (select unnest(range(720)) as bin) g left join (select date_diff('hour', timestamp '2024-01-01', ts) as bin, {_PIVOT} from events group by 1) e on e.bin = g.bin)"
USERS = f"u as materialized (select p.user_id, g.bin, {_COUNTS} from (select distinct user_id from events) p cross join (select unnest(range(30)) as bin) g left join (select user_id, date_diff('day', timestamp '2024-01-01', ts) as bin, {_PIVOT} from events group by 1, 2) e on e.bin = g.bin and e.user_id = p.user_id)"
KIND = ("user_id",)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql.replace("$H", HOURS).replace("$U", USERS)
        return f

    return add


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return binned(spark, sf)


def users(spark: SparkSession, sf: str) -> DataFrame:
    return binned(spark, sf, 30, "DAY", KIND)


def r6(x) -> F.Column:
    return F.round(A.col(x), 6) + 0.0


# --- sources and the grid ---------------------------------------------------------------------------------------------


@query("with $H select bin, arrivals, served, errors, purchases, signups from h")
def grid_arrivals(spark, sf):
    return hours(spark, sf).drop("scenario_id")


@query("select event_type as class_id, b.bin, coalesce(n, 0)::double as value from (select distinct event_type from events) t cross join (select unnest(range(720)) as bin) b left join (select event_type as et, date_diff('hour', timestamp '2024-01-01', ts) as bin, count(*) as n from events group by 1, 2) e on et = event_type and e.bin = b.bin")
def class_grid(spark, sf):
    return by_type(spark, sf).select("class_id", "bin", "value")


@query("select o_orderpriority as entity, date_diff('day', timestamp '1995-01-01', o_orderdate) // 7 as bin, count(*) as orders, round(sum(o_totalprice), 2) as price from orders group by 1, 2")
def weekly_orders(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    week = F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 7).cast("long")
    return o.groupBy(F.col("o_orderpriority").alias("entity"), week.alias("bin")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


# --- expressions ------------------------------------------------------------------------------------------------------


def expressions(name: str, sql: str, **texts: str) -> None:
    def run(spark, sf):
        return hours(spark, sf).select("bin", *[r6(to_column(t)).alias(n) for n, t in texts.items()])

    query(f"with $H select bin, {sql} from h", name)(run)


expressions("expr_arith", "arrivals + served as a, arrivals - served as s, arrivals * served as m, round(arrivals * 1.5 - 2, 6) as l, -errors + 0.0 as n", a="arrivals + served", s="arrivals - served", m="arrivals * served", l="arrivals * 1.5 - 2", n="-errors")
expressions("expr_safe_div", "case when served = 0 then 0.0 else round(arrivals / served, 6) end as d", d="arrivals / served")
expressions("expr_min_max", "least(arrivals, served) as lo, greatest(arrivals, 3.0) as hi", lo="MIN(arrivals, served)", hi="MAX(arrivals, 3)")
expressions("expr_clamp", "least(greatest(arrivals, 2.0), 4.0) as c, case when served > errors then served else greatest(served, least(errors, arrivals)) end as v", c="CLAMP(arrivals, 2, 4)", v="CLAMP(arrivals, served, errors)")
expressions("expr_mod", "arrivals - 3 * floor(arrivals / 3) as m, case when served = 0 then 0.0 else arrivals - served * floor(arrivals / served) end as d, (arrivals - served) - (-4) * floor((arrivals - served) / -4) as n", m="MOD(arrivals, 3)", d="MOD(arrivals, served)", n="MOD(arrivals - served, -4)")
expressions("expr_rounding", "floor((arrivals - served) / 4) as f, ceil((arrivals - served) / 4) + 0.0 as c, sign(arrivals - served) * floor(abs(arrivals - served) / 4 + 0.5) + 0.0 as r", f="FLOOR((arrivals - served) / 4)", c="CEIL((arrivals - served) / 4)", r="ROUND((arrivals - served) / 4)")
expressions("expr_step", "(arrivals >= 3)::int::double as s, (arrivals >= served)::int::double as o", s="STEP(arrivals, 3)", o="STEP(arrivals, served)")
expressions("expr_pulse", "case when bin >= 5 and (bin - 5) % 24 = 0 then 10.0 else 0.0 end::double as p, case when bin % 7 = 0 then arrivals else 0.0 end as q", p="PULSE(24, 5, 10)", q="PULSE(7, 0, arrivals)")
expressions("shift_lag", "coalesce(lag(arrivals, 3) over (order by bin), 0) as s, arrivals as z, arrivals + coalesce(lag(served) over (order by bin), 0) as m", s="SHIFT(arrivals, 3)", z="SHIFT(arrivals, 0)", m="arrivals + SHIFT(served, 1)")
expressions("conv_retry_kernel", "round(0.6 * coalesce(lag(errors, 1) over (order by bin), 0) + 0.3 * coalesce(lag(errors, 2) over (order by bin), 0) + 0.1 * coalesce(lag(errors, 3) over (order by bin), 0), 6) as echo", echo="CONV(errors, [0, 0.6, 0.3, 0.1])")


# --- recurrences ------------------------------------------------------------------------------------------------------


def _fold(columns: str, start: str, step: str, more: str = "") -> str:
    """SQL that walks each user's days: `start` and `step` give the columns, the row before being q."""
    return f"with recursive $U, q as (select user_id, bin, {start} from u where bin = 0 union all select u.user_id, u.bin, {step} from q join u on u.user_id = q.user_id and u.bin = q.bin + 1) select user_id, bin, {columns} from q {more}"


@query(_fold("queue", "greatest(0, arrivals - served) as queue", "greatest(0, q.queue + u.arrivals - u.served)"))
def queue_depth(spark, sf):
    return series.queue_depth(users(spark, sf), F.col("arrivals"), F.col("served"), keys=KIND).select("user_id", "bin", "queue")


@query(_fold("queue", "greatest(0, 5 + arrivals - served - errors) as queue", "greatest(0, q.queue + u.arrivals - u.served - u.errors)"))
def queue_init_loss(spark, sf):
    return series.queue_depth(users(spark, sf), F.col("arrivals"), F.col("served") + F.col("errors"), 5.0, keys=KIND).select("user_id", "bin", "queue")


@query(_fold("least(d, 2) as queue, greatest(0, d - 2) as overflow", "greatest(0, arrivals - served) as d", "greatest(0, least(q.d, 2) + u.arrivals - u.served)"))
def queue_wip_overflow(spark, sf):
    return series.queue_with_limit(users(spark, sf), "arrivals", "served", 2.0, keys=KIND).select("user_id", "bin", "queue", "overflow")


@query(_fold(
    "least(a, 2) as qa, least(b, 1) as qb, c as qc",
    "greatest(0, arrivals - served) as a, greatest(0, greatest(0, greatest(0, arrivals - served) - 2) - errors) as b, greatest(0, greatest(0, greatest(0, greatest(0, arrivals - served) - 2) - errors) - 1) as c",
    "greatest(0, least(q.a, 2) + u.arrivals - u.served), greatest(0, least(q.b, 1) + greatest(0, greatest(0, least(q.a, 2) + u.arrivals - u.served) - 2) - u.errors), q.c + greatest(0, greatest(0, least(q.b, 1) + greatest(0, greatest(0, least(q.a, 2) + u.arrivals - u.served) - 2) - u.errors) - 1)",
))
def overflow_cascade(spark, sf):
    df = series.queue_with_limit(users(spark, sf), "arrivals", "served", 2.0, name="qa", overflow="oa", keys=KIND)
    df = series.queue_with_limit(df, "oa", "errors", 1.0, name="qb", overflow="ob", keys=KIND)
    return series.queue_depth(df, F.col("ob"), F.lit(0.0), name="qc", keys=KIND).select("user_id", "bin", "qa", "qb", "qc")


@query(_fold("queue", "greatest(0, arrivals - 0) as queue", "greatest(0, q.queue + u.arrivals - case when u.bin >= 2 and (u.bin - 2) % 3 = 0 then least(5 * u.served, 4) else 0 end)"))
def dispatch_gate_queue(spark, sf):
    out = series.gate(5 * F.col("served"), 3, 2, F.lit(4.0))
    return series.queue_depth(users(spark, sf), F.col("arrivals"), out, keys=KIND).select("user_id", "bin", "queue")


@query(_fold("round(queue, 6) as queue, round(effective, 6) as effective", "greatest(0, arrivals - served)::double as queue, arrivals::double as effective", "greatest(0, q.queue + u.arrivals * (1 - least(1, q.queue / 8)) - u.served), u.arrivals * (1 - least(1, q.queue / 8))"))
def backpressure_feedback(spark, sf):
    return series.back_pressure(users(spark, sf), "arrivals", "served", 8.0, KIND).select("user_id", "bin", r6("queue").alias("queue"), r6("effective").alias("effective"))


@query("with recursive $U, q as (select user_id, bin, greatest(0, arrivals - served) as queue from u where bin = 0 union all select u.user_id, u.bin, greatest(0, q.queue + u.arrivals - u.served) from q join u on u.user_id = q.user_id and u.bin = q.bin + 1) select user_id, bin, queue from q where bin between 10 and 14")
def state_window(spark, sf):
    df = series.queue_depth(users(spark, sf), F.col("arrivals"), F.col("served"), keys=KIND)
    return series.between(df, 10, 14).select("user_id", "bin", "queue")


# --- routing, constraints, classes, edges -----------------------------------------------------------------------------


def _routed(spark, sf) -> DataFrame:
    """Ten routers, each for a tenth of the users."""
    return users(spark, sf).withColumn("router", F.concat(F.lit("r"), F.col("user_id") % 10))


def _source(spark, sf) -> DataFrame:
    return _routed(spark, sf).groupBy("scenario_id", "bin", "router").agg(F.sum("arrivals").alias("value"))


def _routes(spark, sf, *rows) -> DataFrame:
    """The same routes for each router, to targets of its own."""
    of = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).cast("double").alias("weight"), F.lit(c).cast("string").alias("class_id")) for t, w, c in rows])
    each = _routed(spark, sf).select("router").distinct().select("router", F.explode(of).alias("x"))
    return each.select("router", F.concat_ws(":", "router", "x.t").alias("target"), "x.weight", "x.class_id")


_DAYS = "d as (select 'r' || (user_id % 10) as router, bin, sum(arrivals) as v from u group by 1, 2)"


@query(f"with $U, {_DAYS} select bin, router || ':' || target as target, round(v * f, 6) as flow from d, (values ('a', 0.5), ('b', 0.2), ('c', 0.3)) t(target, f)")
def router_weight(spark, sf):
    flows = routing.route(_source(spark, sf), _routes(spark, sf, ("a", 5.0, None), ("b", 2.0, None), ("c", 1.0, None), ("c", 2.0, None)))
    return flows.select("bin", "target", r6("flow").alias("flow"))


def _class_flow(spark, sf) -> DataFrame:
    df = _routed(spark, sf).groupBy("scenario_id", "bin", "router").agg(*[F.sum(c).alias(c) for c in ("arrivals", "served", "errors")])
    return df.unpivot(["scenario_id", "bin", "router"], ["arrivals", "served", "errors"], "class_id", "value")


_CF = "c as (select router, bin, unnest(['arrivals', 'served', 'errors']) as class_id, unnest([a, s, e]) as value from (select 'r' || (user_id % 10) as router, bin, sum(arrivals) as a, sum(served) as s, sum(errors) as e from u group by 1, 2))"


@query(f"with $U, {_CF} select bin, router || case class_id when 'errors' then ':bad' else ':good' end as target, sum(value) as flow from c group by 1, 2")
def router_class(spark, sf):
    cf = _class_flow(spark, sf)
    source = cf.groupBy("scenario_id", "bin", "router").agg(F.sum("value").alias("value"))
    return routing.route(source, _routes(spark, sf, ("bad", None, "errors"), ("good", None, "arrivals"), ("good", None, "served")), cf).select("bin", "target", "flow")


@query(f"with $U, {_CF}, s as (select router, bin, sum(value) as t, sum(value) filter (where class_id = 'errors') as e from c group by 1, 2) select bin, router || ':' || target as target, round(case target when 'bad' then e + 0.25 * (t - e) else 0.75 * (t - e) end, 6) as flow from s, (values ('bad'), ('good')) x(target)")
def router_mixed(spark, sf):
    cf = _class_flow(spark, sf)
    source = cf.groupBy("scenario_id", "bin", "router").agg(F.sum("value").alias("value"))
    return routing.route(source, _routes(spark, sf, ("bad", None, "errors"), ("good", 0.75, None), ("bad", 0.25, None)), cf).select("bin", "target", r6("flow").alias("flow"))


def _demand(spark, sf) -> DataFrame:
    return users(spark, sf).select("scenario_id", F.concat(F.lit("c"), F.col("user_id") % 10).alias("constraint_id"), F.col("user_id").alias("node_id"), "bin", F.col("arrivals").alias("demand"), F.lit(3.0).alias("capacity"))


@query("with $U select user_id, bin, round(case when t <= 3 then arrivals else 3 * arrivals / t end, 6) as allocated from (select *, sum(arrivals) over (partition by user_id % 10, bin) as t from u)")
def constraint_alloc(spark, sf):
    return routing.allocate(_demand(spark, sf)).select(F.col("node_id").alias("user_id"), "bin", r6("allocated").alias("allocated"))


@query("with recursive $U, w as materialized (select *, case when t <= 3 then arrivals else 3 * arrivals / t end as a from (select *, sum(arrivals) over (partition by user_id % 10, bin) as t from u)), q as (select user_id, bin, greatest(0, a - served) as queue from w where bin = 0 union all select w.user_id, w.bin, greatest(0, q.queue + w.a - w.served) from q join w on w.user_id = q.user_id and w.bin = q.bin + 1) select user_id, bin, round(queue, 6) as queue from q")
def constraint_queue(spark, sf):
    nodes = users(spark, sf).withColumnRenamed("user_id", "node_id")
    d = _demand(spark, sf)
    held = routing.enforce(nodes, d.select("constraint_id", "node_id").distinct(), d.select("scenario_id", "constraint_id", "bin", "capacity").distinct())
    return series.queue_depth(held, F.col("arrivals"), F.col("served"), keys=("node_id",)).select(F.col("node_id").alias("user_id"), "bin", r6("queue").alias("queue"))


def _classes(spark, sf) -> DataFrame:
    """The day's events of each type as classes, their sum as total."""
    c = by_type(spark, sf, 30, "DAY")
    return c.withColumn("total", F.sum("value").over(W.partitionBy("scenario_id", "bin")))


_T = "k as (select bin, class_id, value, sum(value) over (partition by bin) as total from (select b.bin, event_type as class_id, coalesce(n, 0)::double as value from (select distinct event_type from events) t cross join (select unnest(range(30)) as bin) b left join (select event_type as et, date_diff('day', timestamp '2024-01-01', ts) as bin, count(*) as n from events group by 1, 2) e on et = event_type and e.bin = b.bin))"


@query(f"with {_T} select bin, class_id, round(2 * total * value / total, 6) as value from k")
def class_share(spark, sf):
    return routing.normalise_classes(_classes(spark, sf).withColumn("total", 2 * F.col("total"))).select("bin", "class_id", r6("value").alias("value"))


@query(f"with {_T} select bin, class_id, round(least(total, 8) * value / total, 6) as value from k")
def class_min(spark, sf):
    a = _classes(spark, sf)
    limit = a.select("scenario_id", "bin").distinct().select("scenario_id", "bin", F.lit(None).cast("string").alias("class_id"), F.lit(8.0).alias("total"), F.lit(None).cast("double").alias("value"))
    return classes.chosen(a, limit).select("bin", "class_id", r6("value").alias("value"))


@query(f"with {_T}, s as (select bin, class_id, value + coalesce(lag(value) over (partition by class_id order by bin), 0) as value from k) select bin, class_id, value from s")
def class_sum_of_shift(spark, sf):
    a = _classes(spark, sf)
    return classes.add(a, classes.shifted(a, 1)).select("bin", "class_id", r6("value").alias("value"))


@query(f"with recursive {_T}, o as materialized (select *, coalesce(lag(value) over (partition by class_id order by bin), 0) as out, coalesce(lag(total) over (partition by class_id order by bin), 0) as tout from k), q as (select bin, class_id, 2 * value as v, total as t from o where bin = 0 union all select o.bin, o.class_id, greatest(0, q.v + o.value - o.out), greatest(0, q.t + o.total - o.tout) from q join o on o.class_id = q.class_id and o.bin = q.bin + 1) select bin, class_id, round(t * v / sum(v) over (partition by bin), 6) as value from q")
def class_queue(spark, sf):
    a = _classes(spark, sf)
    return classes.queued(a, classes.shifted(a, 1)).select("bin", "class_id", r6("value").alias("value"))


@query("with $U, c as (select user_id, bin, arrivals + served as total, unnest(case when user_id % 4 = 0 then ['view'] when user_id % 3 = 0 then ['view'] else ['view', 'click'] end) as k, unnest(case when user_id % 4 = 0 then [null] when user_id % 3 = 0 then [arrivals] else [arrivals, served] end) as v from u), b as (select user_id, bin, abs(max(total) - sum(coalesce(v, 0))) > 1 as open, count(v) as n from c group by 1, 2), k as (select user_id, array_to_string(list_sort(list_filter(['view', 'click'], x -> not list_contains(list(distinct k), x))), ',') as missing from c group by 1) select user_id as node_id, case when sum(n) = 0 then 'missing' when count(*) filter (where open) > 0 or missing <> '' then 'partial' else 'full' end as coverage, count(*) filter (where open) as open_bins, missing as missing_classes from b join k using (user_id) group by user_id, missing".replace("x -> not list_contains(list(distinct k), x)", "lambda x: not list_contains(list(distinct k), x)"))
def class_coverage(spark, sf):
    """How far classes cover each user's total: some users lack a class, some have no values at all."""
    u, third, fourth = users(spark, sf), F.col("user_id") % 3 == 0, F.col("user_id") % 4 == 0
    cell = lambda c, v: F.struct(F.lit(c).alias("class_id"), v.cast("double").alias("value"))
    cells = F.when(fourth, F.array(cell("view", F.lit(None)))).when(third, F.array(cell("view", F.col("arrivals")))).otherwise(F.array(cell("view", F.col("arrivals")), cell("click", F.col("served"))))
    c = u.select("scenario_id", F.col("user_id").alias("node_id"), "bin", (F.col("arrivals") + F.col("served")).alias("total"), F.explode(cells).alias("x")).select("scenario_id", "node_id", "bin", "total", "x.*")
    return routing.class_coverage(c, ["view", "click"]).select("node_id", "coverage", "open_bins", "missing_classes")


def _edges(spark, sf) -> DataFrame:
    """An edge of every user to the two next ones, heavier to the first; attempts move a day later."""
    ids = users(spark, sf).select("user_id").distinct()
    hop = F.explode(F.array(F.lit(1), F.lit(2))).alias("hop")
    return ids.select("user_id", hop).select(F.concat(F.col("user_id"), F.lit("->"), F.col("user_id") + F.col("hop")).alias("edge_id"), F.col("user_id").alias("source"), (F.col("user_id") + F.col("hop")).alias("target"), (4.0 / F.col("hop") - 1.0).alias("weight"), F.lit(2.0).alias("multiplier"), (F.col("hop") - 1).alias("lag"))


def _nodes(spark, sf) -> DataFrame:
    return users(spark, sf).withColumnRenamed("user_id", "node_id").withColumns({"attempts": F.col("arrivals") + F.col("errors"), "failures": F.col("errors")})


@query("with $U select user_id || '->' || (user_id + hop) as edge_id, bin, round(served * case hop when 1 then 0.75 else 0.25 end, 6) as flow from u, (values (1), (2)) t(hop)")
def edge_flow(spark, sf):
    return routing.edge_flow(_nodes(spark, sf), _edges(spark, sf)).select("edge_id", "bin", r6("flow").alias("flow"))


@query("with $U select user_id || '->' || (user_id + hop) as edge_id, bin, (case hop when 1 then arrivals + errors else lag(arrivals + errors) over w end) * 2 as attempts_volume, (case hop when 1 then errors else lag(errors) over w end) * 2 as failures_volume from u, (values (1), (2)) t(hop) window w as (partition by user_id, hop order by bin)")
def edge_retry_rate(spark, sf):
    return routing.edge_effort(_nodes(spark, sf), _edges(spark, sf)).select("edge_id", "bin", "attempts_volume", "failures_volume")


@query("with $U, f as (select user_id + hop as target, user_id || '->' || (user_id + hop) as edge_id, bin, served * case hop when 1 then 0.75 else 0.25 end as flow from u, (values (1), (2)) t(hop)), g as (select *, sum(flow) over (partition by target, bin) as s, count(*) over (partition by target, bin) as n from f) select edge_id, g.bin, round(errors * case when s > 0 then flow / s else 1.0 / n end, 6) as retry_volume from g join u on u.user_id = g.target and u.bin = g.bin")
def edge_retry_split(spark, sf):
    n = _nodes(spark, sf)
    echo = n.select("scenario_id", F.col("node_id").alias("target"), "bin", F.col("errors").alias("retry_echo"))
    return routing.retry_split(routing.edge_flow(n, _edges(spark, sf)), echo).select("edge_id", "bin", r6("retry_volume").alias("retry_volume"))


@query("with $U select user_id || '->' || (user_id + hop) as edge_id, bin, round(served * case hop when 1 then 0.75 else 0.25 end, 6) as flow from u, (values (1), (2)) t(hop) where lower(user_id || '->' || (user_id + hop)) in ('1->2', '3->5')")
def edge_filter(spark, sf):
    """Edges by id, in any case, of the metric and class that are asked for."""
    flows = routing.edge_flow(_nodes(spark, sf), _edges(spark, sf)).withColumns({"metric": F.lit("flowVolume"), "class_id": F.lit("DEFAULT")})
    tried = flows.withColumns({"metric": F.lit("attemptsVolume"), "flow": F.col("flow") * 2})
    kept = state.keep_edges(flows.unionByName(tried), ["1->2", "3->5"], ["FLOWVOLUME"], ["default"])
    return kept.select("edge_id", "bin", r6("flow").alias("flow"))


@query("with $U, f as (select user_id + hop as target, bin, sum(served * case hop when 1 then 0.75 else 0.25 end) as s from u, (values (1), (2)) t(hop) group by 1, 2) select u.user_id as node_id, u.bin, arrivals as expected, round(s, 6) as edges from u join f on f.target = u.user_id and f.bin = u.bin where abs(arrivals - s) > 1e-6")
def warn_edge_mismatch(spark, sf):
    n = _nodes(spark, sf)
    return routing.edge_mismatch(n, routing.edge_flow(n, _edges(spark, sf)), "target", "arrivals").select("node_id", "bin", "expected", r6("edges").alias("edges"))


@query(
    "with $U, c as (select user_id, bin, served, case when served > 0 then 1000 * arrivals / served end as cyc from u), l1 as (select user_id, bin, case when served > 0 then cyc end as l from c where user_id % 3 = 0),"
    " l2 as (select c.user_id, c.bin, case when c.served > 0 and (c.cyc is not null or p.l is not null) then coalesce(c.cyc, 0) + coalesce(round(p.l, 6), 0) end as l from c left join (select l1.user_id + 1 as user_id, l1.bin, l1.l from l1 join c on c.user_id = l1.user_id and c.bin = l1.bin where l is not null and c.served > 0) p on p.user_id = c.user_id and p.bin = c.bin where c.user_id % 3 = 1),"
    " l3 as (select c.user_id, c.bin, case when c.served > 0 then coalesce(c.cyc, 0) + coalesce(round(p.l, 6), 0) end as l from c left join (select l2.user_id + 1 as user_id, l2.bin, l2.l from l2 join c on c.user_id = l2.user_id and c.bin = l2.bin where l is not null and c.served > 0) p on p.user_id = c.user_id and p.bin = c.bin where c.user_id % 3 = 2)"
    " select user_id, bin, round(l, 4) as latency from (select * from l1 union all select * from l2 union all select * from l3)"
)
def flow_latency(spark, sf):
    n = users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", F.col("served").alias("carried"), M.queue_time_ms("arrivals", "served", 1000.0).alias("cycle_ms"))
    flows = n.where("node_id % 3 < 2").select("scenario_id", "bin", F.col("node_id").alias("source"), (F.col("node_id") + 1).alias("target"), F.col("carried").alias("flow"))
    done = routing.flow_latency(n.withColumn("level", F.col("node_id") % 3), flows, 3)
    return done.select(F.col("node_id").alias("user_id"), "bin", F.round("latency", 4).alias("latency"))


# --- metrics ----------------------------------------------------------------------------------------------------------


@query("""with $U, n as (select user_id, bin, round(case when cap > 0 then served / cap end, 6) as utilization, round(case when served > 0 then q / served * 86400000 end, 4) as queue_time_ms,
  round(case when purchases > 0 then signups * 250 / purchases end, 6) as service_time_ms, round(case when arrivals <> 0 then least(1, served / arrivals) end, 6) as throughput_ratio,
  round(case when arrivals + errors > 0 then greatest(0, (arrivals + errors - served) / (arrivals + errors)) end, 6) as retry_tax from (select *, 2 * signups as cap, arrivals + errors as q from u))
  select *, round(case when queue_time_ms is not null or service_time_ms is not null then coalesce(queue_time_ms, 0) + coalesce(service_time_ms, 0) end, 4) as cycle_time_ms from n""")
def node_metrics(spark, sf):
    df = users(spark, sf).withColumns({"cap": M.effective_capacity("signups", F.lit(2.0)), "q": F.col("arrivals") + F.col("errors")})
    df = df.withColumns({"queue_time_ms": F.round(M.queue_time_ms("q", "served", 86_400_000.0), 4), "service_time_ms": r6(M.service_time_ms(F.col("signups") * 250, "purchases"))})
    return df.select(
        "user_id", "bin", r6(M.utilization("served", "cap")).alias("utilization"), "queue_time_ms", "service_time_ms", r6(M.throughput_ratio("served", "arrivals")).alias("throughput_ratio"),
        r6(M.retry_tax(F.col("arrivals") + F.col("errors"), "served")).alias("retry_tax"), F.round(M.cycle_time_ms(F.col("queue_time_ms"), F.col("service_time_ms")), 4).alias("cycle_time_ms"),
    )


@query("with $U select user_id, round(case when r > 0 and r < 1 and s > 0 then r / (1 - r) * (ca * ca + 0.25) / 2 * s end, 6) as wait from (select user_id, sum(arrivals) / nullif(sum(arrivals) + 2 * sum(served), 0) as r, case when avg(arrivals) <> 0 then stddev_pop(arrivals) / avg(arrivals) else 0 end as ca, sum(errors) as s from u group by 1)")
def kingman(spark, sf):
    g = users(spark, sf).groupBy("user_id").agg(F.try_divide(F.sum("arrivals"), F.sum("arrivals") + 2 * F.sum("served")).alias("rho"), M.cv(F.col("arrivals")).alias("ca"), F.sum("errors").alias("s"))
    return g.select("user_id", r6(M.kingman_wait("rho", "ca", 0.5, "s")).alias("wait"))


@query("with $U select user_id, round(case when avg(arrivals) <> 0 then stddev_pop(arrivals) / abs(avg(arrivals)) else 0 end, 6) as cv from u group by 1")
def cv(spark, sf):
    return users(spark, sf).groupBy("user_id").agg(r6(M.cv(F.col("arrivals"))).alias("cv"))


@query("with $U select user_id, count(*) as evaluated, round(avg((case when arrivals > 0 then least(1, served / arrivals) else 1 end >= 0.95)::int), 6) as sla from u group by 1")
def service_sla(spark, sf):
    return users(spark, sf).groupBy("user_id").agg(F.count("*").alias("evaluated"), r6(F.avg(M.sla_met("served", "arrivals"))).alias("sla"))


@query("with $U select user_id, bin, round(last_value(r ignore nulls) over (partition by user_id order by bin), 6) as ratio from (select *, case when bin % 4 = 1 and arrivals <> 0 then least(1, served / arrivals) end as r from u)")
def sla_carry_forward(spark, sf):
    r = F.when(A.fires(F.col("bin"), 4, 1), M.throughput_ratio("served", "arrivals"))
    return users(spark, sf).select("user_id", "bin", r6(series.carry_forward(r, KIND)).alias("ratio"))


@query("with $U select user_id, bin, case when arrivals = 0 then 'gray' when served / arrivals < 0.7 then 'green' when served / arrivals < 0.9 then 'yellow' else 'red' end as load, case when served = 0 then 'gray' when errors / served <= 1 then 'green' when errors / served <= 1.5 then 'yellow' else 'red' end as queue, case when bin % 3 <> 0 and errors > 0 and served <= 0 then 'paused_gate_closed' end as gate from u")
def colour_buckets(spark, sf):
    return users(spark, sf).select("user_id", "bin", M.load_colour(M.utilization("served", "arrivals")).alias("load"), M.queue_colour(F.when(F.col("served") > 0, F.col("errors") / F.col("served")), 1.0).alias("queue"), M.gate_status(F.lit(True), A.fires(F.col("bin"), 3), "errors", "served").alias("gate"))


@query("with $H select bin, round(case when served = 0 then 0 else arrivals / served end * 3600000, 4) as queue_time_ms, round(case when purchases = 0 then 0 else signups / purchases end, 6) as service_time_ms, case when arrivals + served = 0 then 0 else round(served / (arrivals + served), 6) end as utilization from h")
def filled_metrics(spark, sf):
    df = hours(spark, sf)
    m = M.filled("served", F.col("arrivals") + F.col("served"), "arrivals", 3_600_000.0, "signups", "purchases")
    return df.select("bin", F.round(m["queue_time_ms"], 4).alias("queue_time_ms"), r6(m["service_time_ms"]).alias("service_time_ms"), r6(m["utilization"]).alias("utilization"))


@query(_fold("queue, case when served > 0 then 'serving' when queue > 0 then 'waiting' else 'idle' end as state", "greatest(0, arrivals - served) as queue, served", "greatest(0, q.queue + u.arrivals - u.served), u.served", "where bin = 20"))
def state_snapshot(spark, sf):
    df = series.queue_depth(users(spark, sf), F.col("arrivals"), F.col("served"), keys=KIND).where("bin = 20")
    return df.select("user_id", "bin", "queue", F.when(F.col("served") > 0, "serving").when(F.col("queue") > 0, "waiting").otherwise("idle").alias("state"))


# --- streaks, checks --------------------------------------------------------------------------------------------------

_RUNS = "select user_id, start_bin, end_bin, length from (select *, row_number() over (partition by user_id order by length desc, start_bin) as r from (select user_id, min(bin) as start_bin, max(bin) as end_bin, count(*) as length from (select user_id, bin, bin - row_number() over (partition by user_id order by bin) as g from %s where %s) group by user_id, g)) where r = 1 and length >= 3"


@query("with $U, d as (select *, s - least(0, min(s) over (partition by user_id order by bin)) as q from (select *, sum(arrivals - served) over (partition by user_id order by bin) as s from u)), g as (select *, q - lag(q) over (partition by user_id order by bin) as dq from d) select user_id, start_bin - 1 as start_bin, end_bin, length from (" + _RUNS % ("g", "dq > 0") + ")")
def streak_growth(spark, sf):
    df = series.queue_depth(users(spark, sf), F.col("arrivals"), F.col("served"), keys=KIND)
    return series.growth_streak(df, "queue", KIND, 3)


@query("with $U " + _RUNS % ("u", "arrivals > served"))
def streak_overload(spark, sf):
    return series.longest_streak(users(spark, sf), F.col("arrivals") > F.col("served"), KIND)


@query("with $U " + _RUNS % ("u", "served > 0 and errors / served > 0.5"))
def streak_age(spark, sf):
    return series.longest_streak(users(spark, sf), M.queue_time_ms("errors", "served", 1.0) > 0.5, KIND)


@query("with $U, s as (select user_id, avg(arrivals) filter (where bin < 15) as first_mean, avg(arrivals) filter (where bin >= 15) as second_mean from u group by 1) select user_id, round(first_mean, 6) as first_mean, round(second_mean, 6) as second_mean, coalesce(abs(first_mean - second_mean) / nullif(greatest(abs(first_mean), abs(second_mean)), 0) > 0.25, false) as non_stationary from s")
def stationarity(spark, sf):
    return series.stationarity(users(spark, sf), "arrivals", KIND).select("user_id", r6("first_mean").alias("first_mean"), r6("second_mean").alias("second_mean"), "non_stationary")


def _found(df: DataFrame) -> DataFrame:
    return df.select("node_id", "code", F.array_join("bins", ",").alias("bins"), r6("worst").alias("worst"), "n")


_FOUND = "array_to_string(list_sort(list(bin))[1:5], ',') as bins, round(max(x), 6) as worst, count(*) as n"


@query(f"with $U select user_id as node_id, 'served_negative' as code, {_FOUND} from (select user_id, bin, -(served - errors) as x from u) where x > 1e-6 group by 1")
def warn_negative(spark, sf):
    n = users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", (F.col("served") - F.col("errors")).alias("served"))
    return _found(checks.check(n).where("code = 'served_negative'"))


@query(f"with $U select user_id as node_id, code, {_FOUND} from (select user_id, bin, 'served_exceeds_arrivals' as code, served - arrivals as x from u union all select user_id, bin, 'errors_exceed_arrivals', errors - arrivals from u) where x > 1e-6 group by 1, 2")
def warn_conservation(spark, sf):
    n = users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", "arrivals", "served", "errors")
    return _found(checks.check(n))


@query(f"with recursive $U, q as (select user_id, bin, greatest(0, arrivals - served) as queue from u where bin = 0 union all select u.user_id, u.bin, greatest(0, q.queue + u.arrivals - u.served) from q join u on u.user_id = q.user_id and u.bin = q.bin + 1) select user_id as node_id, 'queue_depth_mismatch' as code, {_FOUND} from (select q.user_id, q.bin, abs(queue - u.signups) as x from q join u on u.user_id = q.user_id and u.bin = q.bin) where x > 1e-6 group by 1")
def warn_queue_mismatch(spark, sf):
    n = users(spark, sf).withColumnsRenamed({"user_id": "node_id", "signups": "queue_depth"})
    return _found(checks.queue_mismatch(n))


_SEEN = "p as (select user_id, sum(arrivals) as a, sum(served) as s, max(signups) as c, count(nullif(purchases, 0)) as m from u group by 1)"


@query(
    f"with $U, {_SEEN}, w as (select user_id as node_id, unnest([case when c <= 1e-6 and (user_id % 5 <> 0 or m > 0) then 'capacity_all_zero' end, case when user_id % 5 = 0 then 'missing_exhausted_failures_series' end, case when user_id % 5 = 0 and m = 0 then 'missing_retry_budget_series' end,"
    " case when user_id % 3 = 1 then 'missing_queue_depth_series' end, case when user_id % 3 = 0 then 'missing_processing_time_series' end, case when user_id % 3 = 0 then 'missing_served_count_series' end,"
    " case when user_id % 7 = 0 and user_id % 2 = 0 then 'dispatch_capacity_missing' end, case when user_id % 7 = 0 and a > 1e-6 and s <= 1e-6 then 'dispatch_never_releases' end]) as code from p)"
    " select node_id, code, case when code in ('missing_exhausted_failures_series', 'missing_retry_budget_series', 'dispatch_capacity_missing') then 'warning' else 'info' end as severity from w where code is not null"
)
def warn_presence(spark, sf):
    n = users(spark, sf).select("scenario_id", F.col("user_id").alias("node_id"), "bin", "arrivals", "served", F.col("signups").alias("capacity"), F.when(F.col("purchases") > 0, F.col("purchases")).alias("retry_budget_remaining"))
    mod = lambda k: F.col("node_id") % k == 0
    kind = F.element_at(F.array(*map(F.lit, ("service", "queue", "dependency"))), (F.col("node_id") % 3 + 1).cast("int"))
    expected = n.select("node_id").distinct().select("node_id", kind.alias("kind"), F.array(F.lit("served")).alias("declared"), mod(5).alias("retries"), mod(7).alias("scheduled"), mod(2).alias("schedule_capacity"))
    return checks.presence(n, expected).drop("scenario_id")


@query(
    "with $U, d as (select *, s - least(0, min(s) over (partition by user_id order by bin)) as q from (select *, sum(arrivals - served) over (partition by user_id order by bin) as s from u)), g as (select *, q - lag(q) over (partition by user_id order by bin) as dq, case when served > 0 then q / served * 1440 end as minutes from d),"
    " m as (select user_id, avg(arrivals) filter (where bin < 15) as f, avg(arrivals) filter (where bin >= 15) as l from u group by 1)"
    " select user_id as node_id, 'backlog_growth_streak' as code, 'queue_depth' as signal, start_bin - 1 as start_bin, end_bin from (" + _RUNS % ("g", "dq > 0") + ")"
    " union all select user_id, 'backlog_overload_ratio', 'overload_ratio', start_bin, end_bin from (" + _RUNS % ("g", "arrivals > served and served > 0") + ")"
    " union all select user_id, 'backlog_age_risk', 'latency_minutes', start_bin, end_bin from (" + _RUNS % ("g", "minutes > 600") + ")"
    " union all select user_id, 'littles-law-non-stationary', 'queue_time_ms', null, null from m where abs(f - l) > 0.25 * greatest(abs(f), abs(l))"
)
def warn_window(spark, sf):
    df = series.queue_depth(users(spark, sf), F.col("arrivals"), F.col("served"), name="queue_depth", keys=KIND).withColumns({"effective_capacity": F.col("served"), "latency_minutes": M.latency_minutes("queue_depth", "served", 86_400_000.0)})
    return checks.window_warnings(df.withColumnRenamed("user_id", "node_id"), 600.0).drop("scenario_id")


@query(
    "with $U, f as (select user_id + hop as node_id, c as class_id, bin, sum(v * case hop when 1 then 0.75 else 0.25 end) as edges from (select user_id, bin, unnest(['a', 's']) as c, unnest([arrivals, served]) as v from u), (values (1), (2)) t(hop) where not (c = 's' and user_id % 4 < 2) group by all), n as (select user_id as node_id, bin, unnest(['a', 's']) as class_id, unnest([arrivals, served]) as value from u),"
    " o as (select node_id, class_id, bin, abs(value - edges) as x from n join f using (node_id, class_id, bin) where abs(value - edges) > 1e-6), l as (select distinct node_id, class_id from n where node_id in (select node_id from f) and (node_id, class_id) not in (select (node_id, class_id) from f)),"
    " b as (select * from o union all select node_id, class_id, null, null from l)"
    " select node_id, case when count(*) filter (where bin is null) > 0 then 'edge_class_partial_coverage' else 'edge_class_mismatch_incoming' end as code, case when count(bin) > 0 then string_agg(distinct class_id, ',' order by class_id) filter (where bin is not null) else string_agg(distinct class_id, ',' order by class_id) end as classes, coalesce(array_to_string(list_sort(list(distinct bin) filter (where bin is not null))[1:5], ','), '') as bins, round(max(x), 6) as worst from b group by 1"
)
def warn_edge_class_coverage(spark, sf):
    long = users(spark, sf).select("scenario_id", "user_id", "bin", F.col("arrivals").alias("a"), F.col("served").alias("s")).unpivot(["scenario_id", "user_id", "bin"], ["a", "s"], "class_id", "value")
    e = _edges(spark, sf).withColumn("part", F.when(F.col("target") - F.col("source") == 1, 0.75).otherwise(0.25))
    flows = long.where("not (class_id = 's' and user_id % 4 < 2)").join(e, F.col("user_id") == F.col("source")).select("scenario_id", "source", "target", "class_id", "bin", (F.col("value") * F.col("part")).alias("flow"))
    w = checks.edge_class_warnings(long.withColumnRenamed("user_id", "node_id"), flows, "target")
    return w.select("node_id", "code", F.array_join("classes", ",").alias("classes"), F.array_join("bins", ",").alias("bins"), r6("worst").alias("worst"))


# --- summaries --------------------------------------------------------------------------------------------------------


@query("with $U select user_id, count(*) as n, min(arrivals) as low, max(arrivals) as high, round(avg(arrivals), 6) as mean, sum(arrivals) as total, round(stddev_pop(arrivals), 6) as deviation, arg_min(bin, (-arrivals, bin)) as peak_bin from u group by 1")
def series_summary(spark, sf):
    d = summary.describe(users(spark, sf), "arrivals", KIND)
    return d.select("user_id", "n", "low", "high", r6("mean").alias("mean"), "total", r6("deviation").alias("deviation"), "peak_bin")


@query("select event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) as p{p}" for p in (50, 90, 95, 99)) + " from events group by 1")
def percentiles(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    return e.groupBy("event_type").agg(*[r6(F.percentile("value", F.lit(p / 100))).alias(f"p{p}") for p in (50, 90, 95, 99)])


@query("with $H, l as (select *, lag(arrivals, 24) over (order by bin) as p from h) select round(greatest(0, least(1, 1 - sum(abs(arrivals - p)) / sum(arrivals) filter (where p is not null))), 6) as score, 1 - sum(abs(arrivals - p)) / sum(arrivals) filter (where p is not null) >= 0.85 as periodic from l")
def periodicity(spark, sf):
    return summary.periodicity(hours(spark, sf), "arrivals", 24, ["scenario_id"]).select(r6("score").alias("score"), "periodic")


@query("with $U select user_id, arrivals as value, round(count(*) / 30.0, 6) as probability from u group by 1, 2")
def pmf_fit(spark, sf):
    return summary.fit_pmf(users(spark, sf), "arrivals", KIND).select("user_id", "value", r6("probability").alias("probability"))


@query("with $U select user_id, round(avg(arrivals), 6) as mean, round(var_pop(arrivals), 6) as variance from u group by 1")
def pmf_moments(spark, sf):
    m = summary.pmf_moments(summary.fit_pmf(users(spark, sf), "arrivals", KIND), KIND)
    return m.select("user_id", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("with $U select user_id, bin, case when avg(arrivals) over (partition by user_id) <> 0 then round(arrivals / avg(arrivals) over (partition by user_id), 6) else 0 end as weight from u")
def profile_normalize(spark, sf):
    return summary.normalise_profile(users(spark, sf), "arrivals", KIND).select("user_id", "bin", r6("weight").alias("weight"))


@query("with $U, a as (select user_id, list(arrivals order by bin) as x from u group by 1) select user_id, bin, round(x[lo + 1] + (x[least(lo + 1, 29) + 1] - x[lo + 1]) * (f - lo), 6) as weight from (select *, bin / 48.0 * 29 as f, floor(bin / 48.0 * 29)::int as lo from a, (select unnest(range(48)) as bin))")
def profile_resample(spark, sf):
    packed = users(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "arrivals"))), lambda x: x["arrivals"]).alias("x"))
    return summary.resample_profile(packed, "x", 48).select("user_id", F.col("bin").cast("long").alias("bin"), r6("weight").alias("weight"))


@query("with $H select bin, case when arrivals = 0 then 0.0 when arrivals > 5 then 0.0 else arrivals end as value, case when arrivals = 0 then 'data_gap' when arrivals > 5 then 'nan_fill' end as gap from h")
def gap_fill(spark, sf):
    broken = hours(spark, sf).select("bin", F.when(F.col("arrivals") > 5, F.lit(float("nan"))).otherwise(F.when(F.col("arrivals") > 0, F.col("arrivals"))).alias("value"))
    return summary.fill_gaps(broken, "value", "zero", "zero").select("bin", "value", "gap")


# --- scenarios --------------------------------------------------------------------------------------------------------


@query("with recursive $U, s as materialized (select k, user_id, bin, arrivals * k / 4 as a, served from u, (select unnest(range(1, 9)) as k)), q as (select k, user_id, bin, greatest(0, a - served) as queue from s where bin = 0 union all select s.k, s.user_id, s.bin, greatest(0, q.queue + s.a - s.served) from q join s on s.k = q.k and s.user_id = q.user_id and s.bin = q.bin + 1) select k as scenario_id, user_id, round(avg(queue), 6) as mean_queue, max(queue) as top_queue from q group by 1, 2")
def sweep(spark, sf):
    values = spark.range(1, 9).select(F.col("id").alias("scenario_id"), (F.col("id") / 4.0).alias("factor"))
    df = scenarios.sweep_frame(users(spark, sf), values)
    keys = ("scenario_id", "user_id")
    q = series.queue_depth(df, F.col("arrivals") * F.col("factor"), F.col("served"), keys=keys)
    return q.groupBy(*keys).agg(r6(F.avg("queue")).alias("mean_queue"), F.max("queue").alias("top_queue"))


def model(bins: int = 24) -> dict:
    """A service behind a queue with retries: the model that the analyses search on."""
    return {
        "grid": {"bins": bins, "binSize": 1, "binUnit": "hours"},
        "nodes": [
            {"id": "demand", "kind": "const", "values": [12.0] * bins}, {"id": "capacity", "kind": "const", "values": [10.0] * bins}, {"id": "failing", "kind": "const", "values": [0.1] * bins},
            {"id": "served", "kind": "expr", "expr": "MIN(demand, capacity)"}, {"id": "errors", "kind": "expr", "expr": "served * failing"},
            {"id": "retries", "kind": "expr", "expr": "CONV(errors, [0, 0.6, 0.3, 0.1])"}, {"id": "inflow", "kind": "expr", "expr": "demand + retries"},
        ],
        "topology": {"nodes": [{"id": "Work", "kind": "serviceWithBuffer", "semantics": {"arrivals": "inflow", "served": "served", "queueDepth": "backlog"}}], "edges": [], "constraints": []},
    }


# --- registry, export -------------------------------------------------------------------------------------------------


def _artifacts(spark, sf, *more: F.Column) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.lit("run").alias("kind"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("size"), F.array(F.concat(F.lit("c"), F.col("o_custkey"))).alias("tags"), (F.col("o_orderstatus") == "P").alias("archived"), F.col("o_orderstatus").alias("template_id"), *more)


@query("select o_orderkey as id, o_orderpriority as title, o_totalprice as size from orders where o_orderstatus <> 'P' and lower(o_orderkey || ' ' || o_orderpriority) like '%urgent%' and o_totalprice between 1000 and 300000 order by o_totalprice desc, o_orderkey limit 50 offset 10")
def registry_search(spark, sf):
    found = registry.search(_artifacts(spark, sf), text="Urgent", size=(1000, 300000))
    return registry.page(found, "size", skip=10).select("id", "title", "size")


@query("select id, rank, other, gap::bigint as gap from (select *, row_number() over (partition by id order by gap, other) as rank from (select a.o_orderkey as id, b.o_orderkey as other, abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) as gap from orders a join orders b on a.o_orderkey <> b.o_orderkey and (a.o_custkey = b.o_custkey or a.o_orderdate = b.o_orderdate))) where rank <= 5")
def related_runs(spark, sf):
    return registry.related(_artifacts(spark, sf)).select("id", F.col("rank").cast("long").alias("rank"), "other", "gap")


@query("with $H select timestamp '2024-01-01' + to_hours(bin) as time_bin, 'web' as component_id, m as measure, v as value from (select bin, unnest(['arrivals', 'served']) as m, unnest([arrivals, served]) as v from h)")
def export_long(spark, sf):
    wide = hours(spark, sf).select("bin", F.col("arrivals").alias("arrivals@web@DEFAULT"), F.col("served").alias("served@web@DEFAULT"))
    return export_rows(wide.unpivot(["bin"], wide.columns[1:], "series_id", "value"), "2024-01-01 00:00:00", 60)


@query("with $H, q as (select *, s - least(0, min(s) over (order by bin)) as queue from (select *, sum(arrivals - served) over (order by bin) as s from h)) select bin, arrivals, served, queue, round(case when served > 0 then queue / served * 60 end, 6) as latency_min, round(case when arrivals <> 0 then least(1, served / arrivals) end, 6) as throughput_ratio from q")
def flagship(spark, sf):
    """Binned events, their queue, and what it does to latency."""
    df = series.queue_depth(hours(spark, sf), F.col("arrivals"), F.col("served"))
    return df.select("bin", "arrivals", "served", "queue", r6(M.latency_minutes("queue", "served", 3_600_000.0)).alias("latency_min"), r6(M.throughput_ratio("served", "arrivals")).alias("throughput_ratio"))


# --- more of routing, checks and the query surface --------------------------------------------------------------------


@query("with $U select user_id || '->' || (user_id + hop) as edge_id, bin, errors * 2 as failures_volume, greatest((arrivals + errors) * 2 - served * case hop when 1 then 0.75 else 0.25 end, 0) as retry_volume from u, (values (1), (2)) t(hop)")
def edge_failures_and_retries(spark, sf):
    n, e = _nodes(spark, sf), _edges(spark, sf)
    failures = routing.terminal_failures(n, e)
    efforts = routing.edge_effort(n, e.withColumn("lag", F.lit(0))).drop("failures_volume").join(routing.edge_flow(n, e).select("scenario_id", "edge_id", "bin", "flow"), ["scenario_id", "edge_id", "bin"])
    return failures.join(routing.effort_retries(efforts), ["scenario_id", "edge_id", "bin"]).select("edge_id", "bin", "failures_volume", "retry_volume")


@query(f"with $U, {_DAYS} select router || '->' || target as edge_id, bin, round(v * f, 6) as flow from d, (values ('a', 0.6), ('b', 0.4)) t(target, f)")
def router_edges(spark, sf):
    routes = _routes(spark, sf, ("a", 3.0, None), ("b", 2.0, None))
    edges = routes.select(F.concat(F.regexp_replace("target", ":", "->")).alias("edge_id"), F.col("router").alias("source"), "target").unionByName(routes.select(F.concat(F.lit("x->"), "target").alias("edge_id"), F.lit("x").alias("source"), "target"))
    flows = routing.route(_source(spark, sf), routes)
    return routing.router_edge_flow(flows, edges, routes.select("router", "target")).select("edge_id", "bin", r6("flow").alias("flow"))


@query("with $U, a as (select *, case when t <= 2 then served else 2 * served / t end as al from (select *, sum(served) over (partition by user_id % 10, bin) as t from u)), c as (select *, case when al + 1e-6 < served then al else served end as held from a) select user_id || '->' || (user_id + hop) as edge_id, bin, round(held, 6) as served, round(served * case hop when 1 then 0.75 else 0.25 end * case when served > 0 then held / served else 1 end, 6) as flow from c, (values (1), (2)) t(hop)")
def constraint_at_query(spark, sf):
    """Constraints applied to results: users say which one they stand under, and their edges carry what it leaves them."""
    n = _nodes(spark, sf).withColumn("limits", F.array(F.struct(F.concat(F.lit("c"), F.col("node_id") % 10).alias("constraint_id"), F.lit(2.0).alias("capacity"))))
    held = routing.hold(n)
    flows = routing.edge_flow(held, _edges(spark, sf)).join(held.select("scenario_id", F.col("node_id").alias("source"), "bin", F.col("served").alias("source_served")), ["scenario_id", "source", "bin"])
    return flows.select("edge_id", "bin", r6("source_served").alias("served"), r6("flow").alias("flow"))


@query("with $U select constraint_id, bin, shortfall, (shortfall > 1e-6)::int as limited from (select 'c' || (user_id % 10) as constraint_id, bin, greatest(0, sum(arrivals) - 3) as shortfall from u group by 1, 2)")
def constraint_status(spark, sf):
    d = _demand(spark, sf).groupBy("constraint_id", "bin").agg(F.sum("demand").alias("demand"), F.max("capacity").alias("capacity"))
    return d.select("constraint_id", "bin", M.shortfall("demand", "capacity").alias("shortfall"), M.limited("capacity", "demand").alias("limited"))


@query(f"with {_T} select bin, class_id, case when class_id in ('view', 'click') then 2 * value else value end as value from k")
def class_overrides(spark, sf):
    c = _classes(spark, sf)
    first = c.where(F.col("class_id").isin("view", "click")).withColumn("value", 2 * F.col("value"))
    return classes.first_of(first, c).select("bin", "class_id", "value")


@query(f"with {_T} select bin, class_id, floor(value / 2) as half, value - 3 * floor(value / 3) as rest from k")
def class_unary(spark, sf):
    c = _classes(spark, sf)
    half = classes.each(c.withColumns({"value": F.col("value") / 2, "total": F.col("total") / 2}), "floor").select("bin", "class_id", F.col("value").alias("half"))
    return half.join(c.select("bin", "class_id", A.floored_mod("value", 3.0).alias("rest")), ["bin", "class_id"])


@query(f"with {_T} select bin, class_id, value * 3 as product, case when total < 1e-9 then 0 else round(value / 4, 6) end as quotient from k")
def class_scaling(spark, sf):
    c = _classes(spark, sf)
    by = lambda v: c.select("scenario_id", "bin").distinct().select("scenario_id", "bin", F.lit(None).cast("string").alias("class_id"), F.lit(v).alias("total"), F.lit(None).cast("double").alias("value"))
    q = classes.over(c, by(4.0)).select("bin", "class_id", r6("value").alias("quotient"))
    return classes.times(c, by(3.0)).select("bin", "class_id", F.col("value").alias("product")).join(q, ["bin", "class_id"])


@query(f"with $U select user_id as node_id, case when bin % 3 = 1 then 'queue_latency_unreported' else 'queue_latency_gate_closed' end as code, {_FOUND} from (select user_id, bin, arrivals as x from u where served <= 1e-6) where x > 1e-6 group by 1, 2")
def warn_gate_closed(spark, sf):
    n = users(spark, sf).withColumns({"node_id": F.col("user_id"), "queue_depth": F.col("arrivals")})
    return _found(checks.gate_closed(n, 3, 1))


@query("with $U, f as (select user_id + hop as node_id, c as class_id, bin, sum(v * case hop when 1 then 0.75 else 0.25 end) as edges from (select user_id, bin, unnest(['a', 's']) as c, unnest([arrivals, served]) as v from u), (values (1), (2)) t(hop) group by all), n as (select user_id as node_id, bin, unnest(['a', 's']) as class_id, unnest([arrivals, served]) as value from u) select node_id, class_id, bin, value as expected, round(edges, 6) as edges from n join f using (node_id, class_id, bin) where abs(value - edges) > 1e-6")
def warn_edge_class(spark, sf):
    long = users(spark, sf).select("scenario_id", "user_id", "bin", F.col("arrivals").alias("a"), F.col("served").alias("s")).unpivot(["scenario_id", "user_id", "bin"], ["a", "s"], "class_id", "value")
    e = _edges(spark, sf).withColumn("part", F.when(F.col("target") - F.col("source") == 1, 0.75).otherwise(0.25))
    flows = long.join(e, F.col("user_id") == F.col("source")).select("scenario_id", "source", "target", "class_id", "bin", (F.col("value") * F.col("part")).alias("flow"))
    n = long.withColumnRenamed("user_id", "node_id")
    return routing.edge_class_mismatch(n, flows, "target").select("node_id", "class_id", "bin", "expected", r6("edges").alias("edges"))


@query("with $U select user_id as node_id, unnest(['invalid_latency_series', 'missing_capacity_series']) as code, 'warning' as severity from u group by 1 having bool_or(served = 0) union all select user_id, 'missing_capacity_series', 'warning' from u group by 1 having not bool_or(served = 0)")
def warn_mode(spark, sf):
    n = users(spark, sf).select(F.col("user_id").alias("node_id"), "bin", "arrivals", M.queue_time_ms("arrivals", "served", 1.0).alias("latency"))
    return checks.mode_errors(n, ["arrivals", "latency", "capacity"], "telemetry")


@query("with $U select series_id, code, n from (select user_id as series_id, unnest(['data_gap', 'length_mismatch']) as code, unnest([count(*) filter (where arrivals = 0), count(*)]) as n from u group by 1) where code <> 'data_gap' or n > 0")
def warn_telemetry(spark, sf):
    t = users(spark, sf).select(F.col("user_id").alias("series_id"), "bin", F.when(F.col("arrivals") > 0, F.col("arrivals")).alias("value"))
    return checks.telemetry_gaps(t, 31)


@query("with $U select user_id as node_id, array_to_string(list(arrivals order by bin), ',') as arrivals, array_to_string(list(served order by bin), ',') as served from u where bin between 3 and 9 and user_id % 2 = 0 group by 1")
def state_arrays(spark, sf):
    n = users(spark, sf).withColumns({"node_id": F.col("user_id"), "kind": F.when(F.col("user_id") % 2 == 0, "service").otherwise("expr")})
    w = state.window(n, 3, 9, ["arrivals", "served"], mode="operational")
    return w.select("node_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("arrivals", "served")])


@query("with $U select user_id as node_id, bool_or(served > 0) as queue_time_ms, bool_or(signups > 0) as utilization, bool_or(arrivals <> 0) as throughput_ratio from u group by 1")
def emitted_metrics(spark, sf):
    n = users(spark, sf).select(F.col("user_id").alias("node_id"), "bin", "arrivals", "served", F.col("arrivals").alias("queue_depth"), F.col("signups").alias("capacity"), F.lit(1.0).alias("processing_time_ms_sum"), F.lit(1.0).alias("served_count"))
    return state.emitted(state.with_metrics(n, 1000.0), ["queue_time_ms", "utilization", "throughput_ratio"])


@query("with k as (select distinct user_id from events), t as (select * from (values (0, 'service', 'service', false, true, 'service'), (1, 'serviceWithBuffer', 'service', true, true, 'service_with_buffer'), (2, 'dlq', 'dlq', true, false, 'queue'), (3, 'router', 'router', false, false, 'router'), (4, 'odd', 'unknown', false, false, 'unknown')) t(i, kind, category, has_queue, has_service, identity)) select user_id as node_id, kind, category, has_queue, has_service, identity from k join t on i = user_id % 5")
def node_descriptors(spark, sf):
    """A node for every user, of one kind of five."""
    kinds = F.array(*map(F.lit, ("service", "serviceWithBuffer", "dlq", "router", "odd")))
    n = users(spark, sf).select(F.col("user_id").alias("node_id")).distinct()
    return state.describe_nodes(n.withColumn("kind", F.element_at(kinds, (F.col("node_id") % 5 + 1).cast("int"))))


@query("with h as (select distinct user_id, case event_type when 'view' then 'arrivals' when 'click' then 'served' when 'error' then 'errors' when 'purchase' then 'purchases' else 'signups' end as s from events), p as (select distinct user_id from events), n as (select user_id, s from h union all select user_id, unnest(['load', 'late', 'Work']) from p), e as (select * from (values ('arrivals->load', 'arrivals', 'load', 'reference'), ('errors->load', 'errors', 'load', 'reference'), ('load->late', 'load', 'late', 'lagged'), ('load->Work', 'load', 'Work', 'arrivals'), ('served->Work', 'served', 'Work', 'served')) t(edge_id, source, target, type)) select user_id, edge_id, type from e join n a on a.s = source join n b on b.s = target and b.user_id = a.user_id".replace("select user_id, edge_id", "select a.user_id, edge_id"))
def model_graph(spark, sf):
    """The graph of each user's model: its edges between the series that the user has events for, and what is made of them."""
    m = {"nodes": [{"id": i, "kind": "const"} for i in ROLES.values()] + [{"id": "load", "kind": "expr", "expr": "arrivals + errors"}, {"id": "late", "kind": "expr", "expr": "SHIFT(load, 1)"}], "topology": {"nodes": [{"id": "Work", "kind": "service", "semantics": {"arrivals": "load", "served": "served"}}]}}
    nodes, edges = graph(spark, m)
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    series_of = F.concat(F.transform("has", lambda t: role[t]), F.array(*map(F.lit, ("load", "late", "Work"))))
    own = by_type_of_users(spark, sf).select("user_id", series_of.alias("has"))
    known = edges.join(nodes.select(F.col("node_id").alias("source")), "source", "left_semi").agg(F.collect_list(F.struct("edge_id", "source", "target", "type")).alias("all"))  # a model's edges
    kept = F.filter("all", lambda e: F.array_contains("has", e["source"]) & F.array_contains("has", e["target"]))
    return own.join(F.broadcast(known)).select("user_id", F.explode(kept).alias("e")).select("user_id", "e.edge_id", "e.type")



@query(
    "with $H, l as (select *, lag(arrivals, 24) over (order by bin) as d, lag(arrivals, 168) over (order by bin) as w from h), s as (select greatest(0, 1 - sum(abs(arrivals - d)) / sum(arrivals) filter (where d is not null)) as d, greatest(0, 1 - sum(abs(arrivals - w)) / sum(arrivals) filter (where w is not null)) as w from l)"
    " select case when d > 0 and d >= w then 'daily' when w > 0 then 'weekly' end as label, case when d > 0 and d >= w then 24 when w > 0 then 168 end::bigint as period, round(case when greatest(d, w) > 0 then greatest(d, w) end, 6) as score, coalesce(greatest(d, w) >= 0.85, false) as periodic from s"
)
def detect_period(spark, sf):
    return summary.detect_period(hours(spark, sf), "arrivals", 24, ["scenario_id"]).select("label", "period", r6("score").alias("score"), "periodic")


@query("select 'run' as kind, count(*) as total, ceil(count(*) / 50.0)::bigint as pages from orders where o_orderstatus <> 'P' and o_totalprice between 1000 and 300000")
def registry_pages(spark, sf):
    return registry.pages(registry.search(_artifacts(spark, sf), size=(1000, 300000))).select("kind", "total", F.col("pages").cast("long").alias("pages"))


@query("with $U, s as (select user_id, list_sort(list_distinct(list(event_type))) as has from events group by 1) select user_id, array_to_string(list_sort(list_filter(['click', 'refund', 'view'], lambda x: not list_contains(has, x))), ',') as missing, len(has) as classes from s")
def class_sets(spark, sf):
    have = by_type_of_users(spark, sf)
    want = F.array(F.lit("click"), F.lit("refund"), F.lit("view"))
    return have.select("user_id", F.array_join(F.array_sort(F.array_except(want, "has")), ",").alias("missing"), F.size("has").cast("long").alias("classes"))


def by_type_of_users(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("has"))


from . import model_queries as _models  # noqa: E402, F401  (each registers its queries here)
from . import class_queries as _class_queries  # noqa: E402, F401
from . import state_queries as _state_queries  # noqa: E402, F401
from . import search_queries as _search_queries  # noqa: E402, F401
