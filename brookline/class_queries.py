"""Queries of classes through models over each user's days: limits, losses, schedules, routers, constraints and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model_queries import BY, expr, run, user_model, work
from .plans.compiler import by_class
from .queries import query, r6


def single(**classes: str) -> dict:
    """Traffic in which each series is of one class."""
    return {"arrivals": [{"nodeId": n, "classId": c, "pattern": {"kind": "constant", "ratePerBin": 1.0}} for n, c in classes.items()]}


def rows(spark, sf, model: dict, *series: str) -> DataFrame:
    """The classes of some series, and how far their sum is from the series."""
    found = by_class(run(spark, sf, model, with_classes=True), model, BY).where(F.col("series_id").isin(*series))
    return found.select("user_id", "bin", "series_id", "class_id", r6("total").alias("total"), r6("value").alias("value"))


def _long(cells: dict[str, tuple[str, str, str]]) -> str:
    """SQL of the rows (user_id, bin, series_id, class_id, total, value) from q; cells: series to total and both classes."""
    return " union all ".join(
        f"select user_id, bin, '{s}' as series_id, '{c}' as class_id, round({total}, 6) + 0.0 as total, round(case when {a} + {b} > 0 then {total} * {v} / ({a} + {b}) else {v} end, 6) + 0.0 as value from q"
        for s, (total, a, b) in cells.items() for c, v in (("bot", b), ("web", a))
    )


_INFLOW = """x as materialized (select user_id, bin, arrivals + errors as i, arrivals as i1, errors as i2, served as o, purchases as p, signups as l,
    case when arrivals + errors > 0 then arrivals / (arrivals + errors) else 0 end as f1, case when arrivals + errors > 0 then errors / (arrivals + errors) else 0 end as f2 from u)"""


@query(
    f"with recursive $U, {_INFLOW}, y as materialized (select *, case when bin % 3 = 1 then least(o, 2 + p) else 0 end as g from x),"
    " q as (select user_id, bin, least(3, greatest(0, i - o)) as a, greatest(0, greatest(0, i - o) - 3) as ao, greatest(0, i - o - l) as b, greatest(0, i - g) as c,"
    " greatest(0, 2 * i1 - o * f1) as ra1, greatest(0, 2 * i2 - o * f2) as ra2, greatest(0, 2 * i1 - (o + l) * f1) as rb1, greatest(0, 2 * i2 - (o + l) * f2) as rb2, greatest(0, 2 * i1 - g * f1) as rc1, greatest(0, 2 * i2 - g * f2) as rc2 from y where bin = 0"
    " union all select y.user_id, y.bin, least(3, greatest(0, q.a + i - o)), greatest(0, greatest(0, q.a + i - o) - 3), greatest(0, q.b + i - o - l), greatest(0, q.c + i - g),"
    " greatest(0, ra1 + i1 - o * f1), greatest(0, ra2 + i2 - o * f2), greatest(0, rb1 + i1 - (o + l) * f1), greatest(0, rb2 + i2 - (o + l) * f2), greatest(0, rc1 + i1 - g * f1), greatest(0, rc2 + i2 - g * f2) from q join y on y.user_id = q.user_id and y.bin = q.bin + 1) "
    + _long({"a_queue": ("a", "ra1", "ra2"), "A__overflow": ("ao", "ra1", "ra2"), "b_queue": ("b", "rb1", "rb2"), "c_queue": ("c", "rc1", "rc2")})
)
def model_class_queues(spark, sf):
    """Queues with a limit, with a loss, and with a schedule that has a capacity: what is served and lost gets the classes of
    what arrives."""
    queue = lambda i, **more: {"id": i, "kind": "serviceWithBuffer", "semantics": {"arrivals": "inflow", "served": "served"} | more.pop("semantics", {}), **more}
    m = user_model(
        expr("inflow", "arrivals + errors"), expr("gatecap", "2 + purchases"), traffic=single(arrivals="web", errors="bot"), classes=[{"id": "bot"}, {"id": "web"}],
        topology=[queue("A", wipLimit=3), queue("B", semantics={"errors": "signups"}), queue("C", dispatchSchedule={"periodBins": 3, "phaseOffset": 1, "capacitySeries": "gatecap"})],
    )
    return rows(spark, sf, m, "a_queue", "A__overflow", "b_queue", "c_queue")


@query(
    "with $U, x as materialized (select user_id, bin, arrivals as i1, errors as i2, signups as i3, (errors + signups) * 0.75 as p, (errors + signups) * 0.25 as s, 1 + purchases as cap from u),"
    " q as (select *, case when p + s <= cap then p else cap * p / (p + s) end as ap, case when p + s <= cap then s else cap * s / (p + s) end as asp from x) "
    + " union all ".join(
        f"select user_id, bin, '{n}' as series_id, '{c}' as class_id, round({total}, 6) + 0.0 as total, round({v}, 6) + 0.0 as value from q"
        for n, total, cells in (
            ("gold", "i1", {"web": "i1"}), ("plain", "p", {"bot": "i2 * 0.75", "new": "i3 * 0.75"}), ("spill", "s", {"bot": "i2 * 0.25", "new": "i3 * 0.25"}),
            ("P__c", "ap", {"bot": "case when i2 + i3 > 0 then ap * i2 / (i2 + i3) else 0 end", "new": "case when i2 + i3 > 0 then ap * i3 / (i2 + i3) else 0 end"}),
        )
        for c, v in cells.items()
    )
)
def model_class_router(spark, sf):
    """A router behind a sum: one class by its route, the others by weight, and a constraint on what they lead to."""
    m = user_model(
        expr("all", "arrivals + errors + signups"), expr("most", "1 + purchases"),
        {"id": "r", "kind": "router", "router": {"inputs": {"queue": "all"}, "routes": [{"target": "gold", "classes": ["web"]}, {"target": "plain", "weight": 3}, {"target": "spill", "weight": 1}]}},
        traffic=single(arrivals="web", errors="bot", signups="new"), topology=[{"id": i, "kind": "serviceWithBuffer", "semantics": {"arrivals": a, "served": "served"}, "constraints": ["c"]} for i, a in (("P", "plain"), ("S", "spill"))],
        constraints=[{"id": "c", "semantics": {"arrivals": "all", "served": "most"}}],
    )
    return rows(spark, sf, m, "gold", "plain", "spill", "P__c")


@query(
    f"with recursive $U, {_INFLOW}, q as (select user_id, bin, i as n, i1 as n1, i2 as n2, greatest(0, i - o) as b, greatest(0, 2 * i1 - o * f1) as r1, greatest(0, 2 * i2 - o * f2) as r2 from x where bin = 0"
    " union all select user_id, bin, n, n1, n2, greatest(0, b + n - o) as b, greatest(0, r1 + n1 - case when n1 + n2 > 0 then o * n1 / (n1 + n2) else 0 end) as r1, greatest(0, r2 + n2 - case when n1 + n2 > 0 then o * n2 / (n1 + n2) else 0 end) as r2"
    " from (select *, case when s > 0 and abs(s - n) > 1e-9 then n * c1 / s else c1 end as n1, case when s > 0 and abs(s - n) > 1e-9 then n * c2 / s else c2 end as n2 from (select *, c1 + c2 as s from"
    " (select x.user_id, x.bin, x.o, q.b, q.r1, q.r2, x.i + 0.25 * q.b as n, x.i1 + 0.25 * case when q.r1 + q.r2 > 0 then q.b * q.r1 / (q.r1 + q.r2) else q.r1 end as c1, x.i2 + 0.25 * case when q.r1 + q.r2 > 0 then q.b * q.r2 / (q.r1 + q.r2) else q.r2 end as c2 from q join x on x.user_id = q.user_id and x.bin = q.bin + 1)))) "
    + _long({"backlog": ("b", "r1", "r2"), "again": ("n", "n1", "n2")})
)
def model_class_cycle(spark, sf):
    """A cycle: a part of a queue's backlog comes in again a day later, with its classes."""
    m = user_model(
        expr("inflow", "arrivals + errors"), expr("again", "inflow + 0.25 * SHIFT(backlog, 1)"), traffic=single(arrivals="web", errors="bot"), classes=[{"id": "bot"}, {"id": "web"}],
        topology=[work("again", "served")],
    )
    return rows(spark, sf, m, "backlog", "again")


@query("with $U, m as (select user_id, count(*) as bins from u group by 1) select user_id, s as series_id, 0::bigint as off, bins from m, (values ('A__overflow'), ('a_queue'), ('inflow'), ('late'), ('served'), ('top')) t(s)")
def model_class_sums(spark, sf):
    """Bins at which a series' classes sum to something else, where they sum to anything: none."""
    m = user_model(
        expr("inflow", "arrivals + errors"), expr("top", "MIN(inflow, 2 * purchases)"), expr("late", "CONV(SHIFT(inflow, 1) + top, [0.5, 0.25])"), traffic=single(arrivals="web", errors="bot"),
        topology=[{"id": "A", "kind": "serviceWithBuffer", "semantics": {"arrivals": "inflow", "served": "served"}, "wipLimit": 3}],
    )
    found = by_class(run(spark, sf, m, with_classes=True), m, BY).where(F.col("series_id").isin("A__overflow", "a_queue", "inflow", "late", "served", "top"))
    sums = found.groupBy("user_id", "series_id", "bin").agg(F.max("total").alias("total"), F.sum("value").alias("sum"))
    off = (F.col("sum") > 0) & (F.abs(F.col("sum") - F.col("total")) > 1e-6)
    return sums.groupBy("user_id", "series_id").agg(F.count_if(off).alias("off"), F.count("*").alias("bins"))
