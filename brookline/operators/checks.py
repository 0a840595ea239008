"""Invariants of node series as warnings: rows (scenario_id, node_id, code, bins, worst), the first bins of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import fires, is_finite
from .routing import edge_class_mismatch
from .series import along, gate, longest_streaks, queue_depth, stationarity

TOLERANCE, FIRST = 1e-6, 5
NEGATIVE = ("arrivals", "served", "errors", "attempts", "failures", "exhausted_failures", "queue_depth", "retry_echo", "retry_budget_remaining")


def rules(columns: list[str]) -> dict[str, Column]:
    """By code, how far a bin is from where it must be (over TOLERANCE: a warning); only for series that are there."""
    c, out = F.col, {f"{x}_negative": -F.col(x) for x in NEGATIVE if x in columns}
    pairs = [
        ("served_exceeds_arrivals", "served", "arrivals"), ("served_exceeds_capacity", "served", "effective_capacity"), ("errors_exceed_arrivals", "errors", "arrivals"),
        ("attempts_below_arrivals", "arrivals", "attempts"), ("failures_exceed_attempts", "failures", "attempts"),
        ("exhausted_exceeds_failures", "exhausted_failures", "failures"), ("exhausted_exceeds_errors", "exhausted_failures", "errors"),
    ]
    out |= {code: c(a) - c(b) for code, a, b in pairs if a in columns and b in columns}
    failed = [c(x) for x in ("failures", "errors") if x in columns]
    if {"attempts", "served"} <= set(columns) and failed:
        off = F.abs(c("attempts") - c("served") - F.coalesce(*failed))
        out["attempts_conservation_mismatch"] = F.when(is_finite(off) & (off > 1e-4), off)
    if {"queue_depth", "served"} <= set(columns):
        stuck = (c("served") <= TOLERANCE) & (F.abs("queue_depth") > TOLERANCE) & is_finite(c("queue_depth")) & is_finite(c("served"))
        out["queue_latency_unreported"] = F.when(stuck, F.abs("queue_depth"))
    return out


#: Rules that name the first bin alone, however many break them.
FIRST_ONLY = ("attempts_conservation_mismatch",)


def _gathered(found: DataFrame) -> DataFrame:
    """A row per node and code. What is not a number breaks no rule."""
    rows = found.where(~F.isnan(F.col("amount").cast("double"))).groupBy("scenario_id", "node_id", "code")
    out = rows.agg(F.slice(F.array_sort(F.collect_list("bin")), 1, FIRST).alias("bins"), F.max("amount").alias("worst"), F.count("*").alias("n"), F.min_by("amount", "bin").alias("_at"))
    one = F.col("code").isin(*FIRST_ONLY)
    return out.select("scenario_id", "node_id", "code", F.when(one, F.slice("bins", 1, 1)).otherwise(F.col("bins")).alias("bins"), F.when(one, F.col("_at")).otherwise(F.col("worst")).alias("worst"), F.when(one, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"))


def check(nodes: DataFrame, skip: dict[str, list[str]] | None = None) -> DataFrame:
    """All rules in one pass over nodes (scenario_id, node_id, bin, series...). skip: codes to the node kinds (column
    kind) that they do not hold for."""
    found = rules(nodes.columns)
    if skip:
        found = {code: F.when(~F.col("kind").isin(*skip[code]), x) if code in skip else x for code, x in found.items()}
    named = F.array(*[F.struct(F.lit(code).alias("code"), x.cast("double").alias("amount")) for code, x in found.items()])
    rows = nodes.select("scenario_id", "node_id", "bin", F.explode(named).alias("w")).select("scenario_id", "node_id", "bin", "w.*")
    return _gathered(rows.where(F.col("amount") > TOLERANCE))


def queue_mismatch(nodes: DataFrame, init: float = 0.0, period: int | None = None, phase: int = 0) -> DataFrame:
    """Bins at which a reported queue_depth is not what inflow and outflow make."""
    keys = ["scenario_id", "node_id"]
    out = F.col("served") if period is None else gate("served", period, phase)
    made = queue_depth(nodes, F.col("arrivals"), out, init, "_made", keys)
    off = made.withColumn("amount", F.abs(F.col("queue_depth") - F.col("_made"))).where(F.col("amount") > TOLERANCE)
    return _gathered(off.withColumn("code", F.lit("queue_depth_mismatch")))


def never_releases(nodes: DataFrame) -> DataFrame:
    """Scheduled nodes that serve nothing while something arrives."""
    sums = nodes.groupBy("scenario_id", "node_id").agg(F.sum("arrivals").alias("a"), F.sum("served").alias("s"))
    return sums.where((F.col("s") <= TOLERANCE) & (F.col("a") > TOLERANCE)).select("scenario_id", "node_id", F.lit("dispatch_never_releases").alias("code"))


def missing_series(node_columns: list[str], kind: str, has: dict[str, bool]) -> list[str]:
    """Codes of the series that a node of this kind should have; a check of the schema, before any data is read."""
    wanted = {"service": ["capacity", "served", "processing_time", "served_count"], "serviceWithBuffer": ["queue_depth", "served"], "queue": ["queue_depth"]}.get(kind, [])
    out = [f"missing_{w}_series" for w in wanted if w not in node_columns]
    if kind == "dependency":
        out += [f"missing_dependency_{w}" for w in ("arrivals", "served") if w not in node_columns]
    if has.get("retries"):
        out += [f"missing_{code}_series" for code, w in (("exhausted_failures", "exhausted_failures"), ("retry_budget", "retry_budget_remaining")) if w not in node_columns]
    return out


def presence(nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Series that a node should have but that have no value in any bin, capacity that is zero throughout, and schedules
    that cannot work: rows (scenario_id, node_id, code, severity).

    nodes: scenario_id, node_id, bin and series (a column that is absent counts as empty). expected: node_id, kind,
    declared (names of the series that the model gives the node), retries (it has a limit of attempts), scheduled, and
    schedule_capacity (its schedule names a capacity, which is the series dispatch_capacity)."""
    names = ("capacity", "effective_capacity", "arrivals", "served", "queue_depth", "exhausted_failures", "retry_budget_remaining", "processing_ms", "served_count", "dispatch_capacity")
    there = [x for x in names if x in nodes.columns]
    total = lambda x: F.sum(F.when(is_finite(F.col(x)), F.col(x))) if x in there else F.lit(None)
    capacity = "effective_capacity" if "effective_capacity" in there else "capacity"
    seen = nodes.groupBy("scenario_id", "node_id").agg(
        *[F.max(F.col(x).isNotNull()).alias(x) for x in there], total("arrivals").cast("double").alias("_in"), total("served").cast("double").alias("_out"),
        (F.max(F.abs(capacity)) <= TOLERANCE if capacity in there else F.lit(False)).alias("_zero"),
    )
    lacks = lambda x: ~F.col(x) if x in there else F.lit(True)
    wants = lambda x, *kinds: F.col("kind").isin(*kinds) | F.array_contains("declared", x)
    serves, dependency = ("service", "serviceWithBuffer", "router"), F.col("kind") == "dependency"
    found = [
        ("missing_capacity_series", "info", wants("capacity", *serves) & lacks("capacity")),
        ("missing_exhausted_failures_series", "warning", F.col("retries") & lacks("exhausted_failures")),
        ("missing_retry_budget_series", "warning", F.col("retries") & lacks("retry_budget_remaining")),
        ("capacity_all_zero", "info", ~(F.col("retries") & lacks("retry_budget_remaining")) & F.col("_zero")),
        ("missing_dependency_arrivals", "info", dependency & lacks("arrivals")),
        ("missing_dependency_served", "info", dependency & lacks("served")),
        ("missing_served_series", "info", ~dependency & wants("served", *serves) & lacks("served")),
        ("missing_queue_depth_series", "info", wants("queue_depth", "queue", "dlq") & lacks("queue_depth")),
        ("missing_processing_time_series", "info", wants("processing_ms", *serves) & lacks("processing_ms")),
        ("missing_served_count_series", "info", wants("served_count", *serves) & lacks("served_count")),
        ("dispatch_capacity_missing", "warning", F.col("scheduled") & F.col("schedule_capacity") & lacks("dispatch_capacity")),
        ("dispatch_missing_served_series", "info", F.col("scheduled") & lacks("served")),
        ("dispatch_never_releases", "info", F.col("scheduled") & ~lacks("served") & (F.col("_in") > TOLERANCE) & (F.coalesce("_out", F.lit(0.0)) <= TOLERANCE)),
    ]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, holds in found]))
    return seen.join(expected, "node_id").select("scenario_id", "node_id", F.explode(codes).alias("w")).select("scenario_id", "node_id", "w.*")


def window_warnings(nodes: DataFrame, sla: float | None = None) -> DataFrame:
    """Rows (scenario_id, node_id, code, signal, start_bin, end_bin): the longest runs of a growing queue, of arrivals over
    the effective capacity and of latency over the SLA (minutes), and arrivals that Little's law does not fit.

    nodes: scenario_id, node_id, bin, arrivals, queue_depth, effective_capacity, latency_minutes. The three runs
    come of one pass, the last of a second."""
    keys = ["scenario_id", "node_id"]
    late = (F.lit(sla if sla and sla > 0 else None).cast("double") < F.col("latency_minutes")) & ~F.isnan("latency_minutes")
    overload = F.when(F.col("effective_capacity") > 0, F.col("arrivals") / F.col("effective_capacity")) > 1
    grown = nodes.withColumn("_d", F.col("queue_depth") - F.lag("queue_depth").over(along(keys)))
    runs = longest_streaks(grown, {"backlog_growth_streak": F.col("_d") > 0, "backlog_overload_ratio": overload, "backlog_age_risk": late}, keys)
    signal = F.when(F.col("name") == "backlog_growth_streak", "queue_depth").when(F.col("name") == "backlog_overload_ratio", "overload_ratio").otherwise("latency_minutes")
    since = F.col("start_bin") - (F.col("name") == "backlog_growth_streak").cast("int")  # growth starts at the bin before its first increase
    streaks = runs.select(*keys, F.col("name").alias("code"), signal.alias("signal"), since.alias("start_bin"), "end_bin")
    none = F.lit(None).cast("long")
    drift = stationarity(nodes, "arrivals", keys).where("non_stationary").select(*keys, F.lit("littles-law-non-stationary").alias("code"), F.lit("queue_time_ms").alias("signal"), none.alias("start_bin"), none.alias("end_bin"))
    return streaks.unionByName(drift)


def edge_class_warnings(nodes: DataFrame, flows: DataFrame, side: str) -> DataFrame:
    """Nodes whose classes the edges of one side do not carry as they should: rows (scenario_id, node_id, code, classes,
    bins, worst). Partial coverage, if edges lack some class of the node; else a mismatch. nodes: node_id, class_id, bin,
    value; flows: source, target, class_id, bin, flow."""
    keys = ["scenario_id", "node_id"]
    carried = flows.select("scenario_id", F.col(side).alias("node_id"), "class_id").distinct()
    lacking = nodes.select(*keys, "class_id").distinct().join(carried, [*keys, "class_id"], "left_anti").join(carried.select(*keys).distinct(), keys, "left_semi")
    off = edge_class_mismatch(nodes, flows, side).select(*keys, "class_id", "bin", F.abs(F.col("expected") - F.col("edges")).alias("amount"))
    both = off.unionByName(lacking.select(*keys, "class_id", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("double").alias("amount")))
    found = both.groupBy(keys).agg(
        F.count(F.when(F.col("bin").isNull(), 1)).alias("_lacking"), F.array_sort(F.collect_set(F.when(F.col("bin").isNotNull(), F.col("class_id")))).alias("_off"),
        F.array_sort(F.collect_set(F.when(F.col("bin").isNull(), F.col("class_id")))).alias("_none"), F.slice(F.array_sort(F.collect_set("bin")), 1, FIRST).alias("bins"), F.max("amount").alias("worst"),
    )
    part = "outgoing" if side == "source" else "incoming"
    return found.select(*keys, F.when(F.col("_lacking") > 0, "edge_class_partial_coverage").otherwise(f"edge_class_mismatch_{part}").alias("code"), F.when(F.size("_off") > 0, F.col("_off")).otherwise(F.col("_none")).alias("classes"), "bins", "worst")


def edge_rules(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Warnings of the graph: dead-letter queues that are not terminal, lags, dependencies without effort edges or, where
    nodes have the columns errors and attempts (whether the model gives them), with errors that no source attempts.

    Each edge meets both its ends once; what it says of them, and what a dependency says of itself, meets in one aggregate by
    node."""
    more = {"errors", "attempts"} <= set(nodes.columns)
    end = lambda side: nodes.select(F.col("node_id").alias(side), F.col("kind").alias(f"_{side}_kind"), (F.col("attempts") if more else F.lit(False)).alias(f"_{side}_attempts"))
    both = edges.join(end("target"), "target", "left").join(end("source"), "source", "left")
    effort, loose = F.col("type") == "effort", F.col("type") != "terminal"
    says = lambda holds, node, code: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.col(node).alias("node_id"), F.lit(code).alias("code")))
    of_edges = F.array_compact(F.array(
        says((F.col("_target_kind") == "dlq") & loose, "target", "dlq_non_terminal_inbound"), says((F.col("_source_kind") == "dlq") & loose, "source", "dlq_non_terminal_outbound"), says(F.col("lag") > 0, "source", "edge_behavior_violation_lag"),
        says((F.col("_target_kind") == "dependency") & effort, "target", "+effort"), says((F.col("_target_kind") == "dependency") & effort & F.col("_source_attempts"), "target", "+tried"),
    ))
    own = F.array(F.lit("+dependency"), F.when(F.col("errors") if more else F.lit(False), "+errors"))
    said = both.select(F.explode(of_edges).alias("w")).select("w.*").unionByName(nodes.where("kind = 'dependency'").select("node_id", F.explode(F.array_compact(own)).alias("code")))
    all_ = said.groupBy("node_id").agg(F.collect_set("code").alias("_c"))
    has = lambda x: F.array_contains("_c", x)
    codes = F.concat(
        F.filter("_c", lambda x: ~x.startswith("+")), F.when(has("+dependency") & ~has("+effort"), F.array(F.lit("dependency_missing_effort_edges"))).otherwise(F.array().cast("array<string>")),
        F.when(has("+errors") & has("+effort") & ~has("+tried"), F.array(F.lit("dependency_retry_pressure_missing"))).otherwise(F.array().cast("array<string>")),
    )
    return all_.select("node_id", F.explode(codes).alias("code"))


def gate_closed(nodes: DataFrame, period: int, phase: int = 0) -> DataFrame:
    """Bins at which a backlog waits behind a closed schedule (and those at which nothing is served though it is open)."""
    stuck = nodes.where((F.col("served") <= TOLERANCE) & (F.abs("queue_depth") > TOLERANCE))
    code = F.when(fires(F.col("bin"), period, phase), "queue_latency_unreported").otherwise("queue_latency_gate_closed")
    return _gathered(stuck.withColumn("code", code).withColumn("amount", F.abs("queue_depth")))


def mode_errors(nodes: DataFrame, required: list[str], mode: str = "simulation") -> DataFrame:
    """Required series that are absent or not numbers: errors of a simulation, warnings of telemetry."""
    bad = lambda c: F.max((F.col(c).isNull() | F.isnan(c)).cast("int"))
    there = [c for c in required if c in nodes.columns]
    seen = nodes.groupBy("node_id").agg(*[bad(c).alias(c) for c in there], F.lit(0).alias("_"))
    entries = [F.when(F.col(c) > 0, F.lit(f"invalid_{c}_series")) if c in there else F.lit(f"missing_{c}_series") for c in required]
    rows = seen.select("node_id", F.explode(F.array_compact(F.array(*entries))).alias("code"))
    return rows.withColumn("severity", F.lit("error" if mode == "simulation" else "warning"))


def constraint_errors(constraints: DataFrame) -> DataFrame:
    """Constraints (constraint_id, arrivals, served series ids) without one of their series."""
    codes = F.array_compact(F.array(F.when(F.col("arrivals").isNull(), "constraint_missing_arrivals"), F.when(F.col("served").isNull(), "constraint_missing_served")))
    return constraints.select("constraint_id", F.explode(codes).alias("code"))


def telemetry_gaps(series: DataFrame, bins: int) -> DataFrame:
    """Per series (series_id, bin, value): data gaps, values that are no numbers, and a wrong length."""
    endless = F.isnan("value") | (F.abs("value") == float("inf"))
    g = series.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("gaps"), F.sum(F.coalesce(endless, F.lit(False)).cast("long")).alias("nans"))
    one = lambda c, code, n: F.when(c, F.struct(F.lit(code).alias("code"), n.alias("n")))
    codes = F.array_compact(F.array(one(F.col("gaps") > 0, "data_gap", F.col("gaps")), one(F.col("nans") > 0, "nan_detected", F.col("nans")), one(F.col("n") != bins, "length_mismatch", F.col("n"))))
    return g.select("series_id", F.explode(codes).alias("w")).select("series_id", "w.*")


def telemetry_class_errors(totals: DataFrame, classes: DataFrame, declared: Sequence[str], supported: bool = True) -> DataFrame:
    """Rows (node_id, code, detail) of telemetry by class: totals (node_id, bin, value) and classes (node_id, class_id, bin, value).
    Classes without a total, nodes without classes or without a declared one, and the first bin at which the classes' sum is not the
    total (nulls and NaN are no samples; a millionth of the total is let pass). supported: whether the telemetry says that it has
    classes. What concerns all of it has no node_id. One aggregate by node and bin, one by node."""
    names = [c for c in dict.fromkeys(declared) if c and c.upper() != "DEFAULT"]
    sample = lambda x: F.when(F.col(x).isNotNull() & ~F.isnan(x), F.col(x))
    rows = totals.select("node_id", "bin", F.col("value").alias("total"), F.lit(None).cast("double").alias("part"), F.lit(None).cast("string").alias("class_id")).unionByName(classes.select("node_id", "bin", F.lit(None).cast("double").alias("total"), F.col("value").alias("part"), "class_id"))
    per_bin = rows.groupBy("node_id", "bin").agg(F.max(sample("total")).alias("total"), F.sum(sample("part")).alias("sum"), F.max(F.col("class_id").isNull()).alias("has_total"), F.collect_set("class_id").alias("ids"))
    off = F.abs(F.col("total") - F.col("sum")) > F.greatest(F.lit(1e-6), F.abs("total") * 1e-6)
    node = per_bin.groupBy("node_id").agg(F.max("has_total").alias("has_total"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.min(F.when(off, F.col("bin"))).alias("off"))
    one = lambda holds, code, detail: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))
    none, some = F.size("ids") == 0, F.size("ids") > 0
    codes = [one(~F.col("has_total"), "class_totals_missing", F.lit(None)), one(F.col("has_total") & none & F.lit(supported), "class_series_missing", F.lit(None)), one(F.col("has_total") & some & F.col("off").isNotNull(), "class_conservation_mismatch", F.col("off"))]
    codes += [one(F.col("has_total") & some & ~F.array_contains("ids", c), "class_series_partial", F.lit(c)) for c in names]
    found = node.select("node_id", F.explode(F.array_compact(F.array(*codes))).alias("w")).select(F.col("node_id").cast("string").alias("node_id"), "w.*")
    whole = rows.agg(F.count("class_id").alias("n")).select(F.lit(None).cast("string").alias("node_id"), F.explode(F.array_compact(F.array(one(F.lit(supported and not names), "class_manifest_missing", F.lit(None)), one(F.lit(supported) & (F.col("n") == 0), "class_data_missing", F.lit(None))))).alias("w"))
    return found.unionByName(whole.select("node_id", "w.*"))


def kernel_warnings(nodes: DataFrame, most: int = 32) -> DataFrame:
    """nodes (node_id, kernel array<double>): rows (node_id, code, detail) of retry kernels that are changed before use."""
    k = F.col("kernel")
    cut_ = F.slice(k, 1, most)
    fine = F.filter(cut_, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    total = F.aggregate(fine, F.lit(0.0), lambda a, x: a + x)
    notes = F.array_compact(F.array(F.when(F.size(k) > most, "trimmed"), F.when(F.size(fine) < F.size(cut_), "replaced"), F.when(total > 1, "scaled")))
    return nodes.select("node_id", F.lit("retry_kernel_policy").alias("code"), F.array_join(notes, ",").alias("detail")).where("detail <> ''")


def source_warnings(declared: DataFrame, found: DataFrame) -> DataFrame:
    """declared (node_id, series_id, source): rows (node_id, code, detail) of series without a source, or whose source is not
    among found (source)."""
    none = declared.where("source is null").select("node_id", F.lit("telemetry_sources_missing").alias("code"), F.col("series_id").alias("detail"))
    lost = declared.where("source is not null").join(found.select("source").distinct(), "source", "left_anti")
    return none.unionByName(lost.select("node_id", F.lit("telemetry_sources_unresolved").alias("code"), F.col("source").alias("detail")))


def missing_values(expected: DataFrame, series: DataFrame) -> DataFrame:
    """expected (node_id, series_id) without any value in series (series_id, bin, value): rows (node_id, code, detail)."""
    there = series.where("value is not null").select("series_id").distinct()
    return expected.join(there, "series_id", "left_anti").select("node_id", F.lit("value_series_missing").alias("code"), F.col("series_id").alias("detail"))
