"""Derived metrics of a node and bin. This layer has nulls: a metric that is not defined is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import col, is_finite, safe_div

SLA_RATIO = 0.95
DEFAULT_KERNEL = (0.0, 0.6, 0.3, 0.1)


def effective_capacity(capacity, parallelism=None) -> Column:
    capacity = col(capacity)
    if parallelism is None:
        return capacity
    p = col(parallelism)
    return capacity * F.when(is_finite(p) & (p > 0), p).otherwise(1.0)


def utilization(served, capacity) -> Column:
    return F.when(col(capacity) > 0, col(served) / col(capacity))


def queue_time_ms(queue, served, bin_ms) -> Column:
    return F.when(col(served) > 0, col(queue) / col(served) * col(bin_ms))


def latency_minutes(queue, served, bin_ms) -> Column:
    """Little's law."""
    return queue_time_ms(queue, served, bin_ms) / 60000


def service_time_ms(processing_ms, count) -> Column:
    return F.when(col(count) > 0, col(processing_ms) / col(count))


def cycle_time_ms(queue_ms: Column, service_ms: Column) -> Column:
    return F.when(queue_ms.isNotNull() | service_ms.isNotNull(), F.coalesce(queue_ms, F.lit(0.0)) + F.coalesce(service_ms, F.lit(0.0)))


def flow_efficiency(service_ms: Column, cycle_ms: Column) -> Column:
    return F.when(cycle_ms > 0, service_ms / cycle_ms)


def throughput_ratio(served, arrivals) -> Column:
    return F.when(col(arrivals) != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(served) / col(arrivals))))


def retry_tax(attempts, served) -> Column:
    return F.when(col(attempts) > 0, F.greatest(F.lit(0.0), (col(attempts) - col(served)) / col(attempts)))


def attempts(given, served, failures, errors) -> Column:
    return F.coalesce(col(given), col(served) + F.coalesce(col(failures), col(errors)))


def kingman_wait(rho, ca, cs, service) -> Column:
    """E[Wq] of G/G/1; null unless 0 < rho < 1 and the service time is positive."""
    rho, ca, cs, service = map(col, (rho, ca, cs, service))
    return F.when((rho > 0) & (rho < 1) & (service > 0), rho / (1 - rho) * (ca * ca + cs * cs) / 2 * service)


def cv(x: Column) -> Column:
    """Aggregate: population deviation over mean; 0 for one value or a zero mean."""
    return F.when((F.count(x) > 1) & (F.avg(x) != 0), F.stddev_pop(x) / F.abs(F.avg(x))).otherwise(0.0)


def filled(served, capacity, queue, bin_ms, processing_ms, count) -> dict[str, Column]:
    """The evaluator's own derived columns, which are 0 where the metric is null."""
    q = safe_div(queue, served) * col(bin_ms)
    s = safe_div(processing_ms, count)
    return {"utilization": safe_div(served, capacity), "queue_time_ms": q, "latency_min": q / 60000, "service_time_ms": s, "cycle_time_ms": q + s, "flow_efficiency": safe_div(s, q + s)}


def load_colour(utilization: Column) -> Column:
    return F.when(utilization.isNull(), "gray").when(utilization < 0.7, "green").when(utilization < 0.9, "yellow").otherwise("red")


def queue_colour(latency: Column, sla: Column | float) -> Column:
    return F.when(latency.isNull(), "gray").when(latency <= col(sla), "green").when(latency <= 1.5 * col(sla), "yellow").otherwise("red")


def gate_status(scheduled: Column, open_: Column, queue, served) -> Column:
    return F.when(scheduled & ~open_ & (col(queue) > 0) & (col(served) <= 0), "paused_gate_closed")


def sla_met(served, arrivals) -> Column:
    """1 where a bin serves at least SLA_RATIO of its arrivals; a bin without arrivals does."""
    ratio = F.when(col(arrivals) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe_div(served, arrivals)))).otherwise(1.0)
    return F.when(ratio >= SLA_RATIO, 1.0).otherwise(0.0)


def schedule_adherence(served, open_: Column) -> Column:
    """1 or 0 at a schedule's bins, by whether anything is served there; null at others."""
    return F.when(open_, F.when(col(served) > 0, 1.0).otherwise(0.0))


def sla_status(kind: str, x: Column) -> Column:
    """Aggregate: the status of an SLA's series. The age of a backlog cannot be told from depths, so it is unavailable."""
    return F.lit("unavailable") if kind == "backlogAge" else F.when(F.count(x) > 0, "ok").otherwise("noEvents")


def shortfall(arrivals, served) -> Column:
    return F.greatest(F.lit(0.0), col(arrivals) - col(served))


def limited(allocated, demand) -> Column:
    return F.when(col(allocated) + 1e-6 < col(demand), 1).otherwise(0)


def retry_kernel(given: list[float] | None) -> tuple[list[float], list[str]]:
    """A kernel that is safe to convolve with, and what was changed: at most 32 terms, none negative, sum at most 1."""
    if not given:
        return list(DEFAULT_KERNEL), ["default"]
    notes, k = [], list(map(float, given))
    if len(k) > 32:
        k, notes = k[:32], [*notes, "trimmed"]
    clean = [x if x == x and 0 <= x < float("inf") else 0.0 for x in k]
    if clean != k:
        notes.append("replaced")
    total = sum(clean)
    if total > 1:
        clean, notes = [x / total for x in clean], [*notes, "scaled"]
    return clean, notes
