"""Structured Streaming forms of binning and of the queue recurrence. The batch operators define what is right."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def binned_stream(events: DataFrame, by: str = "user_id", ts: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(by, start, arrivals, served) of closed bins; events later than the watermark are left out, and
    dropped_rows() counts them."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(by, F.window("_t", size).alias("w")).agg(
        F.sum((F.col("event_type") == "view").cast("double")).alias("arrivals"), F.sum((F.col("event_type") == "click").cast("double")).alias("served")
    ).select(by, F.col("w.start").alias("start"), "arrivals", "served")


def dropped_rows(query) -> int:
    """How many rows a running query has left out, as of its recent batches, because they came after the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def queue_stream(bins: DataFrame, by: str = "user_id") -> DataFrame:
    """Depth after each bin (by, bin, arrivals, served) of a stream whose bins come in order within a key across batches.

    State is the depth and the last bin per key; a bin that comes at or before the last one is left out, and counted: late
    is how many of the key have been so far."""
    schema = f"{by} long, bin long, queue double, late long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, q, late = state.get if state.exists else (-1, 0.0, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("bin").itertuples():
            if row.bin > last:
                last, q = int(row.bin), max(0.0, q + row.arrivals - row.served)
                out.append((key[0], last, q, late))
            else:
                late += 1
        state.update((last, q, late))
        yield pd.DataFrame(out, columns=[by, "bin", "queue", "late"])

    return bins.groupBy(by).applyInPandasWithState(run, schema, "last long, queue double, late long", "append", GroupStateTimeout.NoTimeout)
