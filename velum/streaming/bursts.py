"""Bursts of detection events: sessions with a gap limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: events further apart than this start a new burst.
GAP = "2500 milliseconds"


def event_bursts(
    events: DataFrame, ts: Column, kinds: Sequence[str], kind: str = "source",
    gap: str = GAP, by: Sequence[str] = (), field: str | None = None, delay: str | None = None,
) -> DataFrame:
    """One row per burst: first and last event, count per kind, fields met, total.

    Works on tables and, with ``delay`` as watermark, on streams; streams need a key
    in ``by`` (the scope), which also keeps one busy table off a single task.
    """
    timed = events.withColumn("_ts", ts.cast("timestamp"))
    if delay:
        timed = timed.withWatermark("_ts", delay)
    session = F.session_window("_ts", gap)
    sums = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    if field:
        sums.append(F.array_sort(F.collect_set(field)).alias("fields"))
    return (
        timed.groupBy(session.alias("_w"), *by)
        .agg(F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"), *sums, F.count("*").alias("total"))
        .drop("_w")
    )
