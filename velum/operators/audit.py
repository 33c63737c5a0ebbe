"""Audit rows: hashes and counts, never text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.text import clip


def audit_rows(texts: DataFrame, findings: DataFrame, at: Column, text: str = "text", fmt: Column | None = None) -> DataFrame:
    """One row per masked text; texts without findings count too.

    ``texts`` (scope, doc_id, text), ``findings`` (scope, doc_id, value, label, source [, field]).
    """
    has_field = "field" in findings.columns
    keys = ["scope", "doc_id"]
    per = findings.groupBy(*keys, "label", "source").agg(F.count("*").alias("n"))
    by_label = per.groupBy(*keys, "label").agg(F.sum("n").alias("n"))
    maps = by_label.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("entity_counts")
    )
    by_source = per.groupBy(*keys, "source").agg(F.sum("n").alias("n"))
    sources = by_source.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources")
    )
    totals = findings.groupBy(*keys).agg(
        F.count_distinct("value").alias("token_count"),
        (F.count_distinct("field") if has_field else F.lit(None).cast("bigint")).alias("field_count"),
    )
    empty = F.create_map().cast("map<string,bigint>")
    return (
        texts.select(
            at.alias("at"), "scope", "doc_id",
            F.sha2(F.col("scope").cast("string"), 256).alias("user_hash"),
            F.sha2(F.col(text), 256).alias("text_hash"),
            (fmt if fmt is not None else F.lit("freetext")).alias("format"),
        )
        .join(maps, keys, "left")
        .join(sources, keys, "left")
        .join(totals, keys, "left")
        .select(
            "at", "user_hash", "text_hash",
            F.coalesce("entity_counts", empty).alias("entity_counts"),
            F.coalesce("sources", empty).alias("sources"),
            "format", "field_count",
            F.coalesce("token_count", F.lit(0)).alias("token_count"),
        )
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append to the audit table, one folder per day."""
    rows.withColumn("d", F.to_date("at")).write.mode("append").partitionBy("d").parquet(path)


def audit_rollup(rows: DataFrame, measure: str = "entity_counts", by: Sequence[str] = ("day", "format")) -> DataFrame:
    """Volume per day, format and label (or source)."""
    name = {"entity_counts": "label", "sources": "source"}[measure]
    return (
        rows.select(F.to_date("at").cast("string").alias("day"), "format", F.explode(measure).alias(name, "n"))
        .groupBy(*by, name)
        .agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    )


def audit_retention(rows: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Rows of the last ``days`` days; on a table partitioned by day this prunes folders."""
    day = F.col("d") if "d" in rows.columns else F.to_date("at")
    return rows.where(day >= F.date_sub(today, days))


def recent_detections(events: DataFrame, limit: int = 50, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Latest detections with the value cut for display."""
    return (
        events.orderBy(*[F.desc(c) for c in order])
        .limit(limit)
        .withColumn("value", clip(F.col("value")))
    )
