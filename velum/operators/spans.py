"""Conflicts between spans, and texts rebuilt once from the spans that are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions.hof import bind
from velum.operators.detect import SPAN_COLUMNS
from velum.operators.tokens import attach_entries


def _rank(span) -> list[Column]:
    """What is chosen first: the longest span, then detector priority, then the leftmost."""
    return [
        (span("start") - span("end")).alias("shorter"), span("prio").alias("prio"), span("start").alias("start"),
        (-span("score")).alias("weaker"), span("label").alias("label"), span("source").alias("source"), span("value").alias("value"),
    ]


def resolve_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of each text that do not overlap: the longest first, ties by priority, then from the left.

    Spans are cut into runs that overlap; one window over a text's spans finds them, and a
    choice is made inside a run only. Of equal spans one stays; empty spans go.
    """
    kept = spans.where(F.col("end") > F.col("start"))
    ordered = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start") < reach, 0).otherwise(1)
    runs = kept.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    span = F.struct(*_rank(F.col))
    whole = F.struct(*[F.col(c) for c in SPAN_COLUMNS])
    lists = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(span.alias("rank"), whole.alias("span")))).alias("_all"))

    def choose(chosen: Column, candidate: Column) -> Column:
        s = candidate["span"]
        clash = F.exists(chosen, lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"]))
        return F.when(clash, chosen).otherwise(F.array_append(chosen, s))

    shape = kept.select(F.array(whole).alias("a")).schema["a"].dataType
    chosen = F.when(F.size("_all") == 1, F.transform("_all", lambda c: c["span"])).otherwise(
        F.aggregate("_all", F.array().cast(shape), choose)
    )
    return lists.select(*keys, F.explode(chosen).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in SPAN_COLUMNS])


def rebuilt(text: Column, puts: Column) -> Column:
    """``text`` with each (start, end, put) of the sorted, disjoint ``puts`` replaced, in one pass."""

    def of(spans: Column) -> Column:
        stops = F.transform(spans, lambda s: s["end"])
        before = F.slice(F.concat(F.array(F.lit(0)), stops), F.lit(1), F.size(spans))
        parts = F.zip_with(
            spans, before,
            lambda s, at: F.when(s["start"] < at, F.raise_error(F.lit("spans overlap"))).otherwise(
                F.concat(F.substring(text, at + 1, s["start"] - at), F.coalesce(s["put"], F.lit("")))
            ),
        )
        end = F.element_at(stops, -1)
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(puts.isNull() | (F.size(puts) == 0), text).otherwise(bind(puts, of))


def rebuild_text(texts: DataFrame, puts: DataFrame, keys: Sequence[str], text: str = "text", touched: Column | None = None) -> DataFrame:
    """Texts with the pieces named by ``puts`` (keys, start, end, put) exchanged; positions count from 0.

    The spans of a text must not overlap (see ``resolve_spans``): the job stops where they do.
    """
    piece = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("put").alias("put"))
    lists = puts.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("_puts"))
    rows = attach_entries(texts, lists, keys, touched)
    return rows.withColumn(text, rebuilt(F.col(text), F.col("_puts"))).select(*texts.columns)
