"""Finding personal data in text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.patterns import DetectorConfig, find_spans, might_match, usable

SPAN_COLUMNS = ["start", "end", "value", "label", "source", "score", "prio"]
MODEL_SPANS = "start int, end int, value string, label string, score double"

# Model label names and the labels they are stored under.
MODEL_LABELS = {
    "person": "PERSONNE",
    "date": "DATE",
    "location": "LOCALISATION",
    "organization": "ORG",
    "avs number": "AVS",
    "iban": "IBAN",
    "phone number": "TEL",
    "email address": "EMAIL",
    "policy number": "POLICE",
    "contract number": "CONTRAT",
    "license plate": "PLAQUE",
    "vin": "VIN",
    "permis": "PERMIS",
}
MODEL_PRIORITY = 1_000

# text batches in, one list of (start, end, value, label, score) per text out
Model = Callable[[pd.Series], Iterator[list[tuple[int, int, str, str, float]]]]


def detect_entities(
    texts: DataFrame,
    keys: Sequence[str],
    text: str | Column = "text",
    config: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """One row per pattern match. Narrow: no shuffle, only keys and text are read."""
    column = F.col(text) if isinstance(text, str) else text
    patterns = config.patterns if config.patterns_enabled else ()
    spans = find_spans(column, patterns, config.active_labels)
    return (
        texts.where(might_match(column, usable(patterns, config.active_labels)))
        # outer: an inner explode would make Spark evaluate the spans a second time to
        # filter empty arrays, which the test above has done
        .select(*keys, F.explode_outer(spans).alias("_span"))
        .where("_span IS NOT NULL")
        .select(*keys, *[F.col(f"_span.{c}").alias(c) for c in SPAN_COLUMNS])
    )


def detect_with_model(
    texts: DataFrame,
    keys: Sequence[str],
    load_model: Callable[[], Model],
    text: str = "text",
    config: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """Spans from a user's model, run over Arrow batches; the model loads once per task."""
    source = texts.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.select(*keys).schema]
    names = list(keys)

    def run(batches):
        model = load_model()
        for batch in batches:
            rows = []
            for key, found in zip(batch[names].itertuples(index=False), model(batch["_text"])):
                rows.extend((*key, *span) for span in found)
            yield pd.DataFrame(rows, columns=[*names, "start", "end", "value", "label", "score"])

    label = F.coalesce(
        F.create_map(*[F.lit(x) for kv in MODEL_LABELS.items() for x in kv])[F.col("label")],
        F.col("label"),
    )
    return (
        source.mapInPandas(run, ", ".join(fields) + ", " + MODEL_SPANS)
        .withColumn("label", label)
        .where(F.col("score") >= config.model_threshold)
        .where(F.col("label").isin(*config.active_labels))
        # one-letter hits are model noise
        .where(F.length(F.trim("value")) >= 2)
        .withColumn("source", F.lit("model"))
        .withColumn("prio", F.lit(MODEL_PRIORITY))
        .select(*keys, *SPAN_COLUMNS)
    )


def dedupe_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per identical (start, end): patterns before models; overlaps stay."""
    rest = [c for c in SPAN_COLUMNS if c not in ("start", "end")]
    order = F.struct("prio", F.negative("score").alias("_s"), "label", "value", "source", "score")
    best = spans.groupBy(*keys, "start", "end").agg(F.min(order).alias("_b"))
    return best.select(*keys, "start", "end", *[F.col(f"_b.{c}").alias(c) for c in rest])


def entity_counts(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections per label as a map."""
    per_label = spans.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return per_label.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias(
            "entity_counts"
        )
    )


def source_counts(spans: DataFrame, keys: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Detections per source, one column each."""
    return spans.groupBy(*keys).agg(
        *[F.count_if(F.col("source") == s).alias(s) for s in sources],
        F.count("*").alias("total"),
    )
