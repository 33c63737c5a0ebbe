"""Training corpora for entity recognisers.

Examples are rows (tokens array<string>, ner array<struct<s,e,label>>) with
inclusive indices.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.text import value_metadata, words

# Strategies and corpus labels.
STRATEGY_LABELS = {
    "mask_name": "PERSON",
    "mask_email": "EMAIL",
    "mask_phone": "PHONE",
    "mask_date": "DATE",
    "mask_address": "ADDRESS",
    "mask_plate": "LICENSE_PLATE",
    "mask_id": "ID",
    "redact": "PII",
}
# Labels every example lists.
MENTION_LABELS = (
    "PERSON", "EMAIL", "PHONE", "DATE", "ADDRESS", "LICENSE_PLATE", "ID", "IBAN", "CONTRACT", "POLICY",
)
MAX_VALUES = 3


def _sentence(template: str, column: Column, value: Column) -> Column:
    slots = {"{column}": column, "{value}": value}
    return F.concat(*[slots.get(part, F.lit(part)) for part in re.split(r"(\{column\}|\{value\})", template) if part])


def find_run(tokens: Column, run: Column) -> Column:
    """First index at which ``run`` occurs in ``tokens``; NULL if it does not."""
    places = F.when(
        (F.size(tokens) >= F.size(run)) & (F.size(run) > 0),
        F.sequence(F.lit(0), F.size(tokens) - F.size(run)),
    )
    return F.get(
        F.filter(places, lambda i: F.slice(tokens, i + 1, F.size(run)) == run), F.lit(0)
    )


def ner_examples(columns: DataFrame, keys: Sequence[str], templates: Sequence[str]) -> DataFrame:
    """Column rows (column, strategy, values) to one example each.

    ``templates`` are the job's own sentences with ``{column}`` and ``{value}``. They are
    tried in order, and within one the first three values; the first value found in its
    sentence wins. Columns without a corpus label give nothing.
    """
    label = F.create_map(*[F.lit(x) for kv in STRATEGY_LABELS.items() for x in kv])[F.col("strategy")]
    labelled = columns.withColumn("label", label).where("label IS NOT NULL")
    tries = labelled.select(
        *keys, "label", "column", F.posexplode(F.slice("values", 1, MAX_VALUES)).alias("_v", "value")
    ).select(
        *keys, "label", "_v", "value",
        F.posexplode(F.array(*[_sentence(t, F.col("column"), F.col("value")) for t in templates])).alias("_t", "_text"),
    )
    tokens = tries.select(
        *keys, "label", "_v", "_t", words(F.col("_text")).alias("tokens"), words(F.col("value")).alias("_run")
    ).withColumn("s", find_run(F.col("tokens"), F.col("_run"))).where("s IS NOT NULL")
    best = tokens.groupBy(*keys).agg(
        F.min(F.struct("_t", "_v", "tokens", "s", (F.col("s") + F.size("_run") - 1).alias("e"), "label")).alias("_b")
    )
    return best.select(
        *keys,
        F.col("_b.tokens").alias("tokens"),
        F.array(F.struct(F.col("_b.s").alias("s"), F.col("_b.e").alias("e"), F.col("_b.label").alias("label"))).alias("ner"),
    )


def merge_corpora(*corpora: DataFrame) -> DataFrame:
    merged = corpora[0]
    for other in corpora[1:]:
        merged = merged.unionByName(other)
    return merged


def split_of(key: Column, buckets: int = 10) -> Column:
    """train or val (one bucket in ten), fixed by the key alone."""
    return F.when(F.pmod(key, F.lit(buckets)) == 0, "val").otherwise("train")


def train_val_split(examples: DataFrame, key: Column | None = None, *columns: str) -> DataFrame:
    by = key if key is not None else F.xxhash64(*(columns or examples.columns))
    return examples.withColumn("split", split_of(by))


def label_distribution(examples: DataFrame) -> DataFrame:
    """Mentions per label and per hundred examples, most frequent first."""
    per_label = (
        examples.select(F.explode("ner").alias("m"))
        .groupBy(F.coalesce(F.col("m.label"), F.lit("UNKNOWN")).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    total = examples.agg(F.count("*")).scalar()
    return per_label.select(
        "label", "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct")
    ).orderBy(F.desc("n"), "label")


def mention_lists(examples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Text and, for every corpus label, the list of its mentions (empty = negative)."""

    def of(label: str) -> Column:
        return F.transform(
            F.filter("ner", lambda m: m["label"] == label),
            lambda m: F.array_join(F.slice(F.col("tokens"), m["s"] + 1, m["e"] - m["s"] + 1), " "),
        )

    return examples.where(F.size("tokens") > 0).select(
        *keys,
        F.array_join("tokens", " ").alias("input"),
        F.struct(*[of(x).alias(x) for x in MENTION_LABELS]).alias("entities"),
    )


def classification_rows(examples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(column, value, label) of examples written as ``column: value``; first label only."""
    text = F.array_join("tokens", " ")
    return (
        examples.where(F.size("ner") > 0)
        .withColumn("_parts", F.split(text, ":", 2))
        .where(F.size("_parts") == 2)
        .select(
            *keys,
            F.trim(F.get("_parts", F.lit(0))).alias("column"),
            F.trim(F.get("_parts", F.lit(1))).alias("value"),
            F.get("ner", F.lit(0))["label"].alias("label"),
        )
    )


def classification_prompts(rows: DataFrame, instruction: str) -> DataFrame:
    """Prompt text of classification rows; ``instruction`` lists the allowed labels."""
    prompt = F.concat_ws("\n", F.lit(instruction), F.concat(F.lit("column: "), "column"), F.concat(F.lit("value: "), "value"))
    return rows.select("*", prompt.alias("prompt"), F.concat_ws(" ", prompt, F.col("label")).alias("text"))


def column_prompts(columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metadata prompt and target per column row (table, column, sql_type, values, strategy, confidence)."""
    meta = F.to_json(F.transform("values", value_metadata))
    prompt = F.concat(
        F.lit("Table: "), F.col("table"), F.lit("\nColumn: "), F.col("column"),
        F.lit("\nSQL type: "), F.col("sql_type"), F.lit("\nValue metadata: "), meta,
    )
    return columns.select(
        *keys, prompt.alias("prompt"), F.to_json(F.struct("strategy", "confidence")).alias("target")
    )


def read_examples(spark, path: str) -> DataFrame:
    """JSON lines {tokenized_text, ner: [[start, end, label]]}; blank lines are skipped."""
    raw = spark.read.schema("tokenized_text array<string>, ner array<array<string>>").json(path)
    return raw.select(
        F.col("tokenized_text").alias("tokens"),
        F.transform(
            "ner",
            lambda m: F.struct(m[0].cast("int").alias("s"), m[1].cast("int").alias("e"), m[2].alias("label")),
        ).alias("ner"),
    )


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON lines as read by ``read_examples``; mixed-type lists are written as text."""
    quoted = F.transform("tokens", lambda t: F.to_json(F.struct(t.alias("t"))))
    inner = F.transform(quoted, lambda j: F.substring(j, F.lit(6), F.length(j) - 6))
    spans = F.transform(
        "ner",
        lambda m: F.concat(
            F.lit("["), m["s"].cast("string"), F.lit(", "), m["e"].cast("string"), F.lit(', "'), m["label"], F.lit('"]')
        ),
    )
    line = F.concat(
        F.lit('{"tokenized_text": ['), F.array_join(inner, ", "), F.lit('], "ner": ['), F.array_join(spans, ", "), F.lit("]}")
    )
    examples.select(line.alias("value")).write.mode("errorifexists").text(path)
