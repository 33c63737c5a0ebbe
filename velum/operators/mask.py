"""Masking free-text columns and table columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.patterns import DetectorConfig, might_match
from velum.functions.rewrite import (
    ENTRIES,
    STATEMENT,
    replace_in_sequence,
    replace_outside_placeholders,
    replace_values,
    splice_statements,
)
from velum.functions.text import PLACEHOLDER, placeholders
from velum.operators.detect import dedupe_spans, detect_entities
from velum.operators.payloads import statement_findings
from velum.operators.spans import rebuild_text, resolve_spans
from velum.operators.tokens import (
    assign_tokens,
    attach_entries,
    required,
    tokens_for,
)
from velum.session import stage


class Masked(NamedTuple):
    """``rows`` with masked text, the new part of the token map, and what was found."""

    rows: DataFrame
    token_map: DataFrame
    findings: DataFrame


STAND_IN = "\ue020"


def hide_placeholders(text: Column) -> Column:
    """Text for detectors: earlier tokens become signs no detector matches, as many as they are long,
    so that positions hold in the text itself."""
    hidden = F.zip_with(
        F.split(text, PLACEHOLDER, -1), placeholders(text),
        lambda gap, p: F.concat(gap, F.coalesce(F.repeat(F.lit(STAND_IN), F.length(p)), F.lit(""))),
    )
    return F.when(text.rlike(PLACEHOLDER), F.array_join(hidden, "")).otherwise(text)


def token_findings(findings: DataFrame, existing: DataFrame | None, high_water: DataFrame | None):
    new = assign_tokens(findings, existing, high_water)
    known = new if existing is None else new.unionByName(existing.select(*new.columns))
    return new, known


def mask_documents(
    docs: DataFrame,
    scope: str,
    key: str = "doc_id",
    text: str = "text",
    config: DetectorConfig = DetectorConfig(),
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
    kb: DataFrame | None = None,
    model_spans: DataFrame | None = None,
    chained: bool = False,
    keep_placeholders: bool = False,
    by_position: bool = False,
) -> Masked:
    """Mask a free-text column.

    Detection runs once and its (small) result is staged; texts without a match are
    neither joined nor shuffled. ``kb`` turns on the pass over embedded statements;
    ``model_spans`` adds spans from ``detect_with_model``; ``chained`` is plain
    one-after-the-other replacement. A span that two detectors meet counts once.

    By default a found value is replaced wherever its text holds it. ``by_position``
    resolves overlapping spans and replaces those places only; texts are rebuilt once.
    """
    if by_position and (kb is not None or chained):
        raise ValueError("by_position reads no statements and replaces no values in a row")
    source = docs.select(required(scope).alias("scope"), required(key).alias("doc_id"), F.col(text).alias("text"))
    body = hide_placeholders(F.col("text")) if keep_placeholders else F.col("text")
    keys = ["scope", "doc_id"]
    found = detect_entities(source, keys, body, config)
    if model_spans is not None:
        found = found.unionByName(model_spans)
    if by_position:
        found = resolve_spans(found, keys)
    elif model_spans is not None:
        found = dedupe_spans(found, keys)
    found = found.withColumn("ord", F.lit(1))
    if kb is not None:
        found = found.unionByName(statement_findings(source, kb), allowMissingColumns=True)
    found = stage(found, "findings")
    new, known = token_findings(found, existing, high_water)

    if by_position:
        puts = tokens_for(found, known).select(F.col("scope").alias("_scope"), "doc_id", "start", "end", F.col("token").alias("put"))
        renamed = docs.withColumn("_scope", F.col(scope)).withColumnsRenamed({key: "doc_id", text: "text"})
        touched = might_match(body, config.patterns) if model_spans is None else None
        rows = rebuild_text(renamed, puts, ["_scope", "doc_id"], touched=touched)
        return Masked(rows.withColumnsRenamed({"doc_id": key, "text": text}).select(*docs.columns), new, found)
    pairs = tokens_for(found, known).select("scope", "doc_id", "ord", "value", "token")
    touched = None
    if model_spans is None:
        touched = might_match(body, config.patterns)
        if kb is not None:
            touched = touched | F.coalesce(F.col("text").rlike(STATEMENT), F.lit(False))
    # ids may repeat over scopes, so lists belong to (scope, id)
    renamed = docs.withColumn("_scope", F.col(scope)).withColumnsRenamed({key: "doc_id", text: "text"})
    pair = F.struct(F.col("value").alias("key"), F.col("token").alias("value"))
    lists = pairs.groupBy(F.col("scope").alias("_scope"), "doc_id").agg(
        F.collect_set(F.when(F.col("ord") == 1, pair)).cast(ENTRIES).alias("entries"),
        F.collect_set(F.when(F.col("ord") == 0, pair)).cast(ENTRIES).alias("literals"),
    )
    rows = attach_entries(renamed, lists, ["_scope", "doc_id"], touched)
    masked_text = F.col("text") if kb is None else splice_statements(F.col("text"), F.col("literals"))
    swap = (
        replace_in_sequence
        if chained
        else replace_outside_placeholders if keep_placeholders or kb is not None else replace_values
    )
    rows = (
        rows.withColumn("text", F.when(F.col("entries").isNull(), masked_text).otherwise(swap(masked_text, F.col("entries"))))
        .drop("entries", "literals")
        .withColumnsRenamed({"doc_id": key, "text": text})
        .select(*docs.columns)
    )
    return Masked(rows, new, found)


def mask_columns(
    df: DataFrame,
    key: str,
    scope: str,
    labels: dict[str, str],
    detect_in: Sequence[str] = (),
    config: DetectorConfig = DetectorConfig(),
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
) -> Masked:
    """Mask whole values of labelled columns and detected values of ``detect_in`` columns.

    A cell of a labelled column is always replaced as a whole, so no pattern pass is
    needed on it.
    """
    order = {c: i for i, c in enumerate([*labels, *detect_in])}
    base = df.select(
        required(scope).alias("scope"), required(key).alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in order]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(order[c]).alias("ord"), F.lit(c).alias("field"), F.lit(lb).alias("label"), F.col(c).alias("value")
            )
            for c, lb in labels.items()
        ]
    )
    findings = (
        base.select("scope", "doc_id", F.explode(cells).alias("c"))
        .select("scope", "doc_id", "c.*")
        .where(F.col("value").rlike(r"(?U)\S"))
        .withColumns({"start": F.lit(0), "prio": F.lit(0), "source": F.lit("kb_exact")})
    )
    for column in detect_in:
        spans = detect_entities(base, ["scope", "doc_id"], column, config)
        findings = findings.unionByName(
            spans.select("scope", "doc_id", "label", "value", "start", "prio", "source")
            .withColumns({"ord": F.lit(order[column]), "field": F.lit(column)})
        )
    findings = stage(findings, "cells")
    new, known = token_findings(findings, existing, high_water)

    tokens = tokens_for(findings, known)
    own = {c: F.when(F.col("field") == c, F.col("token")) for c in labels}
    per_row = tokens.groupBy(F.col("scope").alias("_of_scope"), F.col("doc_id").alias("_of_key")).agg(
        *[
            # two rows of one key could not be told apart
            F.when(F.count(own[c]) > 1, F.raise_error(F.lit("key repeated in a scope"))).otherwise(F.max(own[c])).alias(f"_t_{i}")
            for i, c in enumerate(labels)
        ],
        *[
            F.collect_set(
                F.when(F.col("field") == c, F.struct(F.col("value").alias("key"), F.col("token").alias("value")))
            ).alias(f"_d_{i}")
            for i, c in enumerate(detect_in)
        ],
    )
    rows = df.join(per_row, (df[scope] == per_row["_of_scope"]) & (df[key] == per_row["_of_key"]), "left")
    changed = {c: F.coalesce(F.col(f"_t_{i}"), F.col(c).cast("string")) for i, c in enumerate(labels)}
    changed |= {c: replace_values(F.col(c).cast("string"), F.col(f"_d_{i}")) for i, c in enumerate(detect_in)}
    rows = rows.withColumns(changed).select(*df.columns)
    return Masked(rows, new, findings)
