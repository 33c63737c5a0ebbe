"""Semi-structured payload columns: fields out, labels, tokens, masked payload."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.flatten import flatten, open_nested, sql_fields
from velum.functions.formats import detect_format
from velum.functions.patterns import DetectorConfig, find_spans
from velum.functions.rewrite import ENTRIES, STATEMENT, replace_by_format, replace_outside_placeholders, splice_statements, with_blob_entries
from velum.operators.columns import Classifier, classify, column_profile
from velum.operators.kb import is_pii, with_labels
from velum.operators.sql_text import literals_of, sql_literals
from velum.operators.tokens import assign_tokens, required, tokens_for
from velum.session import spread, stage

# Arrays that are costly to build are exploded with the outer form: for an inner one
# Spark adds a filter on the array's size and builds it a second time for that.


def in_order(outer: str, inner: str) -> Column:
    """Two array positions as one number that sorts like them, for arrays of any size."""
    return F.shiftleft(F.col(outer).cast("bigint"), 31) + F.col(inner).cast("bigint")


# ---- readers ---------------------------------------------------------------


def format_profile(texts: DataFrame, text: str = "text") -> DataFrame:
    return (
        texts.select(detect_format(F.col(text)).alias("format"), F.length(text).alias("_len"))
        .groupBy("format")
        .agg(F.count("*").alias("n"), F.sum("_len").alias("chars"))
    )


def with_fields(payloads: DataFrame, text: str = "text", drop_empty: bool = True, statements: bool = False) -> DataFrame:
    """Add ``fmt``, ``fields`` and ``error``; free text is one field without a name.

    With ``statements`` literals of SQL are left to ``sql_literals``: ``sql`` holds the
    scripts and the statements inside free text.
    """
    whole = F.array(
        F.struct(F.lit(None).cast("string").alias("field"), F.col(text).alias("value"), F.lit("").alias("path"))
    )
    fmt, body = F.col("fmt"), F.col(text)
    rows = payloads.withColumn("fmt", detect_format(body))
    if statements:
        inside = F.when(body.rlike(STATEMENT), F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(0)))
        rows = rows.withColumn("sql", F.when(fmt == "sql", F.array(body)).when(fmt == "freetext", inside))
    return (
        rows.withColumn("_flat", flatten(F.when(fmt != "sql", fmt) if statements else fmt, body, drop_empty))
        .withColumn("error", F.col("_flat.error"))
        .withColumn("fields", F.when(F.col("error").isNull(), F.col("_flat.fields")))
        .withColumn(
            "fields",
            F.when(
                F.col("error").isNull() & (F.coalesce(F.size("fields"), F.lit(0)) == 0), whole
            ).otherwise(F.col("fields")),
        )
        .drop("_flat")
    )


def explode_fields(payloads: DataFrame, keys: list[str], text: str = "text", drop_empty: bool = True) -> DataFrame:
    """(keys, fmt, ord, field, value, path) of readable structured payloads."""
    return (
        with_fields(payloads, text, drop_empty)
        .select(*keys, "fmt", F.posexplode_outer("fields").alias("ord", "f"))
        .select(*keys, "fmt", F.col("ord").cast("bigint").alias("ord"), "f.*")
        .where(F.col("field").isNotNull())
    )


def explode_nested(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Open documents held in values, up to five levels; other values pass with depth 0."""
    return (
        fields.select(
            *keys, "ord",
            F.posexplode_outer(open_nested(F.col("field"), F.col("value"), F.col("path"))).alias("sub", "f"),
        )
        .select(*keys, "ord", F.col("sub").cast("bigint").alias("sub"), "f.*")
        .withColumn("depth", F.col("depth").cast("bigint"))
    )


def embedded_sql(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Statements inside prose, in order; leftmost wins, none overlap."""
    return texts.where(F.col(text).rlike(STATEMENT)).select(
        *keys,
        F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(STATEMENT), F.lit(0))).alias("ord", "sql"),
    )


def statement_findings(texts: DataFrame, kb: DataFrame) -> DataFrame:
    """Labelled literals of statements inside free text, as findings with ``ord`` 0."""
    statements = embedded_sql(texts, ["scope", "doc_id"]).withColumnRenamed("ord", "_s")
    literals = sql_literals(statements, ["scope", "doc_id", "_s"], "sql").where("field IS NOT NULL").select(
        "scope", "doc_id", "field", "value",
        # position in the text's run of literals: statement first, then literal
        in_order("_s", "ord").alias("start"),
        F.lit(None).cast("string").alias("db"), F.lit(None).cast("string").alias("table"),
    )
    return (
        with_labels(literals, kb)
        .where(is_pii(F.col("label")))
        .select(
            "scope", "doc_id", F.lit(0).alias("ord"), "start", F.lit(0).alias("prio"), "value", "label",
            F.concat(F.lit("kb_"), F.col("match")).alias("source"),
        )
    )


def structured_findings(texts: DataFrame, keys: list[str], kb: DataFrame) -> DataFrame:
    """Labelled fields of texts that are payloads, and literals of statements inside prose."""
    read = with_fields(texts.select(*keys, "text")).where("error IS NULL")
    literals = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(0)), lambda s: sql_fields(s)))
    fields = read.select(
        *keys, F.posexplode_outer(F.when(F.col("fmt") == "freetext", literals).otherwise(F.col("fields"))).alias("start", "f")
    ).where("f.field IS NOT NULL").select(
        *keys, "start", "f.field", "f.value",
        F.lit(None).cast("string").alias("db"), F.lit(None).cast("string").alias("table"),
    )
    return with_labels(fields, kb).where(is_pii(F.col("label"))).select(
        *keys, "start", F.lit(0).alias("prio"), "value", "label", F.concat(F.lit("kb_"), F.col("match")).alias("source")
    )


# ---- column views of one payload --------------------------------------------


def augment_columns(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a field in order, written as ``field: value`` joined by pipes."""
    return (
        fields.groupBy(*keys, "field")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("_v"))
        .select(
            *keys, "field",
            F.transform("_v", lambda v: v["value"]).alias("values"),
            F.array_join(
                F.transform("_v", lambda v: F.concat(F.col("field"), F.lit(": "), v["value"])), " | "
            ).alias("augmented"),
        )
    )


def column_entities(
    fields: DataFrame, keys: list[str], config: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """Entities of a payload's column that occur in one of its values."""
    columns = augment_columns(fields, keys)
    spans = find_spans(F.col("augmented"), config.patterns, config.active_labels)
    return (
        columns.select(*keys, "field", "values", F.explode_outer(spans).alias("s"))
        .where("s IS NOT NULL")
        .where(F.exists("values", lambda v: F.contains(v, F.col("s.value"))))
        .select(*keys, "field", F.col("s.value").alias("value"), F.col("s.label").alias("label"))
        .distinct()
    )


def unresolved_values(fields: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Field values that hold no entity of their column."""
    per_column = entities.groupBy(*keys, "field").agg(F.collect_set("value").alias("_found"))
    return (
        fields.join(per_column, [*keys, "field"], "left")
        .where(
            F.col("_found").isNull()
            | ~F.exists("_found", lambda e: F.contains(F.col("value"), e))
        )
        .drop("_found")
    )


# ---- the whole job -----------------------------------------------------------


class MaskedPayloads(NamedTuple):
    rows: DataFrame
    quarantine: DataFrame
    token_map: DataFrame
    findings: DataFrame
    suggestions: DataFrame


def check_quarantine(rows: DataFrame, quarantine: DataFrame, limit: float) -> None:
    """Fail closed when too large a share of the payloads could not be read."""
    bad, good = quarantine.count(), rows.count()
    if bad > limit * max(bad + good, 1):
        raise RuntimeError(f"{bad} of {bad + good} payloads in quarantine")


def mask_payloads(
    payloads: DataFrame,
    kb: DataFrame,
    key: str = "doc_id",
    scope: str = "scope",
    text: str = "text",
    db: str | None = None,
    table: str | None = None,
    config: DetectorConfig = DetectorConfig(),
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
    drop_empty: bool = True,
    classifier: Classifier = classify,
) -> MaskedPayloads:
    """Mask JSON, XML, CSV, pipe-table, SQL and free-text payloads.

    Known headers give whole values their label, with a pattern pass for headers
    known as not personal; other values go through detection; values without any
    detection go to the column classifier, one profile per header. Payloads that
    cannot be read leave as (key, reason) without their text.
    """
    null = F.lit(None).cast("string")
    source = payloads.select(
        required(scope).alias("scope"), required(key).alias("doc_id"), F.col(text).alias("text"),
        (F.col(db) if db else null).alias("db"), (F.col(table) if table else null).alias("table"),
    )
    read = with_fields(spread(source), "text", drop_empty, statements=True).drop("text")
    read = stage(read, "payload-fields")
    own = ["scope", "doc_id", "db", "table", "fmt"]
    flat = read.select(*own, F.posexplode("fields").alias("_p", "f")).select(*own, "_p", "f.field", "f.value", "f.path")
    # literals of scripts and of statements inside prose, after the text itself
    said = read.where("sql IS NOT NULL").select(*own, F.posexplode_outer(literals_of(F.col("sql"))).alias("_p", "f")).where("_p IS NOT NULL")
    flat = flat.where("fmt <> 'sql'").unionByName(said.select(*own, (F.col("_p") + 1).alias("_p"), "f.field", "f.value", "f.path"))
    fields = flat.select(
        *own, "_p", F.col("value").alias("_outer"),
        F.posexplode_outer(open_nested(F.col("field"), F.col("value"), F.col("path"))).alias("_s", "f"),
    ).select(
        *own, "_outer",
        # all leaves in document order: outer position, then position inside
        in_order("_p", "_s").alias("ord"), "f.*",
    )
    fields = stage(fields, "leaves")
    columns = ["field", "db", "table"]
    labelled = with_labels(fields, kb)

    known = is_pii(F.col("label"))
    whole = F.array(
        F.struct(
            F.lit(0).alias("start"), F.lit(0).alias("prio"), F.col("value").alias("value"),
            F.col("label").alias("label"), F.concat(F.lit("kb_"), F.col("match")).alias("source"),
        )
    )
    spans = F.transform(
        find_spans(F.col("value"), config.patterns, config.active_labels),
        lambda s: F.struct(
            s["start"].alias("start"), s["prio"].alias("prio"), s["value"].alias("value"), s["label"].alias("label"),
            F.when(F.col("label").isNotNull(), "pattern_safety").otherwise(s["source"]).alias("source"),
        ),
    )
    looked = stage(labelled.withColumn("hits", F.when(known, whole).otherwise(spans)), "hits")
    hits = looked.select("scope", "doc_id", "ord", "field", F.explode("hits").alias("h")).select(
        "scope", "doc_id", "ord", "field", "h.*"
    )
    open_values = looked.where("label IS NULL AND field IS NOT NULL AND size(hits) = 0 AND value IS NOT NULL")
    suggestions = classifier(
        column_profile(open_values, columns, "value").withColumn("column", F.col("field"))
    ).where("label IS NOT NULL")
    suggestions = stage(suggestions, "suggestions")
    findings = hits
    if config.classifier_enabled:
        named = suggestions.select(*[F.col(c).alias(f"_{c}") for c in columns], F.col("label").alias("_label"))
        guessed = open_values.join(
            named,
            (F.col("field") == F.col("_field"))
            & F.col("db").eqNullSafe(F.col("_db"))
            & F.col("table").eqNullSafe(F.col("_table")),
        ).select(
            "scope", "doc_id", "ord", "field", F.lit(0).alias("start"), F.lit(0).alias("prio"), "value",
            F.col("_label").alias("label"), F.lit("classifier").alias("source"),
        )
        findings = hits.unionByName(guessed)
    findings = stage(findings.where(r"value RLIKE '(?U)\\S'"), "findings")

    new = assign_tokens(findings, existing, high_water)
    token_map = new if existing is None else new.unionByName(existing.select(*new.columns))
    pair = F.struct(F.col("value").alias("key"), F.col("token").alias("value"))
    entries = tokens_for(findings, token_map).groupBy("scope", "doc_id").agg(
        F.collect_set(pair).cast(ENTRIES).alias("entries"),
        # in free text a literal is replaced in its statement, other values anywhere
        F.collect_set(F.when(F.col("field").isNotNull(), pair)).cast(ENTRIES).alias("literals"),
        F.collect_set(F.when(F.col("field").isNull(), pair)).cast(ENTRIES).alias("spans"),
    )
    blobs = (
        fields.where("depth > 0 AND fmt IN ('sql', 'csv', 'table')")
        .groupBy("scope", "doc_id")
        .agg(F.collect_set("_outer").alias("blobs"))
    )
    nameless = F.get("fields", F.lit(0))["field"].isNull() & (F.col("fmt") != "sql")
    fmt = F.when(nameless, "freetext").otherwise(F.col("fmt"))
    good = (
        read.groupBy("scope", "doc_id")
        .agg(F.count("*").alias("_n"), F.max("error").alias("error"), F.min(fmt).alias("fmt"))
        # two payloads of one key could not be told apart
        .where(F.when(F.col("_n") > 1, F.raise_error(F.lit("key repeated in a scope"))).otherwise(F.col("error").isNull()))
        .drop("_n", "error")
        .join(entries, ["scope", "doc_id"], "left")
        .join(blobs, ["scope", "doc_id"], "left")
        .withColumn("entries", with_blob_entries(F.col("blobs"), F.col("entries")))
        .drop("blobs")
        .withColumnRenamed("scope", "_scope")
    )
    rows = (
        payloads.withColumn("_scope", F.col(scope)).withColumnsRenamed({key: "doc_id", text: "text"})
        .join(good, ["_scope", "doc_id"])
        .withColumn("text", F.when(
            F.col("fmt") == "freetext",
            replace_outside_placeholders(splice_statements(F.col("text"), F.col("literals")), F.col("spans")),
        ).otherwise(replace_by_format(F.col("fmt"), F.col("text"), F.col("entries"))))
        .withColumnsRenamed({"doc_id": key, "text": text})
        .select(*payloads.columns, "fmt")
    )
    quarantine = read.where("error IS NOT NULL").select(F.col("doc_id").alias(key), "scope", F.col("error").alias("reason"))
    return MaskedPayloads(rows, quarantine, new, findings, suggestions)
