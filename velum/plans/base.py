"""Registry of queries with their SQL twins, and inputs both sides derive alike.

The select lists below are valid in Spark SQL and in DuckDB, so one text defines an
input for both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from velum.functions.patterns import DEFAULT_LABELS, DEFAULT_PATTERNS, Pattern
from velum.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def derived(spark: SparkSession, root: str, source: str, select: str, where: str | None = None) -> DataFrame:
    """Columns of a table computed by one portable select list."""
    rows = table(spark, root, source)
    if where:
        rows = rows.where(where)
    name = f"_derived_{source}"
    rows.createOrReplaceTempView(name)
    return spark.sql(f"SELECT {select} FROM {name}")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_sql(rows: Iterable[tuple]) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def spans_sql(
    source: str, keys: str, text: str,
    patterns: Iterable[Pattern] = DEFAULT_PATTERNS, labels: Iterable[str] = DEFAULT_LABELS,
) -> str:
    """Every pattern match with its position, for DuckDB."""
    parts = []
    for prio, p in enumerate(patterns):
        if p.label not in set(labels):
            continue
        regex = quote(p.regex)
        parts.append(
            f"""SELECT {keys}, hits[i] AS value, '{p.label}' AS label, {p.score}::DOUBLE AS score,
            {prio} AS prio, 'pattern' AS source_,
            length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS start
            FROM (SELECT {keys}, regexp_extract_all({text}, {regex}) AS hits,
                         string_split_regex({text}, {regex}) AS gaps
                  FROM {source} WHERE regexp_matches({text}, {regex})) AS q,
                 unnest(range(1, len(hits) + 1)) AS u(i)"""
        )
    return "\nUNION ALL\n".join(parts)


def tokens_sql(findings: str) -> str:
    """Token map of a findings relation (scope, doc_id, ord, start, prio, value, label)."""
    return f"""SELECT scope, label, n, '[' || label || '_' || n || ']' AS token, value FROM (
        SELECT scope, value, label, row_number() OVER (
            PARTITION BY scope, label ORDER BY doc_id, ord, start, prio, value) AS n
        FROM (SELECT *, row_number() OVER (
                PARTITION BY scope, value ORDER BY doc_id, ord, start, prio, label) AS r
              FROM {findings}) WHERE r = 1)"""


def norm_sql(text: str) -> str:
    return (
        f"trim(regexp_replace(strip_accents(lower({text})), '[ \\-./\\t_]+', '_', 'g'), '_')"
    )


DOC_SPANS = spans_sql("documents", "doc_id, source", "text")
DOC_FINDINGS = f"""WITH found AS (SELECT source AS scope, doc_id, 1 AS ord, start, prio, value, label, score
FROM ({DOC_SPANS})),
tokens AS ({tokens_sql('found')})"""
DOC_MASKED = f"""{DOC_FINDINGS},
lists AS (SELECT doc_id, list({{'k': value, 'v': token}} ORDER BY length(value) DESC, value) AS e
  FROM (SELECT DISTINCT f.doc_id, f.value, t.token FROM found f
        JOIN tokens t ON t.scope = f.scope AND t.value = f.value) GROUP BY doc_id),
masked AS (SELECT d.doc_id, d.source, CASE WHEN e IS NULL THEN d.text
    ELSE list_reduce(e, lambda a, x: replace(a, x.k, x.v), d.text) END AS text
  FROM documents d LEFT JOIN lists USING (doc_id))"""
