"""Guarded read-only queries with masked results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words a read-only query may not hold, and its most rows.
WRITE_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "attach",
    "detach", "pragma", "vacuum", "replace", "reindex",
)
MAX_ROWS = 200

_WRITE = r"(?i)\b(" + "|".join(WRITE_WORDS) + r")\b"
_START = r"(?i)^\s*(select|with)\b"


def refusal(sql: str | None) -> str | None:
    """Why a query is refused; None if it may run."""
    if sql is None or not sql.strip():
        return "empty"
    if ";" in sql.strip().rstrip(";"):
        return "several statements"
    if not re.match(_START, sql):
        return "not a select"
    if re.search(_WRITE, sql):
        return "write word"
    return None


def refusal_column(sql: Column) -> Column:
    """The same check over a column of queries."""
    body = F.regexp_replace(F.trim(sql), r";+\z", "")
    return (
        F.when(sql.isNull() | ~sql.rlike(r"\S"), "empty")
        .when(body.contains(";"), "several statements")
        .when(~sql.rlike(_START), "not a select")
        .when(sql.rlike(_WRITE), "write word")
    )


def read_only(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of a checked query, at most ``max_rows`` (part of the tool's contract)."""
    reason = refusal(sql)
    if reason:
        raise PermissionError(reason)
    return spark.sql(sql.strip().rstrip(";")).limit(max_rows)


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines in column order, NULL as nothing."""
    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike(r'[",\r\n]'), quoted).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))
