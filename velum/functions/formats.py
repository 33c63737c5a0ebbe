"""Which format a payload text has."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.flatten import parse_xml
from velum.functions.text import strip

# Statement shapes that count as SQL: the word alone is not enough ("select a seat").
SQL_SHAPES = (
    r"insert\s+into\s+\S+",
    r"update\s+\S+\s+set\s+\S+\s*=",
    r"delete\s+from\s+\S+",
    r"select\s+(?:[^;]*?\sfrom\s+\S+|\*|[0-9'(][^;]*$)",
)
SQL_START = r"(?is)^(?:\s++|--[^\n]*+(?:\n|\z)|/\*.*?\*/)*+(?:" + "|".join(SQL_SHAPES) + ")"


@F.pandas_udf(T.BooleanType())
def _well_formed_xml(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and parse_xml(t) is not None)


def lines_of(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(text, r"\r\n|[\n\r]", -1), lambda line: line.rlike(r"(?U)\S"))


def looks_like_sql(text: Column) -> Column:
    return text.rlike(SQL_START)


def detect_format(text: Column, check_xml: bool = True) -> Column:
    """sql, xml, json, table, csv or freetext, first rule that holds.

    ``check_xml`` runs the well-formedness test, which only texts that start with
    ``<`` reach with a value.
    """
    body = strip(text)
    lines = lines_of(body)
    opens_xml = body.startswith("<")
    xml = opens_xml & _well_formed_xml(F.when(opens_xml, body)) if check_xml else opens_xml
    piped = F.size(F.filter(F.slice(lines, 1, 3), lambda line: line.contains("|")))
    commas = F.transform(
        F.slice(lines, 1, 5),
        lambda line: F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))),
    )
    return (
        F.when(looks_like_sql(body), "sql")
        .when(xml, "xml")
        .when(body.startswith("{") | body.startswith("["), "json")
        .when((F.size(lines) >= 2) & (piped >= 2), "table")
        .when(
            (F.size(lines) >= 2)
            & (F.size(F.array_distinct(commas)) == 1)
            & (F.get(commas, F.lit(0)) >= 2),
            "csv",
        )
        .otherwise("freetext")
    )
