"""Payload texts to arrays of (field, value, path)."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.hof import bind

FIELD = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)
FIELDS = T.ArrayType(FIELD)
FLAT = T.StructType(
    [T.StructField("fields", FIELDS), T.StructField("error", T.StringType())]
)


# ---- markdown tables: native ---------------------------------------------


def _cells(line: Column, drop_empty: bool) -> Column:
    inner = line if drop_empty else F.regexp_replace(line, r"(?U)^\s*\||\|\s*\z", "")
    cells = F.transform(
        F.split(inner, r"\|", -1), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    )
    return F.filter(cells, lambda c: c != "") if drop_empty else cells


def table_fields(text: Column, drop_empty: bool = True) -> Column:
    """Cells of a pipe table under their headers; blank and rule lines are dropped.

    ``drop_empty`` takes empty cells out before they are matched to headers by
    position; without it, cells keep their column.
    """
    lines = F.filter(
        F.split(text, r"\r\n|[\n\r]", -1),
        lambda line: line.rlike(r"(?U)\S") & line.rlike(r"[^|\-: \t]"),
    )
    rows = F.transform(lines, lambda line: _cells(line, drop_empty))

    def row_fields(acc: Column, row: Column) -> Column:
        cells = F.zip_with(
            F.slice(acc["head"], F.lit(1), F.size(row)),
            row,
            lambda h, c: F.struct(
                h.alias("field"),
                c.alias("value"),
                F.concat(F.lit("row"), acc["n"].cast("string"), F.lit("."), h).alias("path"),
            ),
        )
        kept = F.filter(cells, lambda c: c["field"].isNotNull() & (F.coalesce(c["value"], F.lit("")) != ""))
        return F.struct(
            acc["head"].alias("head"),
            (acc["n"] + F.when(F.size(row) > 0, 1).otherwise(0)).alias("n"),
            F.array_append(acc["out"], kept).alias("out"),
        )

    return F.aggregate(
        F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))),
        F.struct(
            F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")).alias("head"),
            F.lit(0).alias("n"),
            F.array().cast(T.ArrayType(FIELDS)).alias("out"),
        ),
        row_fields,
        lambda acc: F.flatten(acc["out"]),
    )


# ---- SQL statements: native, on quoted literals and VALUES lists ------------

_STRING = r"'[^']*+(?:''[^']*+)*'"
# What stands between semicolons that are in no string.
_STATEMENT = r"(?:[^;']++|'[^']*+'|')++"
_NUMBER = r"[0-9]+(?:\.[0-9]+)?"
_TUPLE = rf"\((?:[^()']|{_STRING}|\((?:[^()']|{_STRING})*\))*\)"
_INSERT = rf"(?is)^\s*insert\s+into\s+[^\s(]+\s*(?:\(([^)]*)\))?\s*values\s*({_TUPLE}(?:\s*,\s*{_TUPLE})*)"
_ELEMENT = rf"(?:[^,()']|{_STRING}|\((?:[^()']|{_STRING})*\))+"
_COLUMN = r'(?:[A-Za-z_]\w*\s*\.\s*)*"?([A-Za-z_]\w*)"?'
_BOUND = (
    rf"(?i){_COLUMN}\s*(?:<>|!=|<=|>=|=|<|>|\b(?:not\s+)?i?like\b)\s*({_STRING}|{_NUMBER}(?![\w.]))"
    rf"|{_COLUMN}\s+(?:not\s+)?in\s*\(\s*((?:{_STRING}|{_NUMBER})(?:\s*,\s*(?:{_STRING}|{_NUMBER}))*)\s*\)"
    rf"|({_STRING})"
)


def _unquote(literal: Column) -> Column:
    return F.when(
        literal.startswith("'"),
        F.replace(F.substring(literal, F.lit(2), F.length(literal) - 2), F.lit("''"), F.lit("'")),
    ).otherwise(literal)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _insert_fields(sql: Column) -> Column:
    names = F.transform(
        F.filter(
            F.split(F.regexp_extract(sql, _INSERT, 1), ",", -1), lambda c: c.rlike(r"\S")
        ),
        lambda c: F.regexp_replace(_trim(c), r'^["`]|["`]\z', ""),
    )
    tuples = F.regexp_extract_all(F.regexp_extract(sql, _INSERT, 2), F.lit(_TUPLE), F.lit(0))
    literal = rf"^(?:{_STRING}|[0-9]+(?:\.[0-9]+)?)\z"

    def of_tuple(row: Column, r: Column, columns: Column) -> Column:
        items = F.regexp_extract_all(
            F.substring(row, F.lit(2), F.length(row) - 2), F.lit(_ELEMENT), F.lit(0)
        )
        cells = F.transform(
            items,
            lambda item, c: F.struct(
                F.coalesce(F.get(columns, c), F.concat(F.lit("col"), c.cast("string"))).alias("field"),
                _trim(item).alias("value"),
                F.concat(F.lit("ins"), r.cast("string"), F.lit("."), c.cast("string")).alias("path"),
            ),
        )
        return F.transform(
            F.filter(cells, lambda f: f["value"].rlike(literal)),
            lambda f: F.struct(f["field"], _unquote(f["value"]).alias("value"), f["path"]),
        )

    return bind(
        names,
        lambda columns: F.flatten(F.transform(tuples, lambda row, r: of_tuple(row, r, columns))),
    )


def _bound_fields(sql: Column) -> Column:
    """Literals next to a comparison carry its column; other strings carry ``valeur``."""

    def of_match(match: Column) -> Column:
        part = lambda i: F.regexp_extract(match, _BOUND, i)
        single = F.array(F.struct(part(1).alias("field"), part(2).alias("literal")))
        listed = F.transform(
            F.regexp_extract_all(part(4), F.lit(f"{_STRING}|{_NUMBER}"), F.lit(0)),
            lambda item: F.struct(part(3).alias("field"), item.alias("literal")),
        )
        alone = F.array(F.struct(F.lit("valeur").alias("field"), match.alias("literal")))
        return (
            F.when(match.startswith("'"), alone)
            .when(match.rlike(r"(?i)\sin\s*\("), listed)
            .otherwise(single)
        )

    flat = F.flatten(
        F.transform(F.regexp_extract_all(sql, F.lit(_BOUND), F.lit(0)), of_match)
    )
    return F.transform(
        flat,
        lambda f, i: F.struct(
            f["field"].alias("field"),
            _unquote(f["literal"]).alias("value"),
            F.concat(F.lit("lit"), i.cast("string")).alias("path"),
        ),
    )


def sql_fields(sql: Column) -> Column:
    """Literals of a script under their columns; paths name the statement where there are several."""

    def of_all(statements: Column) -> Column:
        def of_one(statement: Column, k: Column) -> Column:
            fields = F.when(statement.rlike(r"(?i)^\s*insert\b"), _insert_fields(statement)).otherwise(_bound_fields(statement))
            place = F.when(F.size(statements) > 1, F.concat(F.lit("stmt"), k.cast("string"), F.lit("."))).otherwise("")
            return F.transform(fields, lambda f: F.struct(f["field"], f["value"], F.concat(place, f["path"]).alias("path")))

        return F.flatten(F.transform(statements, of_one))

    pieces = F.regexp_extract_all(sql, F.lit(_STATEMENT), F.lit(0))
    return bind(F.filter(pieces, lambda s: s.rlike(r"\S")), of_all)


# ---- JSON, XML, CSV: the shape differs by row, so a small helper per row -----

_DOCTYPE = re.compile(r"<!(?:DOCTYPE|ENTITY)", re.IGNORECASE)


def parse_xml(text: str) -> ET.Element | None:
    """Element tree, or None for malformed text and for any document type section."""
    if _DOCTYPE.search(text):
        return None
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def _json_fields(text: str) -> list[tuple[str, str, str]]:
    found: list[tuple[str, str, str]] = []
    todo: list[tuple[str, object]] = [("", json.loads(text))]
    while todo:
        path, node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                found.append((path.rsplit(".", 1)[-1].split("[", 1)[0], node, path))
        elif isinstance(node, dict):
            todo.extend(
                (f"{path}.{key}" if path else key, item) for key, item in reversed(node.items())
            )
        elif isinstance(node, list):
            todo.extend((f"{path}[{i}]", node[i]) for i in range(len(node) - 1, -1, -1))
    return found


def _xml_fields(text: str) -> list[tuple[str, str, str]]:
    root = parse_xml(text)
    if root is None:
        raise ValueError("malformed xml")
    found: list[tuple[str, str, str]] = []
    todo = [(root, root.tag)]
    while todo:
        node, path = todo.pop()
        found.extend((k, v, f"{path}@{k}") for k, v in node.attrib.items() if v.strip())
        for body, suffix in ((node.text, ""), (node.tail, "#tail")):
            if body and body.strip():
                found.append((node.tag, body.strip(), path + suffix))
        todo.extend((child, f"{path}/{child.tag}") for child in reversed(node))
    return found


def _csv_fields(text: str) -> list[tuple[str, str, str]]:
    found: list[tuple[str, str, str]] = []
    rows = (row for row in csv.reader(io.StringIO(text)) if row)
    head = [h.strip() for h in next(rows, [])]
    for r, row in enumerate(rows):
        if len(row) > len(head):
            raise ValueError("row longer than header")
        found.extend(
            (h, v.strip(), f"row{r}.{h}") for h, v in zip(head, row) if v.strip()
        )
    return found


_READERS = {"json": _json_fields, "xml": _xml_fields, "csv": _csv_fields}


@F.pandas_udf(FLAT)
def _flatten_nested(fmt: pd.Series, text: pd.Series) -> pd.DataFrame:
    fields, errors = [], []
    for kind, body in zip(fmt, text):
        try:
            rows = _READERS[kind](body) if body is not None else None
            fields.append(None if rows is None else [dict(zip(("field", "value", "path"), r)) for r in rows])
            errors.append(None)
        except (ValueError, RecursionError, csv.Error) as problem:
            fields.append(None)
            # the reason only: messages of parsers may quote the text
            errors.append(f"unreadable {kind}: {type(problem).__name__}")
    return pd.DataFrame({"fields": fields, "error": errors})


# Fixed value: how deep documents inside values are opened.
MAX_NESTING = 5


def blob_kind(text: str) -> str | None:
    """json or xml if the value looks like a document of its own."""
    body = text.strip()
    if body.startswith("<"):
        return "xml" if parse_xml(body) is not None else None
    return "json" if body.startswith(("{", "[")) else None


def _open_blob(text: str, depth: int) -> list[tuple[str | None, str, str, int]] | None:
    """Fields inside a value, documents inside it opened too; None for a plain value."""
    kind = blob_kind(text) if depth <= MAX_NESTING else None
    if kind is None:
        return None
    try:
        inner = _READERS[kind](text.strip())
    except (ValueError, RecursionError):
        return None
    if not inner:
        return [(None, text, "", depth)]
    found: list[tuple[str | None, str, str, int]] = []
    for field, value, path in inner:
        deeper = _open_blob(value, depth + 1)
        if deeper is None:
            found.append((field, value, path, depth))
        else:
            found.extend((f, v, f"{path}>{p}", d) for f, v, p, d in deeper)
    return found


NESTED_FIELD = T.StructType(
    [*FIELD.fields, T.StructField("depth", T.IntegerType())]
)


@F.pandas_udf(T.ArrayType(NESTED_FIELD))
def _open_blobs(value: pd.Series) -> pd.Series:
    names = ("field", "value", "path", "depth")
    out = []
    for text in value:
        rows = None if text is None else _open_blob(text, 1)
        out.append(None if rows is None else [dict(zip(names, r)) for r in rows])
    return pd.Series(out, dtype=object)


def open_nested(field: Column, value: Column, path: Column) -> Column:
    """array<field, value, path, depth>: the value itself, or what the document in it holds."""
    candidate = value.rlike(r"(?U)^\s*[\[{<]")
    inner = F.transform(
        _open_blobs(F.when(candidate, value)),
        lambda f: F.struct(
            f["field"].alias("field"),
            f["value"].alias("value"),
            F.concat(path, F.lit(">"), f["path"]).alias("path"),
            f["depth"].alias("depth"),
        ),
    )
    plain = F.array(
        F.struct(
            field.alias("field"), value.alias("value"), path.alias("path"), F.lit(0).alias("depth")
        )
    )
    return F.coalesce(inner, plain)


def flatten(fmt: Column, text: Column, drop_empty: bool = True) -> Column:
    """struct<fields, error> of a payload of known format; free text has no fields."""
    nested = fmt.isin("json", "xml", "csv")

    def ok(fields: Column) -> Column:
        return F.struct(fields.cast(FIELDS).alias("fields"), F.lit(None).cast("string").alias("error"))

    return (
        F.when(nested, _flatten_nested(F.when(nested, fmt), F.when(nested, text)))
        .when(fmt == "table", ok(table_fields(text, drop_empty)))
        .when(fmt == "sql", ok(sql_fields(text)))
        .otherwise(ok(F.array()))
    )
