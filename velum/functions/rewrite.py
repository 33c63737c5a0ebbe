"""Replacing values by tokens and tokens by values inside one row."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.flatten import MAX_NESTING, blob_kind, parse_xml
from velum.functions.hof import bind
from velum.functions.sql_lex import PARTS, STRING, unquoted
from velum.functions.text import PLACEHOLDER, placeholders

# array<struct<key,value>>: what to look for and what to put in its place
ENTRIES = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)

_OPEN, _CLOSE = "\ue000", "\ue001"
_DIGITS = "".join(chr(0xE010 + d) for d in range(10))


def longest_first(entries: Column) -> Column:
    """Entries ordered by key length (longest first), then key."""
    return F.transform(
        F.array_sort(
            F.transform(
                entries,
                lambda e: F.struct(
                    (-F.length(e["key"])).alias("neg"),
                    e["key"].alias("key"),
                    e["value"].alias("value"),
                ),
            )
        ),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )


def replace_in_sequence(text: Column, entries: Column) -> Column:
    """Plain replacement, longest key first; later keys may hit earlier output."""
    return F.aggregate(
        longest_first(entries), text, lambda acc, e: F.replace(acc, e["key"], e["value"])
    )


def replace_values(text: Column, entries: Column) -> Column:
    """Replace every occurrence of every key, longest first, without chaining.

    Each key is first swapped for a mark made of private-use characters, which no
    later key can hit; the marks are then exchanged for the values in one split.
    Texts or keys that hold such characters themselves take the plain path.
    """

    def rebuilt(ordered: Column) -> Column:
        codes = F.transform(
            ordered,
            lambda e, i: F.struct(
                e["key"].alias("key"),
                F.concat(
                    F.lit(_OPEN),
                    F.translate(i.cast("string"), "0123456789", _DIGITS),
                    F.lit(_CLOSE),
                ).alias("mark"),
            ),
        )
        marked = F.aggregate(codes, text, lambda acc, e: F.replace(acc, e["key"], e["mark"]))

        def unmark(piece: Column, i: Column) -> Column:
            code = F.substring_index(piece, _CLOSE, 1)
            index = F.translate(code, _DIGITS, "0123456789").cast("int")
            rest = F.substring(piece, F.length(code) + 2, F.length(piece))
            return F.when(i == 0, piece).otherwise(F.concat(F.get(ordered, index)["value"], rest))

        return F.array_join(F.transform(F.split(marked, _OPEN, -1), unmark), "")

    reserved = f"[{_OPEN}-{_DIGITS[-1]}]"
    clash = text.rlike(reserved) | F.exists(entries, lambda e: e["key"].rlike(reserved))
    return (
        F.when(entries.isNull() | (F.size(entries) == 0), text)
        .when(clash, replace_in_sequence(text, entries))
        .otherwise(bind(longest_first(entries), rebuilt))
    )


def _lookup(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))


def replace_sql_literals(sql: Column, entries: Column) -> Column:
    """Replace literals whose value is a key; a replaced literal is always quoted.

    A longer string literal or comment that only holds keys has them replaced inside, so
    no value stays readable. Quoted names stay.
    """

    def swap(gap: Column, literal: Column, known: Column) -> Column:
        quoted = literal.rlike(STRING)
        comment = literal.startswith("--") | literal.startswith("/*")
        inner = unquoted(literal)
        held = quoted & F.exists(entries, lambda e: F.contains(inner, e["key"]))
        new = F.coalesce(
            F.try_element_at(known, inner), F.when(held, replace_values(inner, entries))
        )
        put = (
            F.when(comment, replace_values(literal, entries))
            .when(new.isNotNull() & ~literal.rlike('^["`]'), F.concat(F.lit("'"), F.replace(new, F.lit("'"), F.lit("''")), F.lit("'")))
            .otherwise(literal)
        )
        return F.concat(gap, F.coalesce(put, F.lit("")))

    rebuilt = bind(
        _lookup(entries),
        lambda known: F.array_join(
            F.zip_with(
                F.split(sql, PARTS, -1),
                F.regexp_extract_all(sql, F.lit(PARTS), F.lit(0)),
                lambda gap, literal: swap(gap, literal, known),
            ),
            "",
        ),
    )
    return F.when(entries.isNull() | (F.size(entries) == 0), sql).otherwise(rebuilt)


# A statement inside prose: from its first word to the first semicolon outside strings or the line end.
STATEMENT = (
    r"(?i)\b(?:insert[ \t]+into[ \t]+[^\s;]+|update[ \t]+[^\s;]+[ \t]+set[ \t]+[^\s;=]+[ \t]*="
    r"|delete[ \t]+from[ \t]+[^\s;]+|select[ \t]+[^;\n]*?[ \t]from[ \t]+[^\s;]+)(?:[^;\n']++|'[^'\n]*+'|')*+;?"
)


def replace_outside_placeholders(text: Column, entries: Column) -> Column:
    """As ``replace_values``, but earlier tokens stay as they are."""
    gaps = F.transform(
        F.split(text, PLACEHOLDER, -1), lambda gap: replace_values(gap, entries)
    )
    kept = F.array_join(
        F.zip_with(gaps, placeholders(text), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), ""
    )
    return F.when(text.rlike(PLACEHOLDER), kept).otherwise(replace_values(text, entries))


def splice_statements(text: Column, entries: Column) -> Column:
    """Rewrite the literals of embedded statements only."""
    parts = F.zip_with(
        F.split(text, STATEMENT, -1),
        F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0)),
        lambda gap, sql: F.concat(gap, F.coalesce(replace_sql_literals(sql, entries), F.lit(""))),
    )
    return F.when(text.rlike(STATEMENT), F.array_join(parts, "")).otherwise(text)


# ---- nested documents: the shape differs by row, so a small helper per row ----


def _swap(text: str, pairs: list[tuple[str, str]]) -> str:
    """Replace longest first; text already put in is not searched again."""
    parts: list[tuple[bool, str]] = [(False, text)]
    for key, value in pairs:
        if not key:
            continue
        cut: list[tuple[bool, str]] = []
        for done, part in parts:
            if done or key not in part:
                cut.append((done, part))
                continue
            for i, bit in enumerate(part.split(key)):
                if i:
                    cut.append((True, value))
                cut.append((False, bit))
        parts = cut
    return "".join(part for _, part in parts)


def _leaf(text: str, pairs: list[tuple[str, str]], depth: int) -> str:
    """A string inside a document; a document in it is rewritten as one."""
    kind = blob_kind(text) if depth < MAX_NESTING else None
    if kind is None:
        return _swap(text, pairs)
    return _REWRITERS[kind](text, pairs, depth + 1)


def _rewrite_json(text: str, pairs: list[tuple[str, str]], depth: int = 0) -> str:
    def visit(node):
        if isinstance(node, str):
            return _leaf(node, pairs, depth)
        if isinstance(node, list):
            return [visit(item) for item in node]
        if isinstance(node, dict):
            return {key: visit(item) for key, item in node.items()}
        return node

    try:
        tree = json.loads(text)
    except ValueError:
        return _swap(text, pairs)
    return json.dumps(visit(tree), ensure_ascii=False)


def _rewrite_xml(text: str, pairs: list[tuple[str, str]], depth: int = 0) -> str:
    root = parse_xml(text.strip())
    if root is None:
        return _swap(text, pairs)
    for node in root.iter():
        for name, value in node.attrib.items():
            node.set(name, _leaf(value, pairs, depth))
        node.text = node.text and _leaf(node.text, pairs, depth)
        node.tail = node.tail and _leaf(node.tail, pairs, depth)
    return ET.tostring(root, encoding="unicode")


_REWRITERS = {"json": _rewrite_json, "xml": _rewrite_xml}


def _pairs(row) -> list[tuple[str, str]]:
    return sorted(((e["key"], e["value"]) for e in row), key=lambda p: (-len(p[0]), p[0]))


@F.pandas_udf(ENTRIES)
def _blob_entries(blobs: pd.Series, entries: pd.Series) -> pd.Series:
    """Replacement for each document held in a cell or literal."""
    out = []
    for values, row in zip(blobs, entries):
        if values is None or row is None:
            out.append([])
            continue
        pairs = _pairs(row)
        out.append([{"key": v, "value": _leaf(v, pairs, 0)} for v in values])
    return pd.Series(out, dtype=object)


def with_blob_entries(blobs: Column, entries: Column) -> Column:
    return F.when(F.size(blobs) > 0, F.concat(entries, _blob_entries(blobs, entries))).otherwise(entries)


@F.pandas_udf(T.StringType())
def _rewrite_nested(fmt: pd.Series, text: pd.Series, entries: pd.Series) -> pd.Series:
    out = []
    for kind, body, row in zip(fmt, text, entries):
        if body is None or row is None or len(row) == 0:
            out.append(body)
            continue
        out.append(_REWRITERS[kind](body, _pairs(row)))
    return pd.Series(out, dtype=object)


def replace_by_format(fmt: Column, text: Column, entries: Column) -> Column:
    """Format-aware rewriting of one payload."""
    nested = fmt.isin("json", "xml")
    return (
        F.when(
            nested,
            _rewrite_nested(fmt, F.when(nested, text), F.when(nested, entries)),
        )
        .when(fmt == "sql", replace_sql_literals(text, entries))
        .otherwise(replace_values(text, entries))
    )


# ---- back from tokens to values ------------------------------------------


def restore_tokens(text: Column, entries: Column) -> Column:
    """Put values back for known tokens; unknown tokens stay.

    Tokens end with a bracket, so none is the head of another and one split does it.
    """
    rebuilt = bind(
        _lookup(entries),
        lambda known: F.array_join(
            F.zip_with(
                F.split(text, PLACEHOLDER, -1),
                placeholders(text),
                lambda gap, token: F.concat(
                    gap, F.coalesce(F.try_element_at(known, token), token, F.lit(""))
                ),
            ),
            "",
        ),
    )
    return F.when(entries.isNull() | (F.size(entries) == 0), text).otherwise(rebuilt)
