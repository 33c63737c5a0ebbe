"""Lexical forms of SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, dollar-quoted and quoted strings (open ones reach to the end), quoted names, numbers, words, signs.
_OPAQUE = (
    r"(?s)--[^\n]*+|/\*.*?(?:\*/|\z)|\$(\w*)\$.*?(?:\$\1\$|\z)"
    r"|[eE]'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+(?:'|\z)|[nN]?'[^']*+(?:''[^']*+)*+(?:'|\z)"
    r'|"[^"]*+(?:""[^"]*+)*+"|`[^`]*+`'
)
LEX = _OPAQUE + (
    r"|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?!\w)|[\p{L}_][\w$]*+|<>|!=|<=|>=|\S"
)
#: What may be rewritten, and what must be passed over whole: numbers that are no part of a name, and all of the above.
PARTS = _OPAQUE + r"|(?<![\w.'])[0-9]+(?:\.[0-9]+)?(?![\w.'])"
STRING = r"(?s)^(?:[eEnN]?'|\$\w*\$)"
NAME = r'^[\p{L}_"`]'
COMPARISONS = ("=", "<>", "!=", "<", "<=", ">", ">=", "like", "ilike")


def unquoted(literal: Column) -> Column:
    """The value of a string or number token."""
    body = F.regexp_replace(literal, r"(?s)^[eEnN]?'|'\z", "")
    dollar = F.regexp_replace(literal, r"^\$\w*\$|\$\w*\$\z", "")
    return F.when(literal.startswith("$"), dollar).when(literal.rlike(r"^[0-9]"), literal).otherwise(F.replace(body, F.lit("''"), F.lit("'")))
