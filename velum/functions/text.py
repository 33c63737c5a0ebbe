"""Column expressions on strings: headers, value metadata, placeholders."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a placeholder such as [EMAIL_12].
PLACEHOLDER = r"\[[A-Z][A-Z_]*_[0-9]+\]"
# Fixed value: share of placeholder characters from which a text counts as masked.
MASKED_SHARE = 0.30


def _single_base_letters() -> tuple[str, str]:
    """Every BMP letter that decomposes into one base character plus marks."""
    source, target = [], []
    for code in range(0x00C0, 0xFFFF):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = [p for p in parts if not unicodedata.combining(p)]
        if len(parts) > 1 and len(base) == 1:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _single_base_letters()


def strip(text: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def normalize_header(header: Column) -> Column:
    """Lower case, no accents, one underscore for each run of separators; NULL gives ''."""
    plain = F.translate(F.lower(header), _ACCENTED, _PLAIN)
    plain = F.regexp_replace(plain, r"[\u0300-\u036f]", "")
    joined = F.regexp_replace(plain, r"[ \-./\t_]+", "_")
    return F.coalesce(F.regexp_replace(joined, r"^_|_\z", ""), F.lit(""))


# Charset classes in the order they are tried; anything else is mixed.
CHARSET_RULES = (
    ("email", r"(?dU)^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("url", r"(?i)^https?://"),
    ("digits", r"(?d)^[0-9]+$"),
    ("alpha", r"(?d)^[a-zA-Z]+$"),
    ("alphanum", r"(?d)^[a-zA-Z0-9]+$"),
)
# Value forms in the order they are tried; anything else is none.
HINT_RULES = (
    ("avs", r"(?d)^[0-9]{13}$"),
    ("iban_ch", r"(?d)^(CH|LI)[0-9]{2}[0-9]{5}[A-Za-z0-9]{5,17}$"),
    ("phone", r"(?dU)^(\+41|0041)?[0-9]{2,3}\s?[0-9]{3}\s?[0-9]{2}\s?[0-9]{2}$"),
    ("date", r"(?d)^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$"),
    ("date", r"(?d)^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("date", r"(?d)^[0-9]{2}:[0-9]{2}(:[0-9]{2})?$"),
)
PUNCTUATION = r"[.,;:!?'\-/@&]"


def _first_match(value: str, rules, otherwise: str) -> str:
    tests = " ".join(f"WHEN {value} RLIKE r\"{regex}\" THEN '{name}'" for name, regex in rules)
    return f"CASE {tests} ELSE '{otherwise}' END"


def value_metadata_sql(value: str) -> str:
    """``value_metadata`` of a SQL expression, as SQL text."""
    return (
        f"named_struct('length', bigint(length({value})), "
        f"'charset', {_first_match(value, CHARSET_RULES, 'mixed')}, "
        f"'has_spaces', contains({value}, ' '), "
        f"'has_punctuation', {value} RLIKE r\"{PUNCTUATION}\", "
        f"'regex_hint', {_first_match(value, HINT_RULES, 'none')}, "
        f"'sample_hash', substring(sha2({value}, 256), 1, 8))"
    )


def value_metadata(value: Column) -> Column:
    """What may be said about a value without showing it: length, charset, has_spaces,
    has_punctuation, regex_hint and the head of its hash."""

    def rules(table, otherwise):
        out = F.lit(otherwise)
        for name, regex in reversed(table):
            out = F.when(value.rlike(regex), name).otherwise(out)
        return out

    return F.struct(
        F.length(value).cast("bigint").alias("length"),
        rules(CHARSET_RULES, "mixed").alias("charset"),
        value.contains(" ").alias("has_spaces"),
        value.rlike(PUNCTUATION).alias("has_punctuation"),
        rules(HINT_RULES, "none").alias("regex_hint"),
        F.substring(F.sha2(value, 256), 1, 8).alias("sample_hash"),
    )


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def masked_share(text: Column) -> Column:
    """Share of the text taken up by placeholders (0 for empty text)."""
    chars = F.aggregate(placeholders(text), F.lit(0), lambda acc, p: acc + F.length(p))
    return F.when(F.length(text) > 0, chars / F.length(text)).otherwise(F.lit(0.0))


def already_masked(text: Column) -> Column:
    return text.contains("[") & (masked_share(text) >= MASKED_SHARE)


def clip(value: Column, limit: int = 120) -> Column:
    """First ``limit`` characters and an ellipsis; display only."""
    return F.when(
        F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit("…"))
    ).otherwise(value)


def words(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
