"""Pattern table: regex detectors as data, compiled to native expressions."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("prio", T.IntegerType()),
    ]
)

# A pattern table is configuration that the driver reads whole: past this many rows it is refused, not cut.
MAX_PATTERNS = 100_000


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    label: str
    score: float = 0.8
    active: bool = True
    source: str = "manual"
    # text every match holds; tested before the regex runs
    needle: str | None = None
    # characters a match can begin with (inside of a character class); patterns that
    # name them are tested together in one pass over the text
    first: str | None = None


# Identifier forms, labels and scores.
IDENTIFIER_PATTERNS = [
    Pattern("AVS", r"756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}", "AVS", 0.9, needle="756."),
    Pattern("POLICY", r"\bPO[0-9]{9}-[0-9]{5}/[0-9]{2}\b", "POLICE", 0.9, needle="PO"),
    Pattern("CONTRACT", r"\bCT-[0-9]{5,10}\b", "CONTRAT", 0.75, needle="CT-"),
    Pattern("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", "VIN", 0.8, first="A-Z0-9"),
]

GENERAL_PATTERNS = [
    Pattern("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "EMAIL", 0.95, needle="@"),
    Pattern("IBAN", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "IBAN", 0.85, first="A-Z"),
    Pattern("DATE_DMY", r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b", "DATE", 0.6, first="0-9"),
    Pattern("DATE_ISO", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "DATE", 0.6, first="0-9"),
    Pattern("CARD", r"\b[0-9]{16}\b", "CARD", 0.7, first="0-9"),
    Pattern("IPV4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "IP", 0.7, first="0-9"),
    # written in groups of four
    Pattern("IBAN_SPACED", r"\b[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7} [A-Z0-9]{1,4}\b", "IBAN", 0.85, first="A-Z"),
]

DEFAULT_PATTERNS = IDENTIFIER_PATTERNS + GENERAL_PATTERNS

# Labels detectors may emit by default.
BUILTIN_LABELS = (
    "PERSONNE", "DATE", "LOCALISATION", "ORG", "AVS", "IBAN", "TEL", "EMAIL",
    "POLICE", "CONTRAT", "PLAQUE", "VIN", "PERMIS",
)
DEFAULT_LABELS = BUILTIN_LABELS + ("REF_SINISTRE", "ID", "REDACT", "CARD", "IP")


@dataclass(frozen=True)
class DetectorConfig:
    """The one-row detector configuration."""

    active_labels: tuple[str, ...] = DEFAULT_LABELS
    model_threshold: float = 0.5
    patterns_enabled: bool = True
    model_enabled: bool = True
    classifier_enabled: bool = True
    auto_approve: float = 0.7
    patterns: tuple[Pattern, ...] = tuple(DEFAULT_PATTERNS)

    def with_label(self, label: str) -> "DetectorConfig":
        from dataclasses import replace

        if label in self.active_labels:
            return self
        return replace(self, active_labels=self.active_labels + (label,))

    @staticmethod
    def from_row(row: dict, patterns: Iterable[Pattern] = DEFAULT_PATTERNS) -> "DetectorConfig":
        """From the stored configuration row (id = 1)."""
        known = {k: row[k] for k in (
            "model_threshold", "patterns_enabled", "model_enabled",
            "classifier_enabled", "auto_approve") if row.get(k) is not None}
        labels = tuple(row.get("active_labels") or DEFAULT_LABELS)
        return DetectorConfig(active_labels=labels, patterns=tuple(patterns), **known)


def pattern_rows(patterns: Iterable[Pattern] = DEFAULT_PATTERNS) -> list[tuple]:
    return [(p.name, p.regex, p.label, p.score, p.active, p.source) for p in patterns]


PATTERN_SCHEMA = "name string, regex string, label string, score double, active boolean, source string"


def load_patterns(table: DataFrame) -> list[Pattern]:
    """Read the active rows of a pattern table as configuration; a warning names those that are refused."""
    rows = table.where("active").orderBy("name").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"pattern table holds more than {MAX_PATTERNS} active rows")
    compile_ = table.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    good, refused = [], []
    for r in rows:
        ok, reason = vet_regex(r["regex"])
        if ok:
            try:
                compile_(java_regex(r["regex"]))
            except Py4JJavaError:
                ok, reason = False, "invalid in the JVM"
        if ok:
            good.append(Pattern(r["name"], r["regex"], r["label"], r["score"], True, r["source"]))
        else:
            refused.append(f"{r['name']} ({reason})")
    if refused:
        warnings.warn(f"patterns refused: {', '.join(refused)}", stacklevel=2)
    return good


def java_regex(regex: str) -> str:
    """A vetted pattern for the JVM: Unicode-aware classes and word bounds, Python's own
    spellings of named groups and of the text end replaced."""
    plain = re.sub(r"\(\?P<\w+>", "(", regex)
    plain = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", plain)
    return "(?U)" + plain


def _grouped(patterns: Iterable[Pattern]) -> tuple[list[Pattern], list[Pattern]]:
    """(patterns tested together, patterns tested alone)."""
    used = [p for p in patterns if p.active]
    together = [p for p in used if p.first and not p.needle]
    return together, [p for p in used if p not in together]


def _any_of(text: Column, patterns: list[Pattern]) -> Column:
    """One scan for several patterns: the look-ahead skips most positions at once."""
    starts = "".join(dict.fromkeys(p.first for p in patterns))
    bodies = "|".join(f"(?:{p.regex})" for p in patterns)
    return text.rlike(java_regex(f"(?=[{starts}])(?:{bodies})"))


def might_match(text: Column, patterns: Iterable[Pattern]) -> Column:
    """True for every text in which some pattern has a match (and only for those)."""
    together, alone = _grouped(patterns)
    found = F.lit(False)
    for p in alone:
        found = found | _guard(text, p, text.rlike(java_regex(p.regex)))
    if together:
        found = found | _any_of(text, together)
    return F.coalesce(found, F.lit(False))


def _guard(text: Column, pattern: Pattern, test: Column) -> Column:
    return (text.contains(pattern.needle) & test) if pattern.needle else test


def _cut(text: Column, pattern: Pattern, prio: int) -> Column:
    """The text cut at a pattern's matches; both arrays are NULL without a match."""
    regex = java_regex(pattern.regex)
    test = _guard(text, pattern, text.rlike(regex))
    return F.struct(
        F.when(test, F.split(text, regex, -1)).alias("gaps"),
        F.when(test, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).alias("hits"),
        F.lit(pattern.label).alias("label"),
        F.lit(float(pattern.score)).alias("score"),
        F.lit(prio).alias("prio"),
    )


def _walk(cut: Column) -> Column:
    """Spans of one cut: positions are running lengths of gaps and matches."""

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        span = F.struct(
            start.alias("start"),
            stop.alias("end"),
            pair["hit"].alias("value"),
            cut["label"].alias("label"),
            F.lit("pattern").alias("source"),
            cut["score"].alias("score"),
            cut["prio"].alias("prio"),
        )
        spans = F.when(pair["hit"].isNull(), acc["spans"]).otherwise(
            F.array_append(acc["spans"], span)
        )
        return F.struct(F.coalesce(stop, start).alias("pos"), spans.alias("spans"))

    return F.aggregate(
        F.zip_with(cut["gaps"], cut["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))),
        F.struct(F.lit(0).alias("pos"), F.array().cast(T.ArrayType(SPAN)).alias("spans")),
        step,
        lambda acc: acc["spans"],
    )


def find_spans(text: Column, patterns: Iterable[Pattern], labels: Iterable[str] | None = None) -> Column:
    """All pattern matches of a text as one array; no shuffle."""
    patterns = list(patterns)
    used = usable(patterns, labels)
    if not used:
        return F.array().cast(T.ArrayType(SPAN))
    prio = {p: i for i, p in enumerate(patterns)}
    together, alone = _grouped(used)
    cuts = F.array(*[_cut(text, p, prio[p]) for p in alone]) if alone else None
    if together:
        grouped = F.when(_any_of(text, together), F.array(*[_cut(text, p, prio[p]) for p in together]))
        cuts = F.concat(cuts, F.coalesce(grouped, F.slice(cuts, 1, 0))) if alone else grouped
    found = F.transform(F.filter(cuts, lambda c: c["hits"].isNotNull()), _walk)
    return F.coalesce(F.flatten(found), F.array().cast(T.ArrayType(SPAN)))


def usable(patterns: Iterable[Pattern], labels: Iterable[str] | None = None) -> list[Pattern]:
    allowed = None if labels is None else set(labels)
    return [p for p in patterns if p.active and (allowed is None or p.label in allowed)]


# ---- vetting -------------------------------------------------------------

# Longest accepted pattern, repeat count from which a repeat is unbounded.
MAX_REGEX_LENGTH = 200
UNBOUNDED_FROM = 50


#: Escapes and whole character classes of a pattern; what is left over is searched for FOREIGN.
_ESCAPE_OR_CLASS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.S)
#: Written so, the JVM refuses a pattern or reads it in another way: back references and
#: conditions by name, flags it lacks, a brace that is no repeat.
_FOREIGN = re.compile(r"\(\?P=|\(\?\(|\(\?[a-zA-Z]*[aLu]|\{(?![0-9]+(?:,[0-9]*)?\})")


def _open_repeats(node) -> int:
    """How many open repeats stand inside one another at most, counted from the innermost."""
    if isinstance(node, re._parser.SubPattern):
        node = node.data
    if not isinstance(node, (list, tuple)):
        return 0
    inside = max(map(_open_repeats, node), default=0)
    # a repeat is (which, (least, most, body))
    codes = re._constants
    repeats = (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT)
    repeat = isinstance(node, tuple) and len(node) == 2 and node[0] in repeats
    return inside + (repeat and node[1][1] > UNBOUNDED_FROM)


def _is_portable(regex: str) -> bool:
    """Whether the JVM reads a pattern as Python does, as far as its text tells."""
    classes = [c[1:-1] for c in _ESCAPE_OR_CLASS.findall(regex) if c.startswith("[")]
    plain = [re.sub(r"\\.", "", c, flags=re.S) for c in classes]
    return not any("[" in c or "&&" in c for c in plain) and not _FOREIGN.search(_ESCAPE_OR_CLASS.sub("", regex))


def vet_regex(regex: str | None) -> tuple[bool, str]:
    """(accepted, reason): refuses blank, long, broken and catastrophic patterns, and those the JVM reads otherwise."""
    if regex is None or not regex.strip():
        return False, "blank"
    if len(regex) > MAX_REGEX_LENGTH:
        return False, "too long"
    try:
        re.compile(regex)
    except re.error:
        return False, "invalid"
    if _open_repeats(re._parser.parse(regex)) > 1:
        return False, "nested repeats"
    return (True, "") if _is_portable(regex) else (False, "not portable")
