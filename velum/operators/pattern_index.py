"""Detection with thousands of patterns in one pass over the texts.

Of every pattern the literals are taken that its matches must hold; one run of GRAM
characters of each literal is its entry in the index. The distinct runs of a text that
pass a bitmap of all entries are joined with the index by equality; a pattern is tried on
the texts that hold one of its literals, and on no other.

A pattern table of any size stays a table: it is vetted and numbered by Spark, and its whole
literals are sought in the texts by ``contained_values``, so that a text meets the patterns
whose literals it holds, and none that only shares a run of characters with it.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.literals import required_literals
from velum.functions.patterns import DetectorConfig, Pattern, _walk, java_regex, usable, vet_regex
from velum.operators.containment import contained_values
from velum.operators.detect import SPAN_COLUMNS, detect_entities
from velum.operators.tokens import number_within
from velum.session import release, spread, stage

#: Characters of an index entry.
GRAM = 3
#: Bits of the bitmap, as a power of two. More entries than that let more runs through to the join, and change nothing else.
SLOTS = 16
#: Patterns without a literal that are tried in one pass over the texts.
IN_PLACE = 50
#: Refused patterns that a warning names; it counts them all.
NAMED = 20

ENTRIES = "gram string, literal string, earlier array<string>, regex string, label string, score double, prio int"


def entries(patterns: Sequence[Pattern], labels: Sequence[str] | None = None) -> tuple[list[tuple], list[Pattern]]:
    """(rows of the index, patterns that have no literal of GRAM characters).

    Of a literal's runs the one is taken that the fewest literals share. ``earlier`` are the
    pattern's literals before this one: a text that holds several is its candidate once.
    """
    used = usable(patterns, labels)
    prio = {p: i for i, p in enumerate(patterns)}
    literals = {p: required_literals(p.regex) for p in used}
    alone = [p for p in used if min(map(len, literals[p]), default=0) < GRAM]
    indexed = [p for p in used if p not in set(alone)]

    def runs(text: str) -> set[str]:
        return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}

    shared = Counter(g for p in indexed for t in literals[p] for g in runs(t))
    rows = [
        (min(runs(t), key=lambda g: (shared[g], g)), t, literals[p][:i], java_regex(p.regex), p.label, float(p.score), prio[p])
        for p in indexed for i, t in enumerate(literals[p])
    ]
    return rows, alone


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(1 << SLOTS))


def _bitmap(spark: SparkSession, rows: list[tuple]) -> Column:
    grams = spark.createDataFrame(sorted({(r[0],) for r in rows}), "gram string")
    words = [0] * (1 << (SLOTS - 6))
    for (slot,) in grams.select(_slot(F.col("gram"))).distinct().collect():  # at most 2^SLOTS
        words[slot >> 6] |= 1 << (slot & 63)
    return F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words])


def candidates(texts: DataFrame, keys: Sequence[str], text: str, rows: list[tuple]) -> DataFrame:
    """Texts beside the indexed patterns one of whose literals they hold: keys, _text, regex, label, score, prio."""
    spark = texts.sparkSession
    bits = _bitmap(spark, rows)
    index = spark.createDataFrame(rows, ENTRIES)
    grams = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))

    def known(gram: Column) -> Column:
        slot = _slot(gram)
        word = F.get(bits, F.shiftright(slot, 6).cast("int"))
        return F.expr("1L").bitwiseAND(F.call_function("shiftright", word, F.pmod(slot, F.lit(64)).cast("int"))) == 1

    met = texts.select(*keys, F.col(text).alias("_text"), F.explode(F.filter(grams, known)).alias("gram")).join(index, "gram")
    first = F.col("_text").contains(F.col("literal")) & ~F.exists("earlier", lambda t: F.col("_text").contains(t))
    return met.where(first).select(*keys, "_text", "regex", "label", "score", "prio")


READ = T.StructType([T.StructField("reason", T.StringType()), T.StructField("java", T.StringType()), T.StructField("literals", T.ArrayType(T.StringType()))])


@F.pandas_udf(READ)
def _read(regex: pd.Series) -> pd.DataFrame:
    """Why a regex is refused, else its spelling for the JVM and the literals its matches must hold."""
    rows = []
    for r in regex:
        ok, reason = vet_regex(r)
        literals = required_literals(r) if ok else []
        if any("\ud800" <= c <= "\udfff" for t in literals for c in t):  # halves of a character: no text is cut there
            literals = []
        rows.append((None if ok else reason, java_regex(r) if ok else None, literals))
    return pd.DataFrame(rows, columns=["reason", "java", "literals"])


def load_pattern_table(table: DataFrame) -> DataFrame:
    """The active rows of a pattern table of any size, vetted as ``load_patterns`` does, for ``detect_by_index``.

    name, regex, java (the regex for the JVM), label, score, literals; ``prio`` is a pattern's
    place by name. A warning counts the patterns that are refused and names the first.
    """
    own = ["name", "regex", "label", "score"]
    read = spread(table.where("active").select(*own)).withColumn("_r", _read("regex")).select(*own, "_r.*")
    broken = F.expr("java IS NOT NULL AND try_reflect('java.util.regex.Pattern', 'compile', java) IS NULL")
    read = stage(read.withColumn("reason", F.when(broken, "invalid in the JVM").otherwise(F.col("reason"))), "patterns")
    refused = read.where("reason IS NOT NULL")
    more = refused.count() - NAMED
    if more > -NAMED:
        names = ", ".join(f"{r['name']} ({r['reason']})" for r in refused.orderBy("name").limit(NAMED).collect())
        warnings.warn(f"patterns refused: {names}{f' and {more} more' if more > 0 else ''}", stacklevel=2)
    good = number_within(read.where("reason IS NULL").drop("reason"), [], own)
    release(read)
    return good.select(*own, "java", "literals", (F.col("n") - 1).cast("int").alias("prio"))


def _spans(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The matches of the pattern ``_p`` (regex for the JVM, label, score, prio) in ``_text``."""
    cut = F.struct(
        F.split("_text", F.col("_p.regex"), -1).alias("gaps"), F.regexp_extract_all("_text", F.col("_p.regex"), F.lit(0)).alias("hits"),
        "_p.label", "_p.score", "_p.prio",
    )
    spans = found.select(*keys, cut.alias("_cut")).select(*keys, F.explode(_walk(F.col("_cut"))).alias("_span"))
    return spans.select(*keys, *[F.col(f"_span.{c}").alias(c) for c in SPAN_COLUMNS])


def _in_place(texts: DataFrame, keys: Sequence[str], patterns: Sequence[Pattern], prio: Sequence[int], text: str) -> DataFrame:
    """Patterns tried on every text, in one pass; ``prio`` holds their places."""
    own = detect_entities(texts, keys, text, DetectorConfig(active_labels=tuple({p.label for p in patterns}), patterns=tuple(patterns)))
    return own.withColumn("prio", F.get(F.array(*map(F.lit, prio)), F.col("prio")))


def _by_table(texts: DataFrame, keys: Sequence[str], patterns: DataFrame, text: str, labels: Sequence[str] | None) -> DataFrame | None:
    used = patterns if labels is None else patterns.where(F.col("label").isin(*labels))
    shortest = F.coalesce(F.array_min(F.transform("literals", F.length)), F.lit(0))
    indexed, alone = used.where(shortest >= GRAM), used.where(shortest < GRAM)
    pattern = F.struct(F.col("java").alias("regex"), "label", "score", "prio").alias("_p")
    held = texts.select(*keys, F.col(text).alias("_text"))
    out = []
    if not indexed.isEmpty():
        # keys may repeat: a row is known by its number, which has to stay
        rows = stage(held.where("_text <> ''").withColumn("_row", F.monotonically_increasing_id()), "texts")
        index = indexed.select(pattern, "literals", F.posexplode("literals").alias("_i", "_literal"))
        # a text that holds several literals of a pattern is its candidate once
        index = index.select("_literal", F.slice("literals", F.lit(1), F.col("_i")).alias("_earlier"), "_p")
        known = index.select(F.lit("").alias("scope"), F.col("_literal").alias("value"))
        places = contained_values(rows.select(F.lit("").alias("scope"), "_row", "_text"), known, ["_row"], "_text")
        met = places.select("_row", F.col("value").alias("_literal")).distinct().join(index, "_literal").drop("_literal")
        first = ~F.exists("_earlier", lambda t: F.col("_text").contains(t))
        out.append(_spans(rows.join(met, "_row").where(first).where(F.expr("_text rlike _p.regex")), keys))
    few = alone.orderBy("prio").limit(IN_PLACE + 1).collect()
    if len(few) > IN_PLACE:
        # patterns are the outer side, and this test keeps the last regex it was given
        every = alone.select(pattern).hint("shuffle_replicate_nl").join(held, F.expr("regexp_instr(_text, _p.regex) > 0"))
        out.append(_spans(every, keys))
    elif few:
        out.append(_in_place(texts, keys, [Pattern(r["name"], r["regex"], r["label"], r["score"]) for r in few], [r["prio"] for r in few], text))
    return reduce(DataFrame.unionByName, out) if out else None


def detect_by_index(
    texts: DataFrame, keys: Sequence[str], patterns: Sequence[Pattern] | DataFrame, text: str = "text", labels: Sequence[str] | None = None,
) -> DataFrame:
    """One row per match of any active pattern, as ``detect_entities`` gives them; ``prio`` is the pattern's place in ``patterns``.

    NULL and empty texts have no match; repeated rows have theirs each. Spark broadcasts the
    index while it is within its limit; texts are shuffled only beyond it, and then those
    with a candidate. Patterns without a literal are tried on every text, IN_PLACE in one pass.

    ``patterns`` may be a table of any size that ``load_pattern_table`` has read: texts are
    staged, and only (text, literal) pairs meet the patterns. More than IN_PLACE patterns
    without a literal meet the texts in a product of both, which nothing makes smaller.
    """
    if isinstance(patterns, DataFrame):
        out = _by_table(texts, keys, patterns, text, labels)
        return detect_entities(texts, keys, text, DetectorConfig(patterns=())) if out is None else out
    rows, alone = entries(patterns, labels)
    place = {p: i for i, p in enumerate(patterns)}
    out = None
    if rows:
        found = candidates(texts, keys, text, rows).where(F.expr("_text rlike regex"))
        out = _spans(found.select(*keys, "_text", F.struct("regex", "label", "score", "prio").alias("_p")), keys)
    for i in range(0, len(alone), IN_PLACE):
        part = alone[i : i + IN_PLACE]
        own = _in_place(texts, keys, part, [place[p] for p in part], text)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = detect_entities(texts, keys, text, DetectorConfig(patterns=()))
    return out
