"""Stable numbered tokens: one per value and scope.

A *finding* is a row (scope, doc_id, ord, start, prio, value, label, source, ...);
(doc_id, ord, start, prio, value) is the total order that stands for first sight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions.rewrite import ENTRIES
from velum.functions.text import PLACEHOLDER, placeholders
from velum.session import parallelism, stage, stage_small

ORDER = ["doc_id", "ord", "start", "prio", "value"]
TOKEN_COLUMNS = ["scope", "label", "n", "token", "value"]
# Fixed value: lifetime of a scope's tokens after its last new token.
TTL_SECONDS = 86_400


def required(name: str) -> Column:
    """A scope or key column; a NULL in it stops the job, as its row could not be masked."""
    column = F.col(name)
    return F.when(column.isNull(), F.raise_error(F.lit(f"NULL in {name}"))).otherwise(column)


def first_sightings(findings: DataFrame) -> DataFrame:
    """One row per (scope, value) at its first position; that position's label wins."""
    first = findings.groupBy("scope", F.col("value").alias("_value")).agg(
        F.min(F.struct(*ORDER, "label")).alias("_f")
    )
    return first.select("scope", *[F.col(f"_f.{c}").alias(c) for c in [*ORDER, "label"]])


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``n`` = 1, 2, ... within each group, for groups of any size.

    The rows are range-partitioned by (group, order), so a hot group spreads over
    many tasks. Row positions inside the sorted partitions are frozen in a staged
    table; one small count per (group, partition) then gives each piece its offset.
    """
    keys = [*groups, *order]
    ranged = (
        df.repartitionByRange(parallelism(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ranged = stage(ranged, "numbered").withColumn("_part", F.shiftright("_row", 33))
    pieces = ranged.groupBy(*groups, "_part").agg(
        F.count("*").alias("_count"), F.min("_row").alias("_first")
    )
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        *groups, "_part", "_first",
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
    )
    return (
        ranged.join(pieces, [*groups, "_part"])
        .withColumn("n", F.col("_offset") + F.col("_row") - F.col("_first") + 1)
        .drop("_row", "_part", "_first", "_offset")
    )


def token_of(label: Column, n: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]"))


def assign_tokens(
    findings: DataFrame,
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
) -> DataFrame:
    """Tokens for values not yet mapped in their scope.

    Numbers go on after the largest one ever given: ``high_water`` (scope, label, n)
    outlives an erased map.
    """
    new = first_sightings(findings)
    if existing is not None:
        new = new.join(existing.select("scope", "value"), ["scope", "value"], "left_anti")
    numbered = number_within(new, ["scope", "label"], ORDER)
    marks = [d.select("scope", "label", "n") for d in (existing, high_water) if d is not None]
    if marks:
        top = marks[0] if len(marks) == 1 else marks[0].unionByName(marks[1])
        top = top.groupBy("scope", "label").agg(F.max("n").alias("_top"))
        numbered = (
            numbered.join(top, ["scope", "label"], "left")
            .withColumn("n", F.col("n") + F.coalesce("_top", F.lit(0)))
            .drop("_top")
        )
    return numbered.select(
        "scope", "label", "n", token_of(F.col("label"), F.col("n")).alias("token"), "value"
    )


def high_water(token_map: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Largest number given per (scope, label)."""
    rows = token_map.select("scope", "label", "n")
    if earlier is not None:
        rows = rows.unionByName(earlier.select("scope", "label", "n"))
    return rows.groupBy("scope", "label").agg(F.max("n").alias("n"))


def export_token_map(token_map: DataFrame, scope: str) -> DataFrame:
    return token_map.where(F.col("scope") == scope).select("token", "value")


def erase_scope(token_map: DataFrame, scope: str) -> DataFrame:
    """Forget a scope's values; keep ``high_water`` of the old map beside the result."""
    return token_map.where(F.col("scope") != scope)


def expire_tokens(token_map: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Drop whole scopes whose last new token is older than the lifetime."""
    alive = (
        token_map.groupBy("scope")
        .agg(F.max("created_at").alias("_last"))
        .where(F.col("_last") + F.expr(f"interval {ttl_seconds} seconds") > now)
    )
    return token_map.join(alive.select("scope"), "scope", "left_semi")


# ---- carrying replacement lists to their texts -----------------------------


def entry_lists(pairs: DataFrame, keys: Sequence[str], key: str, value: str) -> DataFrame:
    """Replacement list of each document: its distinct (key, value) pairs."""
    return (
        pairs.groupBy(*keys)
        .agg(
            F.collect_set(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))
            .cast(ENTRIES)
            .alias("entries")
        )
    )


def attach_entries(
    texts: DataFrame, entries: DataFrame, keys: Sequence[str], touched: Column | None = None
) -> DataFrame:
    """Left join of replacement lists.

    The lists are staged first. Within the broadcast limit the texts stay where they
    are; above it, rows that cannot have a list (``touched`` is false) skip the shuffle.
    """
    entries, small = stage_small(entries, "entries")
    if small or touched is None:
        return texts.join(entries, list(keys), "left")
    touched = F.coalesce(touched, F.lit(False))
    joined = texts.where(touched).join(entries, list(keys), "left")
    return joined.unionByName(texts.where(~touched), allowMissingColumns=True)


def tokens_for(findings: DataFrame, token_map: DataFrame) -> DataFrame:
    """Token of each finding: the scope's token for the value, whatever the label."""
    known = token_map.select("scope", "value", "token")
    return findings.join(known, ["scope", "value"])


def restore_text(
    texts: DataFrame, token_map: DataFrame, keys: Sequence[str], text: str = "text", scope: str = "scope"
) -> DataFrame:
    """Put original values back for every known token of the row's scope."""
    from velum.functions.rewrite import restore_tokens

    found = texts.where(F.col(text).contains("[")).select(
        *keys, F.col(scope).alias("scope"), F.explode_outer(F.array_distinct(placeholders(F.col(text)))).alias("token")
    ).where("token IS NOT NULL")
    pairs = found.join(token_map.select("scope", "token", "value"), ["scope", "token"])
    lists = entry_lists(pairs, keys, "token", "value")
    return (
        attach_entries(texts, lists, keys, F.col(text).rlike(PLACEHOLDER))
        .withColumn(text, restore_tokens(F.col(text), F.col("entries")))
        .drop("entries")
    )


def leak_check(
    masked: DataFrame, findings: DataFrame, keys: Sequence[str], text: str = "text"
) -> DataFrame:
    """Original values still present in their own document's masked text (expected: none)."""
    lists = findings.where(F.length("value") > 0).groupBy(*keys).agg(F.collect_set("value").alias("_values"))
    lists, _ = stage_small(lists, "values")
    held = F.filter("_values", lambda v: F.contains(F.col(text), v))
    return (
        masked.join(lists, list(keys))
        .select(*keys, F.explode_outer(held).alias("value"))
        .where("value IS NOT NULL")
    )
