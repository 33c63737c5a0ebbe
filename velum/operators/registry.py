"""Pattern table maintenance: vetting, suggestions, registration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.patterns import vet_regex

VERDICT = T.StructType(
    [T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())]
)
# Name prefix and longest name of a suggested pattern, label when none is known.
SUGGESTED_PREFIX = "qwen"
MAX_NAME = 64
FALLBACK_LABEL = "POLICE"


@F.pandas_udf(VERDICT)
def _vet(regex: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([vet_regex(r) for r in regex], columns=["ok", "reason"])


def vet_patterns(patterns: DataFrame, regex: str = "regex", unique: bool = False) -> DataFrame:
    """Add ``ok`` and ``reason``; each distinct regex is checked once."""
    if unique:
        return patterns.withColumn("_v", _vet(F.col(regex))).select(*patterns.columns, "_v.ok", "_v.reason")
    checked = patterns.select(regex).distinct().withColumn("_v", _vet(F.col(regex)))
    checked = checked.select(F.col(regex).alias("_r"), F.col("_v.ok").alias("ok"), F.col("_v.reason").alias("reason"))
    return patterns.join(checked, F.col(regex).eqNullSafe(F.col("_r"))).drop("_r")


def suggested_name(db: Column, table: Column, column: Column) -> Column:
    return F.substring(F.concat_ws("_", F.lit(SUGGESTED_PREFIX), db, table, column), 1, MAX_NAME)


def suggest_patterns(scan: DataFrame, stored: DataFrame, active: bool = False) -> DataFrame:
    """New pattern rows from a scan's suggested regexes: vetted, not stored yet, one per regex."""
    fresh = (
        scan.where("regex IS NOT NULL")
        .select(
            suggested_name(F.col("db"), F.col("table"), F.col("column")).alias("name"),
            "regex",
            F.coalesce("label", F.lit(FALLBACK_LABEL)).alias("label"),
            F.round("confidence", 2).alias("score"),
        )
        .join(stored.select("regex"), "regex", "left_anti")
    )
    one = fresh.groupBy("regex").agg(F.min(F.struct("name", "label", "score")).alias("_f"))
    one = one.select("_f.name", "regex", "_f.label", "_f.score")
    return (
        vet_patterns(one, unique=True)
        .where("ok")
        .select("name", "regex", "label", "score", F.lit(active).alias("active"), F.lit("classifier").alias("source"))
    )


def register_patterns(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored rows plus vetted candidates whose name is free; one candidate per name."""
    ok = vet_patterns(candidates).where("ok").drop("ok", "reason")
    one = ok.groupBy("name").agg(
        F.min(F.struct("regex", "label", "score", "active", "source")).alias("_p")
    ).select("name", "_p.*")
    return stored.unionByName(one.join(stored.select("name"), "name", "left_anti").select(*stored.columns))


def delete_patterns(stored: DataFrame, names: DataFrame) -> DataFrame:
    return stored.join(names.select("name"), "name", "left_anti")


def labels_with(active: Column, new_label: Column) -> Column:
    """Active label set after a pattern with ``new_label`` is created."""
    return F.array_union(active, F.array(new_label))
