"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.session import stage
from velum.sources.files import table

__all__ = ["bounded", "content_key", "lower_ascii", "once_per_worker", "read_bytes", "small_batches", "stage", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does that by itself for a text without an upper-case letter beyond A-Z,
    and is much faster than ``translate``.
    """
    other = r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]"
    return F.when(text.rlike(other), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text in joins, as two columns ``k1`` and ``k2``."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def bounded(staged: DataFrame, most_rows: int) -> DataFrame:
    """``staged`` with a broadcast hint if it has at most ``most_rows`` rows.

    Beyond that Spark joins it by its own choice (shuffle); the rows are the same.
    """
    return F.broadcast(staged) if staged.count() <= most_rows else staged


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Arrow batches of at most ``rows`` rows for what is written inside: whole texts in both of a task's processes are many bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_bytes(path: str) -> bytes:
    """A file that is installed beside the driver (tokenizer vocabularies)."""
    with open(path, "rb") as file:
        return file.read()


def once_per_worker(key: str, make):
    """What ``make`` gives, made once in a Python worker and kept for its later tasks."""
    held = sys.modules.setdefault("_velum_held", types.ModuleType("_velum_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
