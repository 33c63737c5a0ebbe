"""Detector configuration that follows the published snapshots while a stream runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.patterns import PATTERN_SCHEMA, DetectorConfig, load_patterns
from velum.operators.kb import SnapshotReader

_LABEL = "header_norm string, header_raw string, label string, source string, confidence double, db_name string, table_name string"


def snapshot_patterns(rows: DataFrame) -> DataFrame:
    """The pattern table held by a snapshot's rows (kind, item)."""
    item = F.from_json("item", "name string, regex string, label string, score double")
    return rows.where("kind = 'pattern'").select(item.alias("p")).select(
        "p.name", "p.regex", "p.label", "p.score", F.lit(True).alias("active"), F.lit("snapshot").alias("source")
    ).to(spark_schema(rows.sparkSession))


def spark_schema(spark: SparkSession):
    return spark.createDataFrame([], PATTERN_SCHEMA).schema


def snapshot_labels(rows: DataFrame) -> DataFrame:
    """The active column labels held by a snapshot's rows, as a knowledge base for lookups."""
    found = rows.where("kind = 'label'").select(F.from_json("item", _LABEL).alias("k")).select("k.*")
    return found.withColumn("status", F.lit("active"))


class SnapshotConfig:
    """Called before every micro-batch: the base configuration with the newest snapshot's patterns and labels.

    A snapshot is read when its version is new. One that cannot be read leaves the last
    good one in force; ``problem`` tells why.
    """

    def __init__(self, spark: SparkSession, root: str, base: DetectorConfig = DetectorConfig()):
        self.reader, self.base, self.config = SnapshotReader(spark, root), base, base

    @property
    def version(self) -> str | None:
        return self.reader.version

    @property
    def problem(self) -> str | None:
        return self.reader.problem

    def __call__(self) -> DetectorConfig:
        if self.reader.refresh():
            own = {p.name for p in self.base.patterns}
            added = [p for p in load_patterns(snapshot_patterns(self.reader.rows)) if p.name not in own]
            self.config = replace(self.base, patterns=(*self.base.patterns, *added), active_labels=_joined(self.base.active_labels, (p.label for p in added)))
        return self.config


def _joined(labels: Iterable[str], more: Iterable[str]) -> tuple[str, ...]:
    """A label that a pattern brings joins the active set."""
    return tuple(dict.fromkeys([*labels, *more]))
