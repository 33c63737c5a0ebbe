"""A checked query whose result leaves masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions.patterns import DetectorConfig
from velum.operators.kb import is_pii, label_headers
from velum.operators.mask import Masked, mask_columns
from velum.session import stage
from velum.sources.query import MAX_ROWS, read_only


def masked_query(
    spark: SparkSession,
    sql: str,
    kb: DataFrame,
    scope: str = "query",
    table: str | None = None,
    max_rows: int = MAX_ROWS,
    config: DetectorConfig = DetectorConfig(),
    existing: DataFrame | None = None,
    high_water: DataFrame | None = None,
) -> Masked:
    """Run a read-only query and mask its (at most ``max_rows``) rows.

    Columns with a personal label are masked as a whole; patterns run on the other
    text columns. ``table`` gives the labels their context.
    """
    rows = read_only(spark, sql, max_rows)
    columns = rows.columns
    headers = spark.createDataFrame([(c, None, table) for c in columns], "field string, db string, `table` string")
    found = label_headers(headers, kb).where(is_pii(F.col("label"))).collect()  # one row per result column
    labels = {r["field"]: r["label"] for r in found}
    labels = {c: labels[c] for c in columns if c in labels}
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and f.name not in labels]
    # at most max_rows rows: one task numbers them in result order, and they are kept so
    numbered = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_row", F.row_number().over(W.orderBy("_at")).cast("bigint")
    ).withColumn("_scope", F.lit(scope)).drop("_at")
    result = mask_columns(
        stage(numbered, "result"), "_row", "_scope", labels, texts, config, existing, high_water
    )
    return result._replace(rows=result.rows.select(*columns))
