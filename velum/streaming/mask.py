"""Masking a stream of texts with tokens that stay stable across micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.patterns import DetectorConfig
from velum.operators.audit import audit_rows
from velum.operators.mask import mask_documents
from velum.operators.store import TokenStore


def read_batches(spark: SparkSession, path: str, before: int | None = None, schema: str | None = None) -> DataFrame | None:
    """Folders of earlier micro-batches; None while there are none."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema + ", batch_id bigint")
        rows = reader.option("basePath", path).parquet(f"{path}/batch_id=*")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if before is None else rows.where(F.col("batch_id") < before)


def token_store(spark: SparkSession, out: str) -> TokenStore:
    return TokenStore(spark, f"{out}/token_map")


def mask_batch(
    docs: DataFrame, batch_id: int, out: str, scope: str, key: str = "doc_id", text: str = "text",
    config: DetectorConfig | Callable[[], DetectorConfig] = DetectorConfig(),
    compact_every: int = 20, ttl_seconds: int | None = None,
) -> None:
    """Mask one micro-batch: token map first, then masked rows and audit rows.

    Everything goes to the batch's own folders and sees only what earlier batches left,
    so running a batch again gives the same tokens and replaces its output. Of the token
    map only buckets with scopes of the batch are read; every ``compact_every`` batches it
    is folded together. With ``ttl_seconds`` scopes without a new token for so long end
    before the batch. Numbers are never given twice in a scope. ``config`` may be a
    function (see ``SnapshotConfig``): it is asked once per batch.
    """
    config = config() if callable(config) else config
    store = token_store(docs.sparkSession, out)
    if batch_id and batch_id % compact_every == 0:
        store.compact(batch_id - 1)
        store.vacuum()
    if ttl_seconds is not None:
        store.expire(F.current_timestamp(), ttl_seconds, batch_id)
    buckets = store.buckets_of(docs, scope)
    result = mask_documents(
        docs, scope, key, text, config,
        store.live(batch_id, buckets).select("scope", "label", "n", "token", "value"), store.marks(batch_id, buckets),
    )
    folder = f"batch_id={batch_id}"
    store.append(batch_id, result.token_map)
    result.rows.write.mode("overwrite").parquet(f"{out}/masked/{folder}")
    source = docs.select(F.col(scope).alias("scope"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    audit_rows(source, result.findings, F.current_timestamp()).write.mode("overwrite").parquet(
        f"{out}/audit/{folder}"
    )


def start_mask(
    docs: DataFrame, out: str, checkpoint: str, scope: str,
    config: DetectorConfig | Callable[[], DetectorConfig] = DetectorConfig(),
    key: str = "doc_id", text: str = "text", compact_every: int = 20, ttl_seconds: int | None = None, **trigger,
):
    """Run ``mask_batch`` on every micro-batch of a streaming DataFrame."""
    return (
        docs.writeStream.foreachBatch(
            lambda batch, batch_id: mask_batch(batch, batch_id, out, scope, key, text, config, compact_every, ttl_seconds)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
