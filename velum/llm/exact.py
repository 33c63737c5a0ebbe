"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, in a folder that outlives the session.
A load is reduced to one row per digest, sort-merge anti-joined with what earlier loads
brought (the index side is read bucket by bucket, without a shuffle) and appended.
Native throughout.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import stage
from velum.session import parallelism, shared_dir

#: A digest that more than one in HOT rows of a load has is joined by broadcast; there are fewer than HOT of them.
HOT = 1000


@dataclass(frozen=True)
class Index:
    """A digest index: ``name`` is its table in this session, ``path`` where its rows are."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    def rows(self) -> DataFrame:
        """(digest, keep, keep_at, n, load): per load one row a digest; ``keep`` where that load brought it first."""
        return self.spark.table(self.name)

    def state(self) -> DataFrame:
        """(digest, keep, keep_at, load, n): one row a digest, with the row that stays and the count over all loads."""
        first = F.max(F.when(F.col("first"), F.struct("keep", "keep_at", "load")))
        rows = self.rows().groupBy("digest").agg(first.alias("first"), F.sum("n").alias("n"))
        return rows.select("digest", "first.keep", "first.keep_at", "first.load", "n")


def digest(text: Column) -> Column:
    """32 bytes of SHA-256 over the text's UTF-8; NULL counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def open_index(spark: SparkSession, path: str | None = None, *, key_type: str = "bigint", buckets: int | None = None) -> Index:
    """The index in folder ``path``, made there if it holds none; without a path a new one in the shared folder.

    ``buckets`` is fixed when the folder is first written (default: the session's shuffle
    partitions) and must be given again when it is opened with another setting.
    """
    path = path or os.path.join(shared_dir(spark), f"digests-{uuid.uuid4().hex}")
    buckets = buckets or parallelism(spark)
    name = f"digests_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (digest BINARY, keep {key_type}, keep_at BIGINT, n BIGINT, first BOOLEAN, load STRING) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return Index(spark, name, path, buckets)


def written(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def numbered(index: Index, docs: DataFrame, load: str, key: str, text: str) -> DataFrame:
    """(key, digest, at) of every row, written once beside the index and found there when a load is run again.

    ``at`` tells apart rows that repeat a key and a text.
    """
    path = f"{index.path}-{load}"
    rows = docs.select(F.col(f"`{key}`").alias("key"), digest(F.col(f"`{text}`")).alias("digest"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    if not written(index.spark, path):
        rows.write.mode("overwrite").parquet(path)
    return index.spark.read.schema(rows.schema).parquet(path)


def append(index: Index, rows: DataFrame, load: str) -> None:
    """Anti-join a load (key, digest, at) with the index and append it.

    A load whose name the index already holds is left alone, so a job that failed after
    the append can be run again. Copies meet in the partial aggregate, before the shuffle.
    """
    spark = index.spark
    spark.catalog.refreshTable(index.name)
    if index.rows().where(F.col("load") == load).limit(1).count():
        return
    groups = rows.groupBy("digest").agg(F.max(F.struct("key", "at")).alias("last"), F.count("*").alias("n"))
    groups = stage(groups.select("digest", F.col("last.key").alias("keep"), F.col("last.at").alias("keep_at"), "n"), "groups")
    known = index.rows().where("first").select("digest")
    merged = known.hint("merge")
    fresh = groups.join(merged, "digest", "left_anti").select("digest", "keep", "keep_at", "n", F.lit(True).alias("first"))
    again = groups.join(merged, "digest", "left_semi").select(
        "digest", F.lit(None).cast(groups.schema["keep"].dataType).alias("keep"), F.lit(None).cast("bigint").alias("keep_at"), "n", F.lit(False).alias("first")
    )
    added = fresh.unionByName(again).withColumn("load", F.lit(load))
    writer = added.write.mode("append").format("parquet").bucketBy(index.buckets, "digest").sortBy("digest")
    writer.saveAsTable(index.name)
    spark.catalog.refreshTable(index.name)


def decided(index: Index, rows: DataFrame, load: str) -> DataFrame:
    """(key, keep_id, group_size, kept, digest) of every row of a load.

    Digests that a thousandth of the rows or more share (fewer than a thousand) are
    broadcast; all others are merged with the index bucket by bucket.
    """
    total = rows.count()
    state = index.state()
    in_load = index.rows().where((F.col("load") == load) & (F.col("n") * HOT > total)).select("digest")
    hot = stage(state.join(F.broadcast(in_load), "digest", "left_semi"), "hot")
    digests = F.broadcast(hot.select("digest"))
    often = rows.join(F.broadcast(hot), "digest")
    seldom = rows.join(digests, "digest", "left_anti").join(state.hint("merge"), "digest")
    own = (F.col("load") == load) & (F.col("at") == F.col("keep_at"))
    return often.unionByName(seldom).select("key", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), "digest")


def deduplicate(loads: Iterable[tuple[str, DataFrame]], index: Index, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row of all ``loads``: ``key``, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key of the first load that has the text stays;
    later loads find it in the index. NULL and empty texts are equal. Of rows that repeat
    both key and text one is kept; a NULL key stays only where its group has no other. An
    empty load adds nothing; further columns are left out. Group sizes count all loads the
    index holds.
    """
    parts = []
    for load, docs in loads:
        rows = numbered(index, docs, load, key, text)
        append(index, rows, load)
        parts.append((load, rows))
    out = None
    for load, rows in parts:
        found = decided(index, rows, load)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no load was given")
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_new(docs: DataFrame, index: Index, load: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, as they are: one of each text that the index did not hold before this load."""
    rows = numbered(index, docs, load, key, text)
    append(index, rows, load)
    mine = stage(index.rows().where(F.col("first") & (F.col("load") == load)).select(F.col("keep").alias("_keep"), F.col("digest").alias("_digest")), "kept")
    own = docs[f"`{key}`"].eqNullSafe(mine["_keep"]) & (digest(docs[f"`{text}`"]) == mine["_digest"])
    kept = docs.join(mine, own, "left_semi")
    twice = rows.groupBy("key", "digest").agg(F.count("*").alias("k")).where("k > 1").select("key", "digest")
    twice = stage(twice, "twice")  # rows that repeat key and text: usually none
    if not twice.limit(1).count():
        return kept
    repeated = docs[f"`{key}`"].eqNullSafe(twice["key"]) & (digest(docs[f"`{text}`"]) == twice["digest"])
    return kept.join(twice, repeated, "left_anti").unionByName(kept.join(twice, repeated, "left_semi").dropDuplicates([key, text]))


def compact(index: Index, path: str | None = None) -> Index:
    """A copy of the index with one row a digest and one sorted file a bucket."""
    made = open_index(index.spark, path, key_type=index.rows().schema["keep"].dataType.simpleString(), buckets=index.buckets)
    rows = index.state().select("digest", "keep", "keep_at", "n", F.lit(True).alias("first"), "load")
    rows.repartition(index.buckets, "digest").write.mode("append").format("parquet").bucketBy(index.buckets, "digest").sortBy("digest").saveAsTable(made.name)
    index.spark.catalog.refreshTable(made.name)
    return made
