"""Streams run to their end over data derived from the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from velum.plans.base import DOC_MASKED, DOC_SPANS, derived, query
from velum.plans.text import ORDER_TEXTS, RESTORED, order_map
from velum.session import shared_dir, stage
from velum.sources.files import table
from velum.streaming import bursts, mask, restore


def _folder(spark, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _as_stream(df, name: str):
    """A table written once and read as a file stream."""
    spark = df.sparkSession
    path = _folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 64).parquet(path)


def cut(texts, width: int):
    """(stream_id, scope, seq, chunk, is_last): texts cut every ``width`` characters."""
    pieces = F.greatest(F.ceil(F.length("text") / width).cast("int"), F.lit(1))
    return texts.select(
        "stream_id", "scope", "text", pieces.alias("_n"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_i")
    ).select(
        "stream_id", "scope", F.col("_i").cast("bigint").alias("seq"),
        F.substring("text", F.col("_i") * width + 1, F.lit(width)).alias("chunk"),
        (F.col("_i") == F.col("_n") - 1).alias("is_last"),
    )


@query("stream_restore", RESTORED)
def stream_restore(spark, root):
    texts = derived(spark, root, "orders", ORDER_TEXTS).withColumn("stream_id", F.col("o_orderkey").cast("string"))
    chunks = _as_stream(cut(texts, 7), "chunks")
    token_map = stage(order_map(spark, root), "token-map")
    out = _folder(spark, "restored")
    restore.start_restore(chunks, lambda: token_map, out, _folder(spark, "restore-state")).awaitTermination()
    pieces = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    whole = pieces.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_p"))
    return whole.select(
        F.col("stream_id").cast("bigint").alias("o_orderkey"),
        F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"),
    )


def _delta(text: str) -> str:
    return f"""'event: content_block_delta', chr(10), 'data: {{"type": "content_block_delta", "index": 0, "delta": {{"type": "text_delta", "text": "', {text}, '"}}}}', chr(10), chr(10)"""


_START = """'event: content_block_start', chr(10), 'data: {"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}', chr(10), chr(10)"""
_PING = "'event: ping', chr(10), 'data: {\"type\":\"ping\"}', chr(10), chr(10)"
_FRAMES_IN = f"""concat({_START}, {_delta("'Bonjour [PERS'")}, {_PING}, {_delta("concat('ONNE_', cast(c_custkey as string), '] et [')")},
 {_delta("'1, 2] puis [TEL_'")})"""
_FRAMES_OUT = f"""concat({_START}, {_delta("'Bonjour '")}, {_PING}, {_delta("concat(c_name, ' et ')")}, {_delta("'[1, 2] puis '")}, {_delta("'[TEL_'")})"""


@query("stream_frames", f"SELECT c_custkey, {_FRAMES_OUT} AS frames FROM customer")
def stream_frames(spark, root):
    texts = derived(spark, root, "customer", f"cast(c_custkey as string) AS stream_id, 'all' AS scope, {_FRAMES_IN} AS text")
    chunks = _as_stream(cut(texts, 11), "frame-chunks")
    token_map = stage(order_map(spark, root), "token-map")
    out = _folder(spark, "frames")
    restore.start_restore(chunks, lambda: token_map, out, _folder(spark, "frames-state"), framed=True).awaitTermination()
    frames = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    whole = frames.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("part", "frame"))).alias("_f"))
    return whole.select(
        F.col("stream_id").cast("bigint").alias("c_custkey"),
        F.array_join(F.transform("_f", lambda f: f["frame"]), "").alias("frames"),
    )


@query("stream_mask", DOC_MASKED + " SELECT doc_id, text FROM masked")
def stream_mask(spark, root):
    docs = spark.readStream.schema(table(spark, root, "documents").schema).parquet(f"{root}/documents*.parquet")
    out = _folder(spark, "stream-mask")
    mask.start_mask(docs.select("doc_id", "source", "text"), out, _folder(spark, "mask-state"), "source").awaitTermination()
    return mask.read_batches(spark, f"{out}/masked").select("doc_id", "text")


# Four batches: thirds of the ids, then the first third again. src3 is erased before the
# third batch, every scope expires before the fourth.
BATCH = "cast(floor(3 * doc_id / (1 + (SELECT max(doc_id) FROM documents))) as int)"


def _compacted_sql() -> str:
    parts = [f"""WITH found AS (SELECT f.*, {BATCH} AS b FROM (SELECT source AS scope, doc_id, start, prio, value, label FROM ({DOC_SPANS})) f),
    batches AS (SELECT * FROM found UNION ALL SELECT scope, doc_id, start, prio, value, label, 3 FROM found WHERE b = 0),
    m0 AS (SELECT '' AS scope, '' AS label, CAST(0 AS BIGINT) AS n, '' AS value, -1 AS batch WHERE false)"""]
    for b in range(4):
        live = {2: "scope <> 'src3'", 3: "false"}.get(b, "true")
        parts.append(f"""m{b + 1} AS (SELECT * FROM m{b} UNION ALL SELECT scope, label, n + coalesce(top, 0), value, {b} FROM (
          SELECT *, row_number() OVER (PARTITION BY scope, label ORDER BY doc_id, start, prio, value) AS n FROM (
            SELECT *, row_number() OVER (PARTITION BY scope, value ORDER BY doc_id, start, prio, label) AS r FROM batches WHERE b = {b})
          WHERE r = 1 AND (scope, value) NOT IN (SELECT (scope, value) FROM m{b} WHERE {live}))
         LEFT JOIN (SELECT scope, label, max(n) AS top FROM m{b} GROUP BY ALL) USING (scope, label))""")
    return ",\n".join(parts) + " SELECT batch, scope, label, n, value FROM m4"


@query("stream_mask_compacted", _compacted_sql())
def stream_mask_compacted(spark, root):
    """Tokens that each of four micro-batches made, with an erased scope, an expiry and two compactions between them."""
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    docs.createOrReplaceTempView("documents")
    third = docs.withColumn("b", F.expr(BATCH))
    folder, out, state = (_folder(spark, name) for name in ("batches", "mask-out", "mask-state"))
    store = mask.token_store(spark, out)
    made = None
    for batch in range(4):
        if batch == 2:
            store.erase(["src3"])
        if batch == 3:
            store.expire(F.current_timestamp() + F.expr("interval 2 days"))
        third.where(F.col("b") == batch % 3).drop("b").write.mode("append").parquet(folder)
        source = spark.readStream.schema(docs.schema).parquet(folder)
        mask.start_mask(source, out, state, "source", compact_every=2).awaitTermination()
        # kept apart, as a compaction takes ended tokens out
        new = stage(store.live(batch + 1).where(F.col("batch_id") == batch), "new-tokens")
        made = new if made is None else made.unionByName(new)
    return made.select(F.col("batch_id").cast("int").alias("batch"), "scope", "label", "n", "value")


KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "event_bursts",
    f"""SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
      {', '.join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in KINDS)}, count(*) AS total FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
       SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, burst""",
)
def event_bursts(spark, root):
    found = bursts.event_bursts(table(spark, root, "events"), F.col("ts"), KINDS, "event_type", "6 hours", ["user_id"])
    return found.select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), *KINDS, "total"
    )
