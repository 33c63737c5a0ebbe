"""Restoring tokens in text that arrives in pieces.

Two steps: a stateful one that only makes sure no token is cut (its state are the
open tails of a group of streams), and a join with the token map as it is when the
micro-batch runs, so tokens made while the stream flows are found.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from velum.functions.text import placeholders
from velum.operators.tokens import restore_text
from velum.session import release, stage

# Fixed value: a text end that may be the head of a placeholder.
OPEN_TAIL = r"\[(?:[A-Z][A-Z_]*(?:_[0-9]*)?)?\Z"

PIECES = "stream_id string, scope string, seq long, text string"
FRAMES = "stream_id string, scope string, seq long, part long, head string, payload string, text string, tail string"
_STATE = "streams string"
#: Groups of state that streams are dealt to; fixed for a checkpoint, as the number of state partitions is.
GROUPS = 4096

# stands for the delta text inside a frame's JSON until the text is restored
SLOT = "\ue021"
IDLE_MS = 600_000
#: How long a stream that was flushed or has ended is remembered, so that it can go on and repeats are known.
LIFETIME_MS = 86_400_000


def _cut_tail(text: str) -> tuple[str, str]:
    found = re.search(OPEN_TAIL, text)
    return (text[: found.start()], text[found.start():]) if found else (text, "")


@dataclass
class _Stream:
    """Where one stream stands; ``until`` is when it counts as idle, or is forgotten."""

    stream_id: str
    scope: str | None = None
    next_seq: int = 0
    waiting: dict[int, list] = field(default_factory=dict)
    buffer: str = ""
    raw: str = ""
    block: int | None = None
    sent: int = 0
    until: int = 0

    def ready(self) -> tuple[list, bool]:
        """Chunks that are next in line, and whether the last one is among them; ones that came early wait."""
        found, ended = [], False
        while self.next_seq in self.waiting and not ended:
            chunk, ended = self.waiting.pop(self.next_seq)
            found.append((self.next_seq, chunk))
            self.next_seq += 1
        return found, ended

    def rest(self) -> str:
        """Text of the chunks that still wait; chunks up to there count as late from now on."""
        text = "".join(self.waiting[k][0] for k in sorted(self.waiting))
        self.next_seq = max([self.next_seq, *(k + 1 for k in self.waiting)])
        self.waiting = {}
        return text


def _load(state) -> dict[str, _Stream]:
    streams = [_Stream(*one) for one in json.loads(state.get[0])] if state.exists else []
    for one in streams:
        one.waiting = {int(k): v for k, v in one.waiting.items()}
    return {one.stream_id: one for one in streams}


def _save(state, streams: dict[str, _Stream], now: int | None) -> None:
    if streams:
        state.update((json.dumps([list(vars(one).values()) for one in streams.values()]),))
        if now is not None:
            state.setTimeoutDuration(max(min(one.until for one in streams.values()) - now, 1))
    elif state.exists:
        state.remove()


def _by_stream(chunks: DataFrame, schema: str, idle_ms: int | None, send, flush) -> DataFrame:
    """Rows that ``send`` (chunks in line, whether the stream ended) and ``flush`` (an idle stream) make of each stream.

    Streams are dealt to GROUPS groups of state, so a call of the stateful step is made for
    thousands of short streams and not for each. A group's chunks of one micro-batch are in
    memory at a time; between micro-batches only what is open is kept. Streams that have
    ended are dropped where there are no idle times.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key, batches, state):
        now = state.getCurrentProcessingTimeMs() if idle_ms else None
        streams, met, rows = _load(state), {}, []
        for batch in () if state.hasTimedOut else batches:
            for name, scope, seq, chunk, last in zip(*(batch[c].tolist() for c in ("stream_id", "scope", "seq", "chunk", "is_last"))):
                if name not in met:
                    met[name] = streams.setdefault(name, _Stream(name))
                met[name].scope = scope
                if seq >= met[name].next_seq:  # repeats are ignored
                    met[name].waiting[seq] = [chunk or "", bool(last)]
        for name, one in met.items():
            ready, ended = one.ready()
            rows.extend(send(one, ready, ended))
            if ended and idle_ms is None:
                del streams[name]
            elif ended:
                one.waiting, one.buffer, one.raw, one.until = {}, "", "", now + LIFETIME_MS
            elif idle_ms:
                one.until = now + idle_ms
        for name, one in list(streams.items()) if idle_ms else ():
            if name not in met and one.until <= now:
                if not (one.buffer or one.raw or any(chunk for chunk, _ in one.waiting.values())):
                    del streams[name]
                    continue
                rows.extend(flush(one))
                one.buffer, one.raw, one.until = "", "", now + LIFETIME_MS
        _save(state, streams, now)
        yield pd.DataFrame(rows, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    group = F.pmod(F.xxhash64("stream_id"), F.lit(GROUPS)).cast("int").alias("_group")
    rows = chunks.select(group, "stream_id", "scope", "seq", "chunk", "is_last")
    return rows.groupBy("_group").applyInPandasWithState(run, schema, _STATE, "append", timeout)


def whole_pieces(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Streaming (stream_id, scope, seq, chunk, is_last) to pieces that cut no token.

    The rest of a stream is sent when its last chunk comes or when it has been idle
    (``idle_ms``; None for inputs that end, as an idle limit keeps a query running). After
    an idle time a stream goes on with its next chunk; chunks up to there count as late.
    """

    def send(one: _Stream, ready: list, ended: bool):
        for seq, chunk in ready:
            out, one.buffer = _cut_tail(one.buffer + chunk)
            if ended and seq == ready[-1][0]:
                out += one.buffer
            if out:
                yield one.stream_id, one.scope, seq, out

    def flush(one: _Stream):
        if left := one.buffer + one.rest():
            # the tail of the last piece bears its number; pieces of one number are in order of their batches
            yield one.stream_id, one.scope, one.next_seq - 1, left

    return _by_stream(chunks, PIECES, idle_ms, send, flush)


DATA_LINE = re.compile(r"^data: (.*)$", re.M)


def _at(node, *path):
    """What lies at a path of names inside parsed JSON; None where the path ends early."""
    for name in path:
        node = node.get(name) if isinstance(node, dict) else None
    return node


class Frame:
    """One event frame: its first data line, read as JSON, and the text around that line."""

    def __init__(self, raw: str):
        self.head, self.data, self.tail = raw, None, ""
        if line := DATA_LINE.search(raw):
            try:
                data = json.loads(line[1])
            except ValueError:
                data = None
            if isinstance(data, dict):
                self.head, self.data, self.tail = raw[: line.start()], data, raw[line.end():]

    @property
    def text(self) -> str | None:
        """The text of a text delta; None for any other frame."""
        kinds = _at(self.data, "type"), _at(self.data, "delta", "type")
        text = _at(self.data, "delta", "text")
        return text if kinds == ("content_block_delta", "text_delta") and isinstance(text, str) else None

    @property
    def opens(self) -> int | None:
        """The number of the text block that starts here."""
        kinds = _at(self.data, "type"), _at(self.data, "content_block", "type")
        index = _at(self.data, "index")
        return index if kinds == ("content_block_start", "text") and isinstance(index, int) else None

    def payload(self) -> str:
        """The data with its text taken out."""
        return json.dumps(self.data | {"delta": self.data["delta"] | {"text": SLOT}}, ensure_ascii=False)


def whole_frames(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Streaming chunks cut anywhere to event frames whose text deltas cut no token.

    Frames end with a blank line. A text delta leaves with its text beside it (see
    ``join_frames``); every other frame leaves as it came.
    """

    def frame_row(one: _Stream, seq: int, raw_frame: str) -> tuple:
        frame = Frame(raw_frame)
        one.block = one.block if frame.opens is None else frame.opens
        out = (raw_frame, None, None, None)
        if frame.text is not None:
            whole, one.buffer = _cut_tail(one.buffer + frame.text)
            out = (frame.head, frame.payload(), whole, frame.tail)
        one.sent += 1
        return one.stream_id, one.scope, seq, one.sent - 1, *out

    def finish(one: _Stream, seq: int):
        if one.raw:
            yield frame_row(one, seq, one.raw)
        if one.buffer and one.block is not None:
            data = {"type": "content_block_delta", "index": int(one.block), "delta": {"type": "text_delta", "text": SLOT}}
            one.sent += 1
            yield (one.stream_id, one.scope, seq, one.sent - 1, "event: content_block_delta\n",
                   json.dumps(data, ensure_ascii=False), one.buffer, "\n\n")

    def send(one: _Stream, ready: list, ended: bool):
        for seq, chunk in ready:
            one.raw += chunk
            while "\n\n" in one.raw:
                frame, _, one.raw = one.raw.partition("\n\n")
                yield frame_row(one, seq, frame + "\n\n")
        if ended:
            yield from finish(one, one.next_seq)

    def flush(one: _Stream):
        seq = one.next_seq
        one.raw += one.rest()
        yield from finish(one, seq)

    return _by_stream(chunks, FRAMES, idle_ms, send, flush)


def join_frames(frames: DataFrame) -> DataFrame:
    """Put each delta's (restored) text back into its frame."""
    as_json = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(as_json, F.lit(6), F.length(as_json) - 6)
    filled = F.concat("head", F.lit("data: "), F.replace(F.col("payload"), F.lit(f'"{SLOT}"'), quoted), "tail")
    return frames.select(
        "stream_id", "scope", "seq", "part",
        F.when(F.col("payload").isNull(), F.col("head")).otherwise(filled).alias("frame"),
    )


def restore_pieces(pieces: DataFrame, token_map: DataFrame) -> DataFrame:
    return restore_text(pieces, token_map, ["stream_id", "seq"])


def restore_frames(frames: DataFrame, token_map: DataFrame) -> DataFrame:
    return join_frames(restore_text(frames, token_map, ["stream_id", "part"]))


def park(pieces: DataFrame, token_map: DataFrame, now: Column, late_ms: int) -> tuple[DataFrame, DataFrame]:
    """(ready, parked) rows of ``pieces`` (with ``since``, when they were first met).

    A piece with a token that the map does not know yet is parked until it is ``late_ms``
    old; then it is ready as it is, and its tokens are not asked for again.
    """
    keys = ["stream_id", "seq"]
    asked = pieces.where(F.col("text").contains("[")).select(*keys, "scope", F.explode(F.array_distinct(placeholders(F.col("text")))).alias("token"))
    unknown = asked.join(token_map.select("scope", "token"), ["scope", "token"], "left_anti").select(*keys).distinct()
    rows = pieces.join(unknown.withColumn("_open", F.lit(True)), keys, "left")
    waits = F.coalesce("_open", F.lit(False)) & (F.col("since") + F.make_dt_interval(secs=F.lit(late_ms / 1000)) > now)
    rows = stage(rows.withColumn("_waits", waits).drop("_open"), "pieces")
    return rows.where(~F.col("_waits")).drop("_waits"), rows.where("_waits").drop("_waits")


def _parked(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """What the batch before ``batch_id`` parked."""
    return spark.read.schema(PIECES + ", since timestamp").parquet(f"{out}-parked/batch_id={batch_id - 1}")


def send_parked(spark: SparkSession, out: str, read_token_map) -> None:
    """After a stream has ended: send what is still parked, with the tokens known now."""
    batches = [int(p.name.split("=")[1]) for p in _folders(spark, f"{out}-parked")]
    if batches:
        last = max(batches)
        rows = restore_pieces(_parked(spark, out, last + 1).drop("since"), read_token_map())
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={last + 1}")


def _folders(spark: SparkSession, path: str):
    from types import SimpleNamespace

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    return [SimpleNamespace(name=f.getPath().getName()) for f in fs.listStatus(place) if f.getPath().getName().startswith("batch_id=")]


def start_restore(
    chunks: DataFrame, read_token_map, out: str, checkpoint: str, framed: bool = False,
    idle_ms: int | None = IDLE_MS, late_ms: int | None = None, **trigger,
):
    """Run the restore stream; ``read_token_map()`` is called for every micro-batch.

    Each micro-batch owns one folder of the output, so a repeated batch replaces itself.
    Its pieces are written down first, so the stateful step runs once a batch. With
    ``late_ms`` (unframed text) pieces wait so long for tokens that come later than the
    text; ``send_parked`` sends the rest when the stream has ended.
    """
    if framed and late_ms is not None:
        raise ValueError("late_ms is for text without frames")
    spark = chunks.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        pieces = stage(batch, "pieces")
        token_map = read_token_map()
        if late_ms is None:
            step = restore_frames if framed else restore_pieces
            step(pieces, token_map).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        else:
            now = spark.sql("SELECT current_timestamp()").first()[0]
            rows = pieces.withColumn("since", F.lit(now))
            if batch_id:
                rows = rows.unionByName(_parked(spark, out, batch_id))
            ready, parked = park(rows, token_map, F.lit(now), late_ms)
            parked.write.mode("overwrite").parquet(f"{out}-parked/batch_id={batch_id}")
            restore_pieces(ready.drop("since"), token_map).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            release(parked, ready)
        release(pieces)

    ends = not trigger or "availableNow" in trigger or "once" in trigger
    idle_ms = None if ends else idle_ms
    whole = whole_frames(chunks, idle_ms) if framed else whole_pieces(chunks, idle_ms)
    return (
        whole.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_restore(chunks: DataFrame, token_map: DataFrame) -> DataFrame:
    """The same result for chunks at rest: whole text per stream, restored once."""
    whole = chunks.groupBy("stream_id", "scope").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), ""
        ).alias("text")
    )
    return restore_text(whole, token_map, ["stream_id"])
