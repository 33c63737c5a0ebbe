"""Streams that pause, go on, repeat themselves, and meet tokens later than the text."""

import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from velum.streaming import restore

CHUNKS = "stream_id string, scope string, seq long, chunk string, is_last boolean"
MAP = "scope string, token string, value string"


def append(spark, folder, rows):
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(folder))


def texts(spark, out, framed=False):
    try:
        rows = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").collect()
    except AnalysisException:  # nothing yet, or a batch that is being written
        return {}
    whole = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["batch_id"]) if framed else (r["seq"], r["batch_id"])):
        whole[r["stream_id"]] = whole.get(r["stream_id"], "") + r["frame" if framed else "text"]
    return whole


def wait_for(test, seconds=60):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.3)
    assert test()


@pytest.mark.parametrize("framed", [False, True])
def test_resume_after_idle(spark, tmp_path, framed):
    """The open tail is sent after the pause; the next chunk goes on, repeats stay out."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    token_map = spark.createDataFrame([("u", "[EMAIL_1]", "a@b.ch")], MAP).cache()
    if framed:
        first, second = "data: one\n\ndata: tw", "o\n\ndata: three\n\n"
        before, after = "data: one\n\ndata: tw", "data: one\n\ndata: two\n\ndata: three\n\n"
    else:
        first, second = "x [EMAIL_1] and [EMA", " then [EMAIL_1]"
        before, after = "x a@b.ch and [EMA", "x a@b.ch and [EMA then a@b.ch"
    append(spark, folder, [("s", "u", 0, first, False)])
    source = spark.readStream.schema(CHUNKS).parquet(str(folder))
    running = restore.start_restore(source, lambda: token_map, out, str(tmp_path / "state"), framed=framed, idle_ms=1500, processingTime="300 milliseconds")
    try:
        wait_for(lambda: texts(spark, out, framed).get("s") == before)
        append(spark, folder, [("s", "u", 0, "again", False), ("s", "u", 1, second, True)])
        wait_for(lambda: texts(spark, out, framed).get("s") == after)
        append(spark, folder, [("s", "u", 1, second, True), ("t", "u", 0, first, True)])
        wait_for(lambda: "t" in texts(spark, out, framed))
        assert texts(spark, out, framed)["s"] == after, "a repeat after the end stays out"
    finally:
        running.stop()


def test_tokens_later_than_their_text(spark, tmp_path):
    """Parked until the token comes or the delay is over; a second look is not taken after that."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    tokens = [("u", "[EMAIL_1]", "a@b.ch")]
    read = lambda: spark.createDataFrame(tokens, MAP)

    def run(rows, late_ms):
        append(spark, folder, rows)
        source = spark.readStream.schema(CHUNKS).parquet(str(folder))
        restore.start_restore(source, read, out, str(tmp_path / "state"), late_ms=late_ms).awaitTermination()

    run([("s", "u", 0, "known [EMAIL_1].", False), ("s", "u", 1, "late [EMAIL_2]!", False), ("t", "u", 0, "plain [1, 2]", False)], 3_600_000)
    assert texts(spark, out) == {"s": "known a@b.ch.", "t": "plain [1, 2]"}
    tokens.append(("u", "[EMAIL_2]", "c@d.ch"))
    run([("s", "u", 2, "never [EMAIL_3]", False)], 3_600_000)
    assert texts(spark, out)["s"] == "known a@b.ch.late c@d.ch!"
    run([("s", "u", 3, ", end", True)], 0)
    assert texts(spark, out)["s"] == "known a@b.ch.late c@d.ch!never [EMAIL_3], end"
    run([("v", "u", 0, "open [EMAIL_4]", True)], 3_600_000)
    tokens.append(("u", "[EMAIL_3]", "too late"))
    tokens.append(("u", "[EMAIL_4]", "g@h.ch"))
    assert "v" not in texts(spark, out)
    restore.send_parked(spark, out, read)
    assert texts(spark, out)["v"] == "open g@h.ch"
    assert texts(spark, out)["s"].endswith("never [EMAIL_3], end")


def test_the_stateful_step_runs_once_a_batch(spark, tmp_path):
    """Chunks are read once: an accumulator in the source counts them."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    append(spark, folder, [(f"s{i}", "u", 0, "x [EMAIL_1]", True) for i in range(50)])
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(chunk):
        met.add(1)
        return chunk

    source = spark.readStream.schema(CHUNKS).parquet(str(folder)).withColumn("chunk", seen("chunk"))
    token_map = spark.createDataFrame([("u", "[EMAIL_1]", "a@b.ch")], MAP)
    restore.start_restore(source, lambda: token_map, out, str(tmp_path / "state")).awaitTermination()
    assert met.value == 50 and set(texts(spark, out).values()) == {"x a@b.ch"}


def test_the_stateful_step_is_called_for_groups_of_streams(spark, tmp_path, monkeypatch):
    """Many short streams share a call; those left open go on in the next micro-batch, in any group."""
    monkeypatch.setattr(restore, "GROUPS", 3)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    calls = spark.sparkContext.accumulator(0)
    load = restore._load

    def counted(state):
        calls.add(1)
        return load(state)

    monkeypatch.setattr(restore, "_load", counted)
    token_map = spark.createDataFrame([("u", "[EMAIL_1]", "a@b.ch")], MAP)
    names = [f"s{i}" for i in range(40)]

    def run(rows):
        append(spark, folder, rows)
        source = spark.readStream.schema(CHUNKS).parquet(str(folder))
        restore.start_restore(source, lambda: token_map, out, str(tmp_path / "state")).awaitTermination()

    run([(n, "u", seq, chunk, False) for n in names for seq, chunk in ((0, "x [EM"), (2, "_1] z"))])
    run([(n, "u", 1, "AIL", n == "none") for n in names] + [(n, "u", 0, "again", False) for n in names] + [(n, "u", 3, " [", True) for n in names[::2]])
    assert texts(spark, out) == {n: "x a@b.ch z" + (" [" if n in names[::2] else "") for n in names}
    assert calls.value <= 6
