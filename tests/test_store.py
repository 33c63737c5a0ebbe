"""The token store: state before a batch, ends, compaction, pruning by bucket."""

import glob

import pytest
from pyspark.sql import functions as F

from velum.operators.store import TokenStore
from velum.streaming import mask as stream_mask

MAP = "scope string, label string, n bigint, token string, value string"


def rows(spark, *values):
    return spark.createDataFrame([(s, "EMAIL", n, f"[EMAIL_{n}]", v) for s, n, v in values], MAP)


def held(store, before):
    return sorted((r.scope, r.n, r.value) for r in store.live(before).collect())


def test_states_before_each_batch(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path / "s"), 8)
    assert store.next_batch() == 0 and held(store, 0) == [] and store.marks(0).count() == 0
    store.append(0, rows(spark, ("a", 1, "x"), ("b", 1, "y")))
    store.append(1, rows(spark, ("a", 2, "z")))
    assert held(store, 1) == [("a", 1, "x"), ("b", 1, "y")]
    store.erase(["a"])
    store.erase(["never met"])
    assert held(store, 2) == [("b", 1, "y")]
    assert held(store, 1) == [("a", 1, "x"), ("b", 1, "y")], "a batch run again sees what it saw"
    store.append(2, rows(spark, ("a", 3, "x")))
    assert held(store, 3) == [("a", 3, "x"), ("b", 1, "y")]
    store.append(2, rows(spark, ("a", 3, "w")))
    assert held(store, 3) == [("a", 3, "w"), ("b", 1, "y")], "a batch run again replaces its own rows"
    before = held(store, 3), sorted(map(tuple, store.marks(3).collect()))
    store.compact(2)
    assert (held(store, 3), sorted(map(tuple, store.marks(3).collect()))) == before
    store.erase(["b"])  # after the base, before batch 3
    store.vacuum()
    assert held(store, 3) == [("a", 3, "w")]
    assert {(r.scope, r.n) for r in store.marks(3).collect()} == {("a", 3), ("b", 1)}
    files = glob.glob(str(tmp_path / "s" / "**" / "*.parquet"), recursive=True)
    values = {r.value for f in files if "/tokens/" in f for r in spark.read.parquet(f).select("value").collect()}
    assert values == {"w", "y"}, "erased values are gone from the disk"


def test_unfinished_folders_do_not_count(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path / "s"), 4)
    store.append(0, rows(spark, ("a", 1, "x")))
    store.append(1, rows(spark, ("a", 2, "y")))
    (tmp_path / "s" / "tokens" / "batch_id=1" / "_SUCCESS").unlink()
    assert held(store, 5) == [("a", 1, "x")]
    store.compact(0)
    (tmp_path / "s" / "base" / "upto=0" / "marks" / "_SUCCESS").unlink()
    assert store._base(9) is None and held(store, 5) == [("a", 1, "x")]


def test_reads_buckets_of_the_batch_only(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path / "s"), 16)
    store.append(0, rows(spark, *[(f"scope{i}", 1, "v") for i in range(40)]))
    buckets = store.buckets_of(spark.createDataFrame([("scope3",), ("scope3",)], "scope string"))
    assert len(buckets) == 1
    found = store.live(1, buckets)
    assert "scope3" in {r.scope for r in found.collect()} and found.count() < 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_expiry_follows_the_last_new_token(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path / "s"), 4)
    at = lambda text: F.lit(text).cast("timestamp")
    store.append(0, rows(spark, ("a", 1, "x"), ("b", 1, "y")), at("2024-01-01 00:00:00"))
    store.append(1, rows(spark, ("b", 2, "z")), at("2024-01-01 20:00:00"))
    store.expire(at("2024-01-02 10:00:00"))
    assert held(store, 2) == [("b", 1, "y"), ("b", 2, "z")]
    store.expire(at("2024-01-09 10:00:00"))
    assert held(store, 2) == []
    assert {(r.scope, r.n) for r in store.marks(2).collect()} == {("a", 1), ("b", 2)}


@pytest.mark.parametrize("compact_every", [1, 100])
def test_stream_never_reuses_numbers(spark, tmp_path, compact_every):
    """Erased between batches and met again, a value gets a new number; a batch run again gives the same."""
    out = str(tmp_path / "out")
    store = stream_mask.token_store(spark, out)

    def run(k, *texts):
        docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id int, scope string, text string")
        stream_mask.mask_batch(docs, k, out, "scope", compact_every=compact_every)
        batch = spark.read.parquet(f"{out}/masked/batch_id={k}")
        return [r.text for r in batch.orderBy("doc_id").collect()]

    assert run(0, "a@b.ch", "c@d.ch") == ["[EMAIL_1]", "[EMAIL_2]"]
    assert run(1, "c@d.ch e@f.ch") == ["[EMAIL_2] [EMAIL_3]"]
    store.erase(["s"])
    assert run(2, "c@d.ch", "a@b.ch") == ["[EMAIL_4]", "[EMAIL_5]"]
    assert run(2, "c@d.ch", "a@b.ch") == ["[EMAIL_4]", "[EMAIL_5]"]
    assert run(3, "a@b.ch g@h.ch") == ["[EMAIL_5] [EMAIL_6]"]
