"""Span conflicts, rebuilt texts and corpus-wide containment against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from velum.functions.patterns import DetectorConfig, Pattern
from velum.operators.containment import contained_values, leak_check_scope, unresolved_texts
from velum.operators.detect import detect_entities
from velum.operators.mask import hide_placeholders, mask_documents
from velum.operators.spans import rebuild_text, resolve_spans
from velum.operators.tokens import restore_text

SPANS = "doc_id int, start int, end int, value string, label string, source string, score double, prio int"


def greedy(spans):
    chosen = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], s[7], s[1], -s[6], s[4], s[5], s[3])):
        if s[2] > s[1] and not any(c[1] < s[2] and s[1] < c[2] for c in chosen):
            chosen.append(s)
    return chosen


def test_resolve_and_rebuild(spark):
    """Overlapping, nested, equal, touching and empty spans; every text is rebuilt from what is left."""
    rng = random.Random(5)
    texts = {d: "".join(rng.choice("abcé😀 ") for _ in range(60)) for d in range(12)}
    rows = []
    for d, t in texts.items():
        for _ in range(rng.choice([0, 1, 25])):
            a = rng.randrange(60)
            b = min(60, a + rng.choice([0, 1, 2, 5, 9]))
            rows.append((d, a, b, t[a:b], rng.choice("XY"), "pattern", 0.5, rng.randrange(3)))
    rows += [(11, 0, 5, texts[11][:5], "X", "pattern", 0.5, 1), (11, 0, 5, texts[11][:5], "X", "model", 0.5, 9)]
    left = resolve_spans(spark.createDataFrame(rows, SPANS), ["doc_id"])
    want = [s for d in texts for s in greedy([r for r in rows if r[0] == d])]
    assert sorted(map(tuple, left.collect())) == sorted(want)
    docs = spark.createDataFrame([*texts.items(), (99, None)], "doc_id int, text string")
    got = dict(rebuild_text(docs, left.withColumn("put", F.concat(F.lit("<"), "label", F.lit(">"))), ["doc_id"]).collect())
    for d, t in texts.items():
        for s in sorted((s for s in want if s[0] == d), key=lambda s: -s[1]):
            t = t[: s[1]] + f"<{s[4]}>" + t[s[2]:]
        assert got[d] == t
    assert got[99] is None


def test_overlapping_puts_stop_the_job(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id int, text string")
    puts = spark.createDataFrame([(1, 0, 3, "x"), (1, 2, 4, "y")], "doc_id int, start int, end int, put string")
    with pytest.raises(Exception, match="spans overlap"):
        rebuild_text(docs, puts, ["doc_id"]).collect()


def test_positions_hold_beside_placeholders(spark):
    docs = spark.createDataFrame([(1, "[PERSONNE_12] mail a@b.ch [EMAIL_1] c@d.ch")], "doc_id int, text string")
    for r in detect_entities(docs, ["doc_id"], hide_placeholders(F.col("text"))).collect():
        assert docs.first().text[r.start : r.end] == r.value


@pytest.mark.parametrize("by_position", [False, True])
def test_two_detectors_count_one_span(spark, by_position):
    docs = spark.createDataFrame([(1, "s", "mail a@b.ch, a@b.ch"), (2, "s", "none")], "doc_id int, scope string, text string")
    model = spark.createDataFrame(
        [("s", 1, 5, 11, "a@b.ch", "EMAIL", "model", 0.9, 1000)],
        "scope string, doc_id int, start int, end int, value string, label string, source string, score double, prio int")
    result = mask_documents(docs, "scope", model_spans=model, by_position=by_position)
    assert result.findings.count() == 2
    assert {r.source for r in result.findings.collect()} == {"pattern"}
    assert dict(result.rows.select("doc_id", "text").collect()) == {1: "mail [EMAIL_1], [EMAIL_1]", 2: "none"}


def test_masking_by_position_restores(spark):
    """Of nested and overlapping finds the longest is masked; restoring gives the texts back."""
    patterns = (Pattern("A", r"[0-9]{4}", "ID"), Pattern("B", r"x[0-9]{6}", "POLICE"), Pattern("C", r"[0-9]{2} y", "CONTRAT"))
    docs = spark.createDataFrame([(1, "s", "x123456 y 1234"), (2, "s", "99 y 123456")], "doc_id int, scope string, text string")
    config = DetectorConfig(patterns=patterns)
    result = mask_documents(docs, "scope", config=config, by_position=True)
    assert dict(result.rows.select("doc_id", "text").collect()) == {1: "[POLICE_1] y [ID_1]", 2: "[CONTRAT_1] [ID_1]56"}
    back = restore_text(result.rows, result.token_map, ["doc_id"])
    assert sorted(back.select("doc_id", "text").collect()) == sorted(docs.select("doc_id", "text").collect())


def test_containment(spark):
    """All places of all values of a scope, over block borders, any alphabet, values of one sign to thirty times two."""
    rng = random.Random(3)
    texts = [(i, rng.choice(["a", "b", None]), "".join(rng.choice("abé😀") for _ in range(rng.randrange(400)))) for i in range(60)]
    texts += [(98, "a", None), (99, "a", "ab" * 140_000 + "zq")]
    values = [(rng.choice(["a", "b", None]), "".join(rng.choice("abé😀") for _ in range(rng.choice([3, 4, 5, 8, 9, 16])))) for _ in range(80)]
    values += [("a", None), ("a", ""), ("a", "ba" * 30 + "b" + "zq"), ("a", "bzq"), ("a", "bzq"), ("b", "x")]
    t = spark.createDataFrame(texts, "id int, scope string, text string")
    v = spark.createDataFrame(values, "scope string, value string")
    want = set()
    for i, scope, text in texts:
        for of, value in set(values):
            at = text.find(value) if scope and text and value and of == scope else -1
            while at >= 0:
                want.add((scope, i, at, value))
                at = text.find(value, at + 1)
    got = contained_values(t, v, ["id"]).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert {r.id for r in unresolved_texts(t, v, ["id"]).collect()} == {i for i, _, _ in texts} - {w[1] for w in want}
    assert contained_values(t, v.where("scope = 'none'"), ["id"]).count() == 0


def test_leak_from_another_document(spark):
    docs = spark.createDataFrame(
        [(1, "s", "mail a@b.ch"), (2, "s", "no at sign: a_b.ch"), (3, "other", "card 1234123412341234")], "doc_id int, scope string, text string")
    result = mask_documents(docs, "scope")
    token_map = result.token_map.cache()
    assert leak_check_scope(result.rows, token_map, ["doc_id"]).count() == 0
    planted = result.rows.withColumn("text", F.concat("text", F.when(F.col("doc_id") == 2, "xa@b.chx a@b.ch").otherwise(" 1234123412341234 a@b.ch")))
    leaks = leak_check_scope(planted, token_map, ["doc_id"]).collect()
    assert sorted(map(tuple, leaks)) == [("other", 3, "1234123412341234", 1), ("s", 1, "a@b.ch", 1), ("s", 2, "a@b.ch", 2)]
    # what a map of another scope knows is no leak here


def test_containment_is_spread_over_tasks(spark, tmp_path):
    """Texts of one file with one row group are searched by several tasks."""
    from velum.session import spread

    path = str(tmp_path / "one")
    spark.range(400).selectExpr("id", "'s' AS scope", "concat('see v', id) AS text").coalesce(1).write.parquet(path)
    texts = spark.read.parquet(path)
    assert texts.rdd.getNumPartitions() == 1 and spread(texts).rdd.getNumPartitions() == 4
    values = spark.createDataFrame([("s", "v39"), ("s", "v7"), ("t", "v1")], "scope string, value string")
    got = contained_values(texts, values, ["id"])
    want = sorted((i, v) for i in range(400) for v in ("v39", "v7") if v in f"see v{i}")
    assert sorted((r.id, r.value) for r in got.collect()) == want
