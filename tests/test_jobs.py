"""Whole jobs: properties, brute-force comparison, skew, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from velum.functions.patterns import DetectorConfig, Pattern
from velum.operators import audit, chat, columns, corpus, detect, kb, mask, payloads, registry, tokens
from velum.operators.query import masked_query
from velum.plans.text import lexicon_model
from velum.sources import catalog
from velum.streaming import mask as stream_mask
from velum.streaming import bursts, restore
from tests_helpers import feed, lexicon


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, scope string, text string")


def random_docs(spark, n=200, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = ["lorem"] * rng.randint(0, 5)
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice([f"u{rng.randint(0, 9)}@example.com", f"10.0.0.{rng.randint(1, 9)}", "ipsum"]))
        rng.shuffle(parts)
        rows.append((i, "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 3)}", " ".join(parts)))
    return docs(spark, rows)


def test_restore_undoes_mask_and_nothing_leaks(spark):
    source = random_docs(spark)
    result = mask.mask_documents(source, "scope")
    assert tokens.leak_check(result.rows, result.findings, ["doc_id"]).count() == 0
    back = tokens.restore_text(result.rows, result.token_map, ["doc_id"])
    assert back.exceptAll(source).count() == 0 and back.count() == source.count()
    assert result.rows.exceptAll(source).count() > 0


def test_large_map_path_gives_the_same_text(spark):
    source = random_docs(spark)
    small = {tuple(r) for r in mask.mask_documents(source, "scope").rows.collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = {tuple(r) for r in mask.mask_documents(source, "scope").rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert small == large


def test_null_scope_stops_the_job(spark):
    with pytest.raises(Exception, match="NULL in scope"):
        mask.mask_documents(docs(spark, [(1, None, "a@b.ch")]), "scope").rows.collect()


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_numbers_do_not_depend_on_partitions(spark, partitions):
    rows = [("hot" if i % 3 else f"s{i % 5}", i, f"v{i % 700}", "A" if i % 2 else "B") for i in range(2000)]
    findings = spark.createDataFrame(rows, "scope string, doc_id bigint, value string, label string").withColumns(
        {"ord": F.lit(0), "start": F.lit(0), "prio": F.lit(0)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r["scope"], r["value"]): r["token"] for r in tokens.assign_tokens(findings).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    counts, want = {}, {}
    for scope, _, value, label in rows:
        if (scope, value) not in want:
            counts[scope, label] = counts.get((scope, label), 0) + 1
            want[scope, value] = f"[{label}_{counts[scope, label]}]"
    assert got == want


def test_tokens_stay_across_runs_and_first_label_wins(spark):
    schema = "scope string, doc_id bigint, ord int, start int, prio int, value string, label string"
    first = spark.createDataFrame([("u", 1, 0, 5, 0, "x", "A"), ("u", 1, 0, 0, 0, "y", "A"), ("u", 2, 0, 0, 0, "x", "B")], schema)
    one = tokens.assign_tokens(first)
    assert {r["value"]: r["token"] for r in one.collect()} == {"y": "[A_1]", "x": "[A_2]"}
    second = spark.createDataFrame([("u", 3, 0, 0, 0, "x", "B"), ("u", 3, 0, 9, 0, "z", "A")], schema)
    assert [(r["value"], r["token"]) for r in tokens.assign_tokens(second, one).collect()] == [("z", "[A_3]")]


def test_model_hook_and_dedupe(spark):
    texts = docs(spark, [(1, "u", "Hein writes to a@b.ch"), (2, "u", None)])
    model = detect.detect_with_model(texts, ["scope", "doc_id"], lexicon_model())
    assert [(r["value"], r["label"], r["source"]) for r in model.collect()] == [("Hein", "PERSONNE", "model")]
    result = mask.mask_documents(texts.where("text IS NOT NULL"), "scope", model_spans=model)
    assert result.rows.first()["text"] == "[PERSONNE_1] writes to [EMAIL_1]"
    config = DetectorConfig(active_labels=("EMAIL",))
    assert detect.detect_with_model(texts, ["doc_id"], lexicon_model(), config=config).count() == 0


def test_embedded_statements_in_prose(spark):
    text = "Please run INSERT INTO c (nom, ville) VALUES ('Jean Rex', 'Bern'); then mail a@b.ch about Bern."
    result = mask.mask_documents(docs(spark, [(1, "u", text)]), "scope", kb=lexicon(spark))
    assert result.rows.first()["text"] == (
        "Please run INSERT INTO c (nom, ville) VALUES ('[PERSONNE_1]', '[LOCALISATION_1]'); then mail [EMAIL_1] about Bern.")


def test_public_columns_keep_their_value_but_not_identifiers(spark):
    body = json.dumps({"segment": "blue 756.1234.5678.97", "nom": "Jean", "status": "open"})
    rows = docs(spark, [(1, "u", body)])
    out = json.loads(payloads.mask_payloads(rows, lexicon(spark)).rows.first()["text"])
    assert out == {"segment": "blue [AVS_1]", "nom": "[PERSONNE_1]", "status": "open"}


def test_payload_classifier_and_nested_cells(spark):
    rows = docs(spark, [(i, "u", json.dumps({"kontakt_x": f"079 123 45 6{i}", "w": f"m{i}@a.example", "n": i})) for i in range(4)]
                + [(9, "u", "INSERT INTO c (nom, blob) VALUES ('Rex', '{\"nom\": \"Max\"}')")])
    result = payloads.mask_payloads(rows, lexicon(spark))
    texts = {r["doc_id"]: r["text"] for r in result.rows.collect()}
    assert texts[9] == "INSERT INTO c (nom, blob) VALUES ('[PERSONNE_1]', '{\"nom\": \"[PERSONNE_2]\"}')"
    assert all("example" not in t and "079" not in t for t in texts.values())
    assert {r["label"] for r in result.suggestions.collect()} == {"TEL"}
    again = payloads.mask_payloads(rows, lexicon(spark), config=DetectorConfig(classifier_enabled=False))
    assert {r["source"] for r in again.findings.collect()} <= {"kb_exact", "pattern"}


def test_quarantine_limit(spark):
    rows = docs(spark, [(1, "u", '{"nom": '), (2, "u", "fine")])
    result = payloads.mask_payloads(rows, lexicon(spark))
    assert [r["doc_id"] for r in result.quarantine.collect()] == [1]
    with pytest.raises(RuntimeError):
        payloads.check_quarantine(result.rows, result.quarantine, 0.1)
    payloads.check_quarantine(result.rows, result.quarantine, 0.5)


def brute_fuzzy(header, known, threshold=88.0):
    from test_functions import brute_lcs

    scores = sorted(((200.0 * brute_lcs(header, k) / (len(header) + len(k)), k) for k in known), key=lambda s: (-s[0], s[1]))
    if not scores or scores[0][0] < threshold:
        return None
    if len(scores) > 1 and scores[1][0] >= threshold and scores[0][0] - scores[1][0] <= 3:
        return None
    return scores[0][1]


def test_fuzzy_join_misses_nothing(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abcd_") for _ in range(rng.randint(1, 24))).strip("_") or "a" for _ in range(80)})
    asked = set()
    for word in known:
        letters = list(word)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(letters) + 1)
            if rng.random() < 0.5 and letters:
                letters.pop(min(at, len(letters) - 1))
            else:
                letters.insert(at, rng.choice("abcd"))
        asked.add("".join(letters).strip("_") or "b")
    base = kb.new_rows(spark.createDataFrame([(k, "X") for k in known], "header_raw string, label string"))
    heads = spark.createDataFrame([(a,) for a in asked], "header_norm string")
    norm = [r["header_norm"] for r in base.select("header_norm").distinct().collect()]
    got = {r["header_norm"]: r["kb_header"] for r in kb.fuzzy_headers(heads, base).collect()}
    want = {a: brute_fuzzy(a, norm) for a in asked}
    assert got == {a: k for a, k in want.items() if k}


@pytest.mark.parametrize(
    "header, match",
    [("telefon_nummer", "telefonnummer"), ("emai", "email"), ("emial", None), ("zzz", None), ("adress", "address"), ("adresse", "adresse")],
)
def test_fuzzy_cases(spark, header, match):
    heads = spark.createDataFrame([(header,)], "header_norm string")
    got = kb.fuzzy_headers(heads, lexicon(spark)).first()
    want = brute_fuzzy(header, [r["header_norm"] for r in lexicon(spark).select("header_norm").distinct().collect()])
    assert (got and got["kb_header"]) == want
    if match is None:
        assert got is None


def test_snapshot_publish_and_refresh(spark, tmp_path):
    root = str(tmp_path / "kb")
    reader = kb.SnapshotReader(spark, root)
    assert reader.refresh() is False
    rows = kb.snapshot_rows(lexicon(spark), spark.createDataFrame([], "name string, regex string, label string, score double, active boolean, source string"))
    version = kb.publish(rows, root)
    assert reader.refresh() is True and reader.version == version and reader.refresh() is False
    assert kb.publish(rows, root) == version
    other = kb.publish(rows.limit(5), root)
    assert other != version and reader.refresh() is True and reader.rows.count() == 5
    shuffled = rows.orderBy(F.desc("item"))
    assert kb.version_of(shuffled).first()["version"] == version


def test_chat_bodies(spark):
    body = {"system": "mail s@x.ch", "messages": [
        {"role": "user", "content": "mail a@b.ch"},
        {"role": "user", "content": [
            {"type": "text", "text": "again a@b.ch and [EMAIL_7]"},
            {"type": "tool_use", "input": {"a@b.ch": ["c@d.ch", 3, {"x": "a@b.ch"}]}},
            {"type": "tool_result", "content": [{"type": "text", "text": "e@f.ch"}, {"type": "other", "text": "q@r.ch"}]},
            {"type": "thinking", "text": "a@b.ch"}]}]}
    refused = {"messages": [{"role": "user", "content": [{"type": "image", "source": "..."}]}]}
    rows = spark.createDataFrame([(1, "u", json.dumps(body)), (2, "u", json.dumps(refused)), (3, "u", "{broken")],
                                 "body_id bigint, scope string, body string")
    result = chat.mask_bodies(rows)
    out = {r["body_id"]: r["body"] for r in result.rows.collect()}
    assert set(out) == {1}
    got = json.loads(out[1])
    assert got["system"] == "mail [EMAIL_1]" and got["messages"][0]["content"] == "mail [EMAIL_2]"
    blocks = got["messages"][1]["content"]
    assert blocks[0]["text"] == "again [EMAIL_2] and [EMAIL_7]"
    assert blocks[1]["input"] == {"a@b.ch": ["[EMAIL_3]", 3, {"x": "[EMAIL_2]"}]}
    assert blocks[2]["content"] == [{"type": "text", "text": "[EMAIL_4]"}, {"type": "other", "text": "q@r.ch"}]
    assert blocks[3]["text"] == "a@b.ch"
    assert sorted((r["body_id"], r["reason"]) for r in result.refused.collect()) == [(2, "unsupported block: image"), (3, "no json")]
    assert [r["body_id"] for r in chat.unreadable(rows).collect()] == [3]
    kept = json.loads(chat.mask_bodies(rows, mask_system=False).rows.first()["body"])
    assert kept["system"] == "mail s@x.ch" and kept["messages"][0]["content"] == "mail [EMAIL_1]"


def test_odd_bodies_are_refused(spark):
    odd = ['{"messages": null}', '{"prompt": "a@b.ch"}', '{"messages": ["a@b.ch"]}', "[1]", '{"messages": [null]}']
    fine = ['{"messages": []}', '{"messages": [{"role": "user"}]}', '{"messages": [{"role": "user", "content": null}]}']
    rows = spark.createDataFrame([(i, "u", b) for i, b in enumerate(odd + fine)], "body_id bigint, scope string, body string")
    result = chat.mask_bodies(rows)
    assert {r["body_id"] for r in result.refused.collect()} == set(range(len(odd)))
    assert [r["body"] for r in result.rows.orderBy("body_id").collect()] == fine


def test_files_inside_chats_are_read_by_field(spark):
    def body(text):
        return json.dumps({"messages": [{"role": "user", "content": [{"type": "tool_result", "content": text}]}]})

    texts = ["nom,ville,x\nJean Rex,Bern,1\n", json.dumps({"nom": "Max \"M\" Muster", "n": 1}),
             "please run UPDATE c SET nom = 'Eva; Rex' WHERE n = 1; thanks"]
    rows = spark.createDataFrame([(i, "u", body(t)) for i, t in enumerate(texts)], "body_id bigint, scope string, body string")
    out = [r["body"] for r in chat.mask_bodies(rows, kb=lexicon(spark)).rows.orderBy("body_id").collect()]
    assert not any(name in b for b in out for name in ("Jean", "Bern", "Muster", "Eva"))
    assert json.loads(json.loads(out[1])["messages"][0]["content"][0]["content"])["n"] == 1


def test_all_statements_of_a_script_are_masked(spark):
    text = "INSERT INTO c (nom) VALUES ('Jean Rex'); INSERT INTO c (nom) VALUES ('Max; O''Muster');\nUPDATE c SET nom = 'Eva' WHERE n = 2"
    out = payloads.mask_payloads(docs(spark, [(1, "u", text)]), lexicon(spark)).rows.first()["text"]
    assert out == ("INSERT INTO c (nom) VALUES ('[PERSONNE_1]'); INSERT INTO c (nom) VALUES ('[PERSONNE_2]');\n"
                   "UPDATE c SET nom = '[PERSONNE_3]' WHERE n = 2")


def test_ids_repeated_over_scopes_and_inside_one(spark):
    rows = docs(spark, [(1, "a", "x@a.ch"), (1, "b", "y@a.ch"), (1, "b2", "z@a.ch")])
    got = mask.mask_columns(rows, "doc_id", "scope", {"text": "EMAIL"}).rows
    assert sorted(map(tuple, got.collect())) == [(1, "a", "[EMAIL_1]"), (1, "b", "[EMAIL_1]"), (1, "b2", "[EMAIL_1]")]
    twice = docs(spark, [(1, "a", "nom,x,y\nJean,1,2\n"), (1, "a", "nom,x,y\nMax,1,2\n")])
    with pytest.raises(Exception, match="key repeated"):
        payloads.mask_payloads(twice, lexicon(spark)).rows.collect()
    with pytest.raises(Exception, match="key repeated"):
        mask.mask_columns(twice, "doc_id", "scope", {"text": "EMAIL"}).rows.collect()


def test_pattern_table_as_configuration(spark):
    from velum.functions.patterns import PATTERN_SCHEMA, load_patterns

    rows = [("a", r"\bX-[0-9]{4}\b", "POLICE", 0.9, True, "manual"), ("b", "(a)?(?(1)b|c)", "ID", 0.9, True, "manual"),
            ("c", "off", "ID", 0.9, False, "manual"), ("d", r"\p{Nope}", "ID", 0.9, True, "manual")]
    with pytest.warns(UserWarning, match="patterns refused: b .*d "):
        loaded = load_patterns(spark.createDataFrame(rows, PATTERN_SCHEMA))
    assert [p.name for p in loaded] == ["a"]
    config = DetectorConfig(patterns=tuple(loaded))
    assert mask.mask_documents(docs(spark, [(1, "u", "see X-1234")]), "scope", config=config).rows.first()["text"] == "see [POLICE_1]"


def test_masked_query(spark):
    spark.createDataFrame([("Zoe", "a@b.ch", 2), ("Al", "none", 5)], "nom string, memo string, n int").createOrReplaceTempView("people")
    rows = masked_query(spark, "select nom, memo, n from people order by n desc;", lexicon(spark)).rows.collect()
    assert sorted(map(tuple, rows)) == sorted([("[PERSONNE_1]", "none", 5), ("[PERSONNE_2]", "[EMAIL_1]", 2)])
    with pytest.raises(PermissionError):
        masked_query(spark, "drop table people", lexicon(spark))


def test_suggested_patterns_are_found_again(spark):
    schema = "db string, table string, column string, regex string, label string, confidence double"
    scan = spark.createDataFrame([("d", "t" * 70, "c", r"\bX-\d{4}\b", None, 0.914), ("d", "t", "c", "(a+)+", "ID", 0.9)], schema)
    stored = spark.createDataFrame([], "name string, regex string, label string, score double, active boolean, source string")
    row = registry.suggest_patterns(scan, stored).collect()
    assert len(row) == 1 and len(row[0]["name"]) == 64 and row[0]["label"] == "POLICE" and row[0]["score"] == 0.91 and not row[0]["active"]
    custom = DetectorConfig(patterns=(Pattern("x", row[0]["regex"], "POLICE"),))
    assert detect.detect_entities(docs(spark, [(1, "u", "a X-1234 b")]), ["doc_id"], config=custom).count() == 1


def test_inventory_lists_views(spark):
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("v_one")
    rows = catalog.column_inventory(spark, ["default"]).where("table = 'v_one'").collect()
    assert {(r["column"], r["sql_type"], r["object_type"]) for r in rows} == {("k", "int", "view"), ("v", "string", "view")}
    assert catalog.jdbc_url("postgresql", host="h", port="1", db="d") == "jdbc:postgresql://h:1/d"


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "nom", "mask_name", ['Jean "J" Rex']), (2, "x", "keep", ["y"]), (3, "c", "mask_id", [".", "A-1"]), (4, "d", "mask_id", [" "])],
        "id int, column string, strategy string, values array<string>")
    made = corpus.ner_examples(rows, ["id"], ("{column} : {value}",))
    got = {r["id"]: (r["tokens"], tuple(r["ner"][0])) for r in made.collect()}
    assert got[1] == (["nom", ":", "Jean", '"', "J", '"', "Rex"], (2, 6, "PERSON"))
    assert set(got) == {1, 3}
    path = str(tmp_path / "corpus")
    corpus.write_examples(made.select("tokens", "ner"), path)
    back = corpus.read_examples(spark, path)
    assert {json.dumps(r.asDict(True)) for r in back.collect()} == {json.dumps(r.asDict(True)) for r in made.select("tokens", "ner").collect()}


# ---- streams ---------------------------------------------------------------------


def run_restore(spark, tmp_path, batches, token_map, framed=False):
    schema = "stream_id string, scope string, seq long, chunk string, is_last boolean"
    source = feed(spark, tmp_path / "in", schema, batches)
    out = str(tmp_path / "out")
    restore.start_restore(source, lambda: token_map, out, str(tmp_path / "state"), framed=framed).awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").collect()
    text, order = ("frame", "part") if framed else ("text", "seq")
    whole = {}
    for r in sorted(rows, key=lambda r: r[order]):
        whole[r["stream_id"]] = whole.get(r["stream_id"], "") + r[text]
    return whole


def test_stream_restores_cut_tokens_late_and_repeated_chunks(spark, tmp_path):
    token_map = spark.createDataFrame(
        [("u", "[PERSONNE_1]", "Jo"), ("u", "[PERSONNE_10]", "Al")], "scope string, token string, value string")
    first = [("a", "u", 0, "Hi [PERS", False), ("a", "u", 2, "0], list [", False), ("b", "u", 0, "x [", False)]
    second = [("a", "u", 1, "ONNE_1", False), ("a", "u", 1, "ONNE_1", False), ("b", "u", 1, "1, 2] [PERSONNE_1][TEL_3] [PER", True)]
    third = [("a", "u", 3, "3] end [PERSONNE_1]", True)]
    got = run_restore(spark, tmp_path, [first, second, third], token_map)
    assert got == {"a": "Hi Al, list [3] end Jo", "b": "x [1, 2] Jo[TEL_3] [PER"}


def test_framed_stream(spark, tmp_path):
    token_map = spark.createDataFrame([("u", "[PERSONNE_1]", 'J"o\né')], "scope string, token string, value string")

    def frame(kind, **data):
        return f"event: {kind}\ndata: {json.dumps({'type': kind, **data})}\n\n"

    def delta(text):
        return frame("content_block_delta", index=0, delta={"type": "text_delta", "text": text})

    start = frame("content_block_start", index=0, content_block={"type": "text", "text": ""})
    whole = start + delta("a [PERS") + ": comment\n\n" + delta("ONNE_1] b [") + "data: {broken\n\n"
    cuts = [whole[i:i + 9] for i in range(0, len(whole), 9)]
    rows = [("s", "u", i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
    got = run_restore(spark, tmp_path, [rows[:7], rows[7:]], token_map, framed=True)["s"]
    want = start + delta("a ") + ": comment\n\n"
    assert got.startswith(want) and "data: {broken\n\n" in got
    texts = [json.loads(line[6:])["delta"]["text"] for line in got.split("\n") if line.startswith('data: {"type": "content_block_delta"')]
    assert "".join(texts) == 'a J"o\né b ['


def test_stream_mask_keeps_tokens_and_repeats_safely(spark, tmp_path):
    schema = "doc_id bigint, scope string, text string"
    batches = [[(1, "u", "a@b.ch"), (2, "u", "c@d.ch")], [(3, "u", "c@d.ch e@f.ch")]]
    source = feed(spark, tmp_path / "in", schema, batches)
    out = str(tmp_path / "out")
    stream_mask.start_mask(source, out, str(tmp_path / "state"), "scope").awaitTermination()
    read = lambda: {r["doc_id"]: r["text"] for r in stream_mask.read_batches(spark, out + "/masked").collect()}
    assert read() == {1: "[EMAIL_1]", 2: "[EMAIL_2]", 3: "[EMAIL_2] [EMAIL_3]"}
    stream_mask.mask_batch(docs(spark, batches[1]), 1, out, "scope")
    assert read() == {1: "[EMAIL_1]", 2: "[EMAIL_2]", 3: "[EMAIL_2] [EMAIL_3]"}
    logged = stream_mask.read_batches(spark, out + "/audit")
    assert logged.count() == 3 and "text" not in logged.columns


def test_audit_append_and_retention(spark, tmp_path):
    texts = docs(spark, [(1, "u", "a@b.ch a@b.ch"), (2, "u", "nothing")])
    found = detect.detect_entities(texts, ["scope", "doc_id"])
    rows = audit.audit_rows(texts, found, F.to_timestamp(F.lit("2024-03-01 10:00:00")))
    got = {r["token_count"]: r for r in rows.collect()}
    assert got[1]["entity_counts"] == {"EMAIL": 2} and got[0]["sources"] == {}
    audit.append_audit(rows, str(tmp_path / "audit"))
    table = spark.read.parquet(str(tmp_path / "audit"))
    assert audit.audit_retention(table, F.to_date(F.lit("2024-05-30"))).count() == 2
    assert audit.audit_retention(table, F.to_date(F.lit("2024-05-31"))).count() == 0


def test_bursts_on_a_stream_equal_the_table(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00.0", "pattern"), ("u", "2024-01-01 00:00:02.5", "model"),
            ("u", "2024-01-01 00:00:05.1", "pattern"), ("u", "2024-01-01 01:00:00.0", "pattern")]
    schema = "scope string, ts string, source string"
    source = feed(spark, tmp_path / "in", schema, [rows[:2], rows[2:]])
    at_rest = bursts.event_bursts(spark.createDataFrame(rows, schema), F.col("ts"), ["pattern", "model"], by=["scope"]).collect()
    assert sorted(r["total"] for r in at_rest) == [1, 1, 2]
    live = bursts.event_bursts(source, F.col("ts"), ["pattern", "model"], by=["scope"], delay="1 minute")
    out = str(tmp_path / "out")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    # the last burst stays open until the watermark passes it
    assert sorted(r["total"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_own_classifier(spark):
    def shout(profiles):
        return profiles.withColumns({"strategy": F.lit("redact"), "label": F.lit("REDACT"), "confidence": F.lit(0.6), "regex": F.lit(None).cast("string")})

    table = spark.createDataFrame([("a", 1)], "x string, y int")
    rows = columns.scan_catalog({"t": table}, None, classifier=shout).collect()
    assert {(r["column"], r["label"], r["status"]) for r in rows} == {("x", "REDACT", "pending"), ("y", "REDACT", "pending")}


def test_ids_repeat_over_scopes(spark):
    from velum.operators.mask import mask_documents

    docs = spark.createDataFrame([("a", 1, "x@a.ch z@a.ch"), ("b", 1, "z@a.ch y@a.ch")], "scope string, doc_id long, text string")
    got = {r["scope"]: r["text"] for r in mask_documents(docs, "scope").rows.collect()}
    assert got == {"a": "[EMAIL_1] [EMAIL_2]", "b": "[EMAIL_1] [EMAIL_2]"}


def test_payload_of_many_fields_over_scopes(spark):
    from velum.operators.payloads import mask_payloads

    lines = "nom,ville,x\n" + "\n".join(f"Jean {i},Bern,{i}" for i in range(2000))
    rows = spark.createDataFrame([("a", 1, lines), ("b", 1, "nom,ville,x\nMax Muster,Bern,1")], "scope string, doc_id long, text string")
    result = mask_payloads(rows, lexicon(spark))
    got = {r["scope"]: r["text"] for r in result.rows.collect()}
    assert len(got) == 2 and result.rows.count() == 2
    assert "Jean 1999" not in got["a"] and "Max Muster" not in got["b"]


def test_samples_follow_typed_order(spark):
    from velum.operators.columns import first_samples

    got = first_samples(spark.range(1, 80).toDF("k"), ["k"], 50).orderBy("rank").collect()
    assert [int(r["value"]) for r in got] == list(range(1, 51))


def test_no_machine_local_stages_on_a_cluster():
    from types import SimpleNamespace

    from velum import session

    conf = SimpleNamespace(get=lambda key, default=None: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))
