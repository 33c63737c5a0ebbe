"""Scans that are stopped and taken up again; detection through the pattern index."""

import random

import pytest

from velum.functions import patterns as table_of_patterns
from velum.functions.literals import required_literals
from velum.functions.patterns import PATTERN_SCHEMA, DetectorConfig, Pattern, load_patterns
from velum.operators import columns, kb, pattern_index
from velum.operators.detect import detect_entities
from velum.operators.pattern_index import detect_by_index, entries, load_pattern_table
from velum.operators.scan import Scan
from velum.plans.registry import QUERIES


def tables(spark):
    people = spark.createDataFrame([(1, "Ann Lee", "a@b.ch"), (2, "Bob Ray", "c@d.ch")], "id int, name string, mail string")
    return {"a_people": people, "b_empty": people.where("id < 0"), "c_clients": people.withColumnRenamed("mail", "courriel")}


def test_a_scan_stopped_halfway(spark, tmp_path):
    want = sorted(map(tuple, columns.scan_catalog(tables(spark), "db").collect()), key=str)
    calls = []

    def breaks(profiles):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the job is stopped")
        return columns.classify(profiles)

    scan = Scan(spark, str(tmp_path / "scan"))
    assert scan.progress().count() == 0 and scan.proposals().count() == 0
    with pytest.raises(RuntimeError):
        scan.run(tables(spark), "db", classifier=breaks, at_once=1)
    done = {r.table: r.status for r in scan.progress().collect()}
    assert done["a_people"] == "done" and "b_empty" not in done
    before = len(calls)
    scan.run(tables(spark), "db", classifier=breaks)
    assert len(calls) - before == 3 - len(done)  # what was done is not read again
    assert sorted(map(tuple, scan.proposals().collect()), key=str) == want
    assert scan.run(tables(spark), "db").count() == 3
    base = kb.new_rows(spark.createDataFrame([("city", "LOCALISATION")], "header_raw string, label string"))
    once = scan.into_kb(base)
    assert once.count() == 1 + sum(r[6] is not None for r in want) and scan.into_kb(once).count() == once.count()


def test_tables_that_cannot_be_read(spark, tmp_path):
    scan = Scan(spark, str(tmp_path / "scan"))
    good = tables(spark)
    inventory = spark.createDataFrame([(t, c) for t, df in good.items() for c in df.columns], "table string, column string")
    scan.run(good | {"b_empty": lambda: spark.read.parquet(str(tmp_path / "nowhere"))}, "db")
    state = {r.table: r for r in scan.progress().collect()}
    assert state["b_empty"].status == "failed" and "nowhere" in state["b_empty"].problem
    assert state["a_people"].last_column == "name" and state["c_clients"].n_columns == 3
    total = scan.summary(inventory, "db").first()
    assert (total.status, total.total_cols, total.last_table) == ("running", 9, "c_clients")
    scan.run(good, "db")
    assert scan.summary(inventory, "db").first().status == "done" and scan.ledger().count() == 4
    # all columns labelled already: done, and nothing proposed
    known = spark.createDataFrame([(c, "ID", "db", "a_people") for c in ("id", "name", "mail")], "header_raw string, label string, db_name string, table_name string")
    other = Scan(spark, str(tmp_path / "other"))
    other.run({"a_people": good["a_people"]}, "db", kb.new_rows(known))
    assert other.progress().first().status == "done" and other.proposals().count() == 0


@pytest.mark.parametrize("regex, want", [
    (r"\bCT-[0-9]{5,10}\b", ["CT-"]), (r"(?:cat|horse)s?", ["cat", "horse"]), (r"(?i)abcdef", []), (r"ab(?i:cdef)gh", ["ab"]),
    (r"[0-9]+", []), (r"(?:abc)*x", ["x"]), (r"(?:abcd)+x", ["abcd"]), (r"a|bcd", ["a", "bcd"]), (r"abc.*defgh", ["defgh"]), (r"(?:abc|)d", ["d"]),
])
def test_required_literals(regex, want):
    assert sorted(required_literals(regex)) == sorted(want)


def test_index_equals_all_patterns_on_all_texts(spark):
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "Żółć", "x😀yz", "12345", "CT-77", "delta\n", "a", ""]
    texts = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "ab"), (63, "alpha " * 3000 + "beta"), (3, texts[3][1])]
    df = spark.createDataFrame(texts, "id int, text string").selectExpr("*", "'clash' AS gram", "'clash' AS label")
    patterns = [
        Pattern("p0", r"\balpha\b", "A", 0.5), Pattern("p1", r"(?:beta|gamma) \w+", "B", 0.6), Pattern("p2", r"\b[0-9]{5}\b", "C", 0.7),
        Pattern("p3", "Żółć", "D", 0.8), Pattern("p4", "x😀yz", "E", 0.9), Pattern("p5", r"(?i)ALPHA", "F", 0.4), Pattern("p6", r"lph[a-z]", "G", 0.3),
        Pattern("p7", r"delta\n", "H", 0.2), Pattern("off", "alpha", "A", 0.1, active=False), Pattern("p8", r"gamma|gam", "I", 0.1), Pattern("p9", r"CT-\d+", "J", 0.1),
    ]
    every = DetectorConfig(active_labels=tuple("ABCDEFGHIJ"), patterns=tuple(patterns))
    want = sorted(map(tuple, detect_entities(df, ["id"], "text", every).collect()))
    got = sorted(map(tuple, detect_by_index(df, ["id"], patterns).collect()))
    assert got == want and len({r[7] for r in got}) == 10
    rows, alone = entries(patterns)
    assert {p.name for p in alone} == {"p2", "p4", "p5"} and all(len(r[0]) == 3 for r in rows)
    assert detect_by_index(df, ["id"], []).count() == 0 and detect_by_index(df.where("id < 0"), ["id"], patterns).count() == 0


def test_five_thousand_patterns(spark):
    """Each of 5,000 patterns finds the text it is written for, in one pass."""
    names = [f"client {i:05d}" for i in range(5000)]
    patterns = [Pattern(n, rf"\b{n}\b", "ID", 0.8) for n in names]
    df = spark.createDataFrame([(i, f"the {n}, 0{n}1 and {names[i - 1]}") for i, n in enumerate(names)], "id int, text string")
    found = detect_by_index(df, ["id"], patterns).select("id", "value", "prio").collect()
    assert {(r.id, r.value, r.prio) for r in found} == {(i, names[k], k) for i in range(5000) for k in (i, (i - 1) % 5000)}


@pytest.mark.parametrize("in_place", [50, 1])
def test_pattern_table_equals_all_patterns_on_all_texts(spark, monkeypatch, in_place):
    """A table of patterns finds what a list finds, with patterns tried in one pass (50) and in a product (1)."""
    monkeypatch.setattr(pattern_index, "IN_PLACE", in_place)
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "Żółć", "x😀yz", "12345", "CT-77", "delta\n", "a", "", "alphabeta"]
    texts = [(i % 50, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(60)]
    texts += [(None, "alpha beta"), (60, None), (61, ""), (62, "ab"), (63, "alpha " * 3000 + "beta"), (3, texts[3][1])]
    df = spark.createDataFrame(texts, "id int, text string").selectExpr("*", "'clash' AS literal", "'clash' AS label", "'clash' AS scope")
    rows = [
        ("p0", r"\balpha\b", "A", 0.5, True, "m"), ("p1", r"(?:beta|gamma|alphab) ?\w+", "B", 0.6, True, "m"), ("p2", r"\b[0-9]{5}\b", "C", 0.7, True, "m"),
        ("p3", "Żółć", "D", 0.8, True, "m"), ("p4", "x😀yz", "E", 0.9, True, "m"), ("p5", r"(?i)ALPHA", "F", 0.4, True, "m"), ("p6", r"lph[a-z]", "G", 0.3, True, "m"),
        ("p7", r"delta\n", "H", 0.2, True, "m"), ("off", "alpha", "A", 0.1, False, "m"), ("p8", r"gamma|gam", "I", 0.1, True, "m"), ("p9", r"CT-\d+\Z", "J", 0.1, True, "m"),
        ("q0", "a{2147483648}", "A", 0.5, True, "m"), ("q1", "(a+)+", "A", 0.5, True, "m"), ("q2", None, "A", 0.5, True, "m"), ("q3", r"\balpha\b", "K", 0.5, None, "m"),
        ("q4", r"\balpha\b", "K", 0.5, True, "m"), ("q5", r"\ud83d\ude00", "L", 0.5, True, "m"), ("q6", "(?P<x>alpha) beta", "L", 0.5, True, "m"), (None, "gamma a", "L", 0.5, True, "m"),
    ]
    table = spark.createDataFrame(draw.sample(rows, len(rows)), PATTERN_SCHEMA)
    with pytest.warns(UserWarning, match="patterns refused: q0 .invalid in the JVM., q1 .nested repeats., q2 .blank.$"):
        read = load_pattern_table(table)
    with pytest.warns(UserWarning):
        listed = load_patterns(table.where("NOT name <=> 'q0'"))
    assert [(r["name"], r["prio"]) for r in read.orderBy("prio").collect()] == [(p.name, i) for i, p in enumerate(listed)]
    every = DetectorConfig(active_labels=tuple("ABCDEFGHIJKL"), patterns=tuple(listed))
    want = sorted(map(tuple, detect_entities(df, ["id"], "text", every).collect()), key=str)
    assert sorted(map(tuple, detect_by_index(df, ["id"], read).collect()), key=str) == want and len({r[7] for r in want}) == len(listed)
    few = sorted(map(tuple, detect_by_index(df, ["id"], read, labels=["A", "C"]).collect()), key=str)
    assert few == [r for r in want if r[4] in "AC"] and detect_by_index(df, ["id"], read.where("prio < 0")).count() == 0
    monkeypatch.setattr(pattern_index, "NAMED", 1)
    with pytest.warns(UserWarning, match="patterns refused: q0 .invalid in the JVM. and 2 more$"):
        twice = load_pattern_table(table.unionAll(table.where("name = 'p0'")))
    assert detect_by_index(df, ["id"], twice).count() == len(want) + sum(r[4] == "A" for r in want)


def test_more_patterns_than_the_driver_may_hold(spark, tmp_path, monkeypatch):
    """The query's pattern table stays a table: no limit of rows that the driver reads applies to it."""
    monkeypatch.setattr(table_of_patterns, "MAX_PATTERNS", 10)
    spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(200).selectExpr("id AS o_orderkey", "id % 45 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["detect_many_patterns"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, f"Customer#{i % 45:09d}", "PERSONNE", 7, 25) for i in range(200) if i % 45 < 40]
