"""Column expressions and small helpers on hand-made cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions import flatten as FL
from velum.functions import formats, patterns, rewrite, similarity, text
from velum.sources.query import refusal


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_header(spark):
    cases = {
        "Nom Client": "nom_client", "PRÉNOM": "prenom", "e-mail.pro/2": "e_mail_pro_2", "a\tb": "a_b",
        "__a___b__": "a_b", "Größe": "große", "  ": "", "Ä.Ö": "a_o",
    }
    assert column(spark, list(cases), text.normalize_header) == list(cases.values())
    assert column(spark, [None], text.normalize_header) == [""]


def test_value_metadata(spark):
    values = ["jean@example.ch", "7561234567897", "CH9300762011623852957", "1234567", "https://a.b", "Jean Dupont", "12.03.84"]
    got = column(spark, values, text.value_metadata)
    assert [g["charset"] for g in got] == ["email", "digits", "alphanum", "digits", "url", "mixed", "mixed"]
    assert [g["regex_hint"] for g in got] == ["none", "avs", "iban_ch", "none", "none", "none", "date"]
    assert got[5]["has_spaces"] and not got[5]["has_punctuation"] and got[0]["length"] == 15
    # both spellings of the expression agree
    rows = spark.createDataFrame([(v,) for v in values + [None]], "v string")
    assert rows.select(text.value_metadata(F.col("v")).alias("m")).collect() == rows.selectExpr(
        text.value_metadata_sql("v") + " AS m").collect()


def test_already_masked(spark):
    values = ["[PERSONNE_1] et [TEL_22]", "un long texte avec seulement [PERSONNE_1] dedans, tres long", "", "[link](x) [1, 2]", None]
    assert column(spark, values, lambda c: F.coalesce(text.already_masked(c), F.lit(False))) == [True, False, False, False, False]


def test_find_spans_positions(spark):
    body = "é a@b.ch, éPO123456789-12345/12 PO123456789-12345/12 a@b.ch 756.1234.5678.97"
    spans = column(spark, [body], lambda c: patterns.find_spans(c, patterns.DEFAULT_PATTERNS))[0]
    assert {(s["label"], s["value"], s["start"]) for s in spans} == {
        ("EMAIL", "a@b.ch", 2), ("EMAIL", "a@b.ch", 53), ("POLICE", "PO123456789-12345/12", 32), ("AVS", "756.1234.5678.97", 60)
    }
    assert all(body[s["start"]:s["end"]] == s["value"] for s in spans)


def test_might_match_agrees_with_find_spans(spark):
    values = ["nothing", "4444333322221111", "x 10.0.0.1 y", "2024-01-02", "WVWZZZ1KZ00000001", "a@b", None, "CT-12345", "CT-1"]
    both = lambda c: F.struct(
        patterns.might_match(c, patterns.DEFAULT_PATTERNS).alias("a"),
        (F.size(patterns.find_spans(c, patterns.DEFAULT_PATTERNS)) > 0).alias("b"),
    )
    got = column(spark, values, both)
    assert all(g["a"] == g["b"] for g in got)
    assert [g["a"] for g in got] == [False, True, True, True, True, False, False, True, False]


def test_grouped_ibans_and_foreign_digits(spark):
    values = ["to CH93 0076 2011 6238 5295 7 please", "CH9300762011623852957", "AB12 CDEF", "\u0661\u0662.\u0661\u0662.\u0662\u0660\u0662\u0663"]
    spans = column(spark, values, lambda c: patterns.find_spans(c, patterns.DEFAULT_PATTERNS))
    assert [[(s["value"], s["label"]) for s in row] for row in spans] == [
        [("CH93 0076 2011 6238 5295 7", "IBAN")], [("CH9300762011623852957", "IBAN")], [], []]


def test_python_spellings_run_on_the_jvm(spark):
    assert patterns.java_regex(r"(?P<a>x)\Z") == r"(?U)(x)\z"
    assert patterns.java_regex(r"x\\Z") == r"(?U)x\\Z"
    custom = [patterns.Pattern("p", r"(?P<head>AB)-\d{2}\Z", "POLICE")]
    spans = column(spark, ["x AB-12", "AB-12 x"], lambda c: patterns.find_spans(c, custom))
    assert [[s["value"] for s in row] for row in spans] == [["AB-12"], []]


@pytest.mark.parametrize(
    "regex, ok",
    [
        (r"\bAB-\d{4}\b", True), ("[a-z]+", True), ("(ab){1,10}c*", True), ("(abc", False), ("", False), ("   ", False), (None, False),
        ("(a+)+", False), ("(a*b)*", False), ("(?:x{0,60})+", False), ("(?:a{1,5})+", True), ("(a|b+)*", False), ("(?=(a+)+)b", False),
        ("a" * 201, False), ("a" * 200, True), (r"(?P<a>x)(?P=a)", False), ("[[]x", False), ("(a)?(?(1)b|c)", False),
        ("[a&&b]", False), ("a{,3}", False), ("(?a)x", False), (r"\[[a\]]{2,3}\{", True), (r"(?i)x[^\[]{4}", True),
        ("((a+)b)+", False), ("a+b+c*", True), ("(?>a+)+", False),
    ],
)
def test_vet_regex(regex, ok):
    assert patterns.vet_regex(regex)[0] is ok


def entries_of(spark, body, pairs, function):
    schema = T.StructType([T.StructField("t", T.StringType()), T.StructField("e", rewrite.ENTRIES)])
    return spark.createDataFrame([(body, pairs)], schema).select(function(F.col("t"), F.col("e")).alias("out")).first()["out"]


def test_replace_longest_first_without_chaining(spark):
    pairs = [("ab", "[P_1]"), ("abc", "[Q_1]"), ("1", "[N_10]")]
    assert entries_of(spark, "x ab abc 1 [", pairs, rewrite.replace_values) == "x [P_1] [Q_1] [N_10] ["
    assert entries_of(spark, "x ab", None, rewrite.replace_values) == "x ab"
    many = [(f"k{i}k", f"[T_{i}]") for i in range(120)]
    assert entries_of(spark, " ".join(k for k, _ in many), many, rewrite.replace_values) == " ".join(v for _, v in many)
    # texts with the reserved characters take the plain path
    assert entries_of(spark, " ab", [("ab", "[P_1]")], rewrite.replace_values) == " [P_1]"


def test_restore_tokens(spark):
    pairs = [("[PERSONNE_1]", "Jo"), ("[PERSONNE_10]", "Al")]
    out = entries_of(spark, "[PERSONNE_10] [PERSONNE_1] [PERSONNE_2] [x](y)", pairs, rewrite.restore_tokens)
    assert out == "Al Jo [PERSONNE_2] [x](y)"


@pytest.mark.parametrize(
    "sql, fields",
    [
        ("INSERT INTO c (nom, age) VALUES ('O''Neil', 42), ('B', now())", [("nom", "O'Neil"), ("age", "42"), ("nom", "B")]),
        ("INSERT INTO c VALUES ('x', 3.5)", [("col0", "x"), ("col1", "3.5")]),
        ("insert into c (a) select b from d where e = 'f'", []),
        ("UPDATE c SET nom = 'Jean', n=5 WHERE id IN (1, 'b') AND ville LIKE 'Gen%'",
         [("nom", "Jean"), ("n", "5"), ("id", "1"), ("id", "b"), ("ville", "Gen%")]),
        ("DELETE FROM c WHERE c.nom <> 'x' AND 3 <> 4", [("nom", "x")]),
        ("SELECT * FROM c WHERE upper(nom) = 'DUPONT' LIMIT 10", [("valeur", "DUPONT")]),
        ("SELECT a FROM c WHERE a NOT IN ('x', 'y') AND b NOT LIKE 'z'", [("a", "x"), ("a", "y"), ("b", "z")]),
    ],
)
def test_sql_fields(spark, sql, fields):
    got = column(spark, [sql], FL.sql_fields)[0]
    assert [(f["field"], f["value"]) for f in got] == fields


def test_replace_sql_literals(spark):
    sql = "INSERT INTO t42 (nom, age, note) VALUES ('O''Neil', 42, 'call O''Neil')"
    out = entries_of(spark, sql, [("O'Neil", "[P_1]"), ("42", "[A_1]")], rewrite.replace_sql_literals)
    assert out == "INSERT INTO t42 (nom, age, note) VALUES ('[P_1]', '[A_1]', 'call [P_1]')"


def test_detect_format(spark):
    cases = {
        "SELECT a FROM b": "sql", "Select a seat": "freetext", "<a><b/></a>": "xml", "<a><b></a>": "freetext", '{"a": 1': "json",
        "[x": "json", "a | b\nc | d": "table", "a,b,c\n1,2,3": "csv", "a,b\n1,2": "freetext", "one, two, three": "freetext",
        "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>": "freetext",
    }
    assert column(spark, list(cases), formats.detect_format) == list(cases.values())


def test_flatten_helpers():
    assert FL._json_fields('{"a": {"b": [{"c": "v"}, "w"]}, "n": 3, "s": " "}') == [("c", "v", "a.b[0].c"), ("b", "w", "a.b[1]")]
    assert FL._xml_fields('<a x="1">t<b>u</b>tail</a>') == [
        ("x", "1", "a@x"), ("a", "t", "a"), ("b", "u", "a/b"), ("b", "tail", "a/b#tail")]
    assert FL._csv_fields('a, b\n1,"x,y"\n,z\n') == [("a", "1", "row0.a"), ("b", "x,y", "row0.b"), ("b", "z", "row1.b")]
    with pytest.raises(ValueError):
        FL._csv_fields("a,b\n1,2,3")


def test_nesting_limit():
    import json

    blob = "deep"
    for _ in range(7):
        blob = json.dumps({"k": blob})
    rows = FL._open_blob(blob, 1)
    assert [r[3] for r in rows] == [5] and rows[0][1].startswith("{")


def test_rewrite_nested_documents():
    import json

    inner = json.dumps({"nom": 'O"Neil'})
    out = rewrite._rewrite_json(json.dumps({"blob": inner, "k": 'O"Neil'}), [('O"Neil', "[P_1]")])
    assert json.loads(json.loads(out)["blob"]) == {"nom": "[P_1]"} and json.loads(out)["k"] == "[P_1]"
    assert rewrite._rewrite_xml('<a n="Jo">Jo<b/>Jo</a>', [("Jo", "[P_1]")]) == '<a n="[P_1]">[P_1]<b />[P_1]</a>'


def brute_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_similarity_against_brute_force(spark):
    pairs = [("contact", "contract"), ("emai", "email"), ("emial", "email"), ("telefon_nummer", "telefonnummer"), ("a", "b")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("*", F.split("a", "").alias("x"), F.split("b", "").alias("y"))
    got = rows.select("a", "b", similarity.lcs_length(F.col("x"), F.col("y")).alias("n")).collect()
    assert all(r["n"] == brute_lcs(r["a"], r["b"]) for r in got)


@pytest.mark.parametrize(
    "sql, reason",
    [
        ("select 1", None), ("with t as (select 1) select * from t;", None), ("", "empty"), ("select 1; select 2", "several statements"),
        ("explain select 1", "not a select"), ("select * from t where drop = 1", "write word"), ("delete from t", "not a select"),
    ],
)
def test_refusal(sql, reason):
    assert refusal(sql) == reason
