"""Literals read by lexing, and payloads in which none of them leaks."""

import pytest
from tests_helpers import lexicon

from velum.operators import mask, payloads
from velum.operators.sql_text import sql_literals

CASES = [
    ("INSERT INTO c (nom, \"ville\", n) VALUES ('Jean', lower(trim('Bern')), 5), ('O''X', f(1, 'a'), null) ON CONFLICT (nom) DO UPDATE SET nom = 'Zoe', n = 4",
     ["nom=Jean", "ville=Bern", "n=5", "nom=O'X", "ville=a", "nom=Zoe", "n=4"]),
    ("-- it's a script\nINSERT INTO c VALUES ('x', 3);; /* don't */ UPDATE c SET nom = upper('Eva'), t.age = 4 WHERE 'q' = c.nom",
     ["None=-- it's a script", "col0=x", "col1=3", "None=/* don't */", "nom=Eva", "age=4", "nom=q"]),
    ("SELECT $$it's$$, $t$a $$ b$t$, E'a\\'b' FROM t WHERE upper(x) = 'Q' AND `nom` NOT IN (SELECT y FROM u WHERE y LIKE 'v') OR z IN ('a', 7, f('b')) LIMIT 7",
     ["valeur=it's", "valeur=a $$ b", "valeur=a\\'b", "valeur=Q", "y=v", "z=a", "z=7", "valeur=b"]),
    ("SELECT a FROM t WHERE d NOT BETWEEN 1 AND 'z' AND k = ('in') AND x <> \"it's; no string\"", ["d=1", "d=z", "k=in"]),
    ("INSERT INTO a SELECT nom FROM t WHERE nom = 'Max'; )))( UPDATE c SET nom = 'after bad parentheses'", ["nom=Max", "nom=after bad parentheses"]),
    ("UPDATE c SET nom = 'open", ["nom=open"]),
    ("", []), (None, []),
]


def test_literals_and_their_columns(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    rows = sql_literals(texts, ["id"]).orderBy("id", "ord").collect()
    for i, (text, want) in enumerate(CASES):
        assert [f"{r.field}={r.value}" for r in rows if r.id == i] == want, text
    assert [r.ord for r in rows if r.id == 0] == list(range(7))


def test_long_script(spark):
    rows = ", ".join(f"('n{i}', f(g({i}, 'v{i}')))" for i in range(5000))
    texts = spark.createDataFrame([(1, f"INSERT INTO c (a, b) VALUES {rows}")], "id int, text string")
    got = sql_literals(texts, ["id"])
    assert got.where("field = 'a'").count() == got.where("field = 'b'").count() == 5000
    assert got.where("ord = 9999").first()["path"] == "ins4999.1"


LEAKS = [
    ("Voir: INSERT INTO clients (nom) VALUES ('Jean Rex'); merci", "Voir: INSERT INTO clients (nom) VALUES ('[PERSONNE_1]'); merci"),
    ("-- it's a script\nINSERT INTO clients (nom)\n VALUES ('Jean Rex');", "-- it's a script\nINSERT INTO clients (nom)\n VALUES ('[PERSONNE_1]');"),
    ("INSERT INTO c (nom, ville) VALUES ('Jean Rex', upper(lower(trim('Bern'))))", "INSERT INTO c (nom, ville) VALUES ('[PERSONNE_1]', upper(lower(trim('[LOCALISATION_1]'))))"),
    ("INSERT INTO c (nom) VALUES ('Jean Rex') ON CONFLICT DO UPDATE SET nom = 'Zoe Gast'", "INSERT INTO c (nom) VALUES ('[PERSONNE_1]') ON CONFLICT DO UPDATE SET nom = '[PERSONNE_2]'"),
    ("UPDATE c SET nom = $$Jean Rex$$ WHERE n = 1 -- was Jean Rex, a@b.ch", "UPDATE c SET nom = '[PERSONNE_1]' WHERE n = 1 -- was [PERSONNE_1], [EMAIL_1]"),
    ("UPDATE c SET nom = 'Jean Rex' WHERE \"it's\" = 1 AND \"nom\" = 'Eva'", "UPDATE c SET nom = '[PERSONNE_1]' WHERE \"it's\" = 1 AND \"nom\" = '[PERSONNE_2]'"),
    ("merci [PERSONNE_7], voir UPDATE c SET nom = 'Jean Rex' WHERE n = 7; 7 fois", "merci [PERSONNE_7], voir UPDATE c SET nom = '[PERSONNE_1]' WHERE n = 7; 7 fois"),
]


def test_no_literal_leaks_from_payloads(spark):
    rows = spark.createDataFrame([(1, f"s{i}", t) for i, (t, _) in enumerate(LEAKS)], "doc_id int, scope string, text string")
    got = {r.scope: r.text for r in payloads.mask_payloads(rows, lexicon(spark)).rows.collect()}
    assert got == {f"s{i}": want for i, (_, want) in enumerate(LEAKS)}


@pytest.mark.parametrize("i", [0, 2, 3])
def test_documents_with_statements(spark, i):
    docs = spark.createDataFrame([(1, "s", LEAKS[i][0])], "doc_id int, scope string, text string")
    assert mask.mask_documents(docs, "scope", kb=lexicon(spark)).rows.first().text == LEAKS[i][1]


def test_literals_are_read_where_their_text_is(spark):
    """No shuffle and no sort; rows that share a key, or have none, are read one by one."""
    texts = spark.createDataFrame([(1, "UPDATE c SET nom = 'Eva'"), (1, "INSERT INTO c (n) VALUES (2), ('x')"), (None, "x = 'y'")], "id int, text string")
    got = sql_literals(texts, ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    want = [(1, 0, "nom", "Eva", "lit0"), (1, 0, "n", "2", "ins0.0"), (1, 1, "n", "x", "ins1.0"), (None, 0, "x", "y", "lit0")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_payloads_and_bodies_of_one_file_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    from velum.operators import chat

    path, tasks = str(tmp_path / "one"), {}
    body = """'{"messages": [{"role": "user", "content": "write to a@b.ch"}]}' AS body"""
    spark.range(40).selectExpr("id AS doc_id", "id AS body_id", "'s' AS scope", """'{"nom": "Jo"}' AS text""", body).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    for module in (payloads, chat):
        plain = module.stage
        monkeypatch.setattr(module, "stage", lambda df, name="stage", plain=plain: (tasks.setdefault(name, df.rdd.getNumPartitions()), plain(df, name))[1])
    assert payloads.mask_payloads(rows, lexicon(spark)).rows.where("text LIKE '%[PERSONNE_1]%'").count() == 40
    assert chat.mask_bodies(rows.drop("doc_id")).rows.where("body LIKE '%[EMAIL_1]%'").count() == 40
    assert tasks["payload-fields"] == 4 and tasks["blocks"] == 4
