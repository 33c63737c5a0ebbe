"""Semi-structured payloads made from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from velum.operators import payloads as P
from velum.operators.sql_text import sql_literals
from velum.plans.base import derived, query, spans_sql, tokens_sql
from velum.plans.kb import lexicon_kb

NL = "chr(10)"
Q = "chr(39)"

TABLE_TEXT = f"concat('| nom | segment |', {NL}, '|---|---|', {NL}, '| ', c_name, ' | ', c_mktsegment, ' |', {NL}, '| | x |')"
CSV_TEXT = f"concat('nom,segment,solde', {NL}, c_name, ',', c_mktsegment, ',', cast(c_custkey as string), {NL}, 'Z, ,1', {NL})"
JSON_TEXT = """concat('{"client": {"nom": "', c_name, '", "tags": [{"segment": "', c_mktsegment, '"}, "libre"], "n": 3, "vide": " "}, "id": ', cast(c_custkey as string), '}')"""
XML_TEXT = """concat('<dossier ref="', cast(c_custkey as string), '"><client nom="', c_name, '"/>suite <b>', c_mktsegment, '</b></dossier>')"""
INSERT_TEXT = f"concat('INSERT INTO clients (nom, segment, nation) VALUES (', {Q}, c_name, {Q}, ', ', {Q}, c_mktsegment, {Q}, ', ', cast(c_nationkey as string), '), (', {Q}, 'D', {Q}, {Q}, 'Aoste', {Q}, ', null, 7)')"
UPDATE_TEXT = f"concat('UPDATE clients SET nom = ', {Q}, c_name, {Q}, ' WHERE segment IN (', {Q}, c_mktsegment, {Q}, ', ', {Q}, 'ALL', {Q}, ') AND nation >= ', cast(c_nationkey as string), ' AND upper(x) = ', {Q}, 'Q', {Q})"
PROSE_TEXT = "concat('Bonjour ', c_name, ', tout va bien.')"

MIXED = f"""c_custkey, case c_custkey % 9 when 0 then {JSON_TEXT} when 1 then {XML_TEXT} when 2 then {TABLE_TEXT}
 when 3 then {CSV_TEXT} when 4 then {INSERT_TEXT} when 5 then {UPDATE_TEXT} when 6 then {PROSE_TEXT}
 when 7 then concat('<b>', c_name) else concat('  {{"open": "', c_name) end AS text"""


@query(
    "format_profile",
    f"""SELECT ['json', 'xml', 'table', 'csv', 'sql', 'sql', 'freetext', 'freetext', 'json'][c_custkey % 9 + 1] AS format,
     count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT {MIXED} FROM customer) GROUP BY 1""",
)
def format_profile(spark, root):
    return P.format_profile(derived(spark, root, "customer", MIXED))


def exploded(spark, root, text):
    rows = derived(spark, root, "customer", f"c_custkey, {text} AS text")
    return P.explode_fields(rows, ["c_custkey"]).select("c_custkey", "ord", "field", "value", "path")


def rows_sql(*rows: tuple[str, str, str]) -> str:
    """Expected fields of each customer's payload: (field, value expression, path)."""
    return " UNION ALL ".join(
        f"SELECT c_custkey, {i}::BIGINT AS ord, '{f}' AS field, {v} AS value, '{p}' AS path FROM customer"
        for i, (f, v, p) in enumerate(rows)
    )


@query(
    "explode_markdown",
    rows_sql(("nom", "c_name", "row0.nom"), ("segment", "c_mktsegment", "row0.segment"), ("nom", "'x'", "row1.nom")),
)
def explode_markdown(spark, root):
    return exploded(spark, root, TABLE_TEXT)


@query(
    "explode_csv",
    rows_sql(
        ("nom", "c_name", "row0.nom"), ("segment", "c_mktsegment", "row0.segment"),
        ("solde", "c_custkey::VARCHAR", "row0.solde"), ("nom", "'Z'", "row1.nom"), ("solde", "'1'", "row1.solde"),
    ),
)
def explode_csv(spark, root):
    return exploded(spark, root, CSV_TEXT)


@query(
    "explode_json",
    rows_sql(
        ("nom", "c_name", "client.nom"), ("segment", "c_mktsegment", "client.tags[0].segment"),
        ("tags", "'libre'", "client.tags[1]"),
    ),
)
def explode_json(spark, root):
    return exploded(spark, root, JSON_TEXT)


@query(
    "explode_xml",
    rows_sql(
        ("ref", "c_custkey::VARCHAR", "dossier@ref"), ("nom", "c_name", "dossier/client@nom"),
        ("client", "'suite'", "dossier/client#tail"), ("b", "c_mktsegment", "dossier/b"),
    ),
)
def explode_xml(spark, root):
    return exploded(spark, root, XML_TEXT)


_INSERTED = rows_sql(
    ("nom", "c_name", "ins0.0"), ("segment", "c_mktsegment", "ins0.1"), ("nation", "c_nationkey::VARCHAR", "ins0.2"),
    ("nom", "'D''Aoste'", "ins1.0"), ("nation", "'7'", "ins1.2"),
)
_UPDATED = rows_sql(
    ("nom", "c_name", "lit0"), ("segment", "c_mktsegment", "lit1"), ("segment", "'ALL'", "lit2"),
    ("nation", "c_nationkey::VARCHAR", "lit3"), ("valeur", "'Q'", "lit4"),
)


@query(
    "explode_sql_literals",
    f"SELECT * FROM ({_INSERTED}) WHERE c_custkey % 2 = 0 UNION ALL SELECT * FROM ({_UPDATED}) WHERE c_custkey % 2 = 1",
)
def explode_sql_literals(spark, root):
    return exploded(spark, root, f"case when c_custkey % 2 = 0 then {INSERT_TEXT} else {UPDATE_TEXT} end")


SCRIPT_TEXT = f"concat({INSERT_TEXT}, '; ', {UPDATE_TEXT}, ';', {NL}, 'INSERT INTO v (nom) VALUES (', {Q}, 'a;b', {Q}, ');')"


@query(
    "explode_sql_script",
    f"""SELECT c_custkey, ord, field, value, 'stmt0.' || path AS path FROM ({_INSERTED})
    UNION ALL SELECT c_custkey, ord + 5, field, value, 'stmt1.' || path FROM ({_UPDATED})
    UNION ALL SELECT c_custkey, 10, 'nom', 'a;b', 'stmt2.ins0.0' FROM customer""",
)
def explode_sql_script(spark, root):
    return exploded(spark, root, SCRIPT_TEXT)


# Calls in calls, comments with apostrophes, other ways of quoting, both sides of a comparison, what follows the values.
LEXED_TEXT = f"""concat('-- it', {Q}, 's customer ', cast(c_custkey as string), {NL}, 'INSERT INTO clients (nom, "ville", n) VALUES (', {Q}, c_name, {Q},
 ', lower(trim(', {Q}, c_mktsegment, {Q}, ')), ', cast(c_nationkey as string), '), (f(1, g(', {Q}, 'a', {Q}, {Q}, 'b', {Q}, ')), null, 2)',
 ' ON CONFLICT (nom) DO UPDATE SET nom = ', {Q}, c_name, {Q}, '; /* don', {Q}, 't */ UPDATE c SET nom = upper($$T ', c_mktsegment, '$$), k = 4',
 ' WHERE ', {Q}, 'q;', {Q}, ' = c.`rue` AND d BETWEEN 1 AND 9 AND z NOT IN (1, ', {Q}, c_mktsegment, {Q}, ') LIMIT 7;')"""
_LEXED = [
    (None, "'-- it''s customer ' || c_custkey", "comment"), ("nom", "c_name", "stmt0.ins0.0"), ("ville", "c_mktsegment", "stmt0.ins0.1"),
    ("n", "c_nationkey::VARCHAR", "stmt0.ins0.2"), ("nom", "'a''b'", "stmt0.ins1.0"), ("n", "'2'", "stmt0.ins1.2"), ("nom", "c_name", "stmt0.lit0"),
    (None, "'/* don''t */'", "comment"), ("nom", "'T ' || c_mktsegment", "stmt1.lit0"), ("k", "'4'", "stmt1.lit1"), ("rue", "'q;'", "stmt1.lit2"),
    ("d", "'1'", "stmt1.lit3"), ("d", "'9'", "stmt1.lit4"), ("z", "'1'", "stmt1.lit5"), ("z", "c_mktsegment", "stmt1.lit6"),
]


@query("sql_lexed", rows_sql(*_LEXED).replace("'None' AS field", "NULL AS field"))
def sql_lexed(spark, root):
    return sql_literals(derived(spark, root, "customer", f"c_custkey, {LEXED_TEXT} AS text"), ["c_custkey"])


# JSON held as text in JSON, XML held in that.
_INNER = """concat('{"nom": "', c_name, '", "deep": "<a v=\\\\"', c_mktsegment, '\\\\"/>"}')"""
NESTED_TEXT = f"""concat('{{"note": "plain", "blob": "', replace(replace({_INNER}, '\\\\', '\\\\\\\\'), '"', '\\\\"'), '", "bad": "[1, 2"}}')"""


@query(
    "explode_nested",
    """SELECT c_custkey, 0::BIGINT AS ord, 'note' AS field, 'plain' AS value, 'note' AS path, 0::BIGINT AS depth FROM customer
    UNION ALL SELECT c_custkey, 1, 'nom', c_name, 'blob>nom', 1 FROM customer
    UNION ALL SELECT c_custkey, 1, 'v', c_mktsegment, 'blob>deep>a@v', 2 FROM customer
    UNION ALL SELECT c_custkey, 2, 'bad', '[1, 2', 'bad', 0 FROM customer""",
)
def explode_nested(spark, root):
    fields = P.explode_fields(derived(spark, root, "customer", f"c_custkey, {NESTED_TEXT} AS text"), ["c_custkey"])
    return P.explode_nested(fields, ["c_custkey"]).drop("sub")


SQL_IN_PROSE = f"concat('Hello, ', case when c_custkey % 3 = 0 then concat('run ', {INSERT_TEXT}, '; then ', {UPDATE_TEXT}, {NL}, 'and select a seat') else 'nothing; delete it' end)"


@query(
    "embedded_sql_spans",
    f"""SELECT c_custkey, ord, CASE WHEN ord = 0 THEN {INSERT_TEXT} || ';' ELSE {UPDATE_TEXT} END AS sql
    FROM customer, (VALUES (0::BIGINT), (1::BIGINT)) v(ord) WHERE c_custkey % 3 = 0""",
)
def embedded_sql_spans(spark, root):
    texts = derived(spark, root, "customer", f"c_custkey, {SQL_IN_PROSE} AS text")
    return P.embedded_sql(texts, ["c_custkey"]).select("c_custkey", F.col("ord").cast("bigint").alias("ord"), "sql")


# ---- columns of a payload: a customer's orders as one document ----------------------

ORDER_FIELDS = """o_custkey AS doc_id, o_orderkey AS ord, case when o_orderkey % 2 = 0 then 'note' else 'priority' end AS field,
 case when o_orderkey % 4 = 0 then concat('write to u', cast(o_custkey as string), '@example.com') when o_orderkey % 4 = 2
 then concat('call ', cast(o_orderkey as string)) else o_orderpriority end AS value"""
AUGMENTED = f"""SELECT doc_id, field, list(value ORDER BY ord) AS vals, string_agg(field || ': ' || value, ' | ' ORDER BY ord) AS augmented
 FROM (SELECT {ORDER_FIELDS} FROM orders) GROUP BY doc_id, field"""
ENTITIES = f"""SELECT DISTINCT doc_id, field, value, label FROM ({spans_sql(f'({AUGMENTED})', 'doc_id, field, vals', 'augmented')})
 WHERE list_bool_or(list_transform(vals, lambda v: contains(v, value)))"""


@query("augment_columns", f"SELECT doc_id, field, augmented FROM ({AUGMENTED})")
def augment_columns(spark, root):
    return P.augment_columns(derived(spark, root, "orders", ORDER_FIELDS), ["doc_id"]).drop("values")


@query("column_entities", ENTITIES)
def column_entities(spark, root):
    return P.column_entities(derived(spark, root, "orders", ORDER_FIELDS), ["doc_id"])


@query(
    "unresolved_values",
    f"""SELECT f.doc_id, f.ord, f.field, f.value FROM (SELECT {ORDER_FIELDS} FROM orders) f WHERE NOT EXISTS (
      SELECT 1 FROM ({ENTITIES}) e WHERE e.doc_id = f.doc_id AND e.field = f.field AND contains(f.value, e.value))""",
)
def unresolved_values(spark, root):
    fields = derived(spark, root, "orders", ORDER_FIELDS)
    return P.unresolved_values(fields, P.column_entities(fields, ["doc_id"]), ["doc_id"])


# ---- the whole job ---------------------------------------------------------------------

_MAIL = "concat('c', cast(c_custkey % 97 as string), '@example.com')"
_SAY = f"concat('ecrire a ', {_MAIL}, ' vite')"


def payload(nom: str, note: str, segment: str) -> str:
    """One payload text with the three values in one of five formats."""
    return f"""case c_custkey % 5
 when 0 then concat('{{"nom": "', {nom}, '", "note": "', {note}, '", "segment": "', {segment}, '", "n": 1}}')
 when 1 then concat('nom,note,segment', {NL}, {nom}, ',', {note}, ',', {segment}, {NL})
 when 2 then concat('| nom | note | segment |', {NL}, '|---|---|---|', {NL}, '| ', {nom}, ' | ', {note}, ' | ', {segment}, ' |')
 when 3 then concat('<c nom="', {nom}, '"><note>', {note}, '</note><segment>', {segment}, '</segment></c>')
 else concat('INSERT INTO c (nom, note, segment) VALUES (', {Q}, {nom}, {Q}, ', ', {Q}, {note}, {Q}, ', ', {Q}, {segment}, {Q}, ')') end"""


PAYLOADS = f"c_custkey AS doc_id, cast(c_nationkey as string) AS scope, {payload('c_name', _SAY, 'c_mktsegment')} AS text"


@query(
    "mask_payloads",
    f"""WITH src AS (SELECT *, c_nationkey::VARCHAR AS scope, c_custkey AS doc_id, {_MAIL} AS mail FROM customer),
    found AS (SELECT scope, doc_id, 0 AS ord, 0 AS start, 0 AS prio, c_name AS value, 'PERSONNE' AS label FROM src
      UNION ALL SELECT scope, doc_id, 1, 9, 4, mail, 'EMAIL' FROM src),
    tokens AS ({tokens_sql('found')})
    SELECT doc_id, {payload('a.token', "concat('ecrire a ', b.token, ' vite')", 'c_mktsegment')} AS text
    FROM src JOIN tokens a ON a.scope = src.scope AND a.value = c_name JOIN tokens b ON b.scope = src.scope AND b.value = mail""",
)
def mask_payloads(spark, root):
    return P.mask_payloads(derived(spark, root, "customer", PAYLOADS), lexicon_kb(spark)).rows.select("doc_id", "text")


def prose(nom: str, ville: str, again: str, mail: str) -> str:
    """Free text with a statement in it; the name outside the statement is no literal."""
    return f"""concat('Voir ', {mail}, ' : INSERT INTO clients (nom, ville) VALUES (', {Q}, {nom}, {Q}, ', upper(lower(trim(', {Q}, {ville}, {Q}, '))))',
 ' ON CONFLICT DO UPDATE SET nom = ', {Q}, {again}, {Q}, '; merci')"""


@query(
    "mask_payloads_prose",
    f"""WITH src AS (SELECT *, c_nationkey::VARCHAR AS scope, c_custkey AS doc_id, {_MAIL} AS mail FROM customer),
    found AS (SELECT scope, doc_id, 0 AS ord, 5 AS start, 0 AS prio, mail AS value, 'EMAIL' AS label FROM src
      UNION ALL SELECT scope, doc_id, 1, 0, 0, c_name, 'PERSONNE' FROM src UNION ALL SELECT scope, doc_id, 2, 0, 0, c_mktsegment, 'LOCALISATION' FROM src
      UNION ALL SELECT scope, doc_id, 3, 0, 0, 'Z ' || c_name, 'PERSONNE' FROM src),
    tokens AS ({tokens_sql('found')})
    SELECT doc_id, {prose('a.token', 'b.token', 'c.token', 'd.token')} AS text FROM src
    JOIN tokens a ON a.scope = src.scope AND a.value = c_name JOIN tokens b ON b.scope = src.scope AND b.value = c_mktsegment
    JOIN tokens c ON c.scope = src.scope AND c.value = 'Z ' || c_name JOIN tokens d ON d.scope = src.scope AND d.value = mail""",
)
def mask_payloads_prose(spark, root):
    text = prose("c_name", "c_mktsegment", "concat('Z ', c_name)", _MAIL)
    rows = derived(spark, root, "customer", f"c_custkey AS doc_id, cast(c_nationkey as string) AS scope, {text} AS text")
    return P.mask_payloads(rows, lexicon_kb(spark)).rows.select("doc_id", "text")


BROKEN = f"""c_custkey AS doc_id, 'all' AS scope, case when c_custkey % 10 = 0 then concat('{{"nom": "', c_name)
 when c_custkey % 10 = 5 then concat('"a,x",b', {NL}, c_name, ',2,3') else {PROSE_TEXT} end AS text"""


@query(
    "quarantine",
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'unreadable json: JSONDecodeError' ELSE 'unreadable csv: ValueError' END AS reason
    FROM customer WHERE c_custkey % 5 = 0""",
)
def quarantine(spark, root):
    rows = derived(spark, root, "customer", BROKEN)
    return P.mask_payloads(rows, lexicon_kb(spark)).quarantine.select("doc_id", "reason")
