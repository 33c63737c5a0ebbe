"""Knowledge base: seeding, labelling, review, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from velum.functions.patterns import DEFAULT_PATTERNS, PATTERN_SCHEMA, pattern_rows
from velum.operators import kb as K
from velum.plans.base import derived, norm_sql, query, quote, values_sql

WORDS = ("Nom Client", "E-Mail", "Prénom", "Téléphone  mobile", "N.Police", "Ville/Ort", "contact", "Réf_sinistre", "Segment")
LABELS = ("PERSONNE", "EMAIL", "PERSONNE", "TEL", "POLICE", "LOCALISATION", "PERSONNE", "REF_SINISTRE", "NONE")


def _case(key: str, words) -> str:
    return f"case {key} % {len(words)} " + " ".join(f"when {i} then {quote(w)}" for i, w in enumerate(words)) + " end"


def header_of(key: str) -> str:
    return f"concat({_case(key, WORDS)}, ' ', cast({key} as string))"


# A knowledge base with one row per customer, a part of them tied to a database or table.
KB_ROWS = f"""c_custkey AS id, {header_of('c_custkey')} AS header_raw, {_case('c_custkey', LABELS)} AS label,
 'classifier' AS source, case when c_acctbal > 5000 then 'active' else 'pending' end AS status,
 cast(c_custkey % 100 as double) / 100 AS confidence, c_custkey % 17 AS occurrences,
 case when c_nationkey % 3 = 0 then null else concat('db', cast(c_nationkey % 4 as string)) end AS db_name,
 case when c_custkey % 4 = 0 then null else lower(c_mktsegment) end AS table_name"""
KB_SQL = f"SELECT *, {norm_sql('header_raw')} AS header_norm FROM (SELECT {KB_ROWS} FROM customer)"


def customer_kb(spark, root):
    rows = derived(spark, root, "customer", KB_ROWS)
    return K.new_rows(rows).drop("occurrences").join(rows.select("id", "occurrences"), "id").select(
        *[c.split()[0] for c in K.KB_SCHEMA.split(", ")]
    )


@query(
    "kb_seed",
    f"""WITH existing AS (SELECT DISTINCT p_name AS h FROM part WHERE p_size < 3),
    seeds AS (SELECT DISTINCT p_name AS h FROM part)
    SELECT {norm_sql('h')} AS header_norm, 'NONE' AS label, 'admin' AS source FROM existing
    UNION ALL SELECT {norm_sql('h')}, 'ID', 'static' FROM seeds WHERE h NOT IN (SELECT h FROM existing)""",
)
def kb_seed(spark, root):
    existing = derived(spark, root, "part", "DISTINCT p_name AS header_raw, 'NONE' AS label", "p_size < 3")
    seeds = derived(spark, root, "part", "p_name AS header_raw, 'ID' AS label")
    return K.kb_seed(K.new_rows(existing, source="admin"), seeds).select("header_norm", "label", "source")


# Proposals: each order proposes a label for the header of its customer.
def proposals(spark, root):
    orders = derived(
        spark, root, "orders",
        f"""o_custkey AS id, o_orderkey AS updated_at, {header_of('o_custkey')} AS header_raw,
        case when o_orderkey % 5 = 0 then 'NONE' else 'ORG' end AS label,
        case when o_orderstatus = 'F' then 'active' else 'pending' end AS status,
        cast(o_orderkey % 50 as double) / 50 AS confidence,
        case when o_orderkey % 3 = 0 then concat('v', cast(o_orderkey as string)) else null end AS sample""",
    )
    places = derived(spark, root, "customer", KB_ROWS).select("id", "db_name", "table_name")
    return orders.join(places, "id").withColumn(
        "sample_values", F.when(F.col("sample").isNotNull(), F.array("sample"))
    )


@query(
    "kb_upsert",
    f"""WITH kb AS ({KB_SQL}), p AS (SELECT o_custkey AS id, o_orderkey AS k_at,
        case when o_orderkey % 5 = 0 then 'NONE' else 'ORG' end AS label,
        case when o_orderstatus = 'F' then 'active' else 'pending' end AS status,
        cast(o_orderkey % 50 as double) / 50 AS confidence,
        case when o_orderkey % 3 = 0 then concat('v', cast(o_orderkey as string)) end AS sample FROM orders),
    newest AS (SELECT id, max_by(label, k_at) AS label, max_by(status, k_at) AS status, max_by(confidence, k_at) AS confidence,
        max_by(sample, k_at) FILTER (sample IS NOT NULL) AS sample FROM p GROUP BY id)
    SELECT kb.id, header_norm, coalesce(newest.label, kb.label) AS label, coalesce(newest.status, kb.status) AS status,
     coalesce(newest.confidence, kb.confidence) AS confidence, sample FROM kb LEFT JOIN newest ON newest.id = kb.id""",
)
def kb_upsert(spark, root):
    updates = K.new_rows(proposals(spark, root))
    merged = K.kb_upsert(customer_kb(spark, root), updates)
    return merged.select(
        "id", "header_norm", "label", "status", "confidence", F.get("sample_values", F.lit(0)).alias("sample")
    )


@query(
    "kb_occurrences",
    f"""WITH kb AS ({KB_SQL}) SELECT id, header_norm, occurrences + coalesce(n, 0) AS occurrences FROM kb
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = kb.id""",
)
def kb_occurrences(spark, root):
    met = derived(spark, root, "orders", f"{header_of('o_custkey')} AS field")
    return K.kb_occurrences(customer_kb(spark, root), met).select("id", "header_norm", "occurrences")


@query(
    "kb_review_queue",
    f"SELECT id, header_norm, label, occurrences FROM ({KB_SQL}) WHERE status = 'pending'",
)
def kb_review_queue(spark, root):
    return K.review_queue(customer_kb(spark, root)).select("id", "header_norm", "label", "occurrences")


@query(
    "kb_bulk_approve",
    f"""SELECT id, CASE WHEN hit THEN 'active' ELSE status END AS status, CASE WHEN hit THEN 'admin' ELSE source END AS source
    FROM (SELECT *, id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS hit FROM ({KB_SQL}))""",
)
def kb_bulk_approve(spark, root):
    ids = derived(spark, root, "orders", "o_custkey AS id", "o_orderpriority = '1-URGENT'")
    return K.approve(customer_kb(spark, root), ids).select("id", "status", "source")


@query(
    "kb_relabel",
    f"""SELECT id, coalesce(new, label) AS label, CASE WHEN new IS NULL THEN source ELSE 'admin' END AS source
    FROM ({KB_SQL}) kb LEFT JOIN (SELECT o_custkey, max(lower(o_orderpriority)) AS new FROM orders
    WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = kb.id""",
)
def kb_relabel(spark, root):
    changes = derived(spark, root, "orders", "o_custkey AS id, lower(o_orderpriority) AS label", "o_orderstatus = 'P'")
    return K.relabel(customer_kb(spark, root), changes).select("id", "label", "source")


@query(
    "kb_reject",
    f"SELECT id, header_norm FROM ({KB_SQL}) WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def kb_reject(spark, root):
    ids = derived(spark, root, "orders", "o_custkey AS id", "o_totalprice > 300000")
    return K.reject(customer_kb(spark, root), ids).select("id", "header_norm")


PATTERN_VALUES = values_sql((p.name, p.regex, p.label, p.score) for p in DEFAULT_PATTERNS)
SNAPSHOT = f"""SELECT 'label' AS kind, to_json({{'header_norm': header_norm, 'header_raw': header_raw, 'label': label,
   'source': source, 'confidence': confidence, 'db_name': db_name, 'table_name': table_name}})::VARCHAR AS item
   FROM ({KB_SQL}) WHERE status = 'active'
   UNION ALL SELECT 'pattern', to_json({{'name': n, 'regex': r, 'label': l, 'score': s::DOUBLE}})::VARCHAR
   FROM (VALUES {PATTERN_VALUES}) v(n, r, l, s)"""


def snapshot(spark, root):
    patterns = spark.createDataFrame(pattern_rows(), PATTERN_SCHEMA)
    return K.snapshot_rows(customer_kb(spark, root), patterns)


@query("kb_snapshot", SNAPSHOT)
def kb_snapshot(spark, root):
    return snapshot(spark, root)


@query(
    "kb_snapshot_version",
    f"""SELECT sha256(string_agg(b || h, '' ORDER BY b || h)) AS version, CAST(sum(n) AS BIGINT) AS n_items FROM (
      SELECT left(h, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM (
        SELECT sha256(kind || chr(31) || item) AS h FROM ({SNAPSHOT})) GROUP BY left(h, 3))""",
)
def kb_snapshot_version(spark, root):
    return K.version_of(snapshot(spark, root))


# ---- labelling ---------------------------------------------------------------

ASKED = ("Nom Client", "E-MAIL", "Téléphone", "ville", "Segment", "Inconnu", "N° contrat", "numero_contrat", "nom", "Kennzeichen", "VIN", "contact")
CONTEXT = [
    ("nom", "ORG", "crm", "societes"), ("nom", "PERSONNE", None, "clients"), ("nom", "NONE", "dwh", None),
    ("contact", "TEL", "crm", None), ("contact", "NONE", "crm", None), ("contact", "EMAIL", None, "clients"),
    ("ville", "NONE", None, "societes"),
]
FIELDS = f"""c_custkey, {_case('c_custkey', ASKED)} AS field,
 case c_nationkey % 3 when 0 then null when 1 then 'crm' else 'dwh' end AS db,
 case c_nationkey % 4 when 0 then null when 1 then 'clients' when 2 then 'societes' else 'contrats' end AS "table" """
LEXICON = [(w, lb, None, None) for w, lb in K.lexicon_rows()] + CONTEXT


def lexicon_kb(spark):
    rows = spark.createDataFrame(LEXICON, "header_raw string, label string, db_name string, table_name string")
    return K.new_rows(rows)


@query(
    "label_columns",
    f"""WITH kb AS (SELECT {norm_sql('h')} AS header_norm, l AS label, d AS db, t AS tab FROM (VALUES {values_sql(LEXICON)}) v(h, l, d, t)),
    f AS (SELECT *, {norm_sql('field')} AS header_norm FROM (SELECT {FIELDS} FROM customer)),
    best AS (SELECT c_custkey, kb.label, CASE WHEN kb.db IS NOT NULL AND tab IS NOT NULL THEN 0 WHEN tab IS NOT NULL THEN 1
       WHEN kb.db IS NOT NULL THEN 2 ELSE 3 END AS level FROM f JOIN kb ON kb.header_norm = f.header_norm
       AND (kb.db IS NULL OR kb.db = f.db) AND (tab IS NULL OR tab = f."table"))
    SELECT f.c_custkey, f.field, b.label, coalesce(['exact', 'table', 'db', 'exact'][b.level + 1], 'none') AS match
    FROM f LEFT JOIN (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY level, label = 'NONE', label) = 1) b
    ON b.c_custkey = f.c_custkey""",
)
def label_columns(spark, root):
    fields = derived(spark, root, "customer", FIELDS.replace('"table"', "`table`"))
    return K.with_labels(fields, lexicon_kb(spark), fuzzy=False).select("c_custkey", "field", "label", "match")


TYPED = ("telefonnummer", "date_naissance", "customer_name", "numero_contrat", "vertragsnummer", "first_name", "last_name",
         "numero_police", "email", "adresse", "address", "kennzeichen", "contract", "geburtsdatum")
_WORD = _case("c_custkey", TYPED)
# one letter left out or doubled, at a place that moves with the key
TYPOS = f"""c_custkey, case when c_custkey % 2 = 0
 then concat(substring({_WORD}, 1, cast(c_custkey % 11 as int)), substring({_WORD}, cast(c_custkey % 11 as int) + 2))
 else concat(substring({_WORD}, 1, cast(c_custkey % 7 as int) + 1), substring({_WORD}, cast(c_custkey % 7 as int) + 1)) end AS field"""


@query(
    "fuzzy_label_columns",
    f"""WITH RECURSIVE kb AS (SELECT DISTINCT {norm_sql('h')} AS k FROM (VALUES {values_sql(LEXICON)}) v(h, l, d, t)),
    asked AS (SELECT DISTINCT {norm_sql('field')} AS h FROM (SELECT {TYPOS} FROM customer)),
    pairs AS (SELECT h, k FROM asked, kb WHERE least(length(h), length(k)) * 200.0 / (length(h) + length(k)) >= 88),
    dp AS (SELECT h, k, 0 AS i, list_transform(range(0, length(k) + 1), lambda x: 0) AS r FROM pairs
      UNION ALL SELECT h, k, i + 1, list_reduce(range(1, length(k) + 1),
        lambda a, j: list_append(a, CASE WHEN substring(h, i + 1, 1) = substring(k, j::INT, 1) THEN r[j] + 1
           ELSE greatest(r[j + 1], a[len(a)]) END), [0]) FROM dp WHERE i < length(h)),
    scored AS (SELECT h, k, 200.0 * r[len(r)] / (length(h) + length(k)) AS score FROM dp WHERE i = length(h)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC, k) AS n,
       lead(score) OVER (PARTITION BY h ORDER BY score DESC, k) AS second FROM scored WHERE score >= 88)
    SELECT c_custkey, f.field, k AS kb_header, CAST(round(score, 4) AS DOUBLE) AS score
    FROM (SELECT *, {norm_sql('field')} AS h FROM (SELECT {TYPOS} FROM customer)) f
    JOIN ranked ON ranked.h = f.h AND n = 1 AND (second IS NULL OR score - second > 3)""",
)
def fuzzy_label_columns(spark, root):
    fields = derived(spark, root, "customer", TYPOS)
    fields = fields.withColumn("header_norm", K.normalize_header(F.col("field")))
    near = K.fuzzy_headers(fields, lexicon_kb(spark))
    return fields.join(near, "header_norm").select("c_custkey", "field", "kb_header", F.round("score", 4).alias("score"))
