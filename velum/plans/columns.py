"""Column profiles, discovery scan, pattern table, column masking."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from velum.functions.patterns import DEFAULT_PATTERNS, PATTERN_SCHEMA, pattern_rows
from velum.functions.text import value_metadata
from velum.operators import columns as C
from velum.operators import kb as K
from velum.operators import mask, registry
from velum.operators.pattern_index import detect_by_index, load_pattern_table
from velum.operators.query import masked_query as run_masked_query
from velum.operators.scan import Scan
from velum.plans.base import ORACLE, derived, query, quote, spans_sql, tokens_sql, values_sql
from velum.plans.kb import lexicon_kb
from velum.sources import catalog, query as Q
from velum.session import shared_dir
from velum.sources.files import table

VALUES = """c_custkey, case c_custkey % 10
 when 0 then c_name when 1 then concat('user', cast(c_custkey as string), '@example.com')
 when 2 then lpad(cast(c_custkey as string), 13, '7') when 3 then concat('CH93', lpad(cast(c_custkey as string), 17, '0'))
 when 4 then concat('079 123 45 ', lpad(cast(c_custkey % 100 as string), 2, '0')) when 5 then '12.03.1984'
 when 6 then concat('https://example.com/', cast(c_custkey as string)) when 7 then lower(c_mktsegment)
 when 8 then concat('Zoé, ', c_mktsegment) else concat('A', cast(c_custkey as string)) end AS value"""


def charset_sql(v: str) -> str:
    return f"""CASE WHEN regexp_matches({v}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email'
     WHEN regexp_matches({v}, '(?i)^https?://') THEN 'url' WHEN regexp_matches({v}, '^[0-9]+$') THEN 'digits'
     WHEN regexp_matches({v}, '^[a-zA-Z]+$') THEN 'alpha' WHEN regexp_matches({v}, '^[a-zA-Z0-9]+$') THEN 'alphanum'
     ELSE 'mixed' END"""


def hint_sql(v: str) -> str:
    return f"""CASE WHEN regexp_matches({v}, '^[0-9]{{13}}$') THEN 'avs'
     WHEN regexp_matches({v}, '^(CH|LI)[0-9]{{2}}[0-9]{{5}}[A-Za-z0-9]{{5,17}}$') THEN 'iban_ch'
     WHEN regexp_matches({v}, '^(\\+41|0041)?[0-9]{{2,3}}\\s?[0-9]{{3}}\\s?[0-9]{{2}}\\s?[0-9]{{2}}$') THEN 'phone'
     WHEN regexp_matches({v}, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}$') THEN 'date'
     WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date'
     WHEN regexp_matches({v}, '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?$') THEN 'date' ELSE 'none' END"""


PUNCT = "'[.,;:!?''\\-/@&]'"


@query(
    "value_metadata",
    f"""SELECT c_custkey, length(value) AS length, {charset_sql('value')} AS charset, contains(value, ' ') AS has_spaces,
     regexp_matches(value, {PUNCT}) AS has_punctuation, {hint_sql('value')} AS regex_hint,
     left(sha256(value), 8) AS sample_hash FROM (SELECT {VALUES} FROM customer)""",
)
def metadata(spark, root):
    rows = derived(spark, root, "customer", VALUES)
    return rows.select("c_custkey", value_metadata(F.col("value")).alias("m")).select("c_custkey", "m.*")


SCANNED = ("customer", "supplier", "part", "nation", "accounts")
ACCOUNTS = """c_custkey AS account_id, concat('client', cast(c_custkey as string), '@example.com') AS contact_mail,
 lpad(cast(c_custkey as string), 13, '7') AS ahv, concat('079 123 45 ', lpad(cast(c_custkey % 100 as string), 2, '0')) AS natel,
 case when c_custkey % 3 = 0 then null else concat('AG ', lpad(cast(c_custkey as string), 6, '0')) end AS plaque,
 concat('Rue ', cast(c_custkey as string)) AS adresse_client, c_mktsegment AS remark"""


def tables(spark, root):
    out = {t: table(spark, root, t) for t in SCANNED if t != "accounts"}
    out["accounts"] = derived(spark, root, "customer", ACCOUNTS)
    return out


COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "accounts": ["account_id", "contact_mail", "ahv", "natel", "plaque", "adresse_client", "remark"],
}


def cells_sql() -> str:
    parts = [
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST(\"{c}\" AS VARCHAR) AS v FROM "
        + (f"(SELECT {ACCOUNTS} FROM customer)" if t == "accounts" else t)
        for t, cs in COLUMNS.items()
        for c in cs
    ]
    return "\nUNION ALL ".join(parts)


PROFILE = f"""SELECT "table", "column", count(*) AS n, count(v) AS n_values, round(avg(length(v)), 4) AS avg_length,
 min(length(v)) AS min_length, max(length(v)) AS max_length,
 {', '.join(f"count(*) FILTER (v IS NOT NULL AND {charset_sql('v')} = '{c}') AS cs_{c}" for c in C.CHARSETS)},
 {', '.join(f"count(*) FILTER (v IS NOT NULL AND {hint_sql('v')} = '{h}') AS hint_{h}" for h in C.HINTS)},
 count(*) FILTER (contains(v, ' ')) AS with_spaces, count(*) FILTER (regexp_matches(v, {PUNCT})) AS with_punctuation,
 min(regexp_replace(v, '[0-9]', '9', 'g')) AS shape_min, max(regexp_replace(v, '[0-9]', '9', 'g')) AS shape_max
 FROM ({cells_sql()}) GROUP BY ALL"""


@query("profile_columns", PROFILE)
def profile_columns(spark, root):
    profiles = C.profile_catalog(tables(spark, root), "shop")
    return profiles.select("table", "column", *C.PROFILE).withColumn("avg_length", F.round("avg_length", 4))


@query(
    "sample_columns",
    f"""SELECT "column", r AS rank, v AS value FROM (
      {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", account_id, r, CAST({c} AS VARCHAR) AS v FROM first" for c in COLUMNS['accounts'])})
      WHERE v IS NOT NULL""".replace(
        "FROM first", f"FROM (SELECT *, row_number() OVER (ORDER BY account_id) - 1 AS r FROM (SELECT {ACCOUNTS} FROM customer) QUALIFY r < 7)"
    ),
)
def sample_columns(spark, root):
    return C.first_samples(derived(spark, root, "customer", ACCOUNTS), ["account_id"], 7)


_HEAD = 'lower("column")'
STRATEGY = f"""CASE WHEN n_values = 0 THEN 'keep' WHEN cs_email >= 0.8 * n_values THEN 'mask_email'
 WHEN hint_avs + hint_iban_ch >= 0.8 * n_values THEN 'mask_id' WHEN hint_date >= 0.8 * n_values THEN 'mask_date'
 WHEN hint_phone >= 0.8 * n_values AND NOT regexp_matches({_HEAD}, '(?:key|_id|status|type|segment)$') THEN 'mask_phone'
 WHEN regexp_matches({_HEAD}, '(?:^|_)(name|nom|prenom|vorname|nachname)(?:_|$)') THEN 'mask_name'
 WHEN regexp_matches({_HEAD}, '(?:^|_)(address|adresse|city|ville|street|rue|strasse|ort)(?:_|$)') THEN 'mask_address'
 WHEN regexp_matches({_HEAD}, '(?:^|_)(plate|plaque|immatriculation|kennzeichen)(?:_|$)') THEN 'mask_plate' ELSE 'keep' END"""
SCAN = f"""SELECT *, CASE strategy WHEN 'mask_name' THEN 'PERSONNE' WHEN 'mask_email' THEN 'EMAIL' WHEN 'mask_phone' THEN 'TEL'
  WHEN 'mask_date' THEN 'DATE' WHEN 'mask_address' THEN 'LOCALISATION' WHEN 'mask_plate' THEN 'PLAQUE' WHEN 'mask_id' THEN 'ID' END AS label,
  round(CASE strategy WHEN 'keep' THEN 0.5 WHEN 'mask_email' THEN cs_email / n_values WHEN 'mask_id' THEN (hint_avs + hint_iban_ch) / n_values
   WHEN 'mask_date' THEN hint_date / n_values WHEN 'mask_phone' THEN hint_phone / n_values ELSE 0.75 END, 2)::DOUBLE AS confidence,
  CASE WHEN strategy <> 'keep' AND shape_min = shape_max AND contains(shape_min, '9') THEN
   '\\b' || array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: regexp_replace(gaps[i], '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g')
     || CASE WHEN i <= len(runs) THEN '\\d{{' || length(runs[i]) || '}}' ELSE '' END), '') || '\\b' END AS regex
 FROM (SELECT *, {STRATEGY} AS strategy, string_split_regex(shape_min, '9+') AS gaps, regexp_extract_all(shape_min, '9+') AS runs
   FROM ({PROFILE}) WHERE NOT ("table" = 'customer' AND "column" = 'c_name'))"""


def place_kb(spark):
    """One column is labelled already in this place; another only elsewhere."""
    rows = spark.createDataFrame(
        [("c_name", "PERSONNE", "shop", "customer"), ("s_name", "ORG", "other", "supplier")],
        "header_raw string, label string, db_name string, table_name string",
    )
    return K.new_rows(rows)


def run_scan(spark, root):
    return C.scan_catalog(tables(spark, root), "shop", place_kb(spark))


@query(
    "scan_columns",
    f"""SELECT 'shop' AS db, "table", "column", n_values, strategy, label, confidence, regex,
     CASE WHEN label IS NULL THEN NULL WHEN confidence >= 0.7 THEN 'active' ELSE 'pending' END AS status FROM ({SCAN})""",
)
def scan_columns(spark, root):
    return run_scan(spark, root).select(
        "db", "table", "column", "n_values", "strategy", "label", "confidence", "regex", "status"
    )


@query(
    "detect_many_patterns",
    """SELECT o_orderkey, c_name AS value, 'PERSONNE' AS label, 7 AS start, 25 AS "end" FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def detect_many_patterns(spark, root):
    """Every customer's name is a custom pattern, loaded from a pattern table and found by index."""
    rows = table(spark, root, "customer").selectExpr(
        "c_name AS name", r"concat('\\bCustomer#', right(c_name, 9), '\\b') AS regex", "'PERSONNE' AS label", "0.8D AS score", "true AS active", "'admin' AS source")
    texts = derived(spark, root, "orders", "o_orderkey, concat('Client Customer#', lpad(cast(o_custkey as string), 9, '0'), ', not Customer#', cast(o_custkey as string)) AS text")
    return detect_by_index(texts, ["o_orderkey"], load_pattern_table(rows)).select("o_orderkey", "value", "label", "start", "end")


@query("scan_resumed", ORACLE["scan_columns"])
def scan_resumed(spark, root):
    """A scan that takes one table, meets a table it cannot open, and goes on in two further calls."""
    scan = Scan(spark, os.path.join(shared_dir(spark), f"scan-{uuid.uuid4().hex}"))
    sources = dict(tables(spark, root))
    first = max(sources)
    closed = sources | {first: lambda: spark.read.parquet(os.path.join(scan.path, "nowhere"))}
    scan.run(closed, "shop", place_kb(spark), most=1)
    scan.run(closed, "shop", place_kb(spark))
    scan.run(sources, "shop", place_kb(spark))
    return scan.proposals().drop("sql_type")


@query(
    "scan_summary",
    f"""SELECT 'done' AS status, CAST({sum(map(len, COLUMNS.values()))} AS BIGINT) AS total_cols,
     count(*) FILTER (n_values > 0) AS sampled_cols, count(label) AS found_labels,
     'supplier' AS last_table, 's_suppkey' AS last_column FROM ({SCAN})""",
)
def scan_summary(spark, root):
    inventory = catalog.frame_inventory(spark, tables(spark, root), "shop")
    return C.scan_summary(run_scan(spark, root), inventory)


@query(
    "column_inventory",
    """SELECT table_name AS "table", column_name AS "column", n AS n_rows FROM information_schema.columns JOIN
    (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
     UNION ALL SELECT 'documents', count(*) FROM documents) c ON c.t = table_name""",
)
def column_inventory(spark, root):
    """Inventory of catalogued views, with each table's size."""
    names = ("customer", "orders", "documents")
    sizes = None
    for name in names:
        rows = table(spark, root, name)
        rows.createOrReplaceTempView(name)
        size = rows.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        sizes = size if sizes is None else sizes.unionByName(size)
    found = catalog.column_inventory(spark, ["default"]).where(F.col("table").isin(*names))
    return found.join(sizes, "table").select("table", "column", "n_rows")


# ---- pattern table -------------------------------------------------------------

# Pattern candidates made from parts: sound ones and every kind of unsound one.
CANDIDATES = r"""p_partkey, concat('p_', p_name, '_', cast(p_size as string)) AS name,
 case p_partkey % 9 when 1 then '   ' when 2 then concat('(', p_brand, '+)+') when 3 then concat(p_brand, '(\d')
 when 4 then concat('(?:', p_type, '[a-z]{0,60}){2,}') when 5 then rpad(p_brand, 201, 'x')
 when 6 then concat(p_brand, '(?:-\d{2,4}){1,50}\b') else concat('\b', p_brand, '-\d{', cast(p_size as string), '}\b') end AS regex,
 'ID' AS label, cast(0.8 as double) AS score, true AS active, 'manual' AS source"""
REASON = """CASE p_partkey % 9 WHEN 1 THEN 'blank' WHEN 2 THEN 'nested repeats' WHEN 3 THEN 'invalid'
 WHEN 4 THEN 'nested repeats' WHEN 5 THEN 'too long' ELSE '' END"""


def candidates(spark, root):
    select = CANDIDATES.replace("\\", "\\\\")
    return derived(spark, root, "part", select)


@query("vet_patterns", f"SELECT p_partkey, {REASON} = '' AS ok, {REASON} AS reason FROM part")
def vet_patterns(spark, root):
    return registry.vet_patterns(candidates(spark, root)).select("p_partkey", "ok", "reason")


@query(
    "pattern_registry",
    f"""WITH c AS (SELECT {CANDIDATES}, {REASON} AS reason FROM part)
    SELECT name, regex FROM (VALUES {values_sql((p.name, p.regex) for p in DEFAULT_PATTERNS)}) v(name, regex)
    UNION ALL SELECT name, min(regex) FROM c WHERE reason = '' GROUP BY name""",
)
def pattern_registry(spark, root):
    stored = spark.createDataFrame(pattern_rows(), PATTERN_SCHEMA)
    return registry.register_patterns(stored, candidates(spark, root)).select("name", "regex")


@query(
    "suggest_patterns",
    f"""SELECT left('qwen_shop_' || "table" || '_' || "column", 64) AS name, regex, label, round(confidence, 2) AS score
    FROM ({SCAN}) WHERE regex IS NOT NULL AND regex <> '\\b\\d{{13}}\\b'""",
)
def suggest_patterns(spark, root):
    stored = spark.createDataFrame([("AHV", r"\b\d{13}\b", "AVS", 0.9, True, "manual")], PATTERN_SCHEMA)
    return registry.suggest_patterns(run_scan(spark, root), stored).select("name", "regex", "label", "score")


ANSWERS = """c_custkey, case c_custkey % 10
 when 0 then '{"strategy": "mask_name", "confidence": 0.93, "regex": null}'
 when 1 then concat('```json', chr(10), '{"strategy": "MASK_EMAIL", "confidence": 1.7}', chr(10), '```')
 when 2 then concat('The answer is {"strategy": "mask_id", "confidence": 0.', cast(c_custkey % 89 + 10 as string), ', "regex": "AB-[0-9]{4}"} I think')
 when 3 then 'I would use mask_phone here' when 4 then 'no idea' when 5 then ''
 when 6 then '{"strategy": "please mask_date", "confidence": -1}' when 7 then '{"strategy": "unknown"}'
 when 8 then '{"confidence": "high", "strategy": "redact", "regex": "  "}' else '[1, 2]' end AS raw"""


@query(
    "resolve_classifier_output",
    """WITH s AS (SELECT c_custkey, k, ['mask_name', 'mask_email', 'mask_id', 'mask_phone', 'keep', 'keep', 'mask_date', 'keep', 'redact', 'keep'][k + 1] AS strategy,
      CASE k WHEN 0 THEN 0.93 WHEN 1 THEN 1.0 WHEN 2 THEN ('0.' || (c_custkey % 89 + 10))::DOUBLE WHEN 6 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
      CASE WHEN k = 2 THEN 'AB-[0-9]{4}' END AS regex FROM (SELECT c_custkey, c_custkey % 10 AS k FROM customer))
    SELECT c_custkey, strategy, confidence, regex, CASE strategy WHEN 'mask_name' THEN 'PERSONNE' WHEN 'mask_email' THEN 'EMAIL'
      WHEN 'mask_id' THEN 'ID' WHEN 'mask_phone' THEN 'TEL' WHEN 'mask_date' THEN 'DATE' WHEN 'redact' THEN 'REDACT' END AS label FROM s""",
)
def resolve_classifier_output(spark, root):
    answers = derived(spark, root, "customer", ANSWERS)
    return C.resolve_answers(answers).select("c_custkey", "strategy", "confidence", "regex", "label")


# ---- masked tables ---------------------------------------------------------------

NOTED = """c_custkey, c_name, c_mktsegment, c_acctbal, case when c_custkey % 3 = 0 then
 concat('call back, mail m', cast(c_custkey % 50 as string), '@example.com or 10.0.0.', cast(c_custkey % 200 as string)) else 'nothing to add' end AS note"""


@query(
    "mask_customers",
    f"""WITH src AS (SELECT {NOTED} FROM customer), found AS (
      SELECT c_mktsegment AS scope, c_custkey AS doc_id, 0 AS ord, 0 AS start, 0 AS prio, c_name AS value, 'PERSONNE' AS label FROM src
      UNION ALL SELECT scope, doc_id, 1, start, prio, value, label FROM ({spans_sql('(SELECT *, c_mktsegment AS scope, c_custkey AS doc_id FROM src)', 'scope, doc_id', 'note')})),
    tokens AS ({tokens_sql('found')}),
    lists AS (SELECT doc_id, list({{'k': f.value, 'v': token}} ORDER BY length(f.value) DESC, f.value) AS e
      FROM (SELECT DISTINCT scope, doc_id, value FROM found WHERE ord = 1) f JOIN tokens t ON t.scope = f.scope AND t.value = f.value GROUP BY 1)
    SELECT c_custkey, t.token AS c_name, c_mktsegment, c_acctbal,
      CASE WHEN e IS NULL THEN note ELSE list_reduce(e, lambda a, x: replace(a, x.k, x.v), note) END AS note
    FROM src JOIN tokens t ON t.scope = c_mktsegment AND t.value = c_name LEFT JOIN lists ON doc_id = c_custkey""",
)
def mask_customers(spark, root):
    rows = derived(spark, root, "customer", NOTED)
    return mask.mask_columns(rows, "c_custkey", "c_mktsegment", {"c_name": "PERSONNE"}, ["note"]).rows


TOP_CLIENTS = """SELECT c_name AS nom_client, c_mktsegment AS segment, count(*) AS n_orders FROM customer JOIN orders
 ON o_custkey = c_custkey GROUP BY c_name, c_mktsegment ORDER BY n_orders DESC, nom_client LIMIT 20"""


@query(
    "masked_query",
    f"""SELECT '[PERSONNE_' || row_number() OVER (ORDER BY n_orders DESC, nom_client) || ']' AS nom_client, segment,
     n_orders FROM ({TOP_CLIENTS})""",
)
def masked_query(spark, root):
    for name in ("customer", "orders"):
        table(spark, root, name).createOrReplaceTempView(name)
    return run_masked_query(spark, TOP_CLIENTS, lexicon_kb(spark)).rows


QUERY_LOG = """o_orderkey, case o_orderkey % 8 when 0 then concat('select * from orders where o_orderkey = ', cast(o_orderkey as string))
 when 1 then 'select 1;' when 2 then 'delete from orders' when 3 then 'select 1; select 2' when 4 then '  '
 when 5 then 'with t as (select 1) select * from t' when 6 then 'with t as (select 1) UPDATE orders set a = 1'
 else 'explain select 1' end AS "sql" """


@query(
    "readonly_check",
    """SELECT o_orderkey, [NULL, NULL, 'not a select', 'several statements', 'empty', NULL, 'write word', 'not a select'][o_orderkey % 8 + 1] AS refusal
    FROM orders""",
)
def readonly_check(spark, root):
    log = derived(spark, root, "orders", QUERY_LOG.replace('"sql"', "sql"))
    return log.select("o_orderkey", Q.refusal_column(F.col("sql")).alias("refusal"))
