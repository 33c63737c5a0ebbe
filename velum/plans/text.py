"""Detection, tokens, masking and restoring on the documents table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from velum.functions.patterns import DEFAULT_PATTERNS, IDENTIFIER_PATTERNS, DetectorConfig, Pattern
from velum.operators import containment, detect, mask, spans, tokens
from velum.plans.base import DOC_FINDINGS, DOC_MASKED, DOC_SPANS, derived, query, spans_sql, tokens_sql
from velum.session import stage
from velum.sources.files import table

# A second number pattern that meets the card pattern on the same spans.
WITH_LONG_NUMBERS = DEFAULT_PATTERNS + [Pattern("LONG_NUMBER", r"\b\d{12,19}\b", "ID", 0.5)]
LONG_SPANS = spans_sql("documents", "doc_id, lang", "text", WITH_LONG_NUMBERS)

PEOPLE = ("Hein", "Keit", "Avec", "Elle", "Hant")


def lexicon_model(names=PEOPLE):
    """A model hook that knows a list of names."""

    def load():
        import re

        regex = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)")

        def predict(texts: pd.Series):
            for text in texts:
                yield [(m.start(), m.end(), m.group(), "person", 0.9) for m in regex.finditer(text)]

        return predict

    return load


def doc_findings(spark, root):
    docs = table(spark, root, "documents").withColumnRenamed("source", "scope")
    found = detect.detect_entities(docs, ["scope", "doc_id"])
    return found.withColumn("ord", F.lit(1))


def doc_tokens(spark, root):
    return tokens.assign_tokens(doc_findings(spark, root))


@query(
    "detect_entities",
    f"""SELECT doc_id, label, value, CAST(start AS BIGINT) AS start, CAST(start + length(value) AS BIGINT) AS "end", score
    FROM ({DOC_SPANS})""",
)
def detect_entities(spark, root):
    found = detect.detect_entities(table(spark, root, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "label", "value", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "score"
    )


@query(
    "dedupe_spans",
    f"""SELECT doc_id, CAST(start AS BIGINT) AS start, value, label FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, start, length(value) ORDER BY prio) AS r
        FROM ({LONG_SPANS})) WHERE r = 1""",
)
def dedupe_spans(spark, root):
    config = DetectorConfig(patterns=tuple(WITH_LONG_NUMBERS))
    found = detect.detect_entities(table(spark, root, "documents"), ["doc_id"], config=config)
    return detect.dedupe_spans(found, ["doc_id"]).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), "value", "label"
    )


@query(
    "entity_counts",
    f"""SELECT doc_id, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS entity_counts
    FROM (SELECT doc_id, label, count(*) AS n FROM ({DOC_SPANS}) GROUP BY ALL) GROUP BY doc_id""",
)
def entity_counts(spark, root):
    found = detect.detect_entities(table(spark, root, "documents"), ["doc_id"])
    return detect.entity_counts(found, ["doc_id"]).withColumn("entity_counts", F.to_json("entity_counts"))


@query(
    "source_counts",
    f"""SELECT lang, CAST(sum(p) AS BIGINT) AS pattern, CAST(sum(m) AS BIGINT) AS model, CAST(sum(p + m) AS BIGINT) AS total FROM (
        SELECT lang, 1 AS p, 0 AS m FROM ({LONG_SPANS}) WHERE label <> 'ID'
        UNION ALL
        SELECT lang, 0, len(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'),
            lambda w: w IN {PEOPLE})) FROM documents) GROUP BY lang HAVING sum(p + m) > 0""",
)
def source_counts(spark, root):
    docs = table(spark, root, "documents")
    found = detect.detect_entities(docs, ["doc_id", "lang"]).unionByName(
        detect.detect_with_model(docs, ["doc_id", "lang"], lexicon_model())
    )
    return detect.source_counts(detect.dedupe_spans(found, ["doc_id", "lang"]), ["lang"], ["pattern", "model"])


# Detectors that meet, nest and overlap: hosts inside addresses, numbers inside cards, words around both.
OVERLAPPING = DEFAULT_PATTERNS + [
    Pattern("LONG_NUMBER", r"\b\d{12,19}\b", "ID", 0.5),
    Pattern("HOST", r"[A-Za-z0-9-]+\.(?:org|com|net|example)", "ORG", 0.4),
    Pattern("PAIR", r"[a-z]+ [0-9]+", "ID", 0.3),
]
# chosen one after the other: longest, then priority, then from the left
RESOLVED = f"""WITH found AS ({spans_sql('documents', 'doc_id', 'text', OVERLAPPING)}),
lists AS (SELECT doc_id, list({{'s': start, 'e': start + length(value), 'v': value, 'l': label}}
    ORDER BY -length(value), prio, start, -score, label, value) AS a FROM found GROUP BY doc_id),
chosen AS (SELECT doc_id, list_reduce(a, lambda got, x: CASE WHEN len(list_filter(got, lambda g: g.s < x.e AND x.s < g.e)) = 0
    THEN list_append(got, x) ELSE got END, a[1:0]) AS c FROM lists)"""


def _overlapping(spark, root):
    docs = table(spark, root, "documents")
    found = detect.detect_entities(docs, ["doc_id"], config=DetectorConfig(patterns=tuple(OVERLAPPING)))
    return spans.resolve_spans(found, ["doc_id"])


@query(
    "resolve_spans",
    RESOLVED + """ SELECT doc_id, CAST(x.s AS BIGINT) AS start, CAST(x.e AS BIGINT) AS "end", x.v AS value, x.l AS label
    FROM (SELECT doc_id, unnest(c) AS x FROM chosen)""",
)
def resolve_spans(spark, root):
    return _overlapping(spark, root).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "value", "label"
    )


@query(
    "rebuild_text",
    RESOLVED + """ SELECT d.doc_id, CASE WHEN c IS NULL THEN text ELSE
      list_reduce(list_reverse_sort(c), lambda a, x: a[:x.s] || '<' || x.l || '>' || a[x.e + 1:], text) END AS text
    FROM documents d LEFT JOIN (SELECT doc_id, list_transform(c, lambda x: {'s': x.s, 'e': x.e, 'l': x.l}) AS c FROM chosen) USING (doc_id)""",
)
def rebuild_text(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    puts = _overlapping(spark, root).select("doc_id", "start", "end", F.concat(F.lit("<"), "label", F.lit(">")).alias("put"))
    return spans.rebuild_text(docs, puts, ["doc_id"])


SWISS = """c_custkey, concat('Dossier AVS 756.', lpad(cast(c_custkey % 10000 as string), 4, '0'), '.',
 lpad(cast((c_custkey * 7) % 10000 as string), 4, '0'), '.', lpad(cast(c_custkey % 100 as string), 2, '0'),
 ', police PO', lpad(cast(c_custkey as string), 9, '0'), '-', lpad(cast((c_custkey * 3) % 100000 as string), 5, '0'), '/',
 lpad(cast(c_custkey % 100 as string), 2, '0'), ' contrat CT-', lpad(cast(c_custkey % 999983 as string), 7, '0'),
 case when c_custkey % 3 = 0 then concat(' chassis WVWZZZ1KZ', lpad(cast(c_custkey as string), 8, '0')) else '' end,
 ' refus XCT-12345 et POCT-1') AS text"""


@query(
    "detect_swiss_ids",
    f"""SELECT c_custkey, label, value, CAST(start AS BIGINT) AS start, score FROM (
    {spans_sql(f'(SELECT {SWISS} FROM customer)', 'c_custkey', 'text', IDENTIFIER_PATTERNS)})""",
)
def detect_swiss_ids(spark, root):
    texts = derived(spark, root, "customer", SWISS)
    found = detect.detect_entities(texts, ["c_custkey"], config=DetectorConfig(patterns=tuple(IDENTIFIER_PATTERNS)))
    return found.select("c_custkey", "label", "value", F.col("start").cast("bigint").alias("start"), "score")


@query("assign_tokens", DOC_FINDINGS + " SELECT scope, label, n, token, value FROM tokens")
def assign_tokens(spark, root):
    return doc_tokens(spark, root)


@query("mask_documents", DOC_MASKED + " SELECT doc_id, text FROM masked")
def mask_documents(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    return mask.mask_documents(docs, "source").rows.select("doc_id", "text")


@query(
    "leak_check",
    DOC_MASKED + """ SELECT count(*) AS checked,
    CAST(count(*) FILTER (contains(m.text, f.value)) AS BIGINT) AS leaks
    FROM (SELECT DISTINCT doc_id, value FROM found) f JOIN masked m USING (doc_id)""",
)
def leak_check(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    result = mask.mask_documents(docs, "source")
    leaks = tokens.leak_check(result.rows, result.findings, ["doc_id"])
    checked = result.findings.select("doc_id", "value").distinct()
    return checked.agg(F.count("*").alias("checked")).select(
        "checked", leaks.agg(F.count("*")).scalar().alias("leaks")
    )


# masked texts, the last one of each scope with the scope's first mapped value put back
PLANTED = """SELECT m.doc_id, m.source, CASE WHEN m.doc_id = p.last THEN concat(m.text, ' ... ', p.value) ELSE m.text END AS text
 FROM masked m LEFT JOIN (SELECT source, last, value FROM (SELECT source, max(doc_id) AS last FROM masked GROUP BY source) s
   JOIN (SELECT scope, min(value) AS value FROM tokens GROUP BY scope) v ON v.scope = s.source) p ON p.source = m.source"""


@query(
    "leak_check_scope",
    DOC_MASKED + f""", planted AS ({PLANTED})
    SELECT p.source AS scope, doc_id, value, CAST((length(text) - length(replace(text, value, ''))) // length(value) AS BIGINT) AS n
    FROM planted p JOIN tokens t ON t.scope = p.source AND contains(p.text, t.value)""",
)
def leak_check_scope(spark, root):
    """Each value of a scope's map is sought in every masked text of the scope; one is planted per scope."""
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    result = mask.mask_documents(docs, "source")
    token_map = stage(result.token_map, "tokens")
    result.rows.createOrReplaceTempView("masked")
    token_map.createOrReplaceTempView("tokens")
    return containment.leak_check_scope(spark.sql(PLANTED), token_map, ["doc_id"], scope="source")


@query(
    "scope_containment",
    DOC_FINDINGS + """ SELECT d.source AS scope, doc_id, value FROM documents d
    JOIN tokens t ON t.scope = d.source AND contains(d.text, t.value)""",
)
def scope_containment(spark, root):
    """Every text that holds a value found anywhere in its scope."""
    docs = table(spark, root, "documents")
    found = containment.contained_values(docs, stage(doc_tokens(spark, root), "tokens"), ["doc_id"], scope="source")
    return found.select("scope", "doc_id", "value").distinct()


ORDER_TEXTS = """o_orderkey, 'all' AS scope, concat('Order for [PERSONNE_', cast(o_custkey as string), '], mail [EMAIL_',
 cast(o_custkey % 10 as string), '] (not [PERSONNE_', cast(o_custkey % 7 as string), '0]), ref [POLICE_',
 cast(o_orderkey as string), '] list [1, 2]') AS text"""
CUSTOMER_MAP = "'all' AS scope, concat('[PERSONNE_', cast(c_custkey as string), ']') AS token, c_name AS value"
EMAIL_MAP = """'all' AS scope, concat('[EMAIL_', cast(c_custkey % 10 as string), ']') AS token,
 concat('client', cast(c_custkey % 10 as string), '@example.com') AS value"""
RESTORED = f"""WITH texts AS (SELECT o_custkey, {ORDER_TEXTS} FROM orders),
 names AS (SELECT {CUSTOMER_MAP} FROM customer), mails AS (SELECT DISTINCT {EMAIL_MAP} FROM customer)
 SELECT o_orderkey, replace(replace(replace(text, a.token, coalesce(a.value, '')), c.token, coalesce(c.value, '')),
    b.token, coalesce(b.value, '')) AS text
 FROM (SELECT *, '[PERSONNE_' || o_custkey || ']' AS ta, '[PERSONNE_' || (o_custkey % 7) || '0]' AS tc,
        '[EMAIL_' || (o_custkey % 10) || ']' AS tb FROM texts) t
 LEFT JOIN names a0 ON a0.token = ta LEFT JOIN names c0 ON c0.token = tc LEFT JOIN mails b0 ON b0.token = tb,
 LATERAL (SELECT ta AS token, coalesce(a0.value, ta) AS value) a,
 LATERAL (SELECT tc AS token, coalesce(c0.value, tc) AS value) c,
 LATERAL (SELECT tb AS token, coalesce(b0.value, tb) AS value) b"""


def order_map(spark, root):
    return derived(spark, root, "customer", CUSTOMER_MAP).unionByName(
        derived(spark, root, "customer", "DISTINCT " + EMAIL_MAP)
    )


@query("restore_text", RESTORED)
def restore_text(spark, root):
    texts = derived(spark, root, "orders", ORDER_TEXTS)
    return tokens.restore_text(texts, order_map(spark, root), ["o_orderkey"]).select("o_orderkey", "text")


@query("export_token_map", DOC_FINDINGS + " SELECT token, value FROM tokens WHERE scope = 'src3'")
def export_token_map(spark, root):
    return tokens.export_token_map(doc_tokens(spark, root), "src3")


@query(
    "erase_scope",
    DOC_FINDINGS + """ SELECT t.scope, t.value,
     '[' || t.label || '_' || (n + CASE WHEN t.scope = 'src3' THEN top ELSE 0 END) || ']' AS token
     FROM tokens t JOIN (SELECT scope, label, max(n) AS top FROM tokens GROUP BY ALL) h
     ON h.scope = t.scope AND h.label = t.label""",
)
def erase_scope(spark, root):
    """Erase one scope, then meet its values again: old numbers are not given twice."""
    findings = stage(doc_findings(spark, root), "findings")
    first = stage(tokens.assign_tokens(findings), "tokens")
    kept = tokens.erase_scope(first, "src3")
    again = tokens.assign_tokens(findings, kept, tokens.high_water(first))
    return kept.unionByName(again).select("scope", "value", "token")


EVENT_TOKENS = """cast(user_id as string) AS scope, event_type AS label, event_id AS n,
 concat('[', upper(event_type), '_', cast(event_id as string), ']') AS token, cast(event_id as string) AS value"""
NOW = "timestamp '2024-01-20 12:00:00'"


@query(
    "expire_tokens",
    f"""WITH m AS (SELECT {EVENT_TOKENS}, ts AS created_at FROM events WHERE ts <= {NOW})
    SELECT scope, count(*) AS tokens FROM m
    WHERE scope IN (SELECT scope FROM m GROUP BY scope HAVING max(created_at) + INTERVAL 86400 SECOND > {NOW})
    GROUP BY scope""",
)
def expire_tokens(spark, root):
    token_map = derived(spark, root, "events", EVENT_TOKENS + ", cast(ts as timestamp) AS created_at", f"cast(ts as timestamp) <= {NOW}")
    return tokens.expire_tokens(token_map, F.expr(NOW)).groupBy("scope").agg(F.count("*").alias("tokens"))
