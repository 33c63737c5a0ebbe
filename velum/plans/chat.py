"""Conversations and chat bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from velum.functions.text import already_masked as masked_already
from velum.operators import audit, chat, detect, mask
from velum.plans.base import DOC_FINDINGS, derived, query, quote, spans_sql, tokens_sql
from velum.plans.kb import lexicon_kb
from velum.plans.text import doc_findings, doc_tokens
from velum.session import stage
from velum.sources.files import table

# ---- request bodies: one per conversation turn ------------------------------------------

_KIND = "case when (conv_id + turn) % 10 = 0 then 'image' when (conv_id + turn) % 10 = 1 then 'tool_use' when (conv_id + turn) % 10 = 2 then 'tool_result' when (conv_id + turn) % 10 = 3 then 'thinking' else 'text' end"


def bodies(spark, root):
    turns = table(spark, root, "conversations").withColumn("kind", F.expr(_KIND))
    text = F.col("text")
    block = (
        F.when(F.col("kind") == "tool_use", F.to_json(F.struct("kind", F.struct(F.array(text).alias("args"), F.lit(3).alias("n")).alias("input"))))
        .when(F.col("kind") == "tool_result", F.to_json(F.struct("kind", F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))))
        .otherwise(F.to_json(F.struct("kind", "text")))
    )
    block = F.regexp_replace(block, '^\\{"kind"', '{"type"')
    message = F.to_json(F.struct("role", F.lit("C").alias("content")))
    plain = F.to_json(F.struct("role", text.alias("content")))
    first = F.replace(message, F.lit('"C"'), F.concat(F.lit("["), block, F.lit("]")))
    body = F.concat(F.lit('{"system": "keep", "messages": ['), first, F.lit(", "), plain, F.lit("]}"))
    body = F.when(F.col("turn") == 5, F.concat(F.lit("not json "), F.col("conv_id").cast("string"))).otherwise(body)
    return turns.select("conv_id", "turn", body.alias("body"))


@query(
    "chat_blocks",
    f"""WITH t AS (SELECT *, {_KIND} AS kind FROM conversations WHERE turn <> 5)
    SELECT conv_id, turn, 0::BIGINT AS msg, 0::BIGINT AS block, role, kind AS type,
      CASE kind WHEN 'image' THEN 'refuse' WHEN 'thinking' THEN 'pass' ELSE 'mask' END AS route,
      CASE WHEN kind IN ('image', 'thinking') THEN '' ELSE text END AS text FROM t
    UNION ALL SELECT conv_id, turn, 1, 0, role, 'text', 'mask', text FROM t""",
)
def chat_blocks(spark, root):
    blocks = chat.chat_blocks(bodies(spark, root), ["conv_id", "turn"])
    return blocks.withColumn("text", F.array_join("texts", "|")).drop("texts")


# ---- turns ---------------------------------------------------------------------------------

TURNS = """conv_id, turn, role, concat('s', cast(conv_id % 5 as string)) AS scope,
 concat(text, case when turn % 2 = 0 then concat(' mail u', cast(conv_id % 37 as string), '@example.com and [EMAIL_99]') else '' end) AS text"""


@query(
    "mask_conversations",
    f"""WITH t AS (SELECT {TURNS} FROM conversations), found AS (
      SELECT scope, conv_id AS doc_id, turn AS ord, start, prio, value, label FROM
      ({spans_sql("(SELECT * FROM t WHERE role <> 'system')", 'scope, conv_id, turn', 'text')})),
    tokens AS ({tokens_sql('found')}),
    lists AS (SELECT doc_id, ord, list({{'k': f.value, 'v': token}} ORDER BY length(f.value) DESC, f.value) AS e
      FROM (SELECT DISTINCT scope, doc_id, ord, value FROM found) f JOIN tokens k ON k.scope = f.scope AND k.value = f.value GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN e IS NULL THEN text ELSE list_reduce(e, lambda a, x: replace(a, x.k, x.v), text) END AS text
    FROM t LEFT JOIN lists ON doc_id = conv_id AND ord = turn""",
)
def mask_conversations(spark, root):
    turns = derived(spark, root, "conversations", TURNS)
    return chat.mask_conversations(turns, skip_roles=["system"]).rows.select("conv_id", "turn", "text")


def body_of(role: str, text: str) -> str:
    return f"""concat('{{"messages": [{{"role": "', {role}, '", "content": [{{"type": "text", "text": ', {text}, '}}]}}]}}')"""


@query(
    "mask_chat_bodies",
    f"""WITH t AS (SELECT conv_id * 100 + turn AS doc_id, role, scope, text FROM (SELECT {TURNS} FROM conversations)), found AS (
      SELECT scope, doc_id, 0 AS ord, start, prio, value, label FROM ({spans_sql('t', 'scope, doc_id', 'text')})),
    tokens AS ({tokens_sql('found')}),
    lists AS (SELECT doc_id, list({{'k': f.value, 'v': token}} ORDER BY length(f.value) DESC, f.value) AS e
      FROM (SELECT DISTINCT scope, doc_id, value FROM found) f JOIN tokens k ON k.scope = f.scope AND k.value = f.value GROUP BY ALL)
    SELECT doc_id AS body_id, {body_of('role', "to_json(CASE WHEN e IS NULL THEN text ELSE list_reduce(e, lambda a, x: replace(a, x.k, x.v), text) END)::VARCHAR")} AS body
    FROM t LEFT JOIN lists USING (doc_id)""",
)
def mask_chat_bodies(spark, root):
    turns = derived(spark, root, "conversations", TURNS)
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    rows = turns.withColumn("q", F.substring(quoted, F.lit(6), F.length(quoted) - 6)).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("body_id"), "scope", F.expr(body_of("role", "q")).alias("body")
    )
    return chat.mask_bodies(rows).rows.select("body_id", "body")


_MAIL = "concat('c', cast(c_custkey % 97 as string), '@example.com')"


def structured_body(mail: str, nom: str) -> str:
    """A body with a system text and a tool result that is a CSV file."""
    return f"""concat('{{"system": "', {mail}, ' helps", "messages": [{{"role": "user", "content": [{{"type": "tool_result", "content": "nom,note,segment',
     chr(92), 'n', {nom}, ',none,', c_mktsegment, chr(92), 'n"}}]}}]}}')"""


@query(
    "mask_chat_structured",
    f"""WITH src AS (SELECT *, c_nationkey::VARCHAR AS scope, c_custkey AS doc_id, {_MAIL} AS mail FROM customer WHERE c_custkey % 10 <> 0),
    found AS (SELECT scope, doc_id, 0 AS ord, 0 AS start, 0 AS prio, c_name AS value, 'PERSONNE' AS label FROM src
      UNION ALL SELECT scope, doc_id, -1, 0, 4, mail, 'EMAIL' FROM src),
    tokens AS ({tokens_sql('found')})
    SELECT doc_id AS body_id, {structured_body('b.token', 'a.token')} AS body
    FROM src JOIN tokens a ON a.scope = src.scope AND a.value = c_name JOIN tokens b ON b.scope = src.scope AND b.value = mail
    UNION ALL SELECT c_custkey, 'no json' FROM customer WHERE c_custkey % 10 = 0""",
)
def mask_chat_structured(spark, root):
    """Fields of files inside tool results, the system text, and bodies refused for what they are."""
    body = f"case when c_custkey % 10 = 0 then concat('{{\"nom\": \"', c_name) else {structured_body(_MAIL, 'c_name')} end AS body"
    rows = derived(spark, root, "customer", f"c_custkey AS body_id, cast(c_nationkey as string) AS scope, {body}")
    result = chat.mask_bodies(rows, kb=lexicon_kb(spark))
    return result.rows.select("body_id", "body").union(result.refused.select("body_id", "reason"))


PARTLY = """o_orderkey, concat('[PERSONNE_', cast(o_custkey as string), '] ', case when o_orderkey % 3 = 0 then 'et [TEL_4]' else o_orderpriority end,
 case when o_orderkey % 4 = 0 then ' avec un long texte qui suit les jetons' else '' end) AS text"""


@query(
    "already_masked",
    f"""SELECT o_orderkey FROM (SELECT {PARTLY} FROM orders)
    WHERE length(array_to_string(regexp_extract_all(text, '\\[[A-Z][A-Z_]*_[0-9]+\\]'), '')) >= 0.30 * length(text)""",
)
def already_masked(spark, root):
    return derived(spark, root, "orders", PARTLY).where(masked_already(F.col("text"))).select("o_orderkey")


PROTECTED = """c_custkey AS doc_id, 'all' AS scope, concat('[CARD_', lpad(cast(c_custkey as string), 16, '0'), '] paid by ',
 lpad(cast(c_custkey as string), 16, '0'), ' see [link](x) and [1, 2]') AS text"""


@query(
    "protect_placeholders",
    """SELECT c_custkey AS doc_id, concat('[CARD_', lpad(c_custkey::VARCHAR, 16, '0'), '] paid by [CARD_',
      (row_number() OVER (ORDER BY c_custkey))::VARCHAR, '] see [link](x) and [1, 2]') AS text FROM customer""",
)
def protect_placeholders(spark, root):
    texts = derived(spark, root, "customer", PROTECTED)
    return mask.mask_documents(texts, "scope", keep_placeholders=True).rows.select("doc_id", "text")


REPEATED = "user_id % 20 AS scope, concat(event_type, ' ', case when user_id % 7 = 0 then '[EMAIL_1]' else props end) AS text"


@query(
    "payload_stats",
    f"""SELECT scope, CAST(sum(n) AS BIGINT) AS blocks, CAST(coalesce(sum(n - 1) FILTER (NOT m), 0) AS BIGINT) AS cache_hits,
      CAST(coalesce(sum(n) FILTER (m), 0) AS BIGINT) AS already_masked FROM (
       SELECT scope, text, count(*) AS n, contains(text, '[EMAIL_1]') AS m FROM (SELECT {REPEATED} FROM events) GROUP BY ALL)
      GROUP BY scope""",
)
def payload_stats(spark, root):
    return chat.payload_stats(derived(spark, root, "events", REPEATED))


@query(
    "last_assistant_turn",
    """SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations
    WHERE role = 'assistant' AND regexp_matches(text, '\\S') GROUP BY conv_id""",
)
def last_assistant_turn(spark, root):
    return chat.last_assistant_turn(table(spark, root, "conversations"))


# ---- audit -----------------------------------------------------------------------------------

_DAY = "DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER)"
AUDIT = DOC_FINDINGS + f""", counted AS (SELECT doc_id, label, count(*) AS n FROM found GROUP BY ALL),
 maps AS (SELECT doc_id, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS entity_counts,
   '{{"pattern":' || sum(n)::BIGINT || '}}' AS sources FROM counted GROUP BY doc_id),
 totals AS (SELECT doc_id, count(DISTINCT value) AS token_count FROM found GROUP BY doc_id),
 audit AS (SELECT ({_DAY})::VARCHAR AS day, {_DAY} AS d, sha256(source) AS user_hash, sha256(text) AS text_hash,
   coalesce(entity_counts, '{{}}') AS entity_counts, coalesce(sources, '{{}}') AS sources, 'freetext' AS format,
   coalesce(token_count, 0) AS token_count FROM documents LEFT JOIN maps USING (doc_id) LEFT JOIN totals USING (doc_id))"""


def audited(spark, root):
    docs = table(spark, root, "documents").withColumnRenamed("source", "scope")
    findings = stage(doc_findings(spark, root), "findings")
    at = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 200).cast("int")).cast("timestamp")
    return audit.audit_rows(docs, findings, at)


@query(
    "audit_rows",
    AUDIT + " SELECT day, user_hash, text_hash, entity_counts, sources, format, token_count FROM audit",
)
def audit_rows(spark, root):
    return audited(spark, root).select(
        F.to_date("at").cast("string").alias("day"), "user_hash", "text_hash",
        F.to_json("entity_counts").alias("entity_counts"), F.to_json("sources").alias("sources"), "format", "token_count",
    )


@query(
    "audit_rollup",
    DOC_FINDINGS + f""" SELECT ({_DAY})::VARCHAR AS day, 'freetext' AS format, label, count(*) AS n, count(DISTINCT doc_id) AS texts
    FROM found GROUP BY ALL""",
)
def audit_rollup(spark, root):
    return audit.audit_rollup(audited(spark, root))


@query("audit_retention", AUDIT + " SELECT day, text_hash FROM audit WHERE d >= DATE '2024-07-01' - 90")
def audit_retention(spark, root):
    kept = audit.audit_retention(audited(spark, root), F.to_date(F.lit("2024-07-01")))
    return kept.select(F.to_date("at").cast("string").alias("day"), "text_hash")


@query(
    "recent_detections",
    DOC_FINDINGS + """ SELECT doc_id, CAST(f.start AS BIGINT) AS start, f.scope, token, f.value, f.label FROM found f
    JOIN tokens t ON t.scope = f.scope AND t.value = f.value ORDER BY doc_id DESC, start DESC, f.value DESC LIMIT 50""",
)
def recent_detections(spark, root):
    from velum.operators.tokens import tokens_for

    events = tokens_for(doc_findings(spark, root), doc_tokens(spark, root))
    latest = audit.recent_detections(events, 50, ["doc_id", "start", "value"])
    return latest.select("doc_id", F.col("start").cast("bigint").alias("start"), "scope", "token", "value", "label")
