"""Training corpora from column rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from velum.operators import corpus
from velum.plans.base import derived, query
from velum.plans.columns import PUNCT, charset_sql, hint_sql

# Column rows: (id, table, column, sql_type, values, strategy, confidence) per customer.
COLUMN_ROWS = """c_custkey AS id, 'clients' AS "table", case c_custkey % 4 when 0 then 'nom' when 1 then 'courriel' when 2 then 'tel_1' else 'remark' end AS "column",
 'varchar' AS sql_type, case c_custkey % 4 when 0 then 'mask_name' when 1 then 'mask_email' when 2 then 'mask_phone' else 'keep' end AS strategy,
 cast(0.9 as double) AS confidence, case c_custkey % 4 when 0 then c_name when 1 then concat('u', cast(c_custkey as string), '@example.com')
 when 2 then concat('079 ', cast(c_custkey % 90 + 10 as string)) else c_mktsegment end AS value, c_mktsegment AS other"""
SUPPLIERS = """s_suppkey + 1000000 AS id, 'fournisseurs' AS "table", 'nom' AS "column", 'varchar' AS sql_type, 'mask_name' AS strategy,
 cast(0.8 as double) AS confidence, s_name AS value, s_name AS other"""


SENTENCE = ("In column {column} : {value}",)


def column_rows(spark, root, source="customer", select=COLUMN_ROWS):
    rows = derived(spark, root, source, select.replace('"', "`"))
    return rows.withColumn("values", F.array("value", "other")).drop("value", "other")


def examples(spark, root):
    return corpus.ner_examples(column_rows(spark, root), ["id"], SENTENCE)


def merged(spark, root):
    return corpus.merge_corpora(
        examples(spark, root), corpus.ner_examples(column_rows(spark, root, "supplier", SUPPLIERS), ["id"], SENTENCE)
    )


def ner_sql(source: str, select: str) -> str:
    return f"""SELECT id, toks, len(head) + 3 AS s, len(toks) - 1 AS e, label, value FROM (
      SELECT id, value, regexp_extract_all('In column ' || "column" || ' : ' || value, '\\w+|[^\\w\\s]') AS toks, regexp_extract_all("column", '\\w+|[^\\w\\s]') AS head,
        CASE strategy WHEN 'mask_name' THEN 'PERSON' WHEN 'mask_email' THEN 'EMAIL' WHEN 'mask_phone' THEN 'PHONE' END AS label
      FROM (SELECT {select} FROM {source})) WHERE label IS NOT NULL"""


NER = ner_sql("customer", COLUMN_ROWS)
MERGED = NER + " UNION ALL " + ner_sql("supplier", SUPPLIERS)


@query("ner_examples", f"SELECT id, array_to_string(toks, ' ') AS tokens, s, e, label FROM ({NER})")
def ner_examples(spark, root):
    return examples(spark, root).select(
        "id", F.array_join("tokens", " ").alias("tokens"), F.col("ner")[0]["s"].cast("bigint").alias("s"),
        F.col("ner")[0]["e"].cast("bigint").alias("e"), F.col("ner")[0]["label"].alias("label"),
    )


@query("merge_corpora", f"SELECT id, array_to_string(toks, ' ') AS tokens, label FROM ({MERGED})")
def merge_corpora(spark, root):
    return merged(spark, root).select("id", F.array_join("tokens", " ").alias("tokens"), F.col("ner")[0]["label"].alias("label"))


@query(
    "label_distribution",
    f"""SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ({MERGED})), 4)::DOUBLE AS pct
    FROM ({MERGED}) GROUP BY label""",
)
def label_distribution(spark, root):
    return corpus.label_distribution(merged(spark, root))


@query(
    "mention_lists",
    f"""SELECT id, array_to_string(toks, ' ') AS input, '{{' || array_to_string(list_transform({list(corpus.MENTION_LABELS)},
      lambda l: '"' || l || '":[' || CASE WHEN l = label THEN '"' || array_to_string(toks[s + 1:e + 1], ' ') || '"' ELSE '' END || ']'), ',') || '}}' AS entities
    FROM ({NER})""",
)
def mention_lists(spark, root):
    return corpus.mention_lists(examples(spark, root), ["id"]).withColumn("entities", F.to_json("entities"))


@query(
    "classification_rows",
    f"""SELECT id, array_to_string(toks[1:s - 1], ' ') AS "column", array_to_string(toks[s + 1:], ' ') AS value, label FROM ({NER})""",
)
def classification_rows(spark, root):
    return corpus.classification_rows(examples(spark, root), ["id"])


@query("train_val_split", f"SELECT id, CASE WHEN id % 10 = 0 THEN 'val' ELSE 'train' END AS split, label FROM ({MERGED})")
def train_val_split(spark, root):
    split = corpus.train_val_split(merged(spark, root), F.col("id"))
    return split.select("id", "split", F.col("ner")[0]["label"].alias("label"))


_META = "{{'length': length({0}), 'charset': {1}, 'has_spaces': contains({0}, ' '), 'has_punctuation': regexp_matches({0}, {2}), 'regex_hint': {3}, 'sample_hash': left(sha256({0}), 8)}}"


def _meta(v: str) -> str:
    return _META.format(v, charset_sql(v), PUNCT, hint_sql(v))


@query(
    "column_prompts",
    f"""SELECT id, 'Table: ' || "table" || chr(10) || 'Column: ' || "column" || chr(10) || 'SQL type: ' || sql_type || chr(10)
      || 'Value metadata: ' || to_json([{_meta('value')}, {_meta('other')}])::VARCHAR AS prompt,
      to_json({{'strategy': strategy, 'confidence': confidence}})::VARCHAR AS target FROM (SELECT {COLUMN_ROWS} FROM customer)""",
)
def column_prompts(spark, root):
    return corpus.column_prompts(column_rows(spark, root), ["id"])
