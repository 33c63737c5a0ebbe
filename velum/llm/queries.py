"""The operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import alignment, decontaminate, exact, licences, mixing, ngram_join, pages, quality, simhash, spelling, tokens, toxicity, urls
from velum.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Shares of all tokens that languages are mixed to.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
#: (verdict, host, path) in the order of the contract.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query("op1_main_text")
def op1(spark, root):
    return pages.extract(table(spark, root, "pages"), "html", "page_id", "url")


@query("op2_token_counts")
def op2(spark, root):
    import public_tokenizers

    docs = table(spark, root, "documents")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens.fresh_cache(spark))


@query("op3_fingerprints")
def op3(spark, root):
    """Adds near_count: documents within simhash.RADIUS bits of every 50th one (by id), itself left out; NULL for the others."""
    rows = simhash.fingerprint_edits(table(spark, root, "documents"))
    return simhash.with_near_counts(rows, F.col("doc_id") % 50 == 0, radius=simhash.RADIUS).drop("fp")


@query("op4_quality")
def op4(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, table(spark, root, "labels").where(~out))
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op5_mixing")
def op5(spark, root):
    return mixed(table(spark, root, "documents"), table(spark, root, "labels"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mixed to TARGETS. A target no labelled document has is warned of, and the others are scaled up; with none, all domains have one share."""
    docs = docs.select("doc_id", "lang", "text")
    model = mixing.fit_domains(docs, labels)
    targets = {d: t for d, t in TARGETS.items() if d in model.domains}
    if len(targets) < len(TARGETS):
        warnings.warn(f"no labelled document of domain {', '.join(sorted(set(TARGETS) - set(targets)))}", stacklevel=2)
    return mixing.mix(docs, model, targets or dict.fromkeys(model.domains, 1.0))


WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""WITH item AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT doc_id, w, n, i FROM doc, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
hit AS (SELECT DISTINCT doc_id, i, p.n, item_id FROM places AS p JOIN win ON win.n = p.n AND win.win = array_to_string(w[i:i + p.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) AS h, unnest(range(i, i + n)) AS u(x) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op6_decontamination", OP6_SQL)
def op6(spark, root):
    return decontaminate.judge(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op7_toxicity")
def op7(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    out = quality.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, root, "labels").where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op8_url_filter")
def op8(spark, root):
    pages_ = table(spark, root, "pages").select("page_id", "url")
    model = urls.fit(urls.weak_labels(pages_))
    return urls.judge(pages_, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


@query("op9_ngram_join")
def op9(spark, root):
    return ngram_join.classes(table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op10_licences")
def op10(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.fit(docs))


OP11_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query("op11_exact_dedup", OP11_SQL)
def op11(spark, root):
    """The table arrives in two loads, larger ids first, so the second one is held against the index of the first."""
    docs = table(spark, root, "documents")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    return exact.deduplicate([("upper", docs.where(upper)), ("lower", docs.where(~upper))], exact.open_index(spark))


# crc32 byte by byte, its table made by rule; letters beyond A-z take two bytes, 0xC3 and their code less 64
OP12_SQL = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents WHERE text IS NOT NULL),
long AS (SELECT doc_id, r, count(*) AS k FROM run WHERE length(r) >= 6 GROUP BY ALL),
code AS (SELECT r, k, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM long),
hashed AS (SELECT r, k, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM code, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
hole AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (SELECT a.word AS a, b.word AS b FROM hole AS a JOIN hole AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word FROM hole AS h JOIN words AS w ON w.word = h.rest
  UNION SELECT w.word, h.word FROM hole AS h JOIN words AS w ON w.word = h.rest),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near JOIN words ON words.word = b GROUP BY a),
chosen AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM chosen WHERE form IS NULL UNION ALL SELECT c.word, way.root FROM chosen AS c JOIN way ON c.form = way.word)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN way USING (word)"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark, root):
    return spelling.variants(table(spark, root, "documents"), damage=199)


@query("op13_token_alignment")
def op13(spark, root):
    import public_tokenizers

    docs = table(spark, root, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
