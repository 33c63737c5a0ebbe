"""Reviewed knowledge base of column labels."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions.similarity import (
    MARGIN,
    THRESHOLD,
    lcs_length,
    max_edits,
    segment_lengths,
    segments,
    similarity,
    substrings,
)
from velum.functions.text import normalize_header
from velum.session import stage

KB_SCHEMA = (
    "id bigint, header_norm string, header_raw string, label string, source string, "
    "status string, confidence double, occurrences bigint, sample_values array<string>, "
    "db_name string, table_name string, updated_at bigint"
)
KEY = ["header_norm", "db_name", "table_name"]
# Labels that mean "not personal".
NON_PII = ("NONE", "PUBLIC", "")
# Longest header the knowledge base stores.
MAX_HEADER = 128

# Own header lexicon: (header, language, label).
LEXICON = [
    ("name", "en", "PERSONNE"), ("full_name", "en", "PERSONNE"), ("first_name", "en", "PERSONNE"),
    ("last_name", "en", "PERSONNE"), ("customer_name", "en", "PERSONNE"), ("nom", "fr", "PERSONNE"),
    ("nom_client", "fr", "PERSONNE"), ("prenom", "fr", "PERSONNE"), ("vorname", "de", "PERSONNE"),
    ("nachname", "de", "PERSONNE"), ("email", "en", "EMAIL"), ("e_mail", "de", "EMAIL"),
    ("courriel", "fr", "EMAIL"), ("phone", "en", "TEL"), ("telephone", "fr", "TEL"),
    ("telefonnummer", "de", "TEL"), ("mobile", "en", "TEL"), ("city", "en", "LOCALISATION"),
    ("ville", "fr", "LOCALISATION"), ("wohnort", "de", "LOCALISATION"), ("address", "en", "LOCALISATION"),
    ("adresse", "fr", "LOCALISATION"), ("strasse", "de", "LOCALISATION"), ("birth_date", "en", "DATE"),
    ("date_naissance", "fr", "DATE"), ("geburtsdatum", "de", "DATE"), ("iban", "en", "IBAN"),
    ("avs", "fr", "AVS"), ("ahv_nummer", "de", "AVS"), ("policy_number", "en", "POLICE"),
    ("numero_police", "fr", "POLICE"), ("contract", "en", "CONTRAT"), ("numero_contrat", "fr", "CONTRAT"),
    ("vertragsnummer", "de", "CONTRAT"), ("plaque", "fr", "PLAQUE"), ("kennzeichen", "de", "PLAQUE"),
    ("vin", "en", "VIN"), ("permis", "fr", "PERMIS"), ("claim_ref", "en", "REF_SINISTRE"),
    ("ref_sinistre", "fr", "REF_SINISTRE"), ("company", "en", "ORG"), ("entreprise", "fr", "ORG"),
    ("segment", "en", "NONE"), ("status", "en", "NONE"),
]


def lexicon_rows() -> list[tuple[str, str]]:
    return [(word, label) for word, _, label in LEXICON]


def kb_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), KB_SCHEMA)


def new_rows(headers: DataFrame, source: str = "static", status: str = "active") -> DataFrame:
    """Label proposals (header_raw, label [, db_name, table_name, ...]) as KB rows."""
    have = set(headers.columns)

    def given(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in have else default).alias(name)

    null = F.lit(None).cast("string")
    return headers.select(
        given("id", F.lit(None).cast("bigint")),
        normalize_header(F.col("header_raw")).alias("header_norm"),
        "header_raw", "label",
        given("source", F.lit(source)),
        given("status", F.lit(status)),
        given("confidence", F.lit(1.0)),
        F.lit(1).cast("bigint").alias("occurrences"),
        given("sample_values", F.lit(None).cast("array<string>")),
        given("db_name", null),
        given("table_name", null),
        given("updated_at", F.lit(0).cast("bigint")),
    )


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> Column:
    """Equality on a key whose NULLs count as equal."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def kb_seed(kb: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add the lexicon's generic rows that are absent; existing rows win."""
    seeds = new_rows(lexicon).dropDuplicates(KEY)
    # the right side repeats column names, so the key is renamed before the anti-join
    present = kb.select(*[F.col(k).alias(f"_{k}") for k in KEY])
    condition = F.lit(True)
    for k in KEY:
        condition = condition & seeds[k].eqNullSafe(present[f"_{k}"])
    return kb.unionByName(seeds.join(present, condition, "left_anti"))


def kb_upsert(kb: DataFrame, updates: DataFrame) -> DataFrame:
    """Last write per key wins; samples of an earlier write stay if the new one has none.

    One aggregation over both sides: duplicates collapse before the shuffle.
    """
    both = kb.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    at = F.struct("_new", "updated_at", F.col("label").alias("_tie"))
    overwritten = ["header_raw", "label", "source", "status", "confidence", "updated_at"]
    merged = both.groupBy(*KEY).agg(
        F.max(F.struct(at.alias("at"), *overwritten)).alias("_last"),
        F.max(F.when(F.col("sample_values").isNotNull(), F.struct(at.alias("at"), "sample_values"))).alias("_samples"),
        F.max(F.when(F.col("_new") == 0, F.struct(at.alias("at"), "id", "occurrences"))).alias("_old"),
        F.max("id").alias("_any_id"),
    )
    return merged.select(
        F.coalesce("_old.id", "_any_id").alias("id"),
        "header_norm",
        *[F.col(f"_last.{c}").alias(c) for c in overwritten[:-1]],
        F.coalesce("_old.occurrences", F.lit(1).cast("bigint")).alias("occurrences"),
        F.col("_samples.sample_values").alias("sample_values"),
        "db_name", "table_name",
        F.col("_last.updated_at").alias("updated_at"),
    ).select(*kb.columns)


def kb_occurrences(kb: DataFrame, headers: DataFrame, header: str = "field") -> DataFrame:
    """Add how often each header was met; every context row of the header counts it."""
    seen = headers.groupBy(header).agg(F.count("*").alias("_n"))
    seen = seen.groupBy(normalize_header(F.col(header)).alias("header_norm")).agg(F.sum("_n").alias("_n"))
    return (
        kb.join(seen, "header_norm", "left")
        .withColumn("occurrences", F.col("occurrences") + F.coalesce("_n", F.lit(0)))
        .select(*kb.columns)
    )


# ---- review ----------------------------------------------------------------


def review_queue(kb: DataFrame, status: str | None = "pending") -> DataFrame:
    rows = kb if status is None else kb.where(F.col("status") == status)
    return rows.orderBy(F.desc("occurrences"), "id")


def _matching(kb: DataFrame, ids: DataFrame) -> DataFrame:
    flagged = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return kb.join(flagged, "id", "left")


def approve(kb: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows named in ``ids`` become active, approved by an admin."""
    return (
        _matching(kb, ids)
        .withColumn("status", F.when(F.col("_hit"), "active").otherwise(F.col("status")))
        .withColumn("source", F.when(F.col("_hit"), "admin").otherwise(F.col("source")))
        .select(*kb.columns)
    )


def relabel(kb: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: (id, label), one row per id; the status stays."""
    new = changes.groupBy("id").agg(F.max("label").alias("_label"))
    return (
        kb.join(new, "id", "left")
        .withColumn("source", F.when(F.col("_label").isNotNull(), "admin").otherwise(F.col("source")))
        .withColumn("label", F.coalesce("_label", "label"))
        .select(*kb.columns)
    )


def reject(kb: DataFrame, ids: DataFrame) -> DataFrame:
    return kb.join(ids.select("id"), "id", "left_anti")


# ---- labelling headers -----------------------------------------------------


def is_pii(label: Column) -> Column:
    return label.isNotNull() & ~label.isin(*NON_PII)


def _most_sensitive(label: Column) -> Column:
    """Sort key: personal labels first, then by name."""
    return F.struct((~is_pii(label)).alias("public"), label.alias("label"))


def exact_labels(headers: DataFrame, kb: DataFrame) -> DataFrame:
    """Rows of the most specific context level that has any, most sensitive label."""
    rows = kb.where("status = 'active'").select(
        "header_norm", F.col("db_name").alias("_db"), F.col("table_name").alias("_table"), F.col("label").alias("_label")
    )
    fits = (F.col("_db").isNull() | (F.col("_db") == F.col("db"))) & (
        F.col("_table").isNull() | (F.col("_table") == F.col("table"))
    )
    level = (
        F.when(F.col("_db").isNotNull() & F.col("_table").isNotNull(), 0)
        .when(F.col("_table").isNotNull(), 1)
        .when(F.col("_db").isNotNull(), 2)
        .otherwise(3)
    )
    best = (
        headers.join(rows, "header_norm")
        .where(fits)
        .groupBy("field", "db", "table")
        .agg(F.min(F.struct(level.alias("level"), _most_sensitive(F.col("_label")).alias("s"))).alias("_b"))
    )
    # Names of the match types.
    match = F.element_at(F.array(*map(F.lit, ("exact", "table", "db", "exact"))), F.col("_b.level") + 1)
    return best.select("field", "db", "table", F.col("_b.s.label").alias("label"), match.alias("match"))


def fuzzy_headers(
    headers: DataFrame, kb: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN
) -> DataFrame:
    """(header_norm, kb_header, score) for headers with one clear best KB header.

    Headers meet KB headers over shared pieces (see ``segments``): an equi-join that
    misses no pair at or above the threshold, and never compares all with all.
    """
    known = kb.where("status = 'active' AND header_norm <> ''").select(
        F.col("header_norm").alias("kb_header")
    ).distinct()
    asked = headers.where("header_norm <> ''").select("header_norm").distinct()
    sizes = segment_lengths(MAX_HEADER, threshold)
    pieces = known.select(
        "kb_header", F.explode_outer(segments(F.col("kb_header"), threshold)).alias("_p")
    ).select("kb_header", "_p.piece", F.col("_p.at").alias("_kb_at"))
    grams = asked.select(
        "header_norm", F.explode_outer(substrings(F.col("header_norm"), sizes)).alias("_g")
    ).select("header_norm", "_g.piece", F.col("_g.at").alias("_at"))
    la, lb = F.length("header_norm"), F.length("kb_header")
    s = threshold / 100.0
    pairs = (
        grams.join(pieces, "piece")
        # a shared piece moves no further than the edits allowed
        .where(F.abs(F.col("_at") - F.col("_kb_at")) <= max_edits(lb, threshold))
        .where(F.least(la, lb) * 2 >= (la + lb) * s - 1e-9)
        .select("header_norm", "kb_header")
        .distinct()
        .select("*", F.split("header_norm", "").alias("_a"), F.split("kb_header", "").alias("_b"))
        .withColumn("_lcs", lcs_length(F.col("_a"), F.col("_b")))
        .withColumn("score", similarity(F.col("_lcs"), F.size("_a"), F.size("_b")))
        .where(F.col("score") >= threshold)
    )
    ranking = W.partitionBy("header_norm").orderBy(F.desc("score"), "kb_header")
    top = (
        pairs.select("header_norm", "kb_header", "score", F.row_number().over(ranking).alias("rank"))
        .where("rank <= 2")
        .groupBy("header_norm")
        .agg(
            F.max_by("kb_header", F.negative("rank")).alias("kb_header"),
            F.max("score").alias("score"),
            F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"),
        )
    )
    clear = F.col("_second").isNull() | (F.col("score") - F.col("_second") > margin)
    return top.where(clear).select("header_norm", "kb_header", "score")


def label_headers(
    headers: DataFrame, kb: DataFrame, fuzzy: bool = True, threshold: float = THRESHOLD
) -> DataFrame:
    """Label and match type of each distinct (field, db, table)."""
    asked = headers.select("field", "db", "table").distinct().withColumn(
        "header_norm", normalize_header(F.col("field"))
    )
    exact = exact_labels(asked, kb)
    keys = ["field", "db", "table"]
    if not fuzzy:
        return asked.join(
            exact.select(*[F.col(k).alias(f"_{k}") for k in keys], "label", "match"),
            _same(keys), "left",
        ).select(*keys, "header_norm", "label", F.coalesce("match", F.lit("none")).alias("match"))
    near = fuzzy_headers(asked, kb, threshold).join(
        kb.where("status = 'active'").select(
            F.col("header_norm").alias("kb_header"), F.col("label").alias("_label")
        ),
        "kb_header",
    )
    near = near.groupBy("header_norm").agg(F.min(_most_sensitive(F.col("_label"))).alias("_n"))
    return (
        asked.join(exact.select(*[F.col(k).alias(f"_{k}") for k in keys], "label", "match"), _same(keys), "left")
        .join(near, "header_norm", "left")
        .select(
            *keys, "header_norm",
            F.coalesce("label", "_n.label").alias("label"),
            F.coalesce("match", F.when(F.col("_n").isNotNull(), "fuzzy"), F.lit("none")).alias("match"),
        )
    )


def with_labels(fields: DataFrame, kb: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Add ``label`` and ``match`` to rows with (field, db, table).

    Labels are found once per distinct header and staged, so that Spark knows their
    size: within the broadcast limit the rows, whose headers repeat without end, are
    not shuffled by header.
    """
    keys = ["field", "db", "table"]
    labels = stage(label_headers(fields.where("field IS NOT NULL"), kb, fuzzy), "labels")
    known = labels.select(*[F.col(k).alias(f"_{k}") for k in keys], "label", "match")
    return fields.join(known, _same(keys), "left").drop(*[f"_{k}" for k in keys])


def _same(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return condition


# ---- publishing ------------------------------------------------------------


def snapshot_rows(kb: DataFrame, patterns: DataFrame) -> DataFrame:
    """What readers get: active labels and patterns, no timestamps; one row per item."""
    labels = kb.where("status = 'active'").select(
        F.lit("label").alias("kind"),
        F.to_json(
            F.struct("header_norm", "header_raw", "label", "source", "confidence", "db_name", "table_name"),
            {"ignoreNullFields": "false"},
        ).alias("item"),
    )
    active = patterns.where("active").select(
        F.lit("pattern").alias("kind"),
        F.to_json(F.struct("name", "regex", "label", "score")).alias("item"),
    )
    return labels.unionByName(active)


def version_of(rows: DataFrame) -> DataFrame:
    """One content hash of a set of rows, whatever their order.

    Row hashes are folded in 4096 buckets first, so no task holds all rows.
    """
    hashed = rows.select(F.sha2(F.concat_ws("\x1f", "kind", "item"), 256).alias("h"))
    folded = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(
        F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"), F.count("*").alias("n")
    )
    return folded.agg(
        F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.concat("b", "h")))), 256).alias("version"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
    )


VERSIONS = "version string, published_at timestamp"


def publish(rows: DataFrame, root: str) -> str:
    """Write the snapshot under its version; writing the same content again is a no-op."""
    spark = rows.sparkSession
    version = version_of(rows).first()["version"]
    try:
        known = spark.read.schema(VERSIONS).json(f"{root}/versions")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    # the newest marker names what readers load; it is written after the items
    newest = None if known is None else known.orderBy(F.desc("published_at")).first()
    if newest is not None and newest["version"] == version:
        return version
    rows.write.mode("overwrite").partitionBy("kind").json(f"{root}/{version}/items")
    marker = spark.createDataFrame([(version,)], "version string").withColumn(
        "published_at", F.current_timestamp()
    )
    marker.write.mode("append").json(f"{root}/versions")
    return version


class SnapshotReader:
    """Keeps the newest snapshot it could read; a failed refresh keeps the last good one and tells why in ``problem``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.version: str | None = None
        self.rows: DataFrame | None = None
        self.problem: str | None = None

    def refresh(self) -> bool:
        """True if a newer version was loaded."""
        try:
            newest = (
                self.spark.read.schema(VERSIONS)
                .json(f"{self.root}/versions")
                .orderBy(F.desc("published_at"))
                .first()
            )
            if newest is None or newest["version"] == self.version:
                return False
            rows = self.spark.read.schema("item string, kind string").json(
                f"{self.root}/{newest['version']}/items"
            )
            rows.limit(1).count()
        except (PySparkException, Py4JJavaError) as problem:
            # what Spark could not read; anything else is an error of the program
            self.problem = str(problem).splitlines()[0]
            warnings.warn(f"snapshot {self.version or 'none'} is kept: {self.problem}", stacklevel=2)
            return False
        self.version, self.rows, self.problem = newest["version"], rows, None
        return True
