"""Column profiles, the rule classifier and the PII discovery scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.text import normalize_header, value_metadata_sql

CHARSETS = ("email", "url", "digits", "alpha", "alphanum", "mixed")
HINTS = ("avs", "iban_ch", "phone", "date")
PROFILE = [
    "n", "n_values", "avg_length", "min_length", "max_length",
    *[f"cs_{c}" for c in CHARSETS], *[f"hint_{h}" for h in HINTS],
    "with_spaces", "with_punctuation", "shape_min", "shape_max",
]

# Strategies and the labels they stand for; NULL keeps the value.
STRATEGY_LABELS = {
    "mask_name": "PERSONNE",
    "mask_email": "EMAIL",
    "mask_phone": "TEL",
    "mask_date": "DATE",
    "mask_address": "LOCALISATION",
    "mask_plate": "PLAQUE",
    "mask_id": "ID",
    "redact": "REDACT",
    "keep": None,
}

# profile rows in, the same rows with strategy, label, confidence and regex out
Classifier = Callable[[DataFrame], DataFrame]

# Share of values that must agree before values alone decide.
AGREE = 0.8


def _aggregates(value: str, meta: str, prefix: str = "") -> list[Column]:
    """Profile sums of a value column and its metadata column.

    Written as SQL text: a wide table has thousands of them, and text is parsed once.
    """
    shape = f"regexp_replace({value}, '[0-9]', '9')"
    out = {
        "n": "count(*)",
        "n_values": f"count({value})",
        "avg_length": f"avg({meta}.length)",
        "min_length": f"min({meta}.length)",
        "max_length": f"max({meta}.length)",
        **{f"cs_{c}": f"count_if({value} IS NOT NULL AND {meta}.charset = '{c}')" for c in CHARSETS},
        **{f"hint_{h}": f"count_if({value} IS NOT NULL AND {meta}.regex_hint = '{h}')" for h in HINTS},
        "with_spaces": f"count_if({meta}.has_spaces)",
        "with_punctuation": f"count_if({meta}.has_punctuation)",
        "shape_min": f"min({shape})",
        "shape_max": f"max({shape})",
    }
    return [F.expr(f"{out[name]} AS {prefix}{name}") for name in PROFILE]


def column_profile(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Profile of a value column grouped by column keys; partial sums before the shuffle."""
    rows = values.select(*keys, F.col(value).alias("_v")).select(
        *keys, "_v", F.expr(value_metadata_sql("_v") + " AS _m")
    )
    return rows.groupBy(*keys).agg(*_aggregates("_v", "_m"))


def profile_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile of every column of a table in one pass, without turning rows into cells."""
    names = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    indexes = range(len(names))
    cast = df.select(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(names)])
    with_meta = cast.selectExpr("*", *[f"{value_metadata_sql(f'v{i}')} AS m{i}" for i in indexes])
    sums = with_meta.agg(*[a for i in indexes for a in _aggregates(f"v{i}", f"m{i}", f"c{i}_")])
    rows = []
    for i, c in enumerate(names):
        fields = ", ".join(f"'{p}', c{i}_{p}" for p in PROFILE)
        rows.append(f"named_struct('column', n{i}, 'sql_type', t{i}, {fields})")
    named = sums.select(
        "*", *[F.lit(c).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.lit(types[c]).alias(f"t{i}") for i, c in enumerate(names)],
    )
    return named.selectExpr(f"explode(array({', '.join(rows)})) AS p").select("p.*")


def first_samples(df: DataFrame, order: Sequence[str], n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """Values of the first ``n`` rows by ``order``, per column, NULLs dropped afterwards.

    Top-n rows are picked once for the whole table.
    """
    if not 1 <= n <= 1000:
        raise ValueError("n must be between 1 and 1000")
    names = list(columns or df.columns)
    head = df.orderBy(*order).limit(n).select(
        F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]).alias("_o"),  # typed, so 2 stays before 10
        *[F.col(c).cast("string").alias(c) for c in names],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])
    ranked = head.agg(F.array_sort(F.collect_list(F.struct("_o", cells.alias("cells")))).alias("rows"))
    return (
        ranked.select(F.posexplode("rows").alias("rank", "r"))
        .select(F.col("rank").cast("bigint").alias("rank"), F.explode("r.cells").alias("c"))
        .select("c.column", "rank", "c.value")
        .where("value IS NOT NULL")
    )


def shape_regex(low: Column, high: Column) -> Column:
    """Regex of a column whose values share one shape with digits; NULL otherwise."""
    runs = F.regexp_extract_all(low, F.lit("9+"), F.lit(0))
    gaps = F.transform(
        F.split(low, "9+", -1),
        lambda g: F.regexp_replace(g, r"([\\.\[\]{}()*+?^$|])", r"\\$1"),
    )
    body = F.array_join(
        F.zip_with(
            gaps, runs,
            lambda g, r: F.concat(
                g, F.coalesce(F.concat(F.lit("\\d{"), F.length(r).cast("string"), F.lit("}")), F.lit(""))
            ),
        ),
        "",
    )
    return F.when((low == high) & low.contains("9"), F.concat(F.lit("\\b"), body, F.lit("\\b")))


_NAME_WORDS = r"(?:^|_)(name|nom|prenom|vorname|nachname)(?:_|\z)"
_PLACE_WORDS = r"(?:^|_)(address|adresse|city|ville|street|rue|strasse|ort)(?:_|\z)"
_PLATE_WORDS = r"(?:^|_)(plate|plaque|immatriculation|kennzeichen)(?:_|\z)"
_KEEP_WORDS = r"(?:key|_id|status|type|segment)\z"


def classify(profile: DataFrame) -> DataFrame:
    """Rule classifier on one profile row per column: strategy, label, confidence, regex.

    Values decide where most agree on a form; else the header's words do.
    """
    head = normalize_header(F.col("column"))
    total = F.greatest(F.col("n_values"), F.lit(1))
    email, phone = F.col("cs_email") / total, F.col("hint_phone") / total
    date, number = F.col("hint_date") / total, (F.col("hint_avs") + F.col("hint_iban_ch")) / total
    rules = [
        (F.col("n_values") == 0, "keep", F.lit(0.5)),
        (email >= AGREE, "mask_email", email),
        (number >= AGREE, "mask_id", number),
        ((date >= AGREE), "mask_date", date),
        ((phone >= AGREE) & ~head.rlike(_KEEP_WORDS), "mask_phone", phone),
        (head.rlike(_NAME_WORDS), "mask_name", F.lit(0.75)),
        (head.rlike(_PLACE_WORDS), "mask_address", F.lit(0.75)),
        (head.rlike(_PLATE_WORDS), "mask_plate", F.lit(0.75)),
    ]
    strategy, confidence = F.lit("keep"), F.lit(0.5)
    for test, name, sure in reversed(rules):
        strategy = F.when(test, name).otherwise(strategy)
        confidence = F.when(test, sure).otherwise(confidence)
    return (
        profile.withColumn("strategy", strategy)
        .withColumn("confidence", F.round(confidence, 2))
        .withColumn("label", strategy_label(F.col("strategy")))
        .withColumn(
            "regex",
            F.when(F.col("label").isNotNull(), shape_regex(F.col("shape_min"), F.col("shape_max"))),
        )
    )


def strategy_label(strategy: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in STRATEGY_LABELS.items():
        if label is not None:
            out = F.when(strategy == name, label).otherwise(out)
    return out


def approval(confidence: Column, threshold: float = 0.7) -> Column:
    return F.when(confidence >= threshold, "active").otherwise("pending")


_STRATEGY = "(?i)(" + "|".join(STRATEGY_LABELS) + ")"


def resolve_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw classifier answers to (strategy, label, confidence, regex).

    JSON, else the JSON inside, else a strategy word at 0.5, else keep.
    """
    cleaned = F.trim(F.regexp_replace(F.col(raw), r"(?im)^```(?:json)?\s*|\s*```\s*$", ""))
    inside = F.regexp_extract(cleaned, r"(?s)(\{.*\})", 1)
    step = answers.withColumn("_clean", cleaned).withColumn("_inside", inside)

    def obj(text: str) -> Column:
        tree = F.try_parse_json(F.col(text))
        return F.when(F.schema_of_variant(tree).startswith("OBJECT"), tree)

    step = step.withColumn("_obj", F.coalesce(obj("_clean"), obj("_inside")))
    text = lambda path: F.try_variant_get("_obj", path, "string")
    given = F.lower(F.trim(F.coalesce(text("$.strategy"), F.lit("keep"))))
    word = lambda c: F.lower(F.regexp_extract(c, _STRATEGY, 1))
    known = given.isin(*STRATEGY_LABELS)
    from_object = F.when(known, given).when(word(given) != "", word(given)).otherwise("keep")
    from_words = F.when(word(F.col("_clean")) != "", word(F.col("_clean"))).otherwise("keep")
    is_obj = F.col("_obj").isNotNull()
    sure = F.coalesce(F.try_variant_get("_obj", "$.confidence", "double"), F.lit(0.5))
    regex = F.trim(text("$.regex"))
    return (
        step.withColumn("strategy", F.when(is_obj, from_object).otherwise(from_words))
        .withColumn(
            "confidence",
            F.when(is_obj, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.5),
        )
        .withColumn("regex", F.when(is_obj & (regex != ""), regex))
        .withColumn("label", strategy_label(F.col("strategy")))
        .drop("_clean", "_inside", "_obj")
    )


# ---- scan ------------------------------------------------------------------


def label_profiles(
    profiles: DataFrame, threshold: float = 0.7, classifier: Classifier | None = None
) -> DataFrame:
    """Label proposals from column profiles (db, table, column, sql_type, ...).

    ``classifier`` adds strategy, label, confidence and regex to the profile rows; a
    model runs here over one row per column.
    """
    return (classifier or classify)(profiles).select(
        "db", "table", "column", "sql_type", "n_values", "strategy", "label", "confidence",
        F.when(F.col("label").isNotNull(), approval(F.col("confidence"), threshold)).alias("status"),
        "regex",
    )


def profile_catalog(
    tables: dict[str, DataFrame], db: str | None, skip: set[tuple[str, str]] = frozenset()
) -> DataFrame:
    """Profiles of all tables' columns but those in ``skip``; one pass per table."""
    profiles = []
    for name, df in tables.items():
        left = [c for c in df.columns if (name, c) not in skip]
        if left:
            profiles.append(
                profile_table(df, left).select(
                    F.lit(db).cast("string").alias("db"), F.lit(name).alias("table"), "*"
                )
            )
    if not profiles:
        raise ValueError("no column left to profile")
    out = profiles[0]
    for other in profiles[1:]:
        out = out.unionByName(other)
    return out


def labelled_places(tables: dict[str, DataFrame], db: str | None, kb: DataFrame | None) -> set[tuple[str, str]]:
    """(table, column) of the columns that have an active label for this place."""
    if kb is None:
        return set()
    inventory = [(t, c) for t, df in tables.items() for c in df.columns]
    asked = kb.sparkSession.createDataFrame(inventory, "table string, column string").select(
        "*", normalize_header(F.col("column")).alias("_h")
    )
    active = kb.where("status = 'active'").where(F.col("db_name").eqNullSafe(F.lit(db))).select(
        F.col("header_norm").alias("_k"), F.col("table_name").alias("_t")
    )
    hit = asked.join(
        active, (F.col("_h") == F.col("_k")) & F.col("table").eqNullSafe(F.col("_t")), "left_semi"
    )
    # bounded by the inventory above
    return {(r["table"], r["column"]) for r in hit.select("table", "column").collect()}


def scan_catalog(
    tables: dict[str, DataFrame],
    db: str | None,
    kb: DataFrame | None = None,
    threshold: float = 0.7,
    classifier: Classifier | None = None,
) -> DataFrame:
    """Scan several tables; columns with an active label for this place are skipped unread.

    The skip list is read first (one row per catalogued column), so known columns
    are not even scanned.
    """
    return label_profiles(profile_catalog(tables, db, labelled_places(tables, db, kb)), threshold, classifier)


def scan_summary(scan: DataFrame, inventory: DataFrame) -> DataFrame:
    """Totals of a scan run and the last place reached, by table and column name."""
    done = scan.select("table", "column", (F.col("n_values") > 0).alias("_has"), F.col("label").isNotNull().alias("_found"))
    return (
        inventory.select("table", "column")
        .join(done, ["table", "column"], "left")
        .agg(
            F.count("*").alias("total_cols"),
            F.count_if(F.col("_has")).alias("sampled_cols"),
            F.count_if(F.col("_found")).alias("found_labels"),
            F.max(F.struct("table", "column")).alias("_last"),
        )
        .select(
            F.lit("done").alias("status"), "total_cols", "sampled_cols", "found_labels",
            F.col("_last.table").alias("last_table"), F.col("_last.column").alias("last_column"),
        )
    )


def scan_to_kb(scan: DataFrame, source: str = "classifier") -> DataFrame:
    """Labelled scan rows as label proposals for ``kb.new_rows``."""
    return scan.where("label IS NOT NULL").select(
        F.col("column").alias("header_raw"), "label", F.lit(source).alias("source"), "status",
        "confidence", F.col("db").alias("db_name"), F.col("table").alias("table_name"),
    )
