"""URL filter: host and path rules first, gradient-boosted trees on lexical features else. Native."""

from __future__ import annotations

import functools

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import UPPER, bounded, stage

#: Labelled URLs used for fitting, the bound of the sample.
MOST_FIT = 20_000

# Terms that mark a host as unwanted, used where no labelled URLs are given.
BLOCK_TERMS = [
    "ads", "adult", "bet", "bets", "casino", "cheap", "escort", "free", "loan", "pills", "poker", "porn", "sex",
    "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx",
]


def host_and_path(url: Column) -> dict[str, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then to ``?`` or ``#``.

    Both are empty for NULL and where ``://`` is missing.
    """
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return {"host": F.translate(host, UPPER, UPPER.lower()), "path": path}


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; NULL if none does.

    A rule (verdict, host, path) fits its host and all subdomains, if the path starts with
    the rule's. Of two rules of one length, the one given first is taken.
    """
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # stable: the first of equals is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _share(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    alphabet = F.array_distinct(chars)
    part = F.transform(alphabet, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(part, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds lexical columns; every one is defined for NULL, empty and odd URLs."""
    df = df.withColumns(host_and_path(F.col(url)))
    raw = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(raw, r"\?([^#]*)", 1)
    return df.withColumns({
        "suffix": suffix_of(host),
        "f_length": F.length(raw).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_labels": F.regexp_count(host, F.lit(r"\.")).cast("double"),
        "f_depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "f_digits": _share(raw, "[0-9]"),
        "f_host_digits": _share(host, "[0-9]"),
        "f_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "f_entropy": _entropy(host),
        "f_params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "f_vowels": _share(host, "[aeiou]"),
        "f_secure": raw.startswith("https").cast("double"),
    })


LEXICAL = ["f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_hyphens", "f_entropy",
           "f_params", "f_vowels", "f_secure", "f_suffix_rate", "f_suffix_log"]


def weak_labels(urls: DataFrame, url: str = "url", terms: list[str] | None = None) -> DataFrame:
    """(url, label): 1.0 where a part of the host between dots and hyphens is an unwanted term, else 0.0."""
    host = host_and_path(F.col(url))["host"]
    bad = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, terms or BLOCK_TERMS)))
    return urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), bad.cast("double").alias("label"))


class UrlModel:
    """Fitted trees with the suffix statistics of the labelled URLs."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame, base: float):
        self.trees, self.suffixes, self.base = trees, suffixes, base

    def blocked(self, df: DataFrame, url: str = "url") -> DataFrame:
        """``df`` with host, path and ``blocked``, the probability of an unwanted URL."""
        rows = with_suffix(features(df, url), self.suffixes, self.base)
        drop = ["suffix", *LEXICAL]
        if self.trees is None:
            return rows.withColumn("blocked", F.lit(self.base)).drop(*drop)
        rows = VectorAssembler(inputCols=LEXICAL, outputCol="_v").transform(rows)
        rows = self.trees.transform(rows).withColumn("blocked", vector_to_array("_p")[1])
        return rows.drop("_v", "_p", "_raw", "_y", *drop)


def with_suffix(rows: DataFrame, suffixes: DataFrame, base: float) -> DataFrame:
    rows = rows.join(suffixes, "suffix", "left")
    return rows.withColumns({
        "f_suffix_rate": F.coalesce("f_suffix_rate", F.lit(base)), "f_suffix_log": F.coalesce("f_suffix_log", F.lit(0.0)),
    })


#: Suffixes up to which their statistics are broadcast; all have their own.
MOST_BROADCAST = 200_000


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def fit(labelled: DataFrame, most: int = MOST_FIT, trees: int = 15, depth: int = 4) -> UrlModel:
    """Trees from labelled URLs (url, label 0.0 or 1.0), at most about ``most`` of them.

    Distinct URLs are drawn by hash of the URL, unwanted ones first at an even share; what
    is known of suffixes is counted over all of them, before the draw. With
    one class only, or no labelled URL, the model gives that class's share (0.5 for none).
    """
    rows = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label"))
    counts = rows.groupBy(suffix_of(host_and_path(F.col("url"))["host"]).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    counts = stage(counts, "suffixes")
    n, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    sizes = {k: c for k, c in ((0.0, n - int(bad)), (1.0, int(bad))) if c}
    shares = {k: min(1.0, most / 2 / n) for k, n in sizes.items()}
    unit = F.pmod(F.xxhash64(F.lit("fit"), "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = functools.reduce(lambda c, k: F.when(F.col("label") == k, shares[k]).otherwise(c), shares, F.lit(0.0))
    rows = rows.where(unit < share)
    rows = stage(features(rows).withColumn("weight", 1.0 / F.greatest(share, F.lit(1e-9))), "urls-fit")
    base = sizes.get(1.0, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    stats = bounded(counts.select(
        "suffix", ((F.col("s") + 5 * base) / (F.col("n") + 5)).alias("f_suffix_rate"), F.log1p("n").alias("f_suffix_log")), MOST_BROADCAST)
    if len(sizes) < 2:
        return UrlModel(None, stats, base)
    rows = with_suffix(rows, stats, base)
    rows = stage(VectorAssembler(inputCols=LEXICAL, outputCol="_v").transform(rows).select("_v", "label", "weight"), "urls-v")
    gbt = GBTClassifier(featuresCol="_v", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3,
                        predictionCol="_y", seed=7)
    gbt.setProbabilityCol("_p").setRawPredictionCol("_raw")
    return UrlModel(gbt.fit(rows), stats, base)


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, verdict and blocked: the rule's verdict, else the model's.

    Every row stays, repeated ones too; columns named like the added ones are replaced.
    """
    plain = urls.drop("host", "path", "rule", "verdict", "blocked")
    rows = model.blocked(plain, url).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")
    return rows.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", learned)}).drop("_rule")
