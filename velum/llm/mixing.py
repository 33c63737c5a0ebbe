"""Mixing to target weights with soft membership. Native throughout.

A classifier fitted on labelled documents gives every document a posterior over domains.
Nonnegative rates, one per document, are then fitted by projected gradient on least
squares, so that the expected tokens of every domain meet its target share; a small ridge
keeps rates near 1. A step needs one sum per domain over all documents, and nothing else
leaves the executors.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import content_key, stage

#: Labelled documents used for fitting at most, and drawn of a domain at least, as far as it has them.
MOST_FIT, LEAST_FIT = 6_000, 50
#: Domains told apart; if there are more, the smaller ones are one domain of the name OTHER.
MOST_DOMAINS = 50
OTHER = "(other)"
BUCKETS = 1 << 12
RIDGE = 1e-3
#: Steps at most; the largest miss of a domain's share at which they end; steps between two written tables.
STEPS, ENOUGH, WRITTEN = 60, 1e-4, 10
#: A share that misses its target by more than this is warned of.
MISSED = 0.01
#: Steps also end where no share moves by more than this.
STILL = 1e-6


def tokens(text: Column) -> Column:
    """Words between white space of any kind and ASCII punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x1C-\x1F\x85\p{Z}\p{Punct}]+"), "")


class DomainModel:
    def __init__(self, domains: list[str | None], model, prior: list[float]):
        self.domains, self.model, self.prior = domains, model, prior

    def posteriors(self, docs: DataFrame, text: str, *keep: Column) -> DataFrame:
        """``keep``, n_tokens and p, one probability per domain; a text without words has the prior."""
        rows = docs.select(*keep, tokens(F.col(text)).alias("_w"))
        prior = F.array(*[F.lit(float(p)) for p in self.prior])
        if self.model is None:
            return rows.select("*", F.size("_w").cast("long").alias("n_tokens"), prior.alias("p")).drop("_w")
        rows = self.model.transform(vectors(rows)).withColumn("n_tokens", F.size("_w").cast("long"))
        rows = rows.withColumn("p", F.when(F.col("n_tokens") > 0, vector_to_array("_p")).otherwise(prior))
        return rows.drop("_w", "_tf", "_x", "_p", "_m", "_y")


def vectors(rows: DataFrame) -> DataFrame:
    rows = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=BUCKETS).transform(rows)
    return Normalizer(inputCol="_tf", outputCol="_x", p=1.0).transform(rows)


def fit_domains(docs: DataFrame, labelled: DataFrame, *, key: str = "doc_id", text: str = "text", domain: str = "lang",
                most: int = MOST_FIT) -> DomainModel:
    """Multinomial logistic regression on hashed words.

    ``labelled`` names the documents to learn from (column ``key``), ``domain`` the column
    of ``docs`` with their domain. Domains and their sizes (the prior) are counted over all
    of them; about ``most`` are drawn by hash of the key, of each domain in proportion, but
    LEAST_FIT if it has them. Beyond MOST_DOMAINS the smaller domains are told from the rest
    as one, OTHER. Documents without key or domain are not learned from. With one domain
    everything belongs to it; with none (an empty table, too) to the domain NULL.
    """
    ids = stage(labelled.select(F.col(key).alias("_id")).where("_id is not null").distinct(), "labelled")
    own = F.col(domain).cast("string").alias("_d")
    known = stage(docs.select(F.col(key).alias("_id"), own).where("_d is not null").join(ids, "_id"), "labelled-domains")
    sizes = stage(known.groupBy("_d").agg(F.count("*").alias("n")), "domains")
    head = sizes.orderBy(F.desc("n"), "_d").limit(MOST_DOMAINS + 1).collect()
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    if not whole:
        return DomainModel([None], None, [1.0])
    if len(head) > MOST_DOMAINS:
        head = head[: MOST_DOMAINS - 1]
    count = {r["_d"]: r["n"] for r in head}
    if rest := whole - sum(count.values()):
        count[OTHER] = count.get(OTHER, 0) + rest
    domains = sorted(count)
    prior = [count[d] / whole for d in domains]
    if len(domains) == 1:
        return DomainModel(domains, None, prior)
    number = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, domains)), F.col("_d")), F.lit(0)), F.lit(domains.index(OTHER) + 1 if OTHER in count else 0)).cast("int")
    shares = {d: min(1.0, max(most / whole, LEAST_FIT / count[d])) for d in domains}
    share = F.element_at(F.array(*[F.lit(shares[d]) for d in domains]), number)
    unit = F.pmod(F.xxhash64(F.lit("mix"), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = stage(known.where(unit < share).select("_id").distinct(), "drawn")  # bounded by the shares
    texts = docs.select(F.col(key).alias("_id"), own, F.col(text).alias("_text")).where("_d is not null").join(F.broadcast(drawn), "_id")
    rows = stage(texts.select((number - 1).cast("double").alias("_l"), (1 / share).alias("_weight"), tokens(F.col("_text")).alias("_w")), "mix-fit")
    lr = LogisticRegression(featuresCol="_x", labelCol="_l", predictionCol="_y", probabilityCol="_p", rawPredictionCol="_m", weightCol="_weight",
                            regParam=1e-3, maxIter=25, family="multinomial")
    return DomainModel(domains, lr.fit(stage(vectors(rows).select("_x", "_l", "_weight"), "mix-x").coalesce(4)), prior)


def fit_rates(rows: DataFrame, shares: list[float], *, steps: int = STEPS, enough: float = ENOUGH) -> tuple[DataFrame, list[float]]:
    """``rows`` (n_tokens, p) with rate, and the share of all tokens each domain gets by them.

    Minimises sum over k of (S_k - share_k)^2 / q_k + RIDGE * (token-weighted mean of
    (rate - 1)^2), S_k being domain k's expected tokens over all tokens before mixing and
    q_k the same at rate 1, under rate >= 0. Scaled so, no direction is steeper than 1 and a
    step of 1 / (1 + RIDGE) is safe.
    """
    rows = stage(rows.withColumn("rate", F.lit(1.0)), "rates")
    n = len(shares)
    sums = [F.sum(F.col("n_tokens") * F.col("p")[k] * F.col("rate")).alias(f"s{k}") for k in range(n)]
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return rows, [0.0] * n
    at, scale, step = [float("inf")] * n, None, 1 / (1 + RIDGE)
    for i in range(steps + 1):
        got = rows.agg(*sums).first()
        last, at = at, [got[k] / total for k in range(n)]
        scale = scale or [max(a, 1e-6) for a in at]
        miss = [(a - s) for a, s in zip(at, shares)]
        if i == steps or max(map(abs, miss)) <= enough or max(abs(a - b) for a, b in zip(at, last)) <= STILL:
            break
        slope = sum((F.col("p")[k] * (m / q) for k, (m, q) in enumerate(zip(miss, scale))), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.col("rate") - step * (slope + RIDGE * (F.col("rate") - 1)))
        rows = rows.withColumn("rate", rate)
        if i % WRITTEN == WRITTEN - 1:
            rows = stage(rows, "rates")
    return rows, at


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``key``, domain, posterior (of that domain), n_tokens, rate, copies.

    ``targets`` are shares of all tokens (scaled to sum 1); domains without one get 0, and
    targets for unknown domains are refused. ``copies`` is how often the document is taken:
    the rate rounded up or down by a draw on its key and text, right on average. A warning
    names the shares reached where one misses its target by more than MISSED. NULL and
    empty texts have no tokens and keep the rate the fit gives their prior; repeated rows
    stay and are equal.
    """
    unknown = set(targets) - set(model.domains)
    if unknown:
        raise ValueError(f"no such domain: {sorted(unknown)}")
    whole = sum(targets.values())
    if whole <= 0 or min(targets.values()) < 0:
        raise ValueError("targets must be nonnegative and not all 0")
    shares = [targets.get(d, 0.0) / whole for d in model.domains]
    rows = model.posteriors(docs, text, F.col(key).alias("_key"), *content_key(F.col(text)))
    rows, reached = fit_rates(rows, shares)
    if sum(reached) and max(abs(a - b) for a, b in zip(reached, shares)) > MISSED:
        got = ", ".join(f"{d} {a:.3f} of {b:.3f}" for d, a, b in zip(model.domains, reached, shares))
        warnings.warn(f"shares of tokens reached: {got}", stacklevel=2)
    best = F.array_position("p", F.array_max("p")).cast("int")
    unit = F.pmod(F.xxhash64(F.lit("copies"), "_key", "k1", "k2"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.select(
        F.col("_key").alias(key), F.element_at(F.array(*[F.lit(d).cast("string") for d in model.domains]), best).alias("domain"),
        F.array_max("p").alias("posterior"), "n_tokens", "rate", F.floor(F.col("rate") + unit).cast("int").alias("copies"),
    )
