"""Quality by compression: does a dictionary of good or of bad text shorten a text more?

Two zstandard dictionaries are built from labelled text. A text is compressed with
either and without; the difference of the sizes, over the plain size, says which it is
closer to, and the plain size over the length how much it repeats itself. A logistic
curve fitted on labelled texts the dictionaries have not seen turns that into a score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import bounded, content_key, stage

#: Labelled texts used for fitting at most, and bytes of them used for either dictionary.
MOST_FIT = 12_000
DICTIONARY_SOURCE = 6_000_000
DICTIONARY_BYTES = 200_000
LEVEL = 3
MOST_BROADCAST = 1_000_000


def single_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label): one row per id; ids whose labels disagree or are NULL are left out."""
    rows = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    rows = rows.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most"))
    return rows.where("_label = _most").drop("_most")


def sample_ids(labels: DataFrame, most: dict[int, int], salt: str) -> DataFrame:
    """Labelled ids, about ``most[label]`` of each label, drawn by hash of the id; ``_u`` is uniform in [0, 1)."""
    labels = stage(labels, "labels")
    sizes = {r["_label"]: r["count"] for r in labels.groupBy("_label").count().collect()}
    unit = F.pmod(F.xxhash64(F.lit(salt), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for value, limit in most.items():
        share = F.when(F.col("_label") == value, min(1.0, limit / max(1, sizes.get(value, 0)))).otherwise(share)
    rows = labels.select("_id", "_label", unit.alias("_u"), share.alias("_share")).where("_u < _share")
    return rows.withColumn("_u", F.col("_u") / F.col("_share"))


def labelled_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _label, _u, _share, _text) of the drawn ids; the ids are few by construction."""
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.join(F.broadcast(ids), "_id")


class Compressor:
    """Sizes of a text compressed with either dictionary and without; made anew in each worker."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def of(data):
            if not data:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)

        self.each = [of(b""), of(good), of(bad)]

    def sizes(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "replace")
        return (len(data), *(len(c.compress(data)) for c in self.each))


def sizes_udf(good: bytes, bad: bytes):
    held: dict[str, Compressor] = {}

    @F.pandas_udf("n long, plain long, good long, bad long")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held["it"] = Compressor(good, bad)
        rows = [held["it"].sizes(t or "") for t in texts]
        return pd.DataFrame(rows, columns=["n", "plain", "good", "bad"])

    return sizes


def terms(n: Column, plain: Column, good: Column, bad: Column) -> list[Column]:
    """Difference, redundancy, length and their products: what the curve is fitted on."""
    d = (bad - good) / F.greatest(plain, F.lit(1))
    r = plain / F.greatest(n, F.lit(1))
    size = F.log1p(n.cast("double")) / 10
    return [d, r, size, d * d, r * r, size * size, d * r, d * size, r * size]


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    import zstandard

    texts = [t[i : i + 20_000] for t in texts for i in range(0, len(t), 20_000)]  # pieces: all of every text
    size = min(size, max(1024, sum(map(len, texts)) // 8))
    try:
        return zstandard.train_dictionary(size, texts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (last: intercept) by Newton steps on standardised columns, in the given scale."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    pen = np.full(len(b), ridge)
    pen[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - pen * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    coef = b[:-1] / sd
    return np.append(coef, b[-1] - coef @ mean)


class QualityModel:
    def __init__(self, good: bytes, bad: bytes, curve: list[float]):
        self.good, self.bad, self.curve = good, bad, curve

    def columns(self, docs: DataFrame, text: str, *keep: Column) -> DataFrame:
        """``keep`` and ``score``: 0 to 1, higher: good likelier."""
        rows = docs.select(*keep, sizes_udf(self.good, self.bad)(F.coalesce(F.col(text), F.lit(""))).alias("_s"))
        values = terms(*[F.col(f"_s.{c}") for c in ("n", "plain", "good", "bad")])
        z = F.lit(self.curve[-1])
        for c, v in zip(self.curve, values):
            z = z + F.lit(c) * v
        return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).drop("_s")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
        most: int = MOST_FIT) -> QualityModel:
    """Dictionaries and curve from at most about ``most`` labelled texts, drawn by hash of their id.

    Half of the draw, up to DICTIONARY_SOURCE bytes of either label, makes the
    dictionaries; the other half fits the curve. Without labelled texts of both labels
    the score is their share (0.5 for none).
    """
    ids = sample_ids(single_labels(labels, key, label), {0: most // 2, 1: most // 2}, "quality")
    rows = stage(labelled_texts(docs, ids, key, text), "quality-fit")
    sources: dict[int, list[bytes]] = {}
    for value in (0, 1):
        own = rows.where(f"_label = {value} and _u < 0.5")
        narrow = own.select("_id", "_u", F.octet_length("_text").alias("b"))
        total = narrow.agg(F.sum("b")).first()[0] or 0
        taken = own.where(F.col("_u") < 0.5 * min(1.0, DICTIONARY_SOURCE / max(1, total)))
        sources[value] = sorted(r[0].encode("utf-8", "replace") for r in taken.select("_text").collect())
    if not sources[0] or not sources[1]:
        n = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", [0.0] * 9 + [math.log(share / (1 - share))])
    good, bad = dictionary(sources[1]), dictionary(sources[0])
    seen = rows.where("_u >= 0.5").select("_label", "_share", sizes_udf(good, bad)("_text").alias("_s"))
    seen = seen.select("_label", "_share", *[t.alias(f"x{i}") for i, t in enumerate(terms(*[F.col(f"_s.{c}") for c in ("n", "plain", "good", "bad")]))])
    held = seen.toPandas()  # at most about ``most`` / 2 rows of numbers
    y = held["_label"].to_numpy(float)
    x = held[[f"x{i}" for i in range(9)]].to_numpy(float)
    if len(set(y)) < 2:
        share = 0.5 if not len(y) else min(max(y.mean(), 1e-6), 1 - 1e-6)
        return QualityModel(good, bad, [0.0] * 9 + [math.log(share / (1 - share))])
    return QualityModel(good, bad, logistic(x, y, 1 / held["_share"].to_numpy(float)).tolist())


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a NULL id."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def score(docs: DataFrame, model: QualityModel, *, key: str = "doc_id", text: str = "text", accept: float = 0.7) -> DataFrame:
    """One row per document row: ``key``, score, predicted (1 from ``accept``).

    NULL texts count as empty; both have the score of a text of no bytes. Repeated rows
    stay and have one score; the score depends on the text alone.
    """
    rows = model.columns(docs, text, F.col(key).alias("_key"))
    return rows.select(F.col("_key").alias(key), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: QualityModel, *, text: str = "text", accept: float = 0.7) -> DataFrame:
    """The documents with a score of at least ``accept``, as they are."""
    rows = model.columns(docs, text, *content_key(F.col(text)))
    return without(docs, rows.where(F.col("score") < accept), text)


def without(docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``docs`` less the rows whose text is one of ``texts`` (k1, k2)."""
    gone = bounded(stage(texts.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "rejected"), MOST_BROADCAST)
    k1, k2 = content_key(F.col(text))
    return docs.join(gone, (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left_anti")
