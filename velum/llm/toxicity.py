"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts; features are its
densities, how close a second person stands to a hit, capitals, punctuation and
obfuscated spellings. Trees are fitted on features from lexicons that have not seen the
text itself, and the isotonic curve on texts that the trees have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.common import content_key, stage
from velum.llm.quality import labelled_texts, sample_ids, single_labels, without

#: Labelled texts used for fitting at most: toxic and other ones.
MOST_TOXIC = 5_000
MOST_OTHER = 10_000
FOLDS = 4
#: Lexicon entries at most, by strength; toxic documents an entry must be seen in, and where labels name fewer than FEW of them.
MOST_ENTRIES = 20_000
LEAST_SEEN = 4
FEW, LEAST_OF_FEW = 16, 2
#: Counts that a task holds before it hands them on to be summed.
GATHERED = 100_000
#: Lengths of word beginnings that can be entries.
BEGINNINGS = range(3, 9)

# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton",
    "vous", "votre", "vos", "tú", "usted", "ustedes", "vosotros", "tus",
]

WORD = re.compile(r"\w+")
#: Signs that stand for letters in masked spellings.
MASKS = np.zeros(128, bool)
MASKS[[ord(c) for c in "0123456789@$*!#|"]] = True
FEATURES = [
    "length", "hits", "hit_density", "strongest", "sum_density", "known", "beginnings", "second", "nearest",
    "capitals", "exclaim", "punctuation", "masked", "drawn",
]


def entries(word: str) -> list[str]:
    """The lexicon keys a word can match: itself, and its beginnings marked by ``*``."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n <= len(word))]


class Worth(dict):
    """Strength (log odds) of words seen so far, 0 for most; the room for them is bounded."""

    def __init__(self, strength: dict[str, float], room: int = 100_000):
        super().__init__()
        self.strength, self.room = strength, room

    def __missing__(self, word: str) -> float:
        if len(self) > self.room:
            self.clear()
        get = self.strength.get
        value = self[word] = max(get(k, 0.0) for k in entries(word))
        return value


def masked_words(flat: np.ndarray) -> tuple[int, int, int, int]:
    """Capitals, punctuation marks, letters masked inside words, and letters drawn out, of a text's code points."""
    ascii_ = flat < 128
    folded = flat | 32
    letter = (ascii_ & (folded >= 97) & (folded <= 122)) | (flat >= 0xC0)
    capital = np.count_nonzero((flat >= 65) & (flat <= 90)) + np.count_nonzero((flat >= 0xC0) & (flat <= 0xDE))
    mark = ascii_ & (flat > 32) & ~letter & ~((flat >= 48) & (flat <= 57))
    mask = ascii_ & MASKS[np.where(ascii_, flat, 0)]
    # a run of masks counts if letters stand on both sides: what is no mask, in order, tells where runs lie
    rest = np.flatnonzero(~mask)
    gap = np.flatnonzero(np.diff(rest) > 1)
    masked = np.count_nonzero(letter[rest[gap]] & letter[rest[gap + 1]])
    drawn = np.count_nonzero((flat[2:] == flat[1:-1]) & (flat[1:-1] == flat[:-2]) & letter[2:])
    return capital, int(np.count_nonzero(mark)), masked, drawn


class Lexicon:
    def __init__(self, strength: dict[str, float]):
        self.strength, self.worth = strength, Worth(strength)

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        n, kinds, worth = len(words), set(words), self.worth
        hot = {w: s for w in kinds if (s := worth[w])}
        at = [i for i, w in enumerate(words) if w in hot] if hot else []
        strengths = [hot[words[i]] for i in at]
        you = [] if PERSONS.isdisjoint(kinds) else [i for i, w in enumerate(words) if w in PERSONS]
        gap = 100.0
        if at and you:
            a, y = np.array(at), np.array(you)
            k = np.searchsorted(y, a)
            gap = float(min(100, np.abs(a - y[np.minimum(k, len(y) - 1)]).min(), np.abs(a - y[np.maximum(k - 1, 0)]).min()))
        size, per = max(1, len(text)), max(1, n)
        capital, marks, masked, drawn = masked_words(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
        known = sum(words[i] in self.strength for i in at)
        return [
            math.log1p(n), len(at), len(at) / per, max(strengths, default=0.0), sum(strengths) / per, known, len(at) - known,
            len(you) / per, gap, capital / size, text.count("!") / size, marks / size, masked / per, drawn / per,
        ]


PERSONS = frozenset(SECOND_PERSON)


def features_udf(strength: dict[str, float]):
    held: list[Lexicon] = []

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Lexicon(strength))
        return pd.Series([held[0].features(t or "") for t in texts])

    return features


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, fold, toxic, other): texts that hold a word or beginning; partial sums, at most about GATHERED at a time."""
    sums: Counter[tuple[str, int, int]] = Counter()

    def partial() -> pd.DataFrame:
        rows = pd.DataFrame(list(sums), columns=["entry", "fold", "_label"])
        n = np.fromiter(sums.values(), np.int64, len(sums))
        return rows.assign(toxic=n * rows["_label"], other=n * (1 - rows["_label"])).drop(columns="_label")

    for batch in batches:
        for text, label, fold in zip(batch["_text"], batch["_label"], batch["_fold"]):
            keys = {k for w in set(WORD.findall(text.lower())) for k in entries(w)}
            sums.update((k, fold, label) for k in keys)
            if len(sums) >= GATHERED:
                yield partial()
                sums.clear()
    if sums:
        yield partial()


def lexicons(rows: DataFrame, folds: int, least: int) -> list[dict[str, float]]:
    """``folds`` lexicons, each without the texts of its fold, and one of all texts."""
    toxic = rows.where("_label = 1").mapInPandas(counted, "entry string, fold int, toxic long, other long")
    toxic = toxic.groupBy("entry").agg(F.sum("toxic").alias("t")).where(F.col("t") >= least)
    counts = rows.mapInPandas(counted, "entry string, fold int, toxic long, other long")
    counts = counts.groupBy("entry", "fold").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    counts = stage(counts.join(toxic.select("entry"), "entry"), "entries")
    n = {r["_fold"]: (r["t"], r["o"]) for r in rows.groupBy("_fold").agg(
        F.sum("_label").alias("t"), F.sum(1 - F.col("_label")).alias("o")).collect()}
    out = []
    for fold in range(folds + 1):
        own = counts.where(F.col("fold") != fold).groupBy("entry").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        nt = sum(v[0] for f, v in n.items() if f != fold)
        no = sum(v[1] for f, v in n.items() if f != fold)
        odds = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("o") + 0.5) / (no + 1.0))
        own = own.where(F.col("t") >= least).withColumn("s", odds).where("s > 2.0")
        rank = own.orderBy(F.desc(F.col("s") * F.sqrt("t")), "entry").limit(MOST_ENTRIES)
        out.append({r["entry"]: r["s"] for r in rank.select("entry", "s").collect()})
    return out


class ToxicityModel:
    def __init__(self, strength: dict[str, float], trees, curve, share: float):
        self.strength, self.trees, self.curve, self.share = strength, trees, curve, share

    def columns(self, docs: DataFrame, text: str, *keep: Column) -> DataFrame:
        """``keep`` and ``score``: 0 to 1, higher: toxic likelier."""
        rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        if self.trees is None:
            return rows.drop("_text").withColumn("score", F.lit(self.share))
        rows = rows.withColumn("_f", features_udf(self.strength)("_text")).drop("_text")
        return self.calibrated(self.raw(rows))

    def raw(self, rows: DataFrame) -> DataFrame:
        return raw_scores(self.trees, rows)

    def calibrated(self, rows: DataFrame) -> DataFrame:
        rows = self.curve.transform(rows) if self.curve is not None else rows.withColumn("_c", F.col("_raw1"))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_c")))
        return rows.withColumn("score", score).drop("_c", "_raw1", "_x")


def vectors(rows: DataFrame) -> DataFrame:
    """``_x`` from the feature array ``_f``."""
    rows = rows.select("*", *[F.col("_f")[i].alias(f"_f_{c}") for i, c in enumerate(FEATURES)])
    cols = [f"_f_{c}" for c in FEATURES]
    return VectorAssembler(inputCols=cols, outputCol="_x").transform(rows).drop("_f", *cols)


def raw_scores(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(vectors(rows)).withColumn("_raw1", vector_to_array("_p")[1]).drop("_p", "_m", "_y")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        most: dict[int, int] | None = None, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Lexicon, trees and curve from a bounded draw of labelled texts (MOST_TOXIC, MOST_OTHER).

    The draw is by hash of the id, so it is the same in every run; rows carry the inverse
    of their share as weight. Each label is dealt evenly over FOLDS folds, or over as many
    as the rarer label has texts. With a single text of a label, or none, nothing can be
    held out and the score is the share of toxic texts (0 without labels).
    """
    ids = sample_ids(single_labels(labels, key, label), most or {1: MOST_TOXIC, 0: MOST_OTHER}, "toxic")
    ids = stage(ids.join(docs.select(F.col(key).alias("_id")), "_id", "left_semi"), "drawn")
    total = {0: 0, 1: 0} | {r["_label"]: r["count"] for r in ids.groupBy("_label").count().collect()}
    folds = min(FOLDS, total[0], total[1])
    if folds < 2:
        return ToxicityModel({}, None, None, total[1] / max(1, total[0] + total[1]))
    # one partition a label: the draw bounds it, and it holds no text
    nth = F.row_number().over(Window.partitionBy("_label").orderBy("_u", "_id")) - 1
    dealt = stage(ids.withColumn("_fold", F.pmod(nth, F.lit(folds))), "dealt")
    rows = labelled_texts(docs, dealt, key, text).withColumn("_weight", 1 / F.col("_share"))
    rows = stage(rows.repartition(16, "_id"), "toxic-fit")
    lex = lexicons(rows, folds, LEAST_SEEN if total[1] >= FEW else LEAST_OF_FEW)
    parts = [
        rows.where(F.col("_fold") == f).select("_label", "_weight", "_fold", features_udf(lex[f])("_text").alias("_f"))
        for f in range(folds)
    ]
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    seen = stage(seen.withColumn("_y0", F.col("_label").cast("double")), "toxic-features")
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y0", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.3,
                        minInstancesPerNode=5, seed=7, predictionCol="_y")
    gbt.setProbabilityCol("_p").setRawPredictionCol("_m")
    model = gbt.fit(stage(vectors(seen.where("_fold > 0")).coalesce(4), "toxic-v"))
    fresh = raw_scores(model, seen.where("_fold = 0"))
    curve = IsotonicRegression(featuresCol="_raw1", labelCol="_y0", weightCol="_weight", predictionCol="_c").fit(fresh)
    return ToxicityModel(lex[folds], model, curve, total[1] / sum(total.values()))


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", accept: float = 0.5) -> DataFrame:
    """One row per document row: ``key``, score, predicted (1, toxic, from ``accept``).

    NULL texts count as empty; repeated rows stay and have one score; the score depends on
    the text alone.
    """
    rows = model.columns(docs, text, F.col(key).alias("_key"))
    return rows.select(F.col("_key").alias(key), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: ToxicityModel, *, text: str = "text", accept: float = 0.5) -> DataFrame:
    """The documents with a score below ``accept``, as they are."""
    rows = model.columns(docs, text, *content_key(F.col(text)))
    return without(docs, rows.where(F.col("score") >= accept), text)
