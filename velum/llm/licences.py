"""Licence scans: which licence families do a document's paragraphs declare?

Every line that can hold a template, and every window over the end of a line and what
follows it up to a blank line, is classified by multinomial logistic regression on its words and word
pairs, with a class for paragraphs that declare none; the probabilities are calibrated by
a temperature on paragraphs that were not fitted on. A prediction counts if the paragraph
also holds most of a template of that family.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import bounded, content_key, stage

BUCKETS = 1 << 14
#: Paragraphs drawn from the documents for the class without licence, at most about so many.
MOST_OTHER = 6_000
NONE = "none"
#: Probability from which a family is predicted; share of a template's word pairs that confirm it.
LEAST_SCORE, LEAST_MATCH = 0.5, 0.6

# How notices of each family usually read.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license version 2.0"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation version 3", "released under the gpl version 3"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2", "released under the gpl version 2"],
    "lgpl-2.1": ["licensed under the gnu lesser general public license version 2.1", "released under the lgpl version 2.1"],
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "released under the agpl version 3"],
    "bsd": ["licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "released under the 3 clause bsd license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license version 2.0"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0", "no rights reserved under the cc0 public domain dedication"],
    "all-rights-reserved": ["all rights reserved", "no part of this publication may be reproduced without permission"],
}
OPENINGS = ["", "copyright 2020 the authors .", "note :", "this project is", "the text below is"]
ENDINGS = ["", "see the file for details", "all contributions are welcome", "."]


def words(text: Column) -> Column:
    """Lower-case words; dots, hyphens and slashes count inside a word only."""
    return F.array_remove(F.split(F.rtrim(F.lower(text), F.lit(". ")), r"[./\-]*[^\p{L}\p{N}./\-]+"), "")


def pairs(w: Column) -> Column:
    """Each word with the one after it."""
    rest = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    joined = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) > 1, joined).otherwise(F.array().cast("array<string>"))


def with_grams(rows: DataFrame) -> DataFrame:
    """``_g``, hashes of the words ``_w`` and of each with the one after it."""
    rows = rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    rest = F.slice("_h", F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0)))
    return rows.withColumn("_g", F.concat("_h", F.zip_with("_h", rest, lambda a, b: F.xxhash64(a, b)))).drop("_h")


def cues() -> list[str]:
    """Words of the templates without any of which no template can be matched.

    A paragraph that matches lacks at most 1 - LEAST_MATCH of a template's word pairs, so
    it holds a word of any set that touches more than that share of them.
    """
    out: set[str] = set()
    texts = [t.split() for own in TEMPLATES.values() for t in own]
    often = {w: sum(w in t for t in texts) for t in texts for w in t}
    for t in texts:
        pairs_ = set(zip(t, t[1:]))

        def left() -> float:
            return sum(not out.intersection(p) for p in pairs_) / len(pairs_)

        # long words first, as they are rare in other paragraphs
        for w in sorted(set(t), key=lambda w: (-len(w), -often[w], w)):
            if left() < LEAST_MATCH:
                break
            if any(w in p for p in pairs_ if not out.intersection(p)):
                out.add(w)
    return sorted(out)


def may_match(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for w in cues():
        found = found | F.contains(low, F.lit(w))
    return found


def vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_g", outputCol="_x", numFeatures=BUCKETS, binary=True).transform(rows)


def paragraphs(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, at (from 0) and paragraph: the lines of each text that are not blank."""
    rows = docs.select(*keep, F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), r"\R")).alias("at", "paragraph"))
    return rows.where(F.col("paragraph").rlike(r"\S"))


#: Words of the longest template. A template that starts in a line and goes on in the next ends within so many words of either side.
LONGEST = max(len(t.split()) for own in TEMPLATES.values() for t in own)


def passages(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, at, to (lines, from 0), paragraph and ``_apart``: lines that are not blank, and windows for wrapped notices.

    A window is the last LONGEST words of a line and the first LONGEST of the lines after
    it, as far as the next line without letter or digit; there is one for each line that
    another follows. ``_apart`` has its two sides, and is NULL for a line. Only what holds a word that a
    template needs is given.
    """
    said = r"[\p{L}\p{N}]"
    rows = docs.select(*keep, F.split(F.coalesce(F.col(text), F.lit("")), r"\R").alias("_lines"))
    rows = rows.select("*", F.transform("_lines", may_match).alias("_cue"), F.transform("_lines", lambda p: p.rlike(said)).alias("_said"))
    lines = F.filter(F.transform("_lines", lambda p, i: F.struct(
        i.alias("at"), i.alias("to"), p.alias("paragraph"), F.lit(None).cast("array<string>").alias("_apart"), F.element_at("_cue", i + 1).alias("_cue"))), lambda x: x["_cue"])
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_lines") - 1, F.lit(1))), lambda i: (i < F.size("_lines")) & F.element_at("_said", i)
                      & F.element_at("_said", F.least(i + 1, F.size("_lines"))) & F.exists(F.slice("_cue", i, LONGEST + 1), lambda c: c))

    def after(i: Column) -> Column:
        """How many lines follow line ``i`` (from 1) up to one that says nothing."""
        end = F.array_position(F.slice("_said", i + 1, LONGEST), F.lit(False)).cast("int")
        return F.when(end > 0, end - 1).otherwise(F.least(F.lit(LONGEST), F.size("_lines") - i))

    def sides(i: Column, n: Column) -> Column:
        own = words(F.element_at("_lines", i))
        own = F.slice(own, F.greatest(F.size(own) - (LONGEST - 1), F.lit(1)), F.lit(LONGEST))
        rest = F.slice(words(F.array_join(F.slice("_lines", i + 1, n), "\n")), 1, LONGEST)
        return F.array(F.array_join(own, " "), F.array_join(rest, " "))

    windows = F.transform(F.transform(places, lambda i: F.struct(i.alias("i"), after(i).alias("n"))), lambda x: F.struct(
        (x["i"] - 1).alias("at"), (x["i"] - 1 + x["n"]).alias("to"), sides(x["i"], x["n"]).alias("sides")))
    windows = F.transform(windows, lambda x: F.struct(
        x["at"].alias("at"), x["to"].alias("to"), F.array_join(x["sides"], " ").alias("paragraph"), x["sides"].alias("_apart"), F.lit(True).alias("_cue")))
    own = [c for c in rows.columns if not c.startswith("_")]
    rows = rows.select(*own, F.explode(F.concat(lines, windows)).alias("_p"))
    return rows.select(*own, "_p.at", "_p.to", "_p.paragraph", "_p._apart").where(F.col("_apart").isNull() | may_match(F.col("paragraph")))


def template_match(own: Column, family: Column | None = None) -> Column:
    """The largest share of the word pairs of a template, of that family if one is given, that ``own`` holds."""
    out = []
    for name, texts in TEMPLATES.items():
        shares = []
        for t in texts:
            held = t.split()
            wanted = sorted({" ".join(p) for p in zip(held, held[1:])})
            shares.append(F.size(F.array_intersect(F.array(*map(F.lit, wanted)), own)) / F.lit(float(len(wanted))))
        best = F.greatest(*shares, F.lit(0.0))
        out.append(best if family is None else F.when(family == name, best).otherwise(0.0))
    return F.greatest(*out)


class LicenceModel:
    def __init__(self, names: list[str], model, temperature: float):
        self.names, self.model, self.temperature = names, model, temperature

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (paragraph) with family, score and match, only those that declare a licence."""
        rows = with_grams(rows.withColumn("_w", words(F.col("paragraph"))))
        rows = self.model.transform(vectors(rows)).withColumn("_a", vector_to_array("_m"))
        top = F.array_max("_a")
        best = F.array_position("_a", top).cast("int")
        score = 1 / F.aggregate("_a", F.lit(0.0), lambda s, a: s + F.exp((a - top) / self.temperature))
        rows = rows.withColumns({"family": F.element_at(F.array(*map(F.lit, self.names)), best), "score": score})
        rows = rows.where((F.col("family") != NONE) & (F.col("score") >= LEAST_SCORE))
        rows = rows.withColumn("_pairs", pairs(F.col("_w")))
        return rows.withColumn("match", template_match(F.col("_pairs"), F.col("family"))).drop("_w", "_pairs", "_g", "_x", "_m", "_p", "_y", "_a")


def fit(docs: DataFrame, *, text: str = "text", most: int = MOST_OTHER) -> LicenceModel:
    """Fitted on templates in varied frames, and on paragraphs drawn from the documents for the class without.

    The draw takes paragraphs by hash, at most about ``most``; those that hold most of a
    template are left out of it. Works without any document too.
    """
    spark = docs.sparkSession
    made = [(f"{a} {t} {b}".strip(), name) for name, texts in TEMPLATES.items() for t in texts for a, b in product(OPENINGS, ENDINGS)]
    own = spark.createDataFrame(made, "paragraph string, family string")
    unit = F.pmod(F.xxhash64(F.lit("licence"), "paragraph"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    lines = docs.agg(F.sum(F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"\R")))).first()[0] or 1
    other = paragraphs(docs, text).select("paragraph").where(unit < min(1.0, most / lines)).distinct()
    other = stage(other.withColumn("_w", words(F.col("paragraph"))), "licence-other").withColumn("_pairs", pairs(F.col("_w")))
    other = other.withColumn("_holds", template_match(F.col("_pairs"))).where(F.col("_holds") < LEAST_MATCH).select("paragraph", F.lit(NONE).alias("family"))
    names = [NONE, *TEMPLATES]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
    blank = spark.createDataFrame([("-", NONE), ("the license plate of the car", NONE), ("she has a driving licence", NONE)], "paragraph string, family string")
    rows = own.unionByName(other).unionByName(blank)
    rows = rows.select(number.cast("double").alias("_l"), words(F.col("paragraph")).alias("_w"), F.pmod(F.xxhash64("paragraph"), F.lit(4)).alias("_f"))
    rows = with_grams(rows)
    rows = stage(vectors(rows).select("_l", "_x", "_f").coalesce(4), "licence-fit")
    lr = LogisticRegression(featuresCol="_x", labelCol="_l", predictionCol="_y", probabilityCol="_p", rawPredictionCol="_m",
                            regParam=1e-4, maxIter=25, family="multinomial")
    model = lr.fit(rows.where("_f > 0"))
    held = model.transform(rows.where("_f = 0")).select("_l", vector_to_array("_m").alias("_a")).toPandas()  # a quarter of the fit's rows
    return LicenceModel(names, model, temperature(np.stack(held["_a"].to_numpy()), held["_l"].to_numpy(int)))


def temperature(margins: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the margins under which the held-out labels are likeliest."""

    def loss(t: float) -> float:
        z = margins / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), label]))

    return min((math.exp(e / 10) for e in range(-20, 31)), key=loss)


def scan(docs: DataFrame, model: LicenceModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``key``, licence, families, score, match, n_paragraphs.

    ``licence`` is the confirmed family of the highest score and match, NULL if
    none; ``families`` all confirmed ones, sorted, comma-joined; score and match are the
    licence's; notices that are wrapped over lines are read as a whole. ``n_paragraphs``
    counts the lines that are not blank. NULL and empty texts declare none; repeated rows stay and are equal.
    """
    likely = docs.where(may_match(F.col(text)))  # no other text has a paragraph that a template confirms
    found = passages(likely, text, *content_key(F.col(text)))
    found = stage(model.predict(found).where(F.col("match") >= LEAST_MATCH).dropDuplicates(["k1", "k2", "at", "to"]), "licence-found")
    # a window tells something only if neither side holds as much by itself; what it covers with less is a part of it
    windows = [pairs(words(F.col("_apart")[i])) for i in range(2)]
    found = found.where(F.col("_apart").isNull() | (F.col("match") > F.greatest(*map(template_match, windows))))
    whole = found.where(F.col("_apart").isNotNull()).select("k1", "k2", F.explode(F.sequence("at", "to")).alias("at"), "match")
    whole = whole.groupBy("k1", "k2", "at").agg(F.max("match").alias("_whole"))
    found = found.join(whole, ["k1", "k2", "at"], "left").where(F.col("_whole").isNull() | (F.col("_whole") <= F.col("match")))
    found = found.groupBy("k1", "k2").agg(
        F.max_by(F.struct("family", "score", "match"), F.struct("score", "match", "family")).alias("best"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    found = bounded(stage(found, "licences"), 1_000_000)
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\R"), lambda p: p.rlike(r"\S"))).cast("long")
    rows = docs.select(F.col(key).alias("_key"), *content_key(F.col(text)), lines.alias("n_paragraphs")).join(found, ["k1", "k2"], "left")
    return rows.select(F.col("_key").alias(key), F.col("best.family").alias("licence"), F.coalesce("families", F.lit("")).alias("families"),
                       F.col("best.score").alias("score"), F.col("best.match").alias("match"), "n_paragraphs")
