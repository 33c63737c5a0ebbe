"""Benchmark decontamination: windows of test items, searched in every document.

Native throughout. The windows' opening words form a broadcast hash set that every
position of every document is looked up in; the few positions found are verified word
by word against whole windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import UPPER, bounded, content_key, lower_ascii, stage

#: What stands between words: ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text that is not lower-cased yet.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that are looked up first.
ANCHOR = 4
#: Rows up to which the windows are broadcast (about 100 bytes each).
MOST_BROADCAST = 1_000_000


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), PLAIN_GAP), "")


def words(text: Column) -> Column:
    return plain_words(lower_ascii(text))


def folded(text: Column) -> Column:
    """Lower case beyond A-Z as well, for the first look only: what is equal with A-Z lowered is equal here."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))  # the two small sigmas depend on what follows


def windows(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(win, len, anchor_len, anchor, items): distinct windows with the items that hold them.

    An item of fewer words than ``width`` is one window; an item without words has none.
    """
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(width)))
    w = w.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    w = w.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("w"))
    w = w.select("item", "len", F.least("len", F.lit(ANCHOR)).alias("anchor_len"), F.array_join("w", " ").alias("win"),
                 F.xxhash64(*[folded(F.get("w", F.lit(i))) for i in range(ANCHOR)]).alias("anchor"))
    return w.groupBy("win", "len", "anchor_len", "anchor").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
         item_text: str = "text", width: int = 13) -> DataFrame:
    """(k1, k2, at, len, items): every occurrence of a window, by content key; ``at`` counts from 0.

    Depends on texts alone, so copies of a text share their rows. A NULL text has no words.
    """
    found = stage(windows(benchmark, item, item_text, width), "windows")
    anchors = stage(found.select("anchor_len", "anchor", "len").distinct(), "anchors")
    lengths = sorted(r[0] for r in anchors.select("anchor_len").distinct().collect()) or [1]  # 1 to ANCHOR; an empty benchmark is met by nothing
    rows = docs.select(F.col(text).alias("_t")).select("_t", F.array_remove(F.split(folded(F.col("_t")), GAP), "").alias("w"))
    shifted = [F.col("w").alias("s0")] + [
        F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"s{i}") for i in range(1, max(lengths))
    ]
    # outer explodes: an inner one is given a test for emptiness that computes the words a second time
    rows = rows.select("_t", F.arrays_zip(*shifted).alias("z")).select("_t", F.posexplode_outer("z").alias("at", "z"))
    opening = [F.xxhash64(*[F.col("z")[f"s{i}"] for i in range(n)]) for n in lengths]
    rows = rows.select("_t", "at", opening[0].alias("anchor") if len(opening) == 1 else F.explode_outer(F.array(*opening)).alias("anchor"))
    rows = rows.join(bounded(anchors.select("anchor", "len").distinct(), MOST_BROADCAST), "anchor")
    rows = rows.select("_t", "at", "len", F.slice(plain_words(F.col("_t")), F.col("at") + 1, F.col("len")).alias("w"))
    rows = rows.where(F.size("w") == F.col("len")).select(*content_key(F.col("_t")), "at", F.array_join("w", " ").alias("win"))
    rows = rows.withColumn("win", F.translate("win", UPPER, UPPER.lower()))
    return rows.join(bounded(found, MOST_BROADCAST), "win").select("k1", "k2", "at", "len", "items")


def covered(spans: Column) -> Column:
    """Words inside any of the sorted (at, end) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(a, s):
        fresh = F.greatest(s["end"] - F.greatest(s["at"], a["upto"]), F.lit(0))
        return F.struct((a["n"] + fresh).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def hit_texts(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per distinct text with a hit: (k1, k2, spans, n_hit, n_items, items_sha256)."""
    found = hits(docs, benchmark, **names)
    found = found.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.select(
        "k1", "k2", "spans", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )


def judge(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", share: int = 20,
          **names) -> DataFrame:
    """One row per document row: ``key``, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least one in ``share`` of its words lies inside a
    window. NULL and empty texts have no words and no hits; repeated rows stay, each with
    the same result; an empty benchmark hits nothing; items without id hit, but are not
    counted; further columns of either table are ignored.
    """
    found = stage(hit_texts(docs, benchmark, text=text, **names), "hits")
    rows = docs.select(F.col(key).alias("_key"), *content_key(F.col(text)), F.size(plain_words(F.col(text))).cast("long").alias("n_words"))
    rows = rows.join(bounded(found.drop("spans"), MOST_BROADCAST), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", share: int = 20, **names) -> DataFrame:
    """The documents that are not contaminated, as they are; NULL texts stay."""
    found = stage(hit_texts(docs, benchmark, text=text, **names).select("k1", "k2", "n_hit"), "hits")
    found = bounded(found.toDF("_k1", "_k2", "_n"), MOST_BROADCAST)
    k1, k2 = content_key(F.col(text))
    bad = (k1 == F.col("_k1")) & (k2 == F.col("_k2")) & (F.col("_n") * share >= F.size(plain_words(F.col(text))))
    return docs.join(found, bad, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **names) -> DataFrame:
    """The documents without the words inside windows, each cut with what follows it up to the next word."""
    found = stage(hit_texts(docs, benchmark, text=text, **names).select("k1", "k2", "spans"), "hits")
    word = PLAIN_GAP.replace("[", "[^", 1)
    rows = docs.withColumns({"_k1": content_key(F.col(text))[0], "_k2": content_key(F.col(text))[1]})
    rows = rows.join(bounded(found.toDF("_k1", "_k2", "_spans"), MOST_BROADCAST // 10), ["_k1", "_k2"], "left")
    units = F.regexp_extract_all(text, F.lit(f"{word}{PLAIN_GAP[:-1]}*"), F.lit(0))
    kept = F.filter(units, lambda u, i: ~F.exists("_spans", lambda s: (s["at"] <= i) & (i < s["end"])))
    cut = F.concat(F.regexp_extract(text, f"^{PLAIN_GAP[:-1]}*", 0), F.array_join(kept, ""))
    return rows.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)
