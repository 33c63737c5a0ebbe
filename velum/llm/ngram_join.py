"""Jaccard self-join of documents on word n-grams: grouped prefix join, and the classes it links.

Documents with one set of n-grams are one class. Classes whose prefix (the rarest n-grams,
as many as may differ) and size are equal form one group, so a prefix is posted once per
group. Groups that share a posted n-gram are expanded to their classes; pairs pass a size
and a bitmap bound and are then verified on their whole sets.

Pairs are taken in two rounds, so that copies of copies do not meet all with all: first
every class with the most central one of each posting list; then, where a list still holds
classes not connected yet, those outside its largest part with all the others. No pair
that could connect two parts is left out, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from velum.llm.common import bounded, content_key, small_batches, stage
from velum.session import release

WORDS = 4
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: 64-bit parts of the short bitmap that bounds how much two sets differ; the long one has a bit per n-gram or more.
BITMAP = 8
#: N-grams that are ordered by how common they are; the rest count as rare. Only the order
#: depends on it, never which pairs are found.
MOST_COMMON = 500_000
#: N-grams gathered before they are counted, and the count from which one is reported.
GATHERED, REPORTED = 2_000_000, 3
#: Word hashes a worker keeps.
WORD_HASHES = 100_000
MOST_BROADCAST = 2_000_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = out * P + h[i : i + n]
    return np.unique(mixed(out))


def class_of(tokens: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; NULL for the empty one."""
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def survey(width: int):
    """Documents (id, k1, k2, n, c), and n-grams (token, seen) that classes of one task share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, met, held, size = WordHashes(), set(), [], 0

        def common() -> pd.DataFrame:
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()  # in place: np.unique would sort a copy
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            seen = np.diff(np.append(first, len(tokens)))
            token = tokens[first]
            keep = seen >= REPORTED
            return pd.DataFrame({"id": pd.array([None] * int(keep.sum()), "Int64"), "k1": 0, "k2": 0, "n": 0, "c": None, "token": token[keep].view(np.int64), "seen": seen[keep]})

        for batch in batches:
            sets = [shingles(t, hashes, width) for t in batch["text"]]
            names = [class_of(s) for s in sets]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "k1": batch["k1"], "k2": batch["k2"], "n": [len(s) for s in sets], "c": names, "token": 0, "seen": 0})
            for s, c in zip(sets, names):
                if c is not None and c not in met:
                    met.add(c)
                    held.append(s)
                    size += len(s)
            if size >= GATHERED:
                yield common()
                size = 0
        if held:
            yield common()

    return run


class Order:
    """Rarest first: n-grams not known as common by hash, then the common ones by count."""

    def __init__(self, tokens: np.ndarray, rank: np.ndarray):
        self.tokens, self.rank = tokens, rank

    @staticmethod
    def of(tokens: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams and their ranks: plain arrays, as a broadcast object would have to be imported by workers."""
        by_token = np.argsort(tokens)
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, seen))] = np.arange(1, len(tokens) + 1)
        return tokens[by_token], rank[by_token]

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.rank[at], 0)


def bitmap(tokens: np.ndarray, size: int) -> list[int]:
    """Parity of the set in each of ``size`` buckets: two sets differ in at least as many n-grams as bits."""
    odd = np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def long_size(n: int) -> int:
    """Bits of the long bitmap of a set of ``n``: a power of two, so that one folds onto another."""
    return max(64 * BITMAP, 1 << (n - 1).bit_length())


def prefixes(order, width: int, percent: int):
    """Classes (c, g, n, bits, long), and their prefixes (token, g, common), once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes, met, groups = WordHashes(), set(), set()
        known = Order(*order.value)
        for batch in batches:
            classes, posts = [], []
            for text in batch["text"]:
                s = shingles(text, hashes, width)
                c = class_of(s)
                if c is None or c in met:
                    continue
                met.add(c)
                n = len(s)
                rank = known.ranks(s)
                first = np.lexsort((s, rank))[: n - -(-percent * n // 100) + 1]
                g = xxhash.xxh3_64_intdigest(s[first].tobytes() + n.to_bytes(8, "little")) - (1 << 63)
                classes.append((c, g, n, bitmap(s, 64 * BITMAP), bitmap(s, long_size(n))))
                if g not in groups:
                    groups.add(g)
                    posts.append((s[first].view(np.int64), g, rank[first] > 0))
            if classes:
                k = pd.DataFrame(classes, columns=["c", "g", "n", "bits", "long"])
                yield k.assign(token=0, common=False)
            if posts:
                size = [len(p[0]) for p in posts]
                yield pd.DataFrame({
                    "c": None, "g": np.repeat([p[1] for p in posts], size), "n": 0, "bits": None, "long": None,
                    "token": np.concatenate([p[0] for p in posts]), "common": np.concatenate([p[2] for p in posts]),
                })

    return run


def sets_of(width: int):
    """(c, tokens) of the documents given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, met = WordHashes(), set()
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingles(text, hashes, width)
                c = class_of(s)
                if c is not None and c not in met:
                    met.add(c)
                    out.append((c, s.view(np.int64)))
            if out:
                yield pd.DataFrame(out, columns=["c", "tokens"])

    return run


def sizes_may(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def bits_may(odd: Column, n1: Column, n2: Column, percent: int) -> Column:
    """Bits that differ are at most the n-grams that differ, and so many may."""
    return odd * (100 + percent) <= (n1 + n2) * (100 - percent)


def short_odd(a: Column, b: Column) -> Column:
    odd = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, BITMAP):
        odd = odd + F.bit_count(a[i].bitwiseXOR(b[i]))
    return odd


def long_odd(a: Column, b: Column) -> Column:
    """Bits that differ; the longer bitmap, at most twice as long, is folded first."""

    def folded(x: Column, other: Column) -> Column:
        half = F.greatest(F.expr("1"), (F.size(x) / 2).cast("int"))
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), both).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets reach the similarity; those their long bitmaps rule out go first."""
    own = members.select("c", "n", "long", "rep")
    pairs = pairs.join(own.toDF("a", "n1", "long1", "rep1"), "a").join(own.toDF("b", "n2", "long2", "rep2"), "b")
    pairs = pairs.where(bits_may(long_odd(F.col("long1"), F.col("long2")), F.col("n1"), F.col("n2"), percent))
    pairs = stage(pairs.select("a", "b", "rep1", "rep2"), "pairs")
    wanted = pairs.select(F.col("a").alias("c"), F.col("rep1").alias("rep")).union(pairs.select(F.col("b").alias("c"), F.col("rep2").alias("rep")))
    wanted = stage(wanted.distinct(), "wanted")
    few = bounded(wanted.select("rep").distinct(), MOST_BROADCAST)
    texts = docs.join(few, docs["id"].eqNullSafe(few["rep"]), "left_semi").select("text")
    sets = texts.mapInPandas(sets_of(width), "c binary, tokens array<bigint>").join(bounded(wanted.select("c"), MOST_BROADCAST), "c", "left_semi")
    with small_batches(docs.sparkSession):
        sets = stage(sets, "sets")
    both = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    linked = F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent
    links = stage(both.where(linked).select("a", "b").distinct(), "links")
    release(pairs, wanted, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(c, label): the smallest member each node reaches; nodes without an edge are left out.

    Labels spread along edges and then jump to their label's label, so the number of
    rounds grows with the logarithm of the longest way.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stage(both, "edges")
    last = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("c"), "label"), "labels")
    labels = last
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "c"), "c").select("c", "label", F.least("label", "near").alias("new"))
        jump = labels.toDF("new", "jump")
        spread = spread.join(jump, "new").select("c", "label", F.least("new", "jump").alias("new"))
        spread = stage(spread, "labels")
        release(last)
        last = spread
        changed = spread.where("label <> new").limit(1).count()
        labels = spread.select("c", F.col("new").alias("label"))
        if not changed:
            release(both)
            return labels


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: ``key``, n_shingles, component_id; label, the component itself; k1, k2, the text's key.

    ``component_id`` is the smallest key reachable by links, its own included. NULL, empty
    and blank texts have no n-grams, link with nothing and are their own component; rows
    that repeat a key or a text stay, and equal sets are always linked; a NULL key is
    never a component's id unless all its keys are. The key is an integer.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    keyed = docs.select("id", *content_key(F.col("text")), "text")
    with small_batches(spark):
        seen = stage(keyed.mapInPandas(survey(width), "id long, k1 long, k2 long, n int, c binary, token long, seen long"), "survey")
    rows = seen.where("seen = 0").select("id", "k1", "k2", "n", "c")
    reps = stage(rows.where("c is not null").groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    common = seen.where("seen > 0").groupBy("token").agg(F.sum("seen").alias("seen"))
    common = common.orderBy(F.desc("seen"), "token").limit(MOST_COMMON).toPandas()  # order only, bounded
    order = spark.sparkContext.broadcast(Order.of(common["token"].to_numpy(np.int64).view(np.uint64), common["seen"].to_numpy(np.int64)))

    with small_batches(spark):
        parts = stage(docs.select("text").mapInPandas(
            prefixes(order, width, percent), "c binary, g long, n int, bits array<bigint>, long array<bigint>, token long, common boolean"), "prefixes")
    members = parts.where("c is not null").select("c", "g", "n", "bits", "long").dropDuplicates(["c"])
    posts = parts.where("c is null").select("token", "g", "common")
    # n-grams known as common are shared, so only the rare ones need to be counted: no long list is gathered;
    # the many n-grams that only the same two groups share become one list
    w = Window.partitionBy("token")
    rare = posts.where("not common").select("token", "g", F.min("g").over(w).alias("lo"), F.max("g").over(w).alias("hi"), F.count("*").over(w).alias("k"))
    rare = rare.where("lo <> hi").select(F.when(F.col("k") == 2, F.xxhash64("lo", "hi")).otherwise(F.col("token")).alias("token"), "g")
    shared = rare.union(posts.where("common").select("token", "g")).distinct()
    members = stage(members.join(reps, "c"), "members")
    inside = members.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.col("g").alias("token"), "g")  # of one group
    gathered = stage(shared.union(inside).join(members.select("g", "c", "n", "copies"), "g").select("token", "c", "n", "copies"), "lists")
    release(parts)
    share = stage(gathered.groupBy("c").agg((F.count("*") / F.max("n")).alias("share")), "share")

    lists = stage(gathered.join(share, "c").withColumn("band", F.floor(F.log("n") / np.log(100 / percent)).cast("int")), "lists")
    release(gathered, share)
    hubs = lists.groupBy("token", "band").agg(F.max(F.struct("copies", "share", "c", "n")).alias("hub"))
    first = lists.join(hubs, ["token", "band"]).where((F.col("c") != F.col("hub.c")) & sizes_may(F.col("n"), F.col("hub.n"), percent))
    first = stage(first.select(F.col("c").alias("a"), F.col("hub.c").alias("b")).distinct(), "pairs")
    links = verified(first, members, docs, width, percent)

    labelled = lists.select("token", "c").join(components(links), "c", "left").withColumn("label", F.coalesce("label", "c"))
    labelled = stage(labelled, "parted")
    release(lists)
    counts = labelled.groupBy("token", "label").agg(F.count("*").alias("k"))
    major = counts.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("labels"))
    major = stage(major.where("labels > 1").select("token", "major"), "major")
    parted = stage(labelled.join(major, "token").join(members.select("c", "n", "bits"), "c"), "parted")
    release(labelled, major)
    m, o = parted.where("label <> major").alias("m"), parted.alias("o")
    second = m.join(o, (F.col("m.token") == F.col("o.token")) & (F.col("m.label") != F.col("o.label"))
                    & ((F.col("o.label") == F.col("o.major")) | (F.col("m.c") < F.col("o.c")))
                    & sizes_may(F.col("m.n"), F.col("o.n"), percent)
                    & bits_may(short_odd(F.col("m.bits"), F.col("o.bits")), F.col("m.n"), F.col("o.n"), percent))
    second = second.select(F.least("m.c", "o.c").alias("a"), F.greatest("m.c", "o.c").alias("b")).distinct()
    met = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = stage(second.join(met, ["a", "b"], "left_anti"), "pairs")
    release(parted, first)
    links = links.union(verified(second, members, docs, width, percent))
    release(members, second)

    named = reps.join(components(links), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = stage(named.join(least, "label").select("c", "component_id", "label"), "components")
    out = rows.join(named, "c", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "label", "k1", "k2")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest key.

    Documents without n-grams all stay. Rows with a NULL key stay only if their component
    has no other; of rows that repeat the smallest key one stays.
    """
    found = classes(docs, key=key, text=text, **how).where("label is not null")
    found = stage(found.select(F.col(key).alias("_id"), "component_id", "label", "k1", "k2"), "found")
    own = F.col("_id").eqNullSafe(F.col("component_id"))
    first = found.where(own).groupBy("label", "_id").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n"))
    again = stage(first.where("n > 1"), "again")  # where the smallest key is repeated: usually nowhere
    other = found.where(own).join(again.select("label", "k"), "label").where("k1 <> k.k1 OR k2 <> k.k2")
    gone = found.where(~own).select("_id", "k1", "k2").union(other.select("_id", "k1", "k2")).distinct()
    gone = bounded(stage(gone, "gone"), MOST_BROADCAST)
    k1, k2 = content_key(F.col(text))

    def of(other: DataFrame) -> Column:
        return docs[key].eqNullSafe(other["_id"]) & k1.eqNullSafe(other["k1"]) & k2.eqNullSafe(other["k2"])

    rest = docs.join(gone, of(gone), "left_anti")
    if not again.limit(1).count():
        return rest
    few = bounded(again.select("_id", "k.k1", "k.k2"), MOST_BROADCAST)
    once = docs.join(few, of(few), "left_semi").dropDuplicates([key, text])
    return rest.join(few, of(few), "left_anti").unionByName(once)
