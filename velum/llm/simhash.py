"""Document fingerprints (SimHash) and search within a Hamming radius. Native throughout.

The terms of a text are its runs of up to five words, one ending at each word, so a term
weighs as often as it occurs. Every term's hash votes on every bit with its sign; the
fingerprint is the sign of the sums. Votes are added two bits at a time, in the halves of
a long.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.llm.common import bounded, content_key, stage

#: Words of a term; bits of a fingerprint (a multiple of 64).
WORDS = 5
BITS = 128
#: The lowest bit of either half of a long: votes of two bits are added at a time, room for 2^32 terms.
LANES = 0x0000000100000001
#: Of ``BITS``, what texts with a Jaccard similarity of 0.8 differ in at most but for about one pair in a hundred (19 bits expected, deviation 4).
RADIUS = 28
#: Radius up to which block tables have selective keys; beyond it fingerprints are compared in pairs.
NARROW = 6
#: Fingerprints asked for that are broadcast at most.
MOST_BROADCAST = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, r"\s+"), ""), lambda w: F.xxhash64(w))


def fingerprints(texts: DataFrame, keys: list[str], text: str, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """``keys`` and ``fp``, an array of ``bits`` / 64 longs, one row per key.

    Rows of one key must hold one text. Texts without words, NULL ones too, get no votes,
    so all their bits are 0.
    """
    n = bits // 64
    rows = texts.select(*keys, word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    size = F.size("_h")
    # the word at each place with the words before it; before the first there is nothing
    shifted = [F.col("_h").alias("h0")] + [
        F.slice(F.concat(F.array_repeat(F.lit(None).cast("long"), i), F.col("_h")), F.lit(1), size).alias(f"h{i}")
        for i in range(1, words)
    ]
    rows = rows.select(*keys, F.explode_outer(F.arrays_zip(*shifted)).alias("_z"))
    term = F.when(F.col("_z").isNotNull(), F.xxhash64(*[F.col(f"_z.h{i}") for i in range(words)]))
    rows = rows.select(*keys, term.alias("_t0"))
    rows = rows.select(*keys, "_t0", *[F.when(F.col("_t0").isNotNull(), F.xxhash64("_t0", F.lit(i))).alias(f"_t{i}") for i in range(1, n)])
    votes = [
        F.sum(F.shiftrightunsigned(F.col(f"_t{i}"), b).bitwiseAND(F.lit(LANES))).alias(f"_v{i}_{b}")
        for i in range(n) for b in range(32)
    ]
    rows = rows.groupBy(*keys).agg(F.count("_t0").alias("_n"), *votes)

    def word(i: int) -> Column:
        out = []
        for b in range(32):
            v = F.col(f"_v{i}_{b}")
            for lane, count in enumerate((v.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(v, 32))):
                bit = 1 << (b + 32 * lane)
                bit = bit - (1 << 64) if bit >= 1 << 63 else bit
                out.append(F.when(2 * count > F.col("_n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda x, y: x.bitwiseOR(y), out)

    return rows.select(*keys, F.array(*[word(i) for i in range(n)]).alias("fp"))


def text_of(fp: Column, bits: int = BITS) -> Column:
    """A fingerprint as lowercase hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(fp[i]), 16, "0") for i in range(bits // 64)]))


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    """Bits in which two fingerprints differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)])


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    return 1 - distance(a, b, bits) / F.lit(float(bits))


def blocks(fp: Column, count: int, bits: int = BITS) -> list[Column]:
    """``count`` runs of bits that make up the fingerprint, each as a long below 2^32."""
    edges = [round(i * bits / count) for i in range(count + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        value, have = F.lit(0).cast("long"), 0
        while lo < hi:
            i, off = divmod(lo, 64)
            take = min(hi - lo, 64 - off)
            part = F.shiftrightunsigned(fp[i], off)
            if take < 64:
                part = part.bitwiseAND(F.lit((1 << take) - 1))
            value = value.bitwiseOR(F.shiftleft(part, have))
            have, lo = have + take, lo + take
        out.append(value)
    return out


def table_keys(fp: Column, radius: int, extra: int = 2, bits: int = BITS) -> Column:
    """One key per permuted table: ``extra`` of ``radius + extra`` blocks lead in each.

    Fingerprints within ``radius`` differ in at most ``radius`` blocks, so they agree on
    the leading blocks of at least one table.
    """
    parts = blocks(fp, radius + extra, bits)
    return F.array(*[
        F.xxhash64(F.lit(t), *[parts[i] for i in lead]) for t, lead in enumerate(combinations(range(radius + extra), extra))
    ])


def within(queries: DataFrame, fps: DataFrame, radius: int, bits: int = BITS) -> DataFrame:
    """(query, fp, distance): every fingerprint of ``fps`` (fp) within ``radius`` of one of ``queries`` (fp).

    Both sides are reduced to distinct fingerprints first, so copies are not multiplied. No
    pair is missed: a small radius is searched by block tables; for a wide one, where no
    block need agree, each of ``fps`` is compared with every query where it is.
    """
    if radius > NARROW:
        words = range(bits // 64)
        q = stage(queries.select("fp").distinct().select(F.col("fp").alias("query"), *[F.col("fp")[i].alias(f"_q{i}") for i in words]), "asked")
        parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        d = fps.select("fp").distinct().repartition(parts, "fp").select("fp", *[F.col("fp")[i].alias(f"_d{i}") for i in words])
        far = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"_q{i}").bitwiseXOR(F.col(f"_d{i}"))) for i in words])
        return d.join(bounded(q, MOST_BROADCAST), far <= radius).select("query", "fp", far.alias("distance"))
    q = queries.select("fp").distinct().select(F.col("fp").alias("query"), F.explode_outer(table_keys(F.col("fp"), radius, 2, bits)).alias("key"))
    d = fps.select("fp").distinct().select("fp", F.explode_outer(table_keys(F.col("fp"), radius, 2, bits)).alias("key"))
    far = distance(F.col("query"), F.col("fp"), bits)
    return d.join(q, "key").where(far <= radius).select("query", "fp", far.alias("distance")).distinct()


def in_order(rows: DataFrame, key: str, same: list[str], carry: list[str]) -> DataFrame:
    """``rows`` with ``next_*`` of the row that follows by descending ``key``; after the last: the first.

    Rows are dealt by ranges of the key to many tasks; what follows the last row of a
    range is the first of the next one, from a table of one row per range.
    """
    spark = rows.sparkSession
    parts = min(512, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("_missing", F.col(key).isNull())
    first = [F.col("_missing"), F.col(key).desc_nulls_last(), *same]
    cuts = rows.where("not _missing").select(F.percentile_approx(F.col(key), [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []
    number = F.lit(len(set(cuts)))
    for n, cut in enumerate(sorted(set(cuts))):  # a count of the cuts below; the largest keys come first
        number = number - (F.col(key) > F.lit(cut)).cast("int")
    rows = rows.withColumn("_range", F.when(F.col("_missing"), len(set(cuts)) + 1).otherwise(number))
    w = Window.partitionBy("_range").orderBy(*first)
    nexts = [F.lead(c).over(w).alias(f"_next_{c}") for c in carry]
    rows = stage(rows.select("*", F.lead(F.lit(True)).over(w).alias("_has"), *nexts), "ordered")
    heads = rows.groupBy("_range").agg(F.min_by(F.struct(*carry), F.struct((-F.col(key)).alias("_o"), *same)).alias("_head"))
    heads = stage(heads, "heads")  # one row per range
    order = [r[0] for r in heads.select("_range").orderBy("_range").collect()]
    pairs = {a: b for a, b in zip(order, order[1:] + order[:1])}
    if not pairs:
        return rows.select(*[c for c in rows.columns if not c.startswith("_next_") and c not in ("_missing", "_range", "_has")],
                           *[F.col(f"_next_{c}").alias(f"next_{c}") for c in carry])
    after = spark.createDataFrame(list(pairs.items()), "_range int, _after int")
    heads = after.join(heads.select(F.col("_range").alias("_after"), "_head"), "_after").select("_range", "_head")
    rows = rows.join(F.broadcast(heads), "_range")
    out = [F.when(F.col("_has"), F.col(f"_next_{c}")).otherwise(F.col(f"_head.{c}")).alias(f"next_{c}") for c in carry]
    own = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*own, *out)


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document row: ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, fp (the fingerprint as longs). The key is an integer.

    The edited text is the text with its last third replaced by as many characters from
    the start of the next document by descending key. NULL texts count as empty; keys that
    are NULL come last; documents of one key are ordered by the hash of their text, and
    rows that repeat key and text share one place in the order and one result; a single
    document is its own next. An empty text has the fingerprint of no votes.
    """
    base = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.select("id", *content_key(F.col("text")), F.length("text").cast("long").alias("n"), "text")
    places = in_order(base.groupBy("id", "k1", "k2", "n").agg(F.count("*").alias("repeats")), "id", ["k1", "k2"], ["id", "k1", "k2"])
    places = stage(places, "places")
    texts = base.select("id", "k1", "k2", "text")
    wanted = places.select(F.col("next_id").alias("id"), F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"),
                           F.col("id").alias("own_id"), F.col("k1").alias("own_k1"), F.col("k2").alias("own_k2"),
                           F.expr("n div 3").alias("third"))
    t, w = texts.alias("t"), wanted.alias("w")
    heads = t.join(w, same_on("t", "w")).select(F.col("own_id").alias("id"), F.col("own_k1").alias("k1"), F.col("own_k2").alias("k2"),
                                                F.expr("substring(t.text, 1, cast(third as int))").alias("head"))
    if places.where("repeats > 1").limit(1).count():  # rows that repeat would bring their start more than once
        heads = heads.dropDuplicates(["id", "k1", "k2"])
    h = heads.alias("h")
    size = F.length("t.text")
    edited = F.concat(F.expr("substring(t.text, 1, length(t.text) - length(t.text) div 3)"), F.col("h.head"))
    both = t.join(h, same_on("t", "h")).select("t.id", "t.k1", "t.k2", F.col("t.text").alias("text"), edited.alias("edited"))
    sides = both.select("id", "k1", "k2", F.explode_outer(F.array(
        F.struct(F.lit(0).alias("side"), F.lit(None).cast("binary").alias("sha"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("side"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("edited").alias("text")))).alias("s"))
    sides = sides.select("id", "k1", "k2", "s.side", "s.sha", F.col("s.text").alias("text"))
    fps = stage(fingerprints(sides, ["id", "k1", "k2", "side", "sha"], "text", bits), "fingerprints")
    own = fps.where("side = 0").select("id", "k1", "k2", "fp")
    edits = fps.where("side = 1").select("id", "k1", "k2", "sha", F.col("fp").alias("edited_fp"))
    p = places.alias("p")
    rows = p.join(own.alias("o"), same_on("p", "o")).join(edits.alias("e"), same_on("p", "e"))
    rows = rows.join(own.alias("x"), (F.col("p.next_k1") == F.col("x.k1")) & (F.col("p.next_k2") == F.col("x.k2")) & F.col("p.next_id").eqNullSafe(F.col("x.id")))
    fp, efp, nfp = F.col("o.fp"), F.col("e.edited_fp"), F.col("x.fp")
    return rows.select(
        F.col("p.id").alias(key), F.col("p.n").alias("n_chars"), F.lower(F.hex("e.sha")).alias("edited_sha256"),
        text_of(fp, bits).alias("fingerprint"), text_of(efp, bits).alias("edited_fingerprint"),
        likeness(fp, efp, bits).alias("near_edited"), likeness(fp, nfp, bits).alias("near_next"), fp.alias("fp"), F.explode(F.sequence(F.lit(1), F.col("p.repeats").cast("int"))),
    ).drop("col")


def same_on(a: str, b: str) -> Column:
    return (F.col(f"{a}.k1") == F.col(f"{b}.k1")) & (F.col(f"{a}.k2") == F.col(f"{b}.k2")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))


def with_near_counts(rows: DataFrame, asked: Column, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """``rows`` (fp) with near_count: how many other rows have a fingerprint within ``radius``; NULL where not ``asked``."""
    rows = stage(rows, "fingerprinted")
    sizes = stage(rows.groupBy("fp").agg(F.count("*").alias("_rows"), F.max(F.coalesce(asked, F.lit(False))).alias("_asked")), "sizes")
    near = within(sizes.where("_asked"), sizes, radius, bits).join(sizes.select("fp", "_rows"), "fp")
    near = near.groupBy(F.col("query").alias("fp")).agg((F.sum("_rows") - 1).alias("_near"))
    return rows.join(near, "fp", "left").withColumn("near_count", F.when(asked, F.col("_near"))).drop("_near")
