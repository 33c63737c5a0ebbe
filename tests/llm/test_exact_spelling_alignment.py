"""Digest index, trie frontier and tokenizer alignment against brute force, odd inputs included."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from velum.llm import alignment, exact, spelling

DOCS = "doc_id long, text string, digest string, keep string, n string, word string, row string, pair string"


def table(spark, rows):
    """Documents with further columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], DOCS)


# ---- exact duplicates ----------------------------------------------------------

ODD = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 300_000), (6, "b" * 300_000), (7, "A"), (8, "a "), (9, "é"), (9, "é"), (None, "a"), (None, "only"), (None, "only")]


def expected_copies(loads):
    keep, size = {}, collections.Counter()
    for rows in loads:
        best = {}
        for i, t in rows:
            size[t or ""] += 1
            best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
        for t, i in best.items():
            keep.setdefault(t, None if i == -1 else i)
    return keep, size


@pytest.mark.parametrize("cut", [0, 4, 9, 13])
def test_exact_dedup(spark, cut):
    loads = [ODD[:cut], ODD[cut:]]
    index = exact.open_index(spark, buckets=3)
    got = exact.deduplicate([(f"l{k}", table(spark, r)) for k, r in enumerate(loads)], index).collect()
    keep, size = expected_copies(loads)
    assert len(got) == len(ODD)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in keep}
    kept = collections.Counter()
    for r in got:
        t = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep[t], size[t])
        kept[t] += r.kept
        assert not r.kept or r.doc_id == keep[t]
    assert set(kept.values()) == {1}, "one row of each text stays, of repeated rows too"


def test_exact_index_lives_on(spark, tmp_path):
    """Opened again elsewhere, compacted, and a load run twice."""
    path = str(tmp_path / "index")
    index = exact.open_index(spark, path, buckets=4)
    first, second = table(spark, [(1, "x"), (2, "y"), (2, "y")]), table(spark, [(10, "y"), (11, "z"), (12, "z"), (12, "z")])
    assert sorted(r.doc_id for r in exact.keep_new(first, index, "one").collect()) == [1, 2]
    for name in ("two", "two"):
        again = exact.open_index(spark, path, buckets=4)
        new = exact.keep_new(second, again, name)
        assert new.columns == second.columns and [r.doc_id for r in new.collect()] == [12]
    small = exact.compact(again)
    assert sorted((r.keep, r.n) for r in small.rows().collect()) == [(1, 1), (2, 3), (12, 3)]
    assert [r.doc_id for r in exact.keep_new(table(spark, [(5, "z"), (6, "w")]), small, "three").collect()] == [6]
    assert exact.deduplicate([("none", table(spark, []))], small).count() == 0
    plan = index.rows().select("digest").join(small.rows().select("digest").hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, "two indexes are merged bucket by bucket"


def test_exact_dedup_of_a_hot_text(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.deduplicate([("all", rows)], exact.open_index(spark))
    assert got.where("kept").count() == 6001
    assert got.where("group_size = 3000 AND keep_id = 8997").count() == 3000


# ---- spelling variants -----------------------------------------------------------


def brute_variants(rows, damage=None, least_length=6, least_count=5, ratio=5):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate({k: k + 32 for k in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(others)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], form[w] and n[form[w]], out[w]) for w in n)


def variants(spark, rows, **how):
    got = spelling.variants(table(spark, rows), **how)
    return sorted((r.word, r.form, r.root, r.n, r.form_n, r.n_near) for r in got.select("word", "form", "root", "n", "form_n", "n_near").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    """Words over few letters, so that they lie close, nest, and end inside one another; every near pair is found once."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.choice([2, 3, 4, 5]))) for _ in range(60)]
    words += ["abcdefgh" * 9 + "x", "abcdefgh" * 9 + "y", "abcdefgh" * 4 + "bcdefgh" + "abcdefgh" * 4 + "x", "×÷×÷×÷", "×÷×÷×"]
    rows = [(i, rng.choice([" ", "-", "1"]).join(rng.choices(words, weights=[1 + k % 7 for k in range(len(words))], k=30))) for i in range(40)]
    rows += [(None, "ab ABa aBB"), (100, None), (101, ""), (102, "aba " * 50), (102, "aba " * 50)]
    for damage in (None, 7):
        want = brute_variants(rows, damage, least_length=2, least_count=2, ratio=2)
        assert variants(spark, rows, damage=damage, least_length=2, least_count=2, ratio=2) == want
        assert sum(w[5] for w in want) > 100


def test_spelling_chain_and_ties(spark):
    counts = {"letters": 125, "lettera": 25, "letterab": 5, "lettersx": 5, "lettersy": 5, "zzzzzz": 5, "short": 99, "rarest": 4}
    rows = [(1, " ".join(w for w, k in counts.items() for _ in range(k)))]
    got = variants(spark, rows)
    assert got == brute_variants(rows)
    assert ("letterab", "lettera", "letters", 5, 25, 1) in got and ("zzzzzz", None, "zzzzzz", 5, None, 0) in got
    assert variants(spark, []) == []
    trie = spelling.edges(spelling.vocabulary(spark.createDataFrame([("abcdef",)] * 5 + [("abcxyz",)] * 5, "word string")))
    assert sorted((r.node, r.label, r.ends) for r in trie.collect()) == [("", "abc", None), ("abc", "def", "abcdef"), ("abc", "xyz", "abcxyz")]


# ---- alignment of tokenizers --------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "The quick brown fox, the lazy dog."), (2, None), (3, ""), (4, "a <s> b <|endoftext|> </s> <unk>"), (5, "  two  spaces ▁ ▁x "),
    (6, "日本語 \U0001F600 é ﬁ"), (7, "line\nline\r\n\ttab end "), (8, "The quick brown fox"), (8, "The quick brown fox"), (None, "the dog"),
    (9, "word " * 3000 + "end"), (10, "x" * 20_000), (11, " "), (12, "\n"), (13, "a b  c"), (14, "<0x41> ▁ \x00 \x1c y"),
]


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(A)
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = alignment.byte_of_char()
    parts = []
    for i, t in rows:
        want = (" " + t).encode() if t else b""
        a = tk.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(byte[c] for c in tk.id_to_token(k)) for k in a]
        pieces = map(sp.id_to_piece, b)
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (list(np.cumsum([len(x) for x in v])) for v in (bytes_a, bytes_b))
        common = [e for e in ends_a if e in set(ends_b)]
        groups, links, x, y = [], [], 0, 0
        for e in common:
            p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(f"{','.join(map(str, a[x:p]))}|{','.join(map(str, b[y:q]))}")
            links.append((a[p - 1], b[q - 1]))
            x, y = p, q
        parts.append((i, len(a), len(b), links, ";".join(groups)))
    count = collections.Counter(link for p in parts for link in p[3])
    top = collections.Counter()
    for (_, b), k in count.items():
        top[b] = max(top[b], k)
    return sorted(
        ((-1 if i is None else i), n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if n_a else "")
        for i, n_a, n_b, links, g in parts
    )


@pytest.mark.parametrize("most_broadcast", [alignment.MOST_BROADCAST, 0])
def test_alignment(spark, most_broadcast):
    got = alignment.align(table(spark, TEXTS).repartition(3), A, B, most_broadcast=most_broadcast)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted((-1 if r.doc_id is None else r.doc_id, *(r[n] for n in names)) for r in got.collect())
    assert rows == brute_alignment(TEXTS)
    assert alignment.align(table(spark, []), A, B, most_broadcast=most_broadcast).count() == 0


def test_words_forgotten_give_the_same(monkeypatch):
    """A worker that keeps few words, and one that keeps none, align texts as whole texts are aligned."""
    sides = [alignment.Side(alignment.loaded(p, open(p, "rb").read()), c) for p, c in ((A, "|"), (B, ";"))]
    assert alignment.splits_words(sides[0].made, sides[1].made)
    texts = [t for _, t in TEXTS if t]
    words = alignment.Words(*sides)
    split, whole = (alignment.aligned_texts(texts, words, way, []) for way in (True, False))
    assert (split[0] == whole[0]).all() and split[1] == whole[1] and (split[2] == whole[2]).all()


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        short, long = (np.unique(rng.integers(0, rng.choice([5, 50, 5000]), rng.integers(0, 60))) for _ in range(2))
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()
        a, b = alignment.meeting(short, long)
        assert (short[a] == np.intersect1d(short, long)).all() and (long[b] == short[a]).all()


def test_first_of_equal_url_rules(spark):
    from velum.llm import urls

    rules = [("allow", "a.org", "/"), ("block", "a.org", "/"), ("block", "b.org", "/"), ("allow", "b.org", "/")]
    rows = spark.createDataFrame([("a.org", "/x"), ("b.org", "/"), ("c.org", "/")], "host string, path string")
    got = rows.select("host", urls.rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("v")).collect()
    assert {r.host: r.v for r in got} == {"a.org": "allow", "b.org": "block", "c.org": None}
