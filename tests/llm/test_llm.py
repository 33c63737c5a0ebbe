"""Operators of velum.llm on small rows: brute force, held-out accuracy, and odd input."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from velum.llm import decontaminate, licences, mixing, ngram_join, pages, quality, simhash, tokens, toxicity, urls

DOCS = "doc_id long, text string, k1 string, label string, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0, str(r)))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"w{i % 9000}" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven", "x", "y", 0), (1, "One two three four five six seven", "x", "y", 0),
        (2, None, None, None, None), (3, "", "", "", 0), (4, "  \n\t ", "", "", 0), (5, long, "x", "", 1), (6, long, "x", "", 1),
        (7, "É ÀB zz", "x", "", 2), (None, "no id here at all", "x", "", 2), (8, "a", "", "", 0), (8, "another text of eight", "", "", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# main text -----------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("a &lt;b&gt; &amp;\xa0c", "a <b> & c"),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p><b>un<i>closed<br><p>Second</article><footer>f</footer>", "T unclosed Second"),
    ("<body><div class='ad'>Buy now</div><article><h1>A</h1><p>Text text</p><form>Sign <input></form><aside>x</aside></article>", "A Text text"),
    ("<article><p>Real text here</p><section class=comments><article class=comment><p>first!! first!! first!!</p></article></section></article>", "Real text here"),
    ("<div id=page><ul><li><a href=a>a</a><li><a href=b>b</a><li><a href=c>c</a></ul><div class=story><h2>Head &amp; tail</h2>"
     "<p>One long paragraph of text.</p><p>Another long one here.</p></div></div>", "Head & tail One long paragraph of text. Another long one here."),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- no --></p>", "yes"),
    ("<header class=site>Logo</header><main><p>body of text</p></main><div class=cookie-notice><p>" + "We use cookies. " * 50 + "</p></div>", "body of text"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(df, "html", "page_id").collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == (want, len(want)), PAGES[i]
    assert pages.extract(df.limit(0), "html", "page_id").count() == 0


def test_bare_text_beside_blocks():
    """Runs of text between blocks belong to the article as blocks of their length do; runs of links do not."""
    long = "A sentence of the article that has some length. " * 6
    box = f"<div><p>{long}</p><p>{long}</p></div>"
    both = f"{long}{long}".strip()
    assert pages.main_text("<body>Intro text.<br>More text.<div><p>long</p><p>long</p></div></body>") == "Intro text. More text. long long"
    intro = "The intro of the page stands bare in its body, <b>before</b> any box. " * 4
    plain = intro.replace("<b>", "").replace("</b>", "").strip()
    for page in (f"<body>{intro}{box}</body>", f"<div id=page><div class=x><a href=1>Home</a> <a href=2>All</a></div>{intro}{box}</div>"):
        assert pages.main_text(page) == f"{plain} {both}", page
    assert pages.main_text(f"<body>{box}{intro}<p>{long}</p>{intro}</body>") == f"{both} {plain} {long.strip()} {plain}"
    many = f"<div>{f'<p>{long}</p>' * 30}</div>"  # a run as long as the paragraphs of a large box
    assert pages.main_text(f"<body>{long}{many}</body>") == (long * 31).strip()
    assert pages.main_text(f"<body><a href=1>Home</a> | <a href=2>All</a>{box}</body>") == both


def test_deep_and_broken_pages():
    assert pages.main_text("<div>" * 5000 + "x" + "</p>" * 10) == "x"
    assert pages.main_text('<p title="a > b" class="x>y">in</p><a href="unclosed>tail') == "in tail"


# token counts --------------------------------------------------------------------------------------------------------


def test_token_counts(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = tokens.fresh_cache(spark)
    library = Tokenizer.from_file(path)
    for _ in range(2):  # the second time from the cache
        for r in tokens.count_tokens(odd, path, cache, limit=5).collect():
            texts = {x.text or "" for x in odd.collect() if x.doc_id == r.doc_id}
            assert (r.n_bytes, r.n_tokens) in {(len(t.encode()), len(library.encode(t, add_special_tokens=False))) for t in texts}
            assert r.over_limit == (r.n_tokens > 5)
    stored = tokens.read_cache(spark, cache)
    assert stored.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert tokens.count_tokens(empty, path, tokens.fresh_cache(spark)).count() == 0


def test_split_counter_is_the_library():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        count = tokens.counter("byte_bpe_50k.json", f.read())
    parts = ["a", "B ", " ", "  ", "\n", "<|endoftext|>", "'s", " re", "é", "1", "!", " \n", "\t", "\xa0", "中", " \u0301", "d."]
    draw = random.Random(3)
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(5000)]
    assert count(texts) == count.whole(texts)


# fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, empty):
    got = rows_of(simhash.fingerprint_edits(odd))
    assert len(got) == odd.count()
    docs = sorted({(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id not in (8, None)}, reverse=True)
    for (key, text), (_, after) in zip(docs[:-1], docs[1:]):
        if 8 in (key, key - 1):
            continue
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        for r in got:
            if r["doc_id"] == key:
                assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
    by = {r["doc_id"]: r for r in got}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[2]["fingerprint"] == by[3]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert simhash.fingerprint_edits(empty).count() == 0
    one = rows_of(simhash.fingerprint_edits(spark.createDataFrame([(9, "one two three")], "doc_id long, text string")))
    assert one[0]["near_next"] == 1.0


def test_votes_by_hand(spark):
    """Sums over packed lanes are the plain ones."""
    text = " ".join(random.Random(5).choices([f"w{i}" for i in range(40)], k=500))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    fp = simhash.fingerprints(df, ["k"], "text", 64).first()["fp"][0] & (2**64 - 1)
    h = [r[0] for r in df.select(F.explode(simhash.word_hashes(F.col("text")))).collect()]
    runs = [([None] * 5 + h)[i + 1 : i + 6][::-1] for i in range(len(h))]
    terms = spark.createDataFrame(runs, "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e")).collect()
    votes = [sum(1 if (t[0] >> b) & 1 else -1 for t in terms) for b in range(64)]
    assert fp == sum(1 << b for b in range(64) if votes[b] > 0)


def test_search_within_radius(spark):
    draw = random.Random(1)
    fps = [draw.getrandbits(128) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in draw.sample(range(128), draw.randint(0, 5))) for f in fps for _ in range(4)]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    df = spark.createDataFrame([([signed(f & (2**64 - 1)), signed(f >> 64)],) for f in fps], "fp array<long>")
    want = sum((a ^ b).bit_count() <= 3 for a in set(fps) for b in set(fps))
    assert simhash.within(df, df, 3).count() == want
    counts = simhash.with_near_counts(df, F.lit(True), 3).select("fp", "near_count").collect()
    for r in counts[:30]:
        f = (r.fp[0] & (2**64 - 1)) | ((r.fp[1] & (2**64 - 1)) << 64)
        assert r.near_count == sum((f ^ g).bit_count() <= 3 for g in fps) - 1


def test_near_copies_are_found(spark):
    """Recall against brute force on five-word runs: planted copies at a similarity of 0.8 or more."""
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, pairs = [], []
    for _ in range(120):
        base = draw.choices(vocabulary, k=draw.choice([60, 100, 300, 800]))
        texts.append(base)
        at = len(texts) - 1
        for share in (0.002, 0.01, 0.02):
            w = list(base)
            for _ in range(max(1, round(share * len(w)))):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            texts.append(w)
            pairs.append((at, len(texts) - 1))

    def runs(w):
        return {tuple(([None] * 4 + w)[i : i + 5]) for i in range(len(w))}

    sets = [runs(w) for w in texts]
    alike = {(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    fps = simhash.fingerprints(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "k long, text string"), ["k"], "text")
    fps = simhash.stage(fps, "test-fps")
    of = {tuple(r.fp): r.k for r in fps.collect()}
    asked = fps.where(F.col("k") % 4 == 0)
    hits = simhash.within(asked, fps, simhash.RADIUS).collect()
    found = {(of[tuple(r.query)], of[tuple(r.fp)]) for r in hits}
    assert len(alike) > 200 and len(alike & found) >= 0.97 * len(alike)
    assert all(a // 4 == b // 4 for a, b in found)  # nothing unlike is counted
    value = {k: sum((x & (2**64 - 1)) << (64 * i) for i, x in enumerate(f)) for f, k in of.items()}
    assert found == {(a, b) for a in value if a % 4 == 0 for b in value if (value[a] ^ value[b]).bit_count() <= simhash.RADIUS}  # exact for the radius
    counts = {r.k: r.near_count for r in simhash.with_near_counts(fps, F.col("k") % 4 == 0).collect()}
    assert all(counts[k] == (sum(a == k for a, _ in found) - 1 if k % 4 == 0 else None) for k in counts)


# quality and toxicity ------------------------------------------------------------------------------------------------

ROOT = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{ROOT}/labels.parquet")


def test_quality_on_held_out(spark, labelled, odd, empty):
    docs, labels = labelled
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, labels.where(~out))
    got = quality.score(docs, model).join(labels.where(out), "doc_id").select("quality", "score", "predicted").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 1].predicted.mean() > 0.97
    assert 1 - got[got.quality == 0].predicted.mean() > 0.88
    mine = rows_of(quality.score(odd, model))
    assert len(mine) == odd.count() and all(0 <= r["score"] <= 1 for r in mine)
    assert mine[0]["score"] == mine[1]["score"] and mine[2]["score"] == mine[3]["score"]  # a repeated row; NULL and empty
    assert quality.score(empty, model).count() == 0
    kept = quality.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in mine)


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {0.0}
    disputed = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, disputed)).collect()} == {0.5}


def test_toxicity_on_held_out(spark, labelled, odd, empty):
    docs, labels = labelled
    out = quality.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels.where(~out))
    got = toxicity.score(docs, model).join(labels.where(out), "doc_id").select("quality", "toxic", "predicted").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98
    assert got[(got.toxic == 1) & (got.quality == 1)].predicted.mean() > 0.97
    assert got[got.toxic == 0].predicted.mean() < 0.01
    mine = rows_of(toxicity.score(odd, model))
    assert len(mine) == odd.count() and mine[0] == mine[1] and all(0 <= r["score"] <= 1 for r in mine)
    assert toxicity.reject(odd, model).count() == sum(1 - r["predicted"] for r in mine)
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_with_few_labels(spark, labelled):
    """Six toxic texts are dealt over the folds and learned from; with one the score is a constant."""
    docs, labels = labelled
    toxic = labels.where("toxic = 1 AND quality = 1").orderBy("doc_id").limit(6)
    few = labels.where("toxic = 0").orderBy("doc_id").limit(394).unionByName(toxic)
    model = toxicity.fit(docs, few)
    assert model.trees is not None
    got = toxicity.score(docs, model).join(few, "doc_id").select("toxic", "predicted", "score").toPandas()
    assert got[got.toxic == 1].score.mean() > 1.5 * got[got.toxic == 0].score.mean()
    assert got[got.toxic == 0].predicted.mean() < 0.02
    one = toxicity.fit(docs, few.where("toxic = 0").unionByName(toxic.limit(1)))
    assert one.trees is None and abs(one.share - 1 / 395) < 1e-9


# mixing --------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, labelled, odd, empty):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").where("doc_id < 2000")
    model = mixing.fit_domains(docs, labelled[1])
    got = mixing.mix(docs, model, {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}).cache()
    total = got.agg(F.sum("n_tokens")).first()[0]
    by = {r["domain"]: r for r in got.groupBy("domain").agg(
        (F.sum(F.col("rate") * F.col("n_tokens")) / total).alias("share"), (F.sum(F.col("copies") * F.col("n_tokens")) / total).alias("drawn")).collect()}
    for d, want in {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}.items():
        assert abs(by[d]["share"] - want) < 0.02 and abs(by[d]["drawn"] - want) < 0.06
    assert got.where("rate < 0").count() == 0
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("n_tokens > 20")
    assert right.where("domain = lang").count() > 0.97 * right.count()
    assert len(rows_of(mixing.mix(odd, model, {"en": 1.0}))) == odd.count()
    assert mixing.mix(empty, model, {"en": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, model, {"xx": 1.0})
    none = mixing.fit_domains(empty.withColumn("lang", F.lit("en")), labelled[1])
    assert none.domains == [None]
    got = rows_of(mixing.mix(odd, none, {None: 1.0}))
    assert len(got) == odd.count() and {r["domain"] for r in got} == {None}


def test_rare_and_many_domains(spark, monkeypatch):
    """Domains and prior come from all labelled documents, not from the draw; small ones beyond the limit are one."""
    words = {d: [f"{d}{i}" for i in range(30)] for d in "abcde"}
    sizes = {"a": 400, "b": 300, "c": 3, "d": 2, "e": 1}
    draw = random.Random(5)
    rows = [(" ".join(draw.choices(words[d], k=20)), d) for d in sizes for _ in range(sizes[d])]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").withColumn("_d", F.lit("clash"))
    model = mixing.fit_domains(docs, docs.select("doc_id"), most=20)
    assert model.domains == list("abcde") and model.prior == [sizes[d] / 706 for d in "abcde"]
    with pytest.warns(UserWarning, match="shares of tokens reached"):
        hard = mixing.mix(docs.where("lang = 'a'"), mixing.fit_domains(docs.where("lang IN ('a', 'b')"), docs.select("doc_id")), {"a": 0.1, "b": 0.9})
    assert hard.where("rate < 0").count() == 0
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 3)
    model = mixing.fit_domains(docs, docs.select("doc_id"))
    assert model.domains == [mixing.OTHER, "a", "b"] and model.prior[0] == 6 / 706
    got = {r.doc_id: r.domain for r in mixing.mix(docs, model, {"a": 0.5, "b": 0.5}).collect()}
    assert all(got[i] == (d if d in "ab" else mixing.OTHER) for i, (_, d) in enumerate(rows))


def test_rates_reach_the_least_squares_optimum(spark):
    """Against a plain solver on soft memberships."""
    import numpy as np

    draw = np.random.default_rng(2)
    p = draw.dirichlet([0.4, 0.4, 0.4], 200)
    t = draw.integers(1, 500, 200)
    df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(200)], "i long, n_tokens long, p array<double>")
    shares = [0.7, 0.2, 0.1]
    rows, at = mixing.fit_rates(df, shares, steps=200)
    got = np.array([r["rate"] for r in rows.orderBy("i").select("rate").collect()])
    w, q = t / t.sum(), (t / t.sum()) @ p
    rate = np.ones(200)
    for _ in range(20_000):
        rate = np.maximum(0, rate - 0.5 * (p @ (((w * rate) @ p - shares) / q) + mixing.RIDGE * (rate - 1)))

    def loss(r):
        return ((((w * r) @ p - shares) ** 2) / q).sum() + mixing.RIDGE * (w * (r - 1) ** 2).sum()

    assert (got >= 0).all() and loss(got) <= loss(rate) + 1e-3
    assert max(abs(a - s) for a, s in zip(at, shares)) < 5e-3


def test_mixing_counts_words_across_any_white_space(spark):
    """n_tokens against a plain count: line breaks, tabs and other white space part words as spaces do."""
    words = [f"w{i}" for i in range(40)]
    texts = [sep.join(words) for sep in (" ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1f", "\x85", "\u00a0", "\u2028", "\u3000", " \n\n\t ", ", ", ".\n")]
    texts += ["One two\nthree\tfour, five.\n\n\nsix", "\n\t \n", "...", "It's a well-known\ncase", ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = mixing.mix(docs, mixing.fit_domains(docs, docs.select("doc_id")), {"en": 1.0})
    want = {i: len(re.findall(r"[^\s!-/:-@\[-`{-~]+", t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want and want[0] == 40
    # words are told from one another there too, so a text of one word a line finds its domain
    pair = [(i, sep.join(w), d) for i, (sep, w, d) in enumerate((sep, w, d) for sep in (" ", "\n", "\t") for w, d in ((words[:20], "en"), (words[20:], "de")))]
    docs = spark.createDataFrame(pair, "doc_id long, text string, lang string")
    got = mixing.mix(docs, mixing.fit_domains(docs, docs.where("doc_id < 2")), {"en": 0.5, "de": 0.5})
    assert {r.doc_id: r.domain for r in got.collect()} == {i: d for i, _, d in pair}


# decontamination -----------------------------------------------------------------------------------------------------


def brute_hits(text, items, width=13):
    w = WORD.findall(lower(text))
    hit, names = set(), set()
    for name, t in items:
        v = WORD.findall(lower(t))
        n = min(width, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(name)) if name is not None else None
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_decontamination_against_brute_force(spark, odd, empty):
    draw = random.Random(4)
    vocabulary = ["the", "of", "É", "x1", "Öl", "word", "A", "b2"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 2, 3, 5, 13, 14, 20])))) for i in range(12)] + [(2, None), (None, "solo x1 item"), (10, "É x1 Öl")]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60))) + ("; " + (items[i % 12][1] or "").upper().replace("É", "É") if i % 2 else "")) for i in range(80)]
    docs += [(80, None), (81, ""), (3, docs[3][1])]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit("clash"))
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, items string")
    got = rows_of(decontaminate.judge(d, b))
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        n, hit, names, sha = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, names, sha), texts[r["doc_id"]]
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.remove_documents(d, b)
    assert sorted(kept.columns) == sorted(d.columns) and kept.count() == sum(not r["contaminated"] for r in got)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert all(len(WORD.findall(lower(cut[r["doc_id"]]))) == r["n_words"] - r["n_hit"] for r in got)
    assert not any(r["n_hit"] for r in rows_of(decontaminate.judge(odd, b.limit(0))))
    assert decontaminate.judge(empty, b).count() == 0


# URLs ----------------------------------------------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_rules_and_trees(spark):
    df = spark.read.parquet(f"{ROOT}/pages.parquet").select("page_id", "url")
    more = [(-1, None), (-2, ""), (-3, "no scheme/x"), (-4, "http://A.Example.ORG?x"), (-5, "s://b.com#/de/"), (-6, "x://y://z/fr/"), (-7, "http://com/de/"), (-8, "http://notcom/de/")]
    df = df.unionByName(spark.createDataFrame(more, df.schema)).withColumns({"suffix": F.lit("clash"), "verdict": F.lit("clash")})
    labelled = urls.weak_labels(df)
    got = urls.judge(df, RULES, urls.fit(labelled)).collect()
    assert len(got) == df.count()
    right = 0
    for r in got:
        after = (r.url or "").partition("://")[2]
        m = re.match(r"([^/?#]*)([^?#]*)", after)
        host, path = lower(m[1]), m[2]
        assert (r.host, r.path) == (host, path), r
        fits = [x for x in RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert r.rule == (best and best[1] + best[2])
        if best:
            assert r.verdict == best[0]
        elif r.url:
            right += (r.verdict == "block") == bool(set(re.split(r"[.\-]", host)) & set(urls.BLOCK_TERMS))
    assert right > 0.98 * sum(not r.rule and bool(r.url) for r in got)
    none = urls.judge(df, [], urls.fit(labelled.limit(0)))
    assert {r.verdict for r in none.select("verdict").distinct().collect()} == {"block"}  # 0.5: as good as unknown
    assert urls.judge(df.limit(0), RULES, urls.fit(labelled)).count() == 0


def test_suffixes_are_counted_before_the_draw(spark):
    """Every suffix that has a labelled URL has the counts of all of them, however few are drawn."""
    import math

    rows = [(f"http://h{i}.s{i % 6000}/x", float(i % 6000 % 3 == 0)) for i in range(9000)]
    model = urls.fit(spark.createDataFrame(rows + rows[:50], "url string, label double"), most=200, trees=1)
    base = sum(label for _, label in rows) / len(rows)
    n, s = {}, {}
    for url, label in rows:
        k = url.split(".")[-1].split("/")[0]
        n[k], s[k] = n.get(k, 0) + 1, s.get(k, 0) + label
    got = {r.suffix: (r.f_suffix_rate, r.f_suffix_log) for r in model.suffixes.collect()}
    assert set(got) == set(n) and len(n) == 6000
    assert all(abs(got[k][0] - (s[k] + 5 * base) / (n[k] + 5)) < 1e-9 and abs(got[k][1] - math.log1p(n[k])) < 1e-9 for k in n)


# n-gram join ---------------------------------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", lower(t))

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                at[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(k)
    return [(k, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(spark, odd, empty, width, percent):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [draw.choices(vocabulary, k=draw.choice([3, 12, 40, 90, 900])) for _ in range(25)]
    passage = draw.choices(vocabulary, k=40)
    rows = []
    for i in range(300):
        w = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 6])):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        rows.append((i, " ".join(passage + w if i % 5 == 0 else w)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "W1 w2"), (304, "w1 W2"), (305, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, token string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, width=width, percent=percent).collect())
    want = brute_components(rows, width, percent)
    assert got == sorted(want)
    kept = ngram_join.keep_one(df, width=width, percent=percent)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c if n else k for k, n, c in want})
    assert ngram_join.classes(odd).count() == odd.count() and ngram_join.keep_one(odd).count() == 9
    assert ngram_join.classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


# licences ------------------------------------------------------------------------------------------------------------


def test_licences(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licences.fit(docs)
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    }
    for r in licences.scan(docs, model).join(docs, "doc_id").collect():
        held = sorted({v for k, v in lines.items() if k in (r.text or "").split("\n")})
        assert set(held) <= set(r.families.split(",")) and (r.licence is None) == (not r.families)
        if not re.search("licen|reserved", r.text, re.I):
            assert r.families == "", r.text[:200]
    assert len(rows_of(licences.scan(odd, model))) == odd.count() and licences.scan(empty, model).count() == 0
    said = spark.createDataFrame([(1, "the license plate of my car\nfree software is nice"), (2, "x\nALL RIGHTS RESERVED.")], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(said, model).collect()}
    assert got == {1: "", 2: "all-rights-reserved"}
    assert licences.fit(empty).names[0] == licences.NONE


def test_wrapped_licences(spark):
    """A notice counts however its lines are broken, and as the family of the whole of it."""
    import textwrap

    gpl3 = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    notices = {
        gpl3: "gpl-3.0", "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.".replace("Attribution-Non", "Attribution Non"): "cc-by-nc-4.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "you may not use this file except in compliance with the Apache License, Version 2.0": "apache-2.0",
    }
    rows, want = [], {}
    for text, family in notices.items():
        for width in (1, 24, 40, 72):
            for mark, end in (("", "\n"), (" * ", "\r\n"), ("# ", "\n")):
                lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
                body = end.join(mark + x for x in ["Once upon a time there was a house.", "", *lines, "", "The end of the tale is near."])
                want[len(rows)] = family
                rows.append((len(rows), body))
    usual = "\n".join(["    This program is free software: you can redistribute it and/or modify", "    it under the terms of the GNU General Public License as published by",
                       "    the Free Software Foundation, either version 3 of the License, or", "    (at your option) any later version."])
    want[len(rows)] = "gpl-3.0"
    rows.append((len(rows), usual))
    parted = {len(rows): "You can redistribute it and/or modify it under the terms of\n\nthe GNU general", len(rows) + 1: "the license\nplate\nof my car"}
    want |= dict.fromkeys(parted, "")
    docs = spark.createDataFrame([*rows, *parted.items()], "doc_id long, text string")
    model = licences.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    got = {r.doc_id: r.families for r in licences.scan(docs, model).collect()}
    assert {k: (got[k], dict([*rows, *parted.items()])[k]) for k in want if got[k] != want[k]} == {}
