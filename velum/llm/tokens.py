"""Token counts through a cache of digests.

A text is known by the digest of its normalised content together with the digest of the
tokenizer. Counts already stored are joined; texts that no row of the cache has are
reduced to one row each, encoded, and appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import once_per_worker, read_bytes
from velum.session import shared_dir

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Texts are handed to the tokenizer in groups of about so many characters.
GROUP = 2_000_000


def tokenizer_version(name: str, data: bytes) -> str:
    """Digest of the vocabulary file with the library's name and version."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if name.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(library.encode() + b"\0" + data).hexdigest()[:32]


def counter(name: str, data: bytes):
    """A function from texts to token counts: no begin, end or added tokens, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(data.decode("utf-8"))
        made.no_truncation()
        made.no_padding()
        encode = getattr(made, "encode_batch_fast", made.encode_batch)

        def whole(texts):
            return [len(e) for e in encode(texts, add_special_tokens=False)]

        return SplitCounter(whole) if splits_at_spaces(data) else whole
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(ids) for ids in made.encode(texts, num_threads=1)]


def splits_at_spaces(data: bytes) -> bool:
    """Whether a byte-level pre-tokenizer ends a token at every space between two other characters."""
    import json

    made = json.loads(data)
    pre = made.get("pre_tokenizer") or {}
    tokens = [t["content"] for t in made.get("added_tokens", [])]
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not made.get("normalizer") and not any(any(c.isspace() for c in t) for t in tokens)
        and not any(t.get("lstrip") or t.get("rstrip") for t in made.get("added_tokens", []))
    )


class SplitCounter:
    """Counts of a text as the sum over its words, each word encoded once per worker.

    A byte-level pre-tokenizer starts a token at a space that stands between two other
    characters, so the words, each with the space before it, are encoded apart. Texts
    with other white space beside a space are encoded whole.
    """

    WHOLE = 1 << 50

    def __init__(self, whole, room: int = 1_000_000):
        self.whole, self.room = whole, room
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def learn(self, held: dict[str, int], words: set[str], before: str) -> None:
        fresh = [w for w in words if w not in held]
        good = [w for w in fresh if w and not w[-1].isspace() and not (before and w[0].isspace())]
        held.update(dict.fromkeys(fresh, self.WHOLE))
        held.update(zip(good, self.whole([before + w for w in good])))

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.later) > self.room:
            self.first, self.later = {}, {}
        parts = [t.split(" ") for t in texts]
        self.learn(self.first, {p[0] for p in parts if len(p) > 1}, "")
        self.learn(self.later, set().union(*(p[1:] for p in parts)), " ")
        later = self.later.__getitem__
        counts = [self.first[p[0]] + sum(map(later, p[1:])) if len(p) > 1 else self.WHOLE for p in parts]
        whole = [i for i, n in enumerate(counts) if n >= self.WHOLE]
        for i, n in zip(whole, self.whole([texts[i] for i in whole])):
            counts[i] = n
        return counts


def encoder(name: str, data: bytes, version: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = once_per_worker(version, lambda: counter(name, data))
        for batch in batches:
            texts, counts, group, size = batch["text"].tolist(), [], [], 0
            for text in texts:
                group.append(text)
                size += len(text)
                if size >= GROUP:
                    counts += count(group)
                    group, size = [], 0
            counts += count(group) if group else []
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": counts})

    return encode


def digest(text: Column) -> Column:
    """Digest of the content as the tokenizer sees it: NULL is the empty text, all else stays."""
    return F.unhex(F.sha2(text, 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where the table has not been written yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def fresh_cache(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"token-cache-{uuid.uuid4().hex}")


def known(cache: DataFrame, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; a digest that two runs have stored counts once."""
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, *, key: str = "doc_id", text: str = "text",
                 limit: int = 512) -> DataFrame:
    """One row per document row: ``key``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is a tokenizer file beside the driver (.json or .model; its bytes travel
    with the tasks), ``cache`` a folder all executors share. NULL texts count as empty;
    repeated rows and equal texts are encoded once and all get the count; an empty table
    encodes nothing; further columns are left out.
    """
    spark = docs.sparkSession
    data = read_bytes(vocabulary)
    name = os.path.basename(vocabulary)
    version = tokenizer_version(name, data)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), content.alias("text"))
    # copies of a text meet before the shuffle already, in the partial aggregate
    missing = rows.select(digest(F.col("text")).alias("digest"), "text").join(
        known(read_cache(spark, cache), version), "digest", "left_anti"
    ).groupBy("digest").agg(F.any_value("text").alias("text"))
    encoded = missing.mapInPandas(encoder(name, data, version), "digest binary, n_tokens long")
    encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = known(read_cache(spark, cache), version)
    narrow = rows.select("_key", F.octet_length("text").cast("long").alias("n_bytes"), digest(F.col("text")).alias("digest"))
    return narrow.join(counts, "digest").select(
        F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
