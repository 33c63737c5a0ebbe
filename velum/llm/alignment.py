"""Alignment of two tokenizers over the same bytes, by galloping intersection of token ends.

Both tokenizers cover the bytes of a text; the places where a token of each ends cut the
text into groups. The shorter list of ends drives an exponential and then binary search
into the longer one. Arrow batches of texts are laid end to end, so one search serves a
batch, and as both tokenizers begin tokens at single spaces, words met before are not
aligned again. Pairs of ids whose tokens end together are counted over the corpus, first in the
worker, then by Spark; the counts come back to the texts by broadcast while they are few,
by a join beyond that.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import once_per_worker, read_bytes, stage
from velum.llm.tokens import splits_at_spaces

#: Texts are encoded in groups of about so many characters.
GROUP = 1_000_000
#: Links of texts aligned whole that a worker gathers before they are counted.
GATHERED = 1_000_000
#: Words a worker keeps.
ROOM = 150_000
#: Rows looked up at a time.
ROWS = 1_000
#: Distinct id pairs up to which counts are broadcast (24 bytes each); beyond, links are joined by shuffle.
MOST_BROADCAST = 2_000_000


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer file (.json); special strings inside texts are plain text."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_str(data.decode("utf-8"))
        self.made.encode_special_tokens = True
        self.made.no_truncation()
        self.made.no_padding()
        self.splits = splits_at_spaces(data)
        byte = byte_of_char()
        vocabulary = json.loads(data)["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            self.bytes[at] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.made.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts a space before the text by itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [self.piece(i) for i in range(self.made.get_piece_size())]

    def piece(self, i: int) -> bytes:
        piece = self.made.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.made.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.made.encode(texts, num_threads=1)


class Side:
    """A tokenizer with the length of each token and its id as text, followed by a comma or by ``close``."""

    def __init__(self, made, close: str):
        self.made = made
        self.length = np.array([len(b) for b in made.bytes], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(made.bytes))], object)
        self.last = np.array([f"{i}{close}" for i in range(len(made.bytes))], object)
        self.width = np.array([len(x) for x in self.inner], np.int64)


def loaded(name: str, data: bytes):
    return ByteLevel(data) if name.endswith(".json") else Pieces(data)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the sorted ``short`` the first place in the sorted ``long`` that is not smaller.

    All searches run side by side: each starts on the diagonal, doubles its step until it
    has passed its value, and then halves the interval.
    """
    n = len(long)
    start = np.arange(len(short), dtype=np.int64) * n // max(len(short), 1)
    low, high = start.copy(), start.copy()
    step = 1
    behind = np.flatnonzero(long[np.minimum(high, n - 1)] < short) if n else np.empty(0, np.int64)
    while len(behind):  # up: long[low] stays below the value
        low[behind] = high[behind]
        high[behind] = np.minimum(high[behind] + step, n)
        inside = behind[high[behind] < n]
        behind, step = inside[long[high[inside]] < short[inside]], step * 2
    step = 1
    ahead = np.flatnonzero((low == high) & (low > 0))
    ahead = ahead[long[low[ahead] - 1] >= short[ahead]] if n else ahead
    while len(ahead):  # down: long[high] stays at or above it
        high[ahead] = low[ahead]
        low[ahead] = np.maximum(low[ahead] - step, 0)
        inside = ahead[low[ahead] > 0]
        ahead, step = inside[long[low[inside]] >= short[inside]], step * 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return high
        mid = (low[open_] + high[open_]) // 2
        less = long[mid] < short[open_]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and ``b`` of their common values; both are strictly increasing."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    met = np.flatnonzero((at < len(long)) & (long[np.minimum(at, len(long) - 1)] == short)) if len(long) else np.empty(0, np.int64)
    return (met, at[met]) if len(a) <= len(b) else (at[met], met)


def flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


class Aligned(NamedTuple):
    """Sizes (tokens of a, of b, groups, links) and groups of each text, and the links of all texts in a row."""

    sizes: np.ndarray
    groups: list[str]
    links: np.ndarray


def kept(texts: list[str], sides: tuple[Side, Side]) -> list[list[list[int]]]:
    """Token ids of each side; none where the bytes of either differ from a space and the text."""
    want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(w) for w in want], np.int64)
    ids = [side.made.encode(texts) for side in sides]
    good = sizes > 0
    for side, own in zip(sides, ids):
        stop = np.cumsum([len(x) for x in own])
        ends = np.concatenate(([0], np.cumsum(side.length[flat(own)])))
        good &= ends[stop] - ends[np.concatenate(([0], stop[:-1]))] == sizes
    for side, own in zip(sides, ids):
        # lengths agree, so one comparison of all the bytes stands for all the texts, unless it fails
        if b"".join([side.made.bytes[i] for x, g in zip(own, good) if g for i in x]) != b"".join([w for w, g in zip(want, good) if g]):
            good &= [b"".join(map(side.made.bytes.__getitem__, x)) == w for x, w in zip(own, want)]
    return [[x if g else [] for x, g in zip(own, good)] for own in ids]


def aligned(texts: list[str], a: Side, b: Side) -> Aligned:
    ids_a, ids_b = kept(texts, (a, b))
    fa, fb = flat(ids_a), flat(ids_b)
    stop_a, stop_b = (np.cumsum([len(x) for x in ids]).astype(np.int64) for ids in (ids_a, ids_b))
    # tokens without bytes end where their predecessor ends: the last of such a run stands for the place
    ends_a, ends_b = np.cumsum(a.length[fa]), np.cumsum(b.length[fb])
    places_a, places_b = (e[np.flatnonzero(np.append(e[1:] != e[:-1], True))] if len(e) else e for e in (ends_a, ends_b))
    places = places_a[meeting(places_a, places_b)[0]]
    cut_a, cut_b = np.searchsorted(ends_a, places, "right"), np.searchsorted(ends_b, places, "right")  # tokens before each cut
    last_a, last_b = np.zeros(len(fa), bool), np.zeros(len(fb), bool)
    last_a[cut_a - 1], last_b[cut_b - 1] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    words = np.empty(len(fa) + len(fb), object)
    at_a = np.arange(len(fa)) + np.concatenate(([0], cut_b))[group_a]
    at_b = np.arange(len(fb)) + cut_a[group_b] if len(fb) else np.empty(0, np.int64)
    words[at_a] = np.where(last_a, a.last[fa], a.inner[fa])
    words[at_b] = np.where(last_b, b.last[fb], b.inner[fb])
    width = np.zeros(len(words) + 1, np.int64)
    width[at_a + 1], width[at_b + 1] = a.width[fa], b.width[fb]
    written, edge = "".join(words), np.cumsum(width)[np.concatenate(([0], stop_a + stop_b))].tolist()
    link_a, link_b = linked(ends_a, ends_b, places)
    sizes = np.zeros((4, len(texts)), np.int64)
    sizes[0], sizes[1] = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    sizes[2] = np.bincount(np.searchsorted(stop_a, cut_a - 1, "right"), minlength=len(texts))
    sizes[3] = np.bincount(np.searchsorted(stop_a, link_a, "right"), minlength=len(texts))
    return Aligned(sizes, [written[x : y - 1] if y > x else "" for x, y in zip(edge, edge[1:])], (fa[link_a] << 32) | fb[link_b])


def linked(ends_a: np.ndarray, ends_b: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all pairs that end at one of ``places``; each place has one pair, but for tokens without bytes."""
    low_a, low_b = np.searchsorted(ends_a, places, "left"), np.searchsorted(ends_b, places, "left")
    many_a = np.searchsorted(ends_a, places, "right") - low_a
    many_b = np.searchsorted(ends_b, places, "right") - low_b
    if (many_a == 1).all() and (many_b == 1).all():
        return low_a, low_b
    size = many_a * many_b
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(low_a, size) + nth // np.repeat(many_b, size), np.repeat(low_b, size) + nth % np.repeat(many_b, size)


def grouped(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class Words:
    """Alignments of words, each aligned once per worker with the space before it.

    Where a single space stands between two other characters, tokens of both kinds begin,
    so a text's groups are those of its words one after the other.
    """

    def __init__(self, a: Side, b: Side, room: int = ROOM):
        self.a, self.b, self.room = a, b, room
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((4, 1024), np.int64)  # tokens of a, of b, groups, links
        self.links, self.filled = np.zeros(4096, np.int64), 0
        self.start = np.zeros(1024, np.int64)
        self.seen = np.zeros(1024, np.int64)

    def learn(self, words: list[str]) -> None:
        for part in grouped(words):
            made = aligned(part, self.a, self.b)
            at, end = len(self.groups), len(self.groups) + len(part)
            self.index.update(zip(part, range(at, end)))
            self.groups += made.groups
            while end > self.sizes.shape[1]:
                self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)), axis=1)
                self.start, self.seen = (np.concatenate((v, np.zeros_like(v))) for v in (self.start, self.seen))
            while self.filled + len(made.links) > len(self.links):
                self.links = np.concatenate((self.links, np.zeros_like(self.links)))
            self.sizes[:, at:end] = made.sizes
            self.start[at:end] = self.filled + np.cumsum(made.sizes[3]) - made.sizes[3]
            self.links[self.filled : self.filled + len(made.links)] = made.links
            self.filled += len(made.links)

    def links_of(self, words: np.ndarray) -> np.ndarray:
        many = self.sizes[3, words]
        stop = np.cumsum(many)
        return self.links[np.repeat(self.start[words] - stop + many, many) + np.arange(stop[-1] if len(stop) else 0)]

    def counted(self, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Links of all words seen since the last call, and of ``others``, with how often each was met."""
        met = np.flatnonzero(self.seen)
        links = np.concatenate((self.links_of(met), *others))
        times = np.concatenate((np.repeat(self.seen[met], self.sizes[3, met]), np.ones(len(links) - self.sizes[3, met].sum(), np.int64)))
        self.seen[:] = 0
        others.clear()
        order = np.argsort(links, kind="stable")
        links, times = links[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], links[1:] != links[:-1]))) if len(links) else np.empty(0, np.int64)
        return links[first], np.add.reduceat(times, first) if len(first) else times


#: White space beside a space, or at either end.
UNEVEN = re.compile(r"\s | \s|\A\s|\s\Z")


def spaced(text: str) -> list[str] | None:
    """The words of a text in which every space stands between two other characters that are no white space."""
    return None if UNEVEN.search(text) else text.split(" ")


def splits_words(a, b) -> bool:
    """Whether both tokenizers begin a token at every such space."""
    return a.splits and all("▁" not in b.made.id_to_piece(i).lstrip("▁") for i in range(len(b.bytes)))


def aligned_texts(texts: list[str], words: Words, split: bool, others: list[np.ndarray]) -> Aligned:
    """Through the texts' words where that is exact, else whole; links of whole texts are added to ``others``."""
    parts = [spaced(t) if split and t else None for t in texts]
    words.learn(sorted(set().union(*filter(None, parts)).difference(words.index)))
    own = [k for k, p in enumerate(parts) if p]
    many = np.array([len(parts[k]) for k in own], np.int64)
    at = np.fromiter(map(words.index.__getitem__, chain.from_iterable(parts[k] for k in own)), np.int64, int(many.sum()))
    first = np.cumsum(many) - many
    if own:
        good = np.minimum.reduceat(words.sizes[0, at], first) > 0  # else the bytes of some word differ
        at, own, many = at[np.repeat(good, many)], [k for k, g in zip(own, good) if g], many[good]
        first = np.cumsum(many) - many
    sizes, groups = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
    if own:
        sizes[:, own] = np.add.reduceat(words.sizes[:, at], first, axis=1)
        held = at.tolist()
        for k, x, n in zip(own, first.tolist(), many.tolist()):
            groups[k] = ";".join(map(words.groups.__getitem__, held[x : x + n]))
        met, times = np.unique(at, return_counts=True)
        words.seen[met] += times
    links = words.links_of(at)
    whole = [k for k, p in enumerate(parts) if p is None and texts[k]]
    if whole:
        made = aligned([texts[k] for k in whole], words.a, words.b)
        sizes[:, whole] = made.sizes
        for k, text in zip(whole, made.groups):
            groups[k] = text
        others.append(made.links)
        pieces = np.split(links, np.cumsum(sizes[3, own])) if own else []
        placed = dict(zip(own, pieces)) | dict(zip(whole, np.split(made.links, np.cumsum(made.sizes[3]))))
        links = np.concatenate([placed[k] for k in range(len(texts)) if k in placed])
    return Aligned(sizes, groups, links)


OWN = ["key", "n_a", "n_b", "n_groups", "groups_sha256"]
NAMES = ["row", *OWN, "a", "b", "pair", "seen"]
ALIGNED = "row long, key {}, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, pair long, seen long"


def aligner(name_a: str, data_a, name_b: str, data_b):
    """Rows of texts, and rows (pair, seen) that count id pairs; a pair is its a id shifted by 32 bits with its b id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def made():
            a, b = loaded(name_a, data_a.value), loaded(name_b, data_b.value)
            return Words(Side(a, "|"), Side(b, ";")), splits_words(a, b)

        words, split = once_per_worker(f"align {name_a} {name_b}", made)
        words.seen[:] = 0  # a task that failed may have left some
        others: list[np.ndarray] = []
        size, key_type = 0, pa.int64()

        def counts() -> pa.RecordBatch:
            pair, seen = words.counted(others)
            n = len(pair)
            no = [pa.nulls(n, t) for t in (pa.int64(), key_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*no, pa.array(pair), pa.array(seen)], names=NAMES)

        for batch in batches:
            key_type = batch.column(1).type
            at = 0
            for texts in grouped(batch.column(2).to_pylist()):
                sizes, groups, links = aligned_texts(texts, words, split, others)
                own = batch.slice(at, len(texts))
                at += len(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[3]))).astype(np.int32))
                sides = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (links >> 32, links & 0xFFFFFFFF)]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), *map(pa.array, sizes[:3]), pa.array(digests, pa.string()), *sides, none, none], names=NAMES)
                size += sum(map(len, others))
                if size >= GATHERED or len(words.index) > words.room:
                    yield counts()
                    size = 0
                    if len(words.index) > words.room:
                        words.clear()
        yield counts()

    return run


def looker(pairs):
    """Adds up counts over the links of each row, from sorted ``pairs`` with (count, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, seen, best = pairs.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                a, b = batch.column(5), batch.column(6)
                links = (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy()
                stop = np.cumsum(np.diff(a.offsets.to_numpy()).astype(np.int64))
                n = np.diff(stop, prepend=0)
                place = np.searchsorted(pair, links)
                sums = [np.concatenate(([0], np.cumsum(x[place].astype(np.int64)))) for x in (best, seen)]
                out = [pa.array(n), *(pa.array(x[stop] - x[stop - n]) for x in sums)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *out], names=[*OWN, "n_links", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, first: str, second: str, *, key: str = "doc_id", text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document row: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` and ``second`` are tokenizer files beside the driver (.json, byte-level, and
    .model). NULL and empty texts, and texts whose tokens do not give back a space and the
    text byte for byte, have zeros and an empty groups_sha256; repeated rows stay and count
    each time; an empty table gives no row; further columns are left out.
    """
    spark = docs.sparkSession
    data_a, data_b = (spark.sparkContext.broadcast(read_bytes(p)) for p in (first, second))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    schema = ALIGNED.format(rows.schema["key"].dataType.simpleString())
    run = aligner(os.path.basename(first), data_a, os.path.basename(second), data_b)
    made = stage(rows.mapInArrow(run, schema), "aligned")
    counts = made.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("seen").alias("seen"))
    counts = stage(counts, "pairs")
    top = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("id")).agg(F.max("seen").alias("top"))
    counts = counts.join(top, F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)) == F.col("id")).select("pair", "seen", (F.col("seen") == F.col("top")).alias("best"))
    counts = stage(counts, "pairs")
    own = made.where("row IS NOT NULL")
    if counts.count() <= most_broadcast:
        table = counts.orderBy("pair").toPandas()
        sent = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["seen"].to_numpy(np.int64), table["best"].to_numpy(bool)))
        out = own.select(*OWN, "a", "b").mapInArrow(
            looker(sent), f"key {rows.schema['key'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    else:
        links = own.select("row", F.explode(F.arrays_zip("a", "b")).alias("l"))
        links = links.select("row", F.shiftleft(F.col("l.a").cast("long"), 32).bitwiseOR(F.col("l.b").cast("long")).alias("pair"))
        links = links.groupBy("row", "pair").agg(F.count("*").alias("k"))
        sums = links.join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("seen")).alias("count_sum"))
        out = own.join(sums, "row", "left").select(*OWN, F.size("a").cast("long").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
