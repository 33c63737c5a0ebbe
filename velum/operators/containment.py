"""Which known values occur inside which texts of their scope, without comparing all with all.

Values fall into classes by length: class b holds lengths b to 2b - 1, b a power of two.
Every window of b characters of a text is hashed (prefix sums make each window one
subtraction) and looked up in a bitmap of the openings of the class's values. At the few
places left, windows of the exact lengths are looked up in a second bitmap. What passes
both is joined with the values by equality, so bitmaps decide speed only.

The bitmaps have a fixed size, however many values there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.session import spread, stage

#: Bits of each bitmap, as a power of two: 2 MB; more values only let more places through to the join.
BITS = 24
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 18
#: Places handed on at a time.
ROWS = 20_000
_ODD = 0x9E3779B97F4A7C15  # any odd number: powers of it and of its inverse wrap at 2^64
_INVERSE = pow(_ODD, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.full(size, base, np.uint64) for base in (_ODD, _INVERSE))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return self.up[:n], self.down[:n]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _sums(codes: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.get(len(codes))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)))


def _slots(sums: np.ndarray, at: np.ndarray, length: int, salt: int, powers: _Powers) -> np.ndarray:
    """Place in a bitmap of the windows of ``length`` that begin at ``at``."""
    _, down = powers.get(len(sums))
    h = (sums[at + length] - sums[at]) * down[at] + np.uint64(salt & 0xFFFFFFFFFFFFFFFF) + np.uint64(length)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(64 - BITS)).astype(np.int64)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _value_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, size, slot): the opening (kind 0, size is the class) and the whole (kind 1, size is the length) of each value."""
    powers = _Powers()
    for batch in batches:
        rows = []
        for salt, value in zip(batch["salt"].tolist(), batch["value"].tolist()):
            sums = _sums(_codes(value), powers)
            n = len(sums) - 1
            b = 1 << (n.bit_length() - 1)
            first = np.zeros(1, np.int64)
            rows.append((0, b, int(_slots(sums, first, b, salt, powers)[0])))
            rows.append((1, n, int(_slots(sums, first, n, salt, powers)[0])))
        yield pd.DataFrame(rows, columns=["kind", "size", "slot"])


def _bitmaps(values: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lengths that occur, the bitmap of openings and the bitmap of whole values; both are built by Spark's bitmap aggregates."""
    slots = stage(values.mapInPandas(_value_slots, "kind int, size int, slot long"), "slots")
    lengths = [r[0] for r in slots.where("kind = 1").select("size").distinct().orderBy("size").collect()]
    made = [np.zeros(1 << (BITS - 3), np.uint8) for _ in range(2)]
    pieces = slots.groupBy("kind", F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    for r in pieces.toLocalIterator():  # at most 2^BITS bits a kind; bucket 1 begins with number 1
        at = (r["bucket"] - 1) * len(r["bits"])
        made[r["kind"]][at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return lengths, made[0], made[1]


def _finder(keys: Sequence[str], sent):
    """Rows (keys, scope, at, value) of windows that pass both bitmaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, openings, wholes = sent.value
        classes: dict[int, list[int]] = {}
        for n in lengths:
            classes.setdefault(1 << (n.bit_length() - 1), []).append(n)
        powers, reach = _Powers(), max(lengths)
        block = max(BLOCK, 2 * reach)
        for batch in batches:
            own = batch[["scope", *keys]].to_dict("list")

            def sent_on(rows: list) -> pd.DataFrame:
                columns = {name: [cells[r[0]] for r in rows] for name, cells in own.items()}
                return pd.DataFrame(columns | {"at": [r[1] for r in rows], "value": [r[2] for r in rows]}, dtype=object)

            rows: list = []
            for i, (salt, text) in enumerate(zip(batch["salt"].tolist(), batch["text"].tolist())):
                for begin in range(0, len(text), block):
                    sums = _sums(_codes(text[begin : begin + block + reach - 1]), powers)
                    stop = min(block, len(text) - begin)  # windows begin before it, and end in this piece
                    for b, sizes in classes.items():
                        at = np.arange(max(min(stop, len(sums) - b), 0))
                        at = at[_has(openings, _slots(sums, at, b, salt, powers))]
                        for n in sizes:
                            there = at[at + n < len(sums)]
                            there = there[_has(wholes, _slots(sums, there, n, salt, powers))] if len(there) else there
                            for a in map(int, there):
                                rows.append((i, begin + a, text[begin + a : begin + a + n]))
                                if len(rows) == ROWS:
                                    yield sent_on(rows)
                                    rows = []
            yield sent_on(rows)

    return run


def contained_values(texts: DataFrame, values: DataFrame, keys: Sequence[str], text: str = "text", scope: str = "scope") -> DataFrame:
    """(scope, keys, at, value): every place where a value of ``values`` (scope, value) stands in a text of its scope.

    ``at`` counts characters from 0. NULL and empty values and texts meet nothing; values
    repeated in a scope count once; overlapping places all count; a NULL scope meets
    nothing. Texts are dealt once to as many tasks as a shuffle has, then only places that
    passed the bitmaps are shuffled.
    """
    spark = texts.sparkSession
    known = values.where("value <> ''").select("scope", "value").distinct()
    known = stage(known.where("scope IS NOT NULL"), "known-values")
    salted = F.xxhash64(F.col("scope")).alias("salt")
    lengths, openings, wholes = _bitmaps(spread(known.select(salted, "value")))
    rows = texts.select(F.col(scope).alias("scope"), *keys, F.col(text).alias("text")).where("scope IS NOT NULL AND text <> ''")
    shape = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", at int, value string"
    if not lengths:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((lengths, openings, wholes))
    found = spread(rows).select("*", salted).mapInPandas(_finder(list(keys), sent), schema)
    return stage(found, "places").join(known, ["scope", "value"], "left_semi").select("scope", *keys, "at", "value")


def leak_check_scope(masked: DataFrame, token_map: DataFrame, keys: Sequence[str], text: str = "text", scope: str = "scope") -> DataFrame:
    """(scope, keys, value, n): values of the token map that masked texts of their scope still show, wherever they were found.

    Expected to be empty. A value that stands inside a token ([...]) counts too.
    """
    found = contained_values(masked, token_map, keys, text, scope)
    return found.groupBy("scope", *keys, "value").agg(F.count("*").alias("n"))


def unresolved_texts(texts: DataFrame, values: DataFrame, keys: Sequence[str], text: str = "text", scope: str = "scope") -> DataFrame:
    """The texts that hold none of their scope's values, as they are: what is left for another detector."""
    met = stage(contained_values(texts, values, keys, text, scope).select("scope", *keys).distinct(), "met")
    same = F.lit(True)
    for own, other in zip([scope, *keys], ["scope", *keys]):
        same = same & texts[own].eqNullSafe(met[other])
    return texts.join(met, same, "left_anti")
