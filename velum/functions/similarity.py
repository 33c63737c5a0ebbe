"""Header similarity and the blocking keys that make its join an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted score and the margin inside which two candidates are ambiguous.
THRESHOLD = 88.0
MARGIN = 3.0


def lcs_length(chars_a: Column, chars_b: Column) -> Column:
    """Length of the longest common subsequence of two character arrays.

    Pass plain columns: the arrays are read inside nested lambdas.
    """

    def next_row(row: Column, char: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            return F.array_append(
                left,
                F.when(F.get(chars_b, j) == char, F.get(row, j) + 1).otherwise(
                    F.greatest(F.get(row, j + 1), F.get(left, j))
                ),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(chars_b) - 1), F.array(F.lit(0)), cell
        )

    start = F.array_repeat(F.lit(0), F.size(chars_b) + 1)
    return F.element_at(F.aggregate(chars_a, start, next_row), -1)


def similarity(lcs: Column, len_a: Column, len_b: Column) -> Column:
    return F.lit(200.0) * lcs / (len_a + len_b)


def max_edits(length: Column, threshold: float = THRESHOLD) -> Column:
    """Most insertions plus deletions a partner at or above the threshold can differ by.

    A score s allows d <= (1 - s)(la + lb) edits, and then la <= lb (2 - s) / s, so
    d <= 2 lb (1 - s) / s whatever the partner's length.
    """
    s = threshold / 100.0
    return F.floor(length * (2 * (1 - s) / s) + F.lit(1e-9)).cast("int")


def segments(text: Column, threshold: float = THRESHOLD) -> Column:
    """Cut ``text`` into ``max_edits + 1`` pieces: array<piece, at>.

    Each edit can touch one piece only, so any partner at or above the threshold
    holds at least one piece unchanged, moved by no more than ``max_edits`` places:
    joining pieces to substrings finds every pair.
    """
    n = max_edits(F.length(text), threshold) + 1

    def piece(i: Column) -> Column:
        start = F.floor(i * F.length(text) / n).cast("int")
        stop = F.floor((i + 1) * F.length(text) / n).cast("int")
        return F.struct(
            F.substring(text, start + 1, stop - start).alias("piece"), (start + 1).alias("at")
        )

    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def segment_lengths(longest: int, threshold: float = THRESHOLD) -> list[int]:
    """Every piece length ``segments`` can produce for texts of 1..longest characters."""
    s = threshold / 100.0
    found: set[int] = set()
    for length in range(1, longest + 1):
        n = math.floor(length * (2 * (1 - s) / s) + 1e-9) + 1
        cuts = [math.floor(i * length / n) for i in range(n + 1)]
        found.update(b - a for a, b in zip(cuts, cuts[1:]))
    return sorted(found - {0})


def substrings(text: Column, sizes: list[int]) -> Column:
    """All substrings of the given sizes with their places: array<piece, at>."""

    def of_size(k: int) -> Column:
        places = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - (k - 1)))
        return F.transform(
            F.coalesce(places, F.array().cast("array<int>")),
            lambda i: F.struct(F.substring(text, i, F.lit(k)).alias("piece"), i.alias("at")),
        )

    return F.flatten(F.array(*[of_size(k) for k in sizes]))
