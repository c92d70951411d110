"""Fuzzy ratios between texts, from their published definitions, as vectorised UDFs.

The basis is the longest common subsequence: ratio = 200 * LCS / (|a| + |b|). It is computed bit by bit in parallel on Python's
long integers (Hyyrö 2004).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def places(a: str) -> dict[str, int]:
    """For each character the bits of its places in a."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs_of(at: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of b and a text of n characters with these places."""
    full = (1 << n) - 1
    rows = full
    for c in b:
        hit = rows & at.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return n - rows.bit_count()


def lcs(a: str, b: str) -> int:
    return lcs_of(places(a), len(a), b)


def percent(common: int, total: int) -> float:
    return 100.0 if not total else 200.0 * common / total


def ratio(a: str, b: str) -> float:
    return percent(lcs(a, b), len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one, windows at both ends being shorter too."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 0.0 if m else 100.0
    at, best = places(a), 0.0
    for stop in range(1, m + n):
        lo, hi = max(0, stop - n), min(stop, m)
        size = hi - lo
        if percent(min(size, n), size + n) > best:
            best = max(best, percent(lcs_of(at, n, b[lo:hi]), size + n))
            if best == 100.0:
                break
    if n == m and best < 100.0:
        other = places(b)
        for stop in range(1, 2 * n):
            part = a[max(0, stop - n) : min(stop, n)]
            if percent(len(part), len(part) + n) > best:
                best = max(best, percent(lcs_of(other, n, part), len(part) + n))
    return best


def sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sorted_words(a), sorted_words(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and the shared words with either side's others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_a or not only_b):
        return 100.0
    gap = len(only_a) + len(only_b) - 2 * lcs(only_a, only_b)
    joint = bool(shared)
    full_a, full_b = len(shared) + joint + len(only_a), len(shared) + joint + len(only_b)
    best = 100.0 * (1 - gap / (full_a + full_b))
    if shared:
        for full in (full_a, full_b):
            best = max(best, percent(len(shared), len(shared) + full))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """100 if a word is shared, else the partial ratio of the sorted words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else max(partial_ratio(sorted_words(a), sorted_words(b)), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios, those that ignore order or parts weighing less."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def lexical_score(a: str, b: str) -> float:
    return max(token_set_ratio(a, b), partial_ratio(a, b))


def vectorised(fn):
    """A pandas UDF of two string columns; null if either is."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


UDFS = {f.__name__: vectorised(f) for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio, lexical_score)}
