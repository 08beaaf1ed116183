"""Weighted similarity of two names, 0…100, from its published definition.

Plain, word-sorted and word-set ratios count when the lengths are alike; the best
window of the longer name counts, at a discount, when they are not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Discounts, and the length ratios at which windows start and stop to count.
TOKEN_SCALE = 0.95
PARTIAL_SCALE, FAR_SCALE = 0.9, 0.6
PARTIAL_FROM, FAR_FROM = 1.5, 8.0
SHARED_WORD_SCORE = 100.0 * TOKEN_SCALE * PARTIAL_SCALE


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per position of ``a``."""
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for char in b:
        hit = row & places.get(char, 0)
        row = (row + hit) | (row - hit)
    return (~row & every).bit_count()


def _share(distance: int, total: int) -> float:
    return 100.0 * (1 - distance / total) if total else 100.0


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return _share(total - 2 * _common(a, b), total)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter name with a window of the longer, cut-off ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, m = len(a), len(b)
    windows = {b[max(i, 0) : i + n] for i in range(1 - n, m)}
    best = max(ratio(a, w) for w in windows)
    if n == m:
        best = max(best, max(ratio(b, a[max(i, 0) : i + n]) for i in range(1 - n, n)))
    return best


def _set_ratio(shared: list[str], only_a: list[str], only_b: list[str]) -> float:
    if shared and (not only_a or not only_b):
        return 100.0
    both, rest_a, rest_b = len(" ".join(shared)), " ".join(only_a), " ".join(only_b)
    gap = 1 if both else 0
    len_a, len_b = both + gap + len(rest_a), both + gap + len(rest_b)
    best = _share(len(rest_a) + len(rest_b) - 2 * _common(rest_a, rest_b), len_a + len_b)
    if both:
        best = max(best, _share(gap + len(rest_a), both + len_a), _share(gap + len(rest_b), both + len_b))
    return best


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    words_a, words_b = sorted(a.split()), sorted(b.split())
    shared = sorted(set(words_a) & set(words_b))
    only_a, only_b = sorted(set(words_a) - set(shared)), sorted(set(words_b) - set(shared))
    sorted_a, sorted_b = " ".join(words_a), " ".join(words_b)
    best = ratio(a, b)
    if spread < PARTIAL_FROM:
        if not words_a or not words_b:
            return best
        by_words = max(ratio(sorted_a, sorted_b), _set_ratio(shared, only_a, only_b))
        return max(best, by_words * TOKEN_SCALE)
    scale = PARTIAL_SCALE if spread <= FAR_FROM else FAR_SCALE
    best = max(best, partial_ratio(a, b) * scale)
    if shared:
        by_words = 100.0
    else:
        by_words = partial_ratio(sorted_a, sorted_b)
        if len(only_a) != len(words_a) or len(only_b) != len(words_b):
            by_words = max(by_words, partial_ratio(" ".join(only_a), " ".join(only_b)))
    return max(best, by_words * TOKEN_SCALE * scale)


@F.pandas_udf(T.DoubleType())
def weighted_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
