"""Fuzzy text scores. The scores are symmetric percentages built on the longest common subsequence;
Spark has no such function, so small Arrow-batched helpers compute them per pair of short strings."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _positions(seq) -> dict:
    masks: dict = {}
    for i, item in enumerate(seq):
        masks[item] = masks.get(item, 0) | (1 << i)
    return masks


def lcs_length(a, b) -> int:
    """Longest common subsequence, one machine-word style step per element of ``b``."""
    if not a or not b:
        return 0
    masks = _positions(a)
    full = (1 << len(a)) - 1
    state = full
    for item in b:
        hit = state & masks.get(item, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences, bit-parallel over ``a`` (Myers, Hyyro)."""
    if not a or not b:
        return max(len(a), len(b))
    masks = _positions(a)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for item in b:
        eq = masks.get(item, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        distance += bool(up & last) - bool(down & last)
        up = ((up << 1) | 1) & full
        plus = ((down << 1) & full) | (full & ~(diag | up))
        minus = up & diag
    return distance


def _similarity(common: int, total: int) -> float:
    return 100.0 * 2 * common / total if total else 100.0


@lru_cache(maxsize=1024)
def _tokens(text: str) -> tuple[frozenset, str]:
    own = frozenset(text.split())
    return own, " ".join(sorted(own))


def _parts(a: str, b: str):
    (ta, sa), (tb, sb) = _tokens(a), _tokens(b)
    if ta.isdisjoint(tb):
        return ta, tb, "", sa, sb
    both = " ".join(sorted(ta & tb))
    return ta, tb, both, " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))


def token_set_ratio(a: str, b: str) -> float:
    ta, tb, both, only_a, only_b = _parts(a, b)
    if not ta or not tb:
        return 0.0
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(both) + bool(both)
    len_a, len_b = shared + len(only_a), shared + len(only_b)
    missing = len(only_a) + len(only_b) - 2 * lcs_length(only_a, only_b)
    best = 100.0 - 100.0 * missing / (len_a + len_b)
    if both:
        best = max(best, _similarity(len(both), len(both) + len_a), _similarity(len(both), len(both) + len_b))
    return best


@lru_cache(maxsize=64)
def _bigrams_in(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams of a text, and which of them stands at each place."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64")
    return np.unique((a[:-1] << 21) | a[1:], return_inverse=True)


def _ends(short: str, long: str, floor: float) -> np.ndarray:
    """Ends of the windows that can reach ``floor``. Where c characters of n and w are common in order, all but n - c and
    w - c of the c - 1 steps between them are single steps on both sides, hence bigrams of ``short``."""
    n = len(short)
    known, place = _bigrams_in(long)
    until = np.concatenate([[0], np.cumsum(np.isin(known, _bigrams_in(short)[0])[place]), [0]])
    until[-1] = until[-2]
    ends = np.arange(1, len(long) + n)
    start, stop = np.maximum(0, ends - n), np.minimum(ends, len(long))
    wide = n + stop - start
    least = 3 * np.ceil(floor * wide / 200 - 1e-9) - wide - 1
    return ends[until[stop - 1] - until[np.minimum(start, stop - 1)] >= least]


def _best_window(short: str, long: str, floor: float) -> float:
    """Best score above ``floor`` of ``short`` against the windows of its length in ``long`` (shorter ones at
    the ends), 0 when none reaches it. One step of the window changes the common subsequence by at most one,
    so a window that misses the best score by k characters lets k - 1 windows be passed over; those that share too
    few bigrams are not tried at all."""
    if not short or not long:
        return 0.0
    n, best, end = len(short), 0.0, 1
    ends = _ends(short, long, floor)
    if not len(ends):
        return 0.0
    masks = _positions(short)
    full = (1 << n) - 1
    while (at := int(np.searchsorted(ends, end))) < len(ends):
        end = int(ends[at])
        window = long[max(0, end - n):end]
        state = full
        for item in window:
            hit = state & masks.get(item, 0)
            state = ((state + hit) | (state - hit)) & full
        common = n - state.bit_count()
        score = _similarity(common, n + len(window))
        if score >= floor:
            best = max(best, score)
        end += max(1, math.ceil(max(best, floor) * (n + len(window)) / 200 - common - 1e-9))
    return best


def partial_token_set_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """100 as soon as one token is shared, otherwise the best aligned window of the shorter side; 0 when that
    is below ``floor``."""
    ta, tb, both, only_a, only_b = _parts(a, b)
    if not ta or not tb:
        return 0.0
    if both:
        return 100.0
    short, long = sorted((only_a, only_b), key=len)
    best = _best_window(short, long, floor)
    return max(best, _best_window(long, short, max(best, floor))) if len(short) == len(long) else best


@F.pandas_udf(T.DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.LongType())
def aligned_count(many: pd.Series, counts: pd.Series, text: pd.Series, floor: pd.Series) -> pd.Series:
    """How many of the strings, each as often as its count, reach ``floor`` against the text."""
    rows = zip(many, counts, text, floor)
    return pd.Series([sum(int(n) for x, n in zip(xs, ns) if partial_token_set_ratio(x, y, f) >= f) for xs, ns, y, f in rows], dtype="int64")


@F.pandas_udf(T.LongType())
def word_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")
