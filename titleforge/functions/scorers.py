"""Similarity of strings from 0 to 100, vectorised over Arrow batches. Candidates should be blocked before they are scored."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for letter in b:
        hit = state & places.get(letter, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _lcs(a, b) / total


def qratio(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_x and only_y):
        return 100.0
    base, left, right = " ".join(both), " ".join(only_x), " ".join(only_y)
    best = ratio(left, right) if not both else ratio(f"{base} {left}", f"{base} {right}")
    if both:
        best = max(best, ratio(base, f"{base} {left}"), ratio(base, f"{base} {right}"))
    return best


def _best_window(a: str, b: str) -> float:
    """a against its best window in b, which isn't shorter; windows that reach over an end are cut off there."""
    size, letters, best = len(a), set(a), 0.0
    for end in range(1, len(b) + size):
        window = b[max(0, end - size) : min(end, len(b))]
        if window[-1] in letters or window[0] in letters:
            best = max(best, ratio(a, window))
    return best


def partial(a: str, b: str) -> float:
    """The shorter against its best window in the longer; of two that are equally long, each takes its turn as the shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _partial_token(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * _partial_token(a, b))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, letter in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == letter:
                used[j] = True
                matched.append(letter)
                break
    if not matched:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return 100.0 * (jaro + (0.1 * prefix * (1 - jaro) if jaro > 0.7 else 0))


SCORERS: dict[str, Callable[[str, str], float]] = {"wratio": wratio, "token_set": token_set, "token_sort": token_sort, "partial": partial, "qratio": qratio, "ratio": ratio, "jaro_winkler": jaro_winkler}


def get_scorer(name: str) -> Callable[[str, str], float]:
    """An unknown name means wratio."""
    return SCORERS.get(name, wratio)


def score(left: Column, right: Column, scorer: str = "wratio") -> Column:
    """Null if either is null."""
    function = get_scorer(scorer)

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return scored(left, right)
