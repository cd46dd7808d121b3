"""String similarities that Spark has no built-in for, as Arrow-batched functions over distinct pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (sum of lengths); two empty strings are alike."""
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best indel_ratio of the shorter string with a window of the longer one, windows cut off at either end included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, m = len(short), len(long)
    best = 0.0
    # longest windows first: shorter ones can't beat what they leave little room for
    for start in sorted(range(1 - n, m), key=lambda k: max(0, -k, k + n - m)):
        window = long[max(0, start) : start + n]
        if 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, indel_ratio(short, window))
    return best


#: Characters by which bounds are counted: letters, digits, space, and two for all others; what is counted together only raises a bound.
_CLASSES = 39


def _class_of(code: np.ndarray) -> np.ndarray:
    letter, digit = (code >= 97) & (code <= 122), (code >= 48) & (code <= 57)
    return np.where(letter, code - 97, np.where(digit, code - 22, np.where(code == 32, 36, 37 + code % 2))).astype(np.int64)


def character_counts(strings: list[str]) -> np.ndarray:
    """How often each string has each class of characters, a row each."""
    sizes = np.array([len(x) for x in strings])
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(strings)), sizes) * _CLASSES + _class_of(codes)
    return np.bincount(at, minlength=len(strings) * _CLASSES).reshape(len(strings), _CLASSES).astype(np.uint16)


def upper_bounds(counts: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of max(ratio, 0.95 * partial ratio) and of the ratio alone of a string with each of others, from the characters that they share in any order.

    A common subsequence has no more characters than that, b; a window that holds it has b at least, so a partial ratio is at most
    200 * b / (length of the shorter + b).
    """
    shared = np.minimum(counts, others).sum(1, dtype=np.int64)
    short = np.minimum(size, sizes)
    whole = 200.0 * shared / np.maximum(size + sizes, 1)
    return np.maximum(whole, 0.95 * (200.0 * shared / np.maximum(short + shared, 1))), whole  # rounded as the scores are


def window_bound(short: str, long: str) -> float:
    """A bound of the partial ratio from the characters that the shorter string shares, in any order, with each window of the longer one."""
    n, best = len(short), 0.0
    if not n:
        return partial_ratio(short, long)
    for text in (long, long[::-1]):  # the window grows in at one end, stays full, and for the last time shrinks out as the other way round
        left = dict.fromkeys(text, 0)
        for c in short:
            left[c] = left.get(c, 0) + 1
        shared = 0
        for i, c in enumerate(text):
            shared += left[c] > 0
            left[c] -= 1
            if i >= n:
                out = text[i - n]
                left[out] += 1
                shared -= left[out] > 0
            best = max(best, 200.0 * shared / (n + min(i + 1, n)))
    return best


def _kinds(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows of character_counts(), the sizes with them, and which of these each string has."""
    rows = np.column_stack([character_counts(strings), [len(x) for x in strings]])
    kinds, which = np.unique(rows, axis=0, return_inverse=True)
    return kinds[:, :-1].astype(np.uint16), kinds[:, -1], which.reshape(-1)


def known_names(names: list[str]) -> tuple:
    """names as best_of_known() takes them: those of the same characters together, as they share their bounds."""
    low = [x.strip().lower() for x in names]
    if not low:
        return low, np.zeros((0, _CLASSES), np.uint16), np.zeros(0, np.int64), []
    counts, sizes, which = _kinds(low)
    order = np.argsort(which, kind="stable")
    return low, counts, sizes, np.split(order, np.cumsum(np.bincount(which))[:-1])


def best_of_known(values: list[str], known: tuple, least: list[float]) -> list[tuple[str, int, float]]:
    """(value, position of its best name, score) for values whose best score is their ``least`` or more; of equal scores the first name. Bounds are
    taken once for all values and names of the same characters."""
    low, counts, sizes, members = known
    out: list[tuple[str, int, float]] = []
    if not low or not values:
        return out
    owns = [value.strip().lower() for value in values]
    own_counts, own_sizes, which = _kinds(owns)
    for kind in range(len(own_counts)):
        size = int(own_sizes[kind])
        bounds, wholes = upper_bounds(own_counts[kind], size, counts, sizes)
        shared = np.rint(wholes * np.maximum(size + sizes, 1) / 200.0)
        parts = 0.95 * (200.0 * shared / np.maximum(np.minimum(size, sizes) + shared, 1))
        for i in np.flatnonzero(which == kind).tolist():
            own, best, at = owns[i], least[i], None
            near = np.flatnonzero(bounds >= best)
            if not len(near):
                continue
            ks = np.concatenate([members[x] for x in near])
            of = np.repeat(near, [len(members[x]) for x in near])
            order = np.lexsort((ks, -bounds[of]))

            def wins(score: float, k: int) -> bool:
                return score > best or score == best and (at is None or k < at)

            for k, x in zip(ks[order].tolist(), of[order].tolist(), strict=True):
                if not wins(bounds[x], k):
                    break  # of equal bounds the first names come first, so the others can only be equal and later
                if wins(wholes[x], k) and wins(score := indel_ratio(own, low[k]), k):
                    best, at = score, k
                if not min(size, sizes[x]) or wins(parts[x], k):
                    ends = sorted((own, low[k]), key=len)
                    if wins(0.95 * window_bound(*ends), k) and wins(score := 0.95 * partial_ratio(own, low[k]), k):
                        best, at = score, k
            if at is not None:
                out.append((values[i], at, best))
    return out


def best_by_bounds(values: list[str], names: list[str], least: float) -> list[tuple[str, int]]:
    """(value, position of its best name) for values whose best score is ``least`` or more; of equal scores the first name."""
    found = best_of_known(values, known_names(names), [least] * len(values))
    place = {value: k for k, value in reversed([*enumerate(values)])}
    return sorted(((value, at) for value, at, _ in found), key=lambda x: place[x[0]])


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x.strip().lower(), y.strip().lower()) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x.strip().lower(), y.strip().lower()) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def partial_similarity(a: Column, b: Column) -> Column:
    return _partial(a, b)
