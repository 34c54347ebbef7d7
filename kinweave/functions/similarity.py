"""Similarity of two text columns. The edit distance stays in the JVM; the others are Arrow functions over distinct pairs of a batch."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import ship
from . import strings
from .every_pair import edit_scores, jaro_scores, jaro_winkler_scores

#: Longer texts are compared one by one.
WIDEST = 64


def edit_score(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; null if either is null, or both are empty."""
    return F.lit(1.0) - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def _edit_one(a: str, b: str) -> float | None:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return 1.0 - row[-1] / max(len(a), len(b)) if a or b else None


def _each_pair_once(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    def column(a: Column, b: Column) -> Column:
        ship()
        return F.pandas_udf(of, "double")(a, b)  # type: ignore[call-overload]

    return column


@lru_cache(4096)
def _matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)  # what it learns of the second text is kept for other first ones


def _ratio(a: str, b: str) -> float:
    matcher = _matcher(b)
    matcher.set_seq1(a)
    return matcher.ratio()


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points in rows of one width, 0 behind the end."""
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def _jaro_many(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro of many pairs at once; the texts have at most WIDEST characters and no null character.

    The shorter text's characters are gone through one position at a time, each taking the first free equal one in reach.
    """
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)])
    la, lb = np.array([len(x) for x in a]), np.array([len(y) for y in b])
    wide_a, wide_b = max(1, la.max()), max(1, lb.max())
    ca, cb, n = _codes(a, wide_a), _codes(b, wide_b), len(a)
    reach = np.maximum(0, lb // 2 - 1)[:, None]
    free = np.arange(wide_b)[None, :] < lb[:, None]
    matched = np.zeros((n, wide_a), bool)
    at, rows = np.arange(wide_b)[None, :], np.arange(n)
    for i in range(wide_a):
        hit = free & (cb == ca[:, i : i + 1]) & (np.abs(at - i) <= reach) & (la > i)[:, None]
        first = hit.argmax(axis=1)
        matched[:, i] = hit[rows, first]
        free[rows, first] &= ~matched[:, i]
    taken = (np.arange(wide_b)[None, :] < lb[:, None]) & ~free
    m = matched.sum(axis=1)
    left, right = np.zeros((n, wide_a), np.uint32), np.zeros((n, wide_a), np.uint32)
    for out, codes, used in ((left, ca, matched), (right, cb, taken)):
        r, c = np.nonzero(used)
        out[r, np.cumsum(used, axis=1)[r, c] - 1] = codes[r, c]
    moved = (left != right).sum(axis=1) // 2
    some = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / some) / 3, 0.0)
    return np.where([x == y for x, y in zip(a, b)], 1.0, score)


def _jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    s = _jaro_many(a, b)
    x, y = _codes([t[:4] for t in a], 4), _codes([t[:4] for t in b], 4)
    same = np.cumprod((x == y) & (x > 0), axis=1).sum(axis=1)
    return np.where(s > 0.7, s + same * 0.1 * (1 - s), s)


def _many_pairs(many: Callable[[list[str], list[str]], np.ndarray], one: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        (x, texts_a), (y, texts_b) = pd.factorize(a), pd.factorize(b)
        known = (x >= 0) & (y >= 0)
        pairs, at = np.unique(x[known].astype(np.int64) * max(1, len(texts_b)) + y[known], return_inverse=True)
        left, right = texts_a[pairs // max(1, len(texts_b))], texts_b[pairs % max(1, len(texts_b))]
        longest = np.array([max(len(p), len(q)) if "\0" not in p + q else WIDEST + 1 for p, q in zip(left, right)], np.int64)
        score = np.zeros(len(pairs))
        order = np.argsort(longest, kind="stable")  # texts of like lengths together, so that few cells are empty
        few = int(np.searchsorted(longest[order], WIDEST, side="right"))
        for k in range(0, few, 2000):
            part = order[k : min(k + 2000, few)]
            score[part] = many(left[part].tolist(), right[part].tolist())
        for i in order[few:]:
            score[i] = one(left[i], right[i])
        out = np.full(len(a), np.nan)
        out[known] = score[at]
        return pd.Series([None if v != v else v for v in out.tolist()], dtype="float64")

    def column(a: Column, b: Column) -> Column:
        ship()
        return F.pandas_udf(of, "double")(a, b)  # type: ignore[call-overload]

    column.of = of
    return column


jaro = _many_pairs(_jaro_many, strings.jaro)
jaro_winkler = _many_pairs(_jaro_winkler_many, strings.jaro_winkler)
sequence_ratio = _each_pair_once(_ratio)
#: For all pairs of two lists: of many texts at once, and of two.
edit_score.every = (edit_scores, _edit_one)
jaro.every = (jaro_scores, strings.jaro)
jaro_winkler.every = (jaro_winkler_scores, strings.jaro_winkler)
