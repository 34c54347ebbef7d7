"""Similarity of every text of one list to every text of another, by words of bits that hold where a text has a character."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Longer texts are compared one by one; so many pairs are worked on at once, as many as a processor's cache holds.
LONGEST, AT_ONCE = 63, 30_000


def _codes(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places in the list, and code points."""
    by: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by.setdefault(len(t), []).append(i)
    return {n: (np.array(at), np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)) for n, at in by.items()}


def _where(codes: np.ndarray, letters: np.ndarray, word: type) -> np.ndarray:
    """For every letter and text a word with a bit for each place where the text has it."""
    out = np.zeros((len(letters), len(codes)), word)
    for j in range(codes.shape[1]):
        out[np.searchsorted(letters, codes[:, j]), np.arange(len(codes))] |= word(1 << j)
    return out


def _edits(scan: np.ndarray, has: np.ndarray, width: int) -> np.ndarray:
    """Edit distances (Myers 1999), of texts as numbers of letters to texts of one width."""
    word = has.dtype.type
    shape, one, top = (len(scan), has.shape[1]), word(1), word(width - 1)
    plus, minus, score = np.full(shape, ~word(0)), np.zeros(shape, word), np.full(shape, width, np.int16)
    for i in range(scan.shape[1]):
        eq = has[scan[:, i]]
        across = (((eq & plus) + plus) ^ plus) | eq
        down = eq | minus
        up = minus | ~(across | plus)
        low = plus & across
        score += ((up >> top) & one).astype(np.int16)
        score -= ((low >> top) & one).astype(np.int16)
        up = (up << one) | one
        plus = (low << one) | ~(down | up)
        minus = up & down
    return score


def edit_scores(scan: np.ndarray, other: np.ndarray, has: np.ndarray, number: np.ndarray) -> np.ndarray:
    return 1.0 - _edits(number, has, other.shape[1]) / max(scan.shape[1], other.shape[1])


def jaro_scores(scan: np.ndarray, other: np.ndarray, has: np.ndarray, number: np.ndarray) -> np.ndarray:
    """As :func:`kinweave.functions.strings.jaro`; ``scan`` has the shorter texts."""
    word, (a, b) = has.dtype.type, (scan.shape[1], other.shape[1])
    shape, reach, one = (len(scan), len(other)), max(0, b // 2 - 1), word(1)
    free, hit = np.full(shape, word((1 << b) - 1)), np.zeros(shape, word)
    for i in range(a):
        near = word(((1 << min(b, i + reach + 1)) - 1) & ~((1 << max(0, i - reach)) - 1))
        found = has[number[:, i]] & near & free
        found &= ~found + one  # the first
        free ^= found
        hit |= (found != 0).astype(word) << word(i)
    m, taken, moved = np.bitwise_count(hit).astype(np.int64), free ^ word((1 << b) - 1), np.zeros(shape, np.int16)
    for i in range(a):
        next_ = taken & (~taken + one) & (~((hit >> word(i)) & one) + one)
        moved += (next_ != 0) & ((has[number[:, i]] & next_) == 0)
        taken ^= next_
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / a + m / b + (m - moved // 2) / some) / 3, 0.0)


def jaro_winkler_scores(scan: np.ndarray, other: np.ndarray, has: np.ndarray, number: np.ndarray) -> np.ndarray:
    s = jaro_scores(scan, other, has, number)
    same, n = np.ones(s.shape, bool), np.zeros(s.shape, np.int64)
    for i in range(min(4, scan.shape[1], other.shape[1])):
        same &= scan[:, i][:, None] == other[:, i]
        n += same
    return np.where(s > 0.7, s + n * 0.1 * (1 - s), s)


def every_pair(a: list[str], b: list[str], many: Callable[..., np.ndarray], one: Callable[[str, str], float | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``a``, places in ``b`` and the scores of all their pairs (a row for each of ``a``), piece by piece; all pieces have each pair once."""
    left, right = _codes(a), _codes(b)
    for n, (at_a, x) in left.items():
        for m, (at_b, y) in right.items():
            if not n or not m or max(n, m) > LONGEST:
                yield at_a, at_b, np.array([[np.nan if (s := one(a[i], b[j])) is None else s for j in at_b] for i in at_a])
                continue
            turned = n > m
            scan, other = (y, x) if turned else (x, y)
            letters = np.unique(np.concatenate([scan.ravel(), other.ravel()]))
            number, has = np.searchsorted(letters, scan), _where(other, letters, np.uint32 if other.shape[1] < 32 else np.uint64)
            step = max(1, AT_ONCE // len(other))
            for k in range(0, len(scan), step):
                score = many(scan[k : k + step], other, has, number[k : k + step])
                yield (at_a, at_b[k : k + step], score.T) if turned else (at_a[k : k + step], at_b, score)
