"""String similarity in plain Python, for use inside Arrow functions; every function is symmetric."""

from __future__ import annotations


def jaro(a: str, b: str) -> float:
    """Jaro similarity: 1 for two equal strings, also empty ones; 0 without a common character in reach."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, boost: float = 0.1, above: float = 0.7) -> float:
    """Jaro with Winkler's bonus for up to four equal first letters, given only above a Jaro similarity of 0.7."""
    s = jaro(a, b)
    if s <= above:
        return s
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return s + n * boost * (1 - s)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours makes ``a`` of ``b``; equal strings count."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i + 1 : i - 1 if i else None : -1] and a[i + 2 :] == b[i + 2 :])
