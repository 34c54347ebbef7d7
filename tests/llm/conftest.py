import itertools

import pytest


@pytest.fixture
def closure():
    """Groups of ids by brute force: each id with the smallest that it reaches."""

    def of(pairs):
        links = {}
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x is not None:
                    links.setdefault(x, set())
                    if y is not None:
                        links[x].add(y)
        out = {}
        for x in links:
            seen, todo = {x}, [x]
            while todo:
                todo += [n for n in links[todo.pop()] if n not in seen and not seen.add(n)]
            out[x] = min(seen)
        return out

    return of


@pytest.fixture
def all_pairs():
    return lambda xs: itertools.combinations(sorted(xs), 2)
