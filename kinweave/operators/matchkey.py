"""Match keys: declared comparisons between a left and a right frame, compiled to one join condition."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import missing, q

Make = Callable[[Column], Column]


@dataclass(frozen=True)
class Comparison:
    """One condition: the columns it needs on either side, how it is made of the two frames, and how it is described."""

    left: tuple[str, ...]
    right: tuple[str, ...]
    make: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    text: str
    equi: bool
    prune: bool = True
    own: Make | None = None  #: of an equality: what of a column must be equal on either side
    score: tuple[Callable[[Column, Column], Column], float] | None = None  #: of a similarity, its function and what it must exceed


def eq(left: str, right: str | None = None) -> Comparison:
    """Equality of a left and a right column."""
    r = right or left
    return Comparison((left,), (r,), lambda a, b: a(left) == b(r), f"{left}={r}", True, own=lambda c: c)


def eq_fn(left: str, right: str | None, fn: Make, name: str) -> Comparison:
    """Equality of the same expression of either column, such as an initial or a sound."""
    r = right or left
    return Comparison((left,), (r,), lambda a, b: fn(a(left)) == fn(b(r)), f"{name}({left})={name}({r})", True, own=fn)


def score(fn: Callable[[Column, Column], Column], left: str, right: str | None, above: float, name: str) -> Comparison:
    """A similarity score of the two columns above a threshold."""
    r = right or left
    return Comparison((left,), (r,), lambda a, b: fn(a(left), b(r)) > above, f"{name}({left},{r})>{above}", False, score=(fn, above))


def any_of(*parts: Comparison) -> Comparison:
    """At least one of several comparisons; rows with nulls in some of their columns are not left out."""
    columns = lambda side: tuple(dict.fromkeys(c for p in parts for c in getattr(p, side)))
    return Comparison(columns("left"), columns("right"), lambda a, b: reduce(lambda x, y: x | y, [p.make(a, b) for p in parts]), "(" + "OR".join(p.text for p in parts) + ")", False, False)


class MatchKey:
    """Comparisons that must all hold. At least one should be an equality, or the join has to try every pair."""

    def __init__(self, *comparisons: Comparison) -> None:
        if not comparisons:
            raise ValueError("a match key needs a comparison")
        if not any(c.equi for c in comparisons):
            warnings.warn("a match key without equality compares every pair of rows", stacklevel=2)
        self.comparisons = comparisons

    def columns(self, side: str) -> list[str]:
        """The columns of ``left`` or ``right`` that the key compares."""
        return list(dict.fromkeys(c for x in self.comparisons for c in getattr(x, side)))

    def condition(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        return reduce(lambda a, b: a & b, [c.make(left, right) for c in self.comparisons])

    def equalities(self) -> list[Comparison]:
        """Comparisons that say of one column on either side what must be equal."""
        return [c for c in self.comparisons if c.own]

    def rest(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column | None:
        """The condition without :meth:`equalities`; None if there is no other."""
        others = [c.make(left, right) for c in self.comparisons if not c.own]
        return reduce(lambda a, b: a & b, others) if others else None

    def prune(self, df: DataFrame, side: str) -> DataFrame:
        """Rows without a null (or NaN) in a column that must be compared."""
        names = list(dict.fromkeys(c for x in self.comparisons if x.prune for c in getattr(x, side)))
        return df.where(~reduce(lambda a, b: a | b, [missing(df, c) for c in names])) if names else df

    def __str__(self) -> str:
        return "[" + ",".join(c.text for c in self.comparisons) + "]"


def sides(df_l: DataFrame, df_r: DataFrame, columns_l: list[str], columns_r: list[str]) -> tuple[DataFrame, DataFrame, Callable[[str], Column], Callable[[str], Column]]:
    """The two frames pruned to some columns, under names that cannot clash, and how to reach them."""
    l = df_l.select(*[q(c).alias(f"__l_{c}") for c in dict.fromkeys(columns_l)])
    r = df_r.select(*[q(c).alias(f"__r_{c}") for c in dict.fromkeys(columns_r)])
    return l, r, lambda c: q(f"__l_{c}"), lambda c: q(f"__r_{c}")


def matchkey_dataframe(spark, keys: list[MatchKey]) -> DataFrame:
    """``matchkey`` (from 1) and ``description``."""
    return spark.createDataFrame([(i, str(k)) for i, k in enumerate(keys, 1)], "matchkey bigint, description string")


def prefix_of(n: int) -> Make:
    return lambda c: F.substring(c, 1, n)


def suffix_of(n: int) -> Make:
    return lambda c: F.substring(c, -n, n)
