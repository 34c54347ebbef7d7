"""Aggregates beside the rows they are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Names, as_list, missing, nan_to_null, q

MODES = ("count", "countDistinct", "min", "max", "sum")


def _aggregate(df: DataFrame, target: str, mode: str, drop_na: bool = False) -> Column:
    value = nan_to_null(df, target)
    if mode == "countDistinct":
        n = F.count_distinct(value if drop_na else q(target))
        return F.when(n > 0, n) if drop_na else n
    return {"count": F.count(q(target)), "min": F.min(value), "max": F.max(value), "sum": F.sum(value)}[mode]


def _beside(df: DataFrame, keys: list[str], made: Column, name: str) -> DataFrame:
    """``df`` with the aggregate of its group under ``name``. Groups are aggregated map-side and joined back, null keys too,
    so no task holds the rows of a group; adaptive execution broadcasts small results and splits heavy keys."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(made.alias(name))))  # one row
    groups = df.groupBy(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(made.alias(name))
    on = reduce(lambda x, y: x & y, [q(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return df.join(groups, on).drop(*[f"__k{i}" for i in range(len(keys))])


def window(df: DataFrame, keys: Names, target: str, mode: str, alias: str | None = None, drop_na: bool = False) -> DataFrame:
    """The aggregate of ``target`` over the rows with the same keys; null keys are a group like others.

    ``count`` adds its column last; the others put keys, aggregate, then the other columns. ``min``, ``max`` and ``sum``
    skip NaN as they skip null. ``countDistinct`` counts NaN as one value, unless ``drop_na``, which also makes the count
    of a group without values null.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    keys, name = as_list(keys), alias or mode
    made = _beside(df, keys, _aggregate(df, target, mode, drop_na), "__new")
    if mode == "count":
        return made.select(*[q(c) for c in df.columns if c != name], F.col("__new").alias(name))
    rest = [c for c in df.columns if c not in keys and c != name]
    return made.select(*map(q, keys), F.col("__new").alias(name), *map(q, rest))


def filter_window(df: DataFrame, keys: Names, target: str, mode: str, value: object = None, condition: bool = True) -> DataFrame:
    """Rows whose aggregate equals ``value`` (count, countDistinct), or whose target is the group's extremum (min, max).

    ``condition=False`` gives the other rows. Extrema compare null-safely, NaN as null; the keys then come first.
    """
    if mode in ("count", "countDistinct"):
        made = window(df, keys, target, mode, "__value")
        hit = F.col("__value") == F.lit(value)
        return made.where(hit if condition else ~hit).select(*map(q, df.columns))
    if mode not in ("min", "max"):
        raise ValueError("mode is count, countDistinct, min or max")
    keys = as_list(keys)
    made = _beside(df, keys, _aggregate(df, target, mode), "__value")
    clean = F.when(~missing(df, target), q(target))
    hit = clean.eqNullSafe(F.col("__value"))
    rest = [c for c in df.columns if c not in keys and c != target]
    out = [*map(q, keys), *([clean.alias(target)] if target not in keys else []), *map(q, rest)]
    return made.where(hit if condition else ~hit).select(*out)
