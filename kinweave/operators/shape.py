"""Verbs on the shape of a frame: columns, rows and their union. Each makes one projection."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, dates, text
from ..types import Names, as_list, kind, missing, nan_to_null, q, resolve, to_common, typed_literal


def _criteria(startswith: str | None, endswith: str | None, contains: str | None, regex: str | None) -> list[Callable[[str], bool]]:
    out: list[Callable[[str], bool]] = []
    if startswith is not None:
        out.append(lambda c: c.startswith(startswith))
    if endswith is not None:
        out.append(lambda c: c.endswith(endswith))
    if contains is not None:
        out.append(lambda c: contains in c)
    if regex is not None:
        out.append(lambda c: re.search(regex, c) is not None)
    return out


def select(df: DataFrame, columns: Names = None, startswith: str | None = None, endswith: str | None = None, contains: str | None = None, regex: str | None = None, drop_duplicates: bool = True) -> DataFrame:
    """The columns that meet *all* criteria given; then distinct rows, unless told otherwise."""
    tests = _criteria(startswith, endswith, contains, regex)
    names = [c for c in resolve(df, columns) if all(t(c) for t in tests)]
    out = df.select(*map(q, names))
    return out.distinct() if drop_duplicates else out


def drop_columns(df: DataFrame, subset: Names = None, startswith: str | None = None, endswith: str | None = None, contains: str | None = None, regex: str | None = None, drop_duplicates: bool = True) -> DataFrame:
    """Without the columns that meet *any* criterion given; then distinct rows, unless told otherwise."""
    tests = _criteria(startswith, endswith, contains, regex)
    gone = set(as_list(subset)) | {c for c in df.columns if any(t(c) for t in tests)}
    out = df.select(*[q(c) for c in df.columns if c not in gone])
    return out.distinct() if drop_duplicates else out


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def prefix_columns(df: DataFrame, prefix: str, exclude: Names = None) -> DataFrame:
    kept = set(as_list(exclude))
    return df.toDF(*[c if c in kept else prefix + c for c in df.columns])


def suffix_columns(df: DataFrame, suffix: str, exclude: Names = None) -> DataFrame:
    kept = set(as_list(exclude))
    return df.toDF(*[c if c in kept else c + suffix for c in df.columns])


def literal_column(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def clone_column(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, q(source))


def cast_type(df: DataFrame, subset: Names = None, to: str = "string") -> DataFrame:
    """Casts columns of another type; what cannot be cast becomes null."""
    return df.withColumns({c: q(c).try_cast(to) for c in resolve(df, subset) if kind(df, c).simpleString() != to})


def coalesced(df: DataFrame, subset: Names = None, name: str = "coalesced_col", drop: bool = False) -> DataFrame:
    """The first non-null (and not NaN) value of the columns, in order; columns of several types are read as strings."""
    names = resolve(df, subset)
    common = {c: e for c, e in zip(names, to_common(df, names))}
    out = df.withColumn(name, F.coalesce(*[F.when(~missing(df, c), common[c]) for c in names]))
    return out.drop(*[c for c in names if c != name]) if drop else out


def cut_off(df: DataFrame, column: str, value: object, mode: str) -> DataFrame:
    """Rows on one side of a threshold: ``>=``, ``>``, ``<`` or ``<=``; null rows vanish."""
    c, v = q(column), F.lit(value)
    tests = {">=": c >= v, ">": c > v, "<": c < v, "<=": c <= v}
    if mode not in tests:
        raise ValueError(f"mode is one of {', '.join(tests)}")
    return df.where(tests[mode])


def drop_nulls(df: DataFrame, subset: Names = None, value: object = None) -> DataFrame:
    """Without rows in which any of the columns is null, NaN or ``value``."""
    names = resolve(df, subset)
    gone = [missing(df, c) for c in names]
    if value is not None:
        gone += [F.coalesce(q(c) == typed_literal(df, c, value), F.lit(False)) for c in names if not isinstance(kind(df, c), (T.ArrayType, T.StructType, T.MapType))]
    return df.where(~reduce(lambda a, b: a | b, gone))


def union_all(*frames: DataFrame, fill: object = None) -> DataFrame:
    """All rows by column name; columns in the order first seen, those that a frame lacks filled with ``fill``.

    Columns of several types become strings.
    """
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = {c: {kind(f, c).simpleString() for f in frames if c in f.columns} for c in names}
    as_type = {c: next(iter(k)) if len(k) == 1 else "string" for c, k in kinds.items()}
    full = [f.select(*[(q(c).cast(as_type[c]) if c in f.columns else F.lit(fill).try_cast(as_type[c])).alias(c) for c in names]) for f in frames]
    return reduce(DataFrame.unionByName, full)


def concat(df: DataFrame, name: str, columns: Names = None, sep: str = " ") -> DataFrame:
    return df.withColumn(name, text.join_text([nan_to_null(df, c).cast("string") for c in resolve(df, columns)], sep))


def substring(df: DataFrame, name: str, column: str, start: int, length: int, from_end: bool = False) -> DataFrame:
    return df.withColumn(name, text.substring(q(column), start, length, from_end))


def split(df: DataFrame, column: str, name: str | None = None, on: str = " ") -> DataFrame:
    """The column as an array of its parts between matches of the pattern ``on``."""
    return df.withColumn(name or column, F.split(q(column), on))


def index_select(df: DataFrame, column: str, name: str, index: int | tuple[int, int], sep: str = " ") -> DataFrame:
    return df.withColumn(name, arrays.pick(q(column), index, sep))


def explode(df: DataFrame, column: str, on: str = " ", retain: bool = False, drop_duplicates: bool = True, flag: str | None = None) -> DataFrame:
    """A row for each part of the column between matches of ``on``; other rows stay once. ``column`` (and ``flag``) come last.

    ``retain`` keeps the original rows as well; ``flag`` then tells new rows (true) from original ones (false).
    """
    c = q(column)
    parts = F.transform(F.split(c, on), lambda x: F.struct(x.alias("part"), F.lit(True).alias("new")))
    whole = F.array(F.struct(c.alias("part"), F.lit(False).alias("new")))
    made = F.when(c.rlike(on), F.concat(parts, whole) if retain else parts).otherwise(whole)
    rest = [q(x) for x in df.columns if x != column]
    out = df.select(*rest, F.explode(made).alias("__part")).select(*rest, F.col("__part.part").alias(column), *([F.col("__part.new").alias(flag)] if flag and retain else []))
    return out.distinct() if drop_duplicates else out


def date_diff(df: DataFrame, first: str, second: str, name: str = "Difference", pattern: str = "yyyy-MM-dd", units: str = "days", absolute: bool = True) -> DataFrame:
    return df.withColumn(name, dates.difference(dates.parsed(q(first), pattern), dates.parsed(q(second), pattern), units, absolute))


