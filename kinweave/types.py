"""Type predicates and typed null logic; everything here is safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = str | list[str] | tuple[str, ...] | None


def as_list(names: Names) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)


def resolve(df: DataFrame, subset: Names) -> list[str]:
    """``subset`` as a list, or all columns; a name that the frame lacks is a ValueError."""
    names = as_list(subset) or df.columns
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(lacking)}")
    return names


def q(name: str) -> Column:
    """The column of exactly that name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), (T.StringType, T.VarcharType, T.CharType))


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), (T.DoubleType, T.FloatType))


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has it."""
    c = q(name)
    return c.isNull() | F.isnan(c) if is_floating(df, name) else c.isNull()


def nan_to_null(df: DataFrame, name: str) -> Column:
    c = q(name)
    return F.when(~F.isnan(c), c) if is_floating(df, name) else c


def typed_literal(df: DataFrame, name: str, value: object) -> Column:
    """``value`` as a literal of the column's type, null where it cannot be one."""
    return F.lit(value).try_cast(kind(df, name))


def to_common(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns as they are if all have one type, else as strings."""
    kinds = {kind(df, n).simpleString() for n in names}
    return [q(n) for n in names] if len(kinds) < 2 else [q(n).cast("string") for n in names]
