"""Flags on rows, their summary and their check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Names, as_list, missing, q, typed_literal

COMPARISONS = {"==": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def flag(df: DataFrame, ref_col: str, condition: str, value: object = None, column: str | None = None, alias: str | None = None, prefix: str = "FLAG", fill_null: bool | None = None) -> DataFrame:
    """A boolean column: ``ref_col`` compared with ``column`` or ``value``, or isNull, isNotNull (NaN as null), or regex.

    Its name is ``alias``, with ``prefix_`` before it, or made of the parts. A null result becomes ``fill_null``.
    """
    ref = q(ref_col)
    if condition in COMPARISONS:
        other = q(column) if column is not None else typed_literal(df, ref_col, value)
        made: Column = getattr(ref, COMPARISONS[condition])(other)
    elif condition == "isNull":
        made = missing(df, ref_col)
    elif condition == "isNotNull":
        made = ~missing(df, ref_col)
    elif condition == "regex":
        made = ref.cast("string").rlike(str(value))
    else:
        raise ValueError(f"no such condition: {condition}")
    if fill_null is not None:
        made = F.coalesce(made, F.lit(fill_null))
    name = alias or f"{ref_col}{condition}" + (f"_{column}" if column is not None else str(value) if value is not None else "")
    return df.withColumn(f"{prefix}_{name}" if prefix else name, made)


def flag_summary(df: DataFrame, flags: Names = None, prefix: str = "FLAG_") -> DataFrame:
    """A row for each flag: ``flag, true, false, rows, percent_true, percent_false``; null counts as false. One scan."""
    names = as_list(flags) or [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError("no flags")
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(q(f)).alias(f"n{i}") for i, f in enumerate(names)])
    long = one.select("rows", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"n{i}").alias("true")) for i, f in enumerate(names)])).alias("x")).select("x.flag", "x.true", (F.col("rows") - F.col("x.true")).alias("false"), "rows")
    return long.select("*", F.try_divide(F.col("true") * 100.0, "rows").alias("percent_true"), F.try_divide(F.col("false") * 100.0, "rows").alias("percent_false"))


def flag_check(df: DataFrame, prefix: str = "FLAG_", flags: Names = None, mode: str = "master", summary: bool = False, null_as: bool | None = False) -> DataFrame | tuple:
    """Adds ``flag_count`` (true flags) and ``FAIL`` (any true).

    ``mode``: master (all rows), pass, fail, or split (pass, fail). A null flag counts as ``null_as``; with None it makes
    ``FAIL`` null. With ``summary`` the flags' summary, with FAIL last, comes second.
    """
    names = as_list(flags) or [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError("no flags")
    if mode not in ("master", "pass", "fail", "split"):
        raise ValueError("mode is master, pass, fail or split")
    count = reduce(lambda a, b: a + b, [F.coalesce(q(f), F.lit(False)).cast("int") for f in names])
    values = [q(f) if null_as is None else F.coalesce(q(f), F.lit(null_as)) for f in names]
    fail = reduce(lambda a, b: a + b, [v.cast("int") for v in values]) > 0
    made = df.withColumns({"flag_count": count, "FAIL": fail})
    good, bad = made.where(~F.col("FAIL")), made.where(F.col("FAIL"))
    out = {"master": made, "pass": good, "fail": bad, "split": (good, bad)}[mode]
    if not summary:
        return out
    table = flag_summary(made, [*names, "FAIL"])
    return (*out, table) if mode == "split" else (out, table)
