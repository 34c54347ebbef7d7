"""Cleaning verbs: ``DataFrame`` to ``DataFrame``, one projection each; they also work on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..types import Names, is_string, missing, q, resolve, typed_literal

JOIN_FROM = 200
MAX_BROADCAST_RULES = 100_000


def _each(df: DataFrame, subset: Names, f: Callable[[Column], Column], strings_only: bool = True) -> DataFrame:
    return df.withColumns({c: f(q(c)) for c in resolve(df, subset) if not strings_only or is_string(df, c)})


def standardise_white_space(df: DataFrame, subset: Names = None, level: str = "one", fill: str | None = None) -> DataFrame:
    return _each(df, subset, lambda c: text.white_space(c, level, fill))


def trim(df: DataFrame, subset: Names = None) -> DataFrame:
    return _each(df, subset, F.trim)


def standardise_case(df: DataFrame, subset: Names = None, style: str = "upper") -> DataFrame:
    return _each(df, subset, lambda c: text.case(c, style))


def remove_punct(df: DataFrame, subset: Names = None, keep: str | None = None) -> DataFrame:
    return _each(df, subset, lambda c: text.strip_punctuation(c, keep), strings_only=False)


def max_white_space(df: DataFrame, limit: int, subset: Names = None) -> DataFrame:
    return _each(df, subset, lambda c: text.limit_white_space(c, limit))


def max_hyphen(df: DataFrame, limit: int, subset: Names = None) -> DataFrame:
    return _each(df, subset, lambda c: text.limit_hyphens(c, limit))


def clean_hyphens(df: DataFrame, subset: Names = None) -> DataFrame:
    return _each(df, subset, text.clean_hyphens)


def group_single_characters(df: DataFrame, subset: Names = None, include_terminals: bool = False) -> DataFrame:
    return _each(df, subset, lambda c: text.join_single_letters(c, include_terminals))


def clean_forename(df: DataFrame, subset: Names = None) -> DataFrame:
    return _each(df, subset, text.clean_forename)


def clean_surname(df: DataFrame, subset: Names = None) -> DataFrame:
    return _each(df, subset, text.clean_surname)


def reg_replace(df: DataFrame, rules: dict[str, str], subset: Names = None) -> DataFrame:
    """``rules`` {replacement: pattern}, one after the other."""
    return _each(df, subset, lambda c: text.regex_chain(c, rules))


def add_leading_zeros(df: DataFrame, n: int, subset: Names = None) -> DataFrame:
    return _each(df, subset, lambda c: text.pad_zeros(c, n), strings_only=False)


def standardise_null(df: DataFrame, pattern: str, subset: Names = None, replace_with: str | None = None, regex: bool = True, like: bool = False) -> DataFrame:
    """Values that match ``pattern`` anywhere (or equal it, or are LIKE it) become ``replace_with``."""

    def new(c: Column) -> Column:
        s = c.cast("string")
        hit = s.rlike(pattern) if regex else s.like(pattern) if like else s == F.lit(pattern)
        return F.when(hit, F.lit(replace_with)).otherwise(c)

    return _each(df, subset, new)


def fill_nulls(df: DataFrame, fill: object, subset: Names = None) -> DataFrame:
    """Null and NaN become ``fill``, as a value of the column's type; where it cannot be one they stay."""
    return df.withColumns({c: F.when(missing(df, c), F.coalesce(typed_literal(df, c, fill), q(c))).otherwise(q(c)) for c in resolve(df, subset)})


def replace(df: DataFrame, subset: Names, rules: dict[str | None, str | None], use_join: bool = False, use_regex: bool = False, like: bool = False) -> DataFrame:
    """Whole values by ``rules`` {before: after}; the first rule that fits wins and no result is replaced again.

    By equality (a ``None`` key fits null), or with ``use_regex`` or ``like`` by pattern. ``use_join`` looks values up in
    a table of the rules instead of testing one after the other; many rules by equality do so anyway.
    """
    if use_join and use_regex:
        raise ValueError("a join cannot use regular expressions")
    if use_join and (None in rules or None in rules.values()):
        raise ValueError("a join cannot look up null")
    names = resolve(df, subset)
    if use_join or (len(rules) > JOIN_FROM and not use_regex and not like and None not in rules):
        if len(rules) > MAX_BROADCAST_RULES:
            raise ValueError(f"more than {MAX_BROADCAST_RULES} rules")
        look_up = df.sparkSession.createDataFrame(list(rules.items()), "__before string, __after string")
        out = df
        for c in names:
            found = out.join(F.broadcast(look_up), q(c).cast("string") == F.col("__before"), "left")
            out = found.select(*[(F.when(F.col("__before").isNotNull(), F.col("__after")).otherwise(q(x)) if x == c else q(x)).alias(x) for x in df.columns])
        return out

    def new(c: Column) -> Column:
        out = None
        for before, after in rules.items():
            hit = c.isNull() if before is None else c.rlike(before) if use_regex else c.like(before) if like else c == F.lit(before)
            out = F.when(hit, F.lit(after)) if out is None else out.when(hit, F.lit(after))
        return c if out is None else out.otherwise(c)

    return _each(df, names, new)


def align_forenames(df: DataFrame, first: str, middle: str, sep: str = " ") -> DataFrame:
    """Where the first name has several words, its first word stays and the others go before the middle name."""
    several = q(first).contains(sep)
    every = text.join_text([q(first), q(middle)], sep)
    parts = F.split(every, text.quoted(sep), 2)
    return df.withColumns({first: F.when(several, F.get(parts, F.lit(0))).otherwise(q(first)), middle: F.when(several, F.get(parts, F.lit(1))).otherwise(q(middle))})


def standardise_date(df: DataFrame, column: str, pattern: str = "dd-MM-yyyy", out: str = "yyyy-MM-dd", null_counts: bool = False) -> DataFrame | tuple[DataFrame, tuple[int, int]]:
    """A date's text in another pattern; what cannot be read is null. With ``null_counts`` also the nulls before and after."""
    new = dates.reformat(q(column), pattern, out)
    made = df.withColumn(column, new)
    if not null_counts:
        return made
    before, after = df.agg(F.count_if(q(column).isNull()), F.count_if(new.isNull())).first()
    return made, (before, after)


def age_at(df: DataFrame, column: str, pattern: str, *at: str) -> DataFrame:
    """``<column>_age_at_<date>``: whole years at each date (yyyy-MM-dd)."""
    actual = next(c for c in df.columns if c.lower() == column.lower())
    return df.withColumns({f"{column}_age_at_{d}": dates.age_at(dates.parsed(q(actual), pattern), F.lit(d).cast("timestamp")) for d in at})
