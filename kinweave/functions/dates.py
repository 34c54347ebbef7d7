"""Dates written as text: parsing never fails, what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"days": 86_400, "months": 31 * 86_400, "years": 365 * 86_400}


def parsed(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c.cast("string"), F.lit(pattern))


def reformat(c: Column, pattern: str = "dd-MM-yyyy", out: str = "yyyy-MM-dd") -> Column:
    return F.date_format(parsed(c, pattern), out)


def age_at(born: Column, date: Column) -> Column:
    """Whole years from ``born`` to ``date``, towards zero."""
    return (F.months_between(date, born) / 12).cast("int")


def difference(a: Column, b: Column, units: str = "days", absolute: bool = True) -> Column:
    """(a - b) of two timestamps, to two decimals; a month has 31 days, a year 365."""
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    out = F.round((F.unix_timestamp(a) - F.unix_timestamp(b)) / UNITS[units], 2)
    return F.abs(out) if absolute else out


def year_and_quarter(c: Column) -> tuple[Column, Column]:
    """Year and Q1..Q4 of a date whose digits are year, month, day; ``input_error`` for any other text, null for null."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    month = F.substring(digits, 5, 2)
    good = (F.length(digits) == 8) & month.rlike("^(0[1-9]|1[0-2])$")
    quarter = F.concat(F.lit("Q"), F.ceil(month.try_cast("int") / 3).cast("string"))
    error = F.when(c.isNotNull(), F.lit("input_error"))
    return F.when(good, F.substring(digits, 1, 4)).otherwise(error), F.when(good, quarter).otherwise(error)
