"""Checks before data are passed on: outliers, extreme values, identifying texts, coarser dates and postcodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, places
from ..types import nan_to_null, q

#: Accuracy of the sketch and half the width of a bracket of ranks; values that a driver may look through.
SKETCH, BRACKET, FEW = 10_000, 0.001, 10_000
#: Patterns of identifiers.
IDENTIFIERS = {
    "NHS No": r"^\d{10}$",
    "NIN": r"^\s*[a-zA-Z]{2}(?:\s*\d\s*){6}[a-dA-D]{1}?\s*$",
    "UK phone no": r"^(?:0|\+?44)(?:\d\s?){9,10}$",
    "UK Child Benefit": r"^[A-Z]{3}\d{8}$",
    "UK Passport": r"[0-9]{10}[a-z]{3}[0-9]{7}[U,M,F]{1}[0-9]{9}",
    "UK VAT": r"^\d{9}$",
    "UK Vehicle Reg": r"^([A-Z]{3}\s?(\d{3}|\d{2}|\d{1})\s?[A-Z])|([A-Z]\s?(\d{3}|\d{2}|\d{1})\s?[A-Z]{3})|(([A-HK-PRSVWY][A-HJ-PR-Y])\s?([0][2-9]|[1-9][0-9])\s?[A-HJ-PR-Z]{3})$",
    "UPRN": r"^[0-9]{12}$",
    "email_1": r"^[^\.\s][\w\-\.{2,}]+@([\w-]+\.)+[\w-]{2,}$",
    "filepath_1": r"^(?:[\w]\:|\/)(\/[a-z_\-\s0-9\.]+)+\.(txt|gif|pdf|doc|docx|xls|xlsx|js)$",
    "free_text_1": r"[a-zA-Z0-9\s]",
}


def exact_percentiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Percentiles of a double column, interpolated between ranks as F.percentile does; null without values.

    A sketch of bounded size brackets the ranks, counts place the bracket, and only the distinct values within it are
    counted. If there are more than a driver should hold, the bracket is narrowed by a sketch of its own rows, so nothing
    grows with the rows but the scans.
    """
    v = df.select(value.alias("v")).where("v is not null and not isnan(v)")
    around = lambda p: [max(0.0, p - BRACKET), min(1.0, p + BRACKET)]
    n, ends = v.agg(F.count("*"), F.percentile_approx("v", [x for s in shares for x in around(s)], SKETCH)).first()
    if not n:
        return [None] * len(shares)
    brackets = [(ends[2 * k], ends[2 * k + 1]) for k in range(len(shares))]
    out = []
    for share, counts in zip(shares, _within(v, brackets)):
        at = share * (n - 1)
        low = int(at)
        a, b = _ranked(v, n, low, min(low + 1, n - 1), *counts)
        out.append(a if at == low else a + (b - a) * (at - low))
    return out


def _within(rows: DataFrame, brackets: list[tuple[float, float]]) -> list[tuple[float, float, int, int, int]]:
    """Of every bracket: its ends, how many rows lie below and in it, and about how many values."""
    inside = [F.col("v").between(lo, hi) for lo, hi in brackets]
    one = rows.agg(*[x for (lo, _), i in zip(brackets, inside) for x in (F.count_if(F.col("v") < lo), F.count_if(i), F.approx_count_distinct(F.when(i, F.col("v"))))]).first()
    return [(*b, *one[3 * k : 3 * k + 3]) for k, b in enumerate(brackets)]


def _ranked(rows: DataFrame, n: int, low: int, high: int, lo: float, hi: float, under: int, within: int, kinds: int) -> tuple[float, float]:
    """The values at two neighbouring ranks of ``n`` rows, given a bracket and what it holds."""
    below = 0
    while True:
        if not (below + under <= low and high < below + under + within):  # the ranks are at an edge of the bracket, or beyond
            lo, hi = rows.agg(F.min("v"), F.max("v")).first()
            under, within = 0, n
        if kinds <= FEW or within == n:
            found, seen = [], below + under
            for r in rows.where(F.col("v").between(lo, hi)).groupBy("v").count().orderBy("v").toLocalIterator():
                seen += r["count"]
                found += [r.v] * ((low < seen and not found) + (high < seen))
                if len(found) >= 2:
                    return found[0], found[1]
        rows, below, n = rows.where(F.col("v").between(lo, hi)), below + under, within
        p = (low - below) / max(1, n - 1)
        lo, hi = rows.agg(F.percentile_approx("v", [max(0.0, p - BRACKET), min(1.0, p + BRACKET)], SKETCH)).first()[0]
        _, _, under, within, kinds = _within(rows, [(lo, hi)])[0]


def numerical_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows more than 1.5 interquartile ranges outside the quartiles; ``Outlier`` names the bound. Quartiles interpolate and
    are worked out at once."""
    v = nan_to_null(df, column).cast("double")
    a, b = exact_percentiles(df, v, [0.25, 0.75])
    lo, hi = (None, None) if a is None else (a - 1.5 * (b - a), b + 1.5 * (b - a))
    bound = lambda x: F.lit(x).cast("double")
    label = F.when(v < bound(lo), F.concat(F.lit("lower_bound = "), bound(lo).cast("string"))).when(v > bound(hi), F.concat(F.lit("upper_bound = "), bound(hi).cast("string")))
    return df.withColumn("Outlier", label).where(F.col("Outlier").isNotNull())


def numerical_percentiles(df: DataFrame, column: str, side: str, percentile: float | str) -> DataFrame:
    """Rows strictly ``less`` or ``greater`` than a percentile (0 to 1), with its value in ``<p>_percentile_value``; the
    percentile is worked out at once."""
    if side not in ("less", "greater"):
        raise ValueError("side is less or greater")
    v, name = nan_to_null(df, column).cast("double"), f"{percentile}_percentile_value"
    made = df.withColumn(name, F.lit(exact_percentiles(df, v, [float(percentile)])[0]).cast("double"))
    return made.where(v < q(name) if side == "less" else v > q(name))


def date_year_quarter(df: DataFrame, column: str) -> DataFrame:
    """``<column>_year`` and ``<column>_year_quarter`` instead of the date."""
    year, quarter = dates.year_and_quarter(q(column))
    return df.withColumns({f"{column}_year": year, f"{column}_year_quarter": quarter}).drop(column)


def postcode_level(df: DataFrame, column: str, level: str) -> DataFrame:
    """``postcode_<level>`` (area, district or sector) instead of the postcode."""
    return df.withColumn(f"postcode_{level}", places.postcode_part(q(column), level)).drop(column)


def identifying_strings(df: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct rows in which a column fits an identifier's pattern, with ``<column>_identifier`` (the first that fits, in
    the order asked for), and the table of the patterns asked for."""
    names = list(IDENTIFIERS) if required is None else required
    if unknown := [n for n in names if n not in IDENTIFIERS]:
        raise ValueError(f"no such identifiers: {', '.join(unknown)}")
    found = {f"{c}_identifier": reduce(lambda e, n: e.when(q(c).cast("string").rlike(IDENTIFIERS[n]), n), names, F.when(F.lit(False), F.lit(""))) for c in df.columns}
    rows = df.distinct().withColumns(found).where(F.coalesce(*map(q, found)).isNotNull())
    return rows, df.sparkSession.createDataFrame([(n, IDENTIFIERS[n]) for n in names], "identifier string, regex string")


def check_variables(spark: SparkSession, df: DataFrame, approved: list[str]) -> tuple[DataFrame, DataFrame]:
    """Approved variables that the frame lacks, and its variables that are not approved; letter case does not matter."""
    have, may = {c.lower() for c in df.columns}, {a.lower() for a in approved}
    lacking, extra = [a for a in approved if a.lower() not in have], [c for c in df.columns if c.lower() not in may]
    return spark.createDataFrame([(x,) for x in lacking], "missing_variable string"), spark.createDataFrame([(x,) for x in extra], "unapproved_variable string")
