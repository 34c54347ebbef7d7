"""Profiles of whole frames: one aggregate over one scan, a row for each column in the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import is_floating, is_string, kind, missing, q


def _rows(df: DataFrame, metrics: dict[str, dict[str, Column]], types: dict[str, str]) -> DataFrame:
    """One aggregate of all ``metrics`` {variable: {metric: aggregate}}, turned into a row for each variable."""
    flat = [(v, m, a) for v, ms in metrics.items() for m, a in ms.items()]
    one = df.agg(*[a.alias(f"__{i}") for i, (_, _, a) in enumerate(flat)])
    at = {(v, m): F.col(f"__{i}").cast(types[m]) for i, (v, m, _) in enumerate(flat)}
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), *[at[v, m].alias(m) for m in ms]) for v, ms in metrics.items()])
    return one.select(F.inline(rows))


def _distinct(df: DataFrame) -> DataFrame:
    """``variable, distinct``: distinct values of each column. Values are combined map-side by (column, value) and then
    counted; columns of a nested type, whose values have no text, are counted as they are."""
    nested = [c for c in df.columns if isinstance(kind(df, c), (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    text = lambda c: F.hex(q(c)) if isinstance(kind(df, c), T.BinaryType) else (q(c) + 0.0 if is_floating(df, c) else q(c)).cast("string")
    none = df.sparkSession.createDataFrame([(c, 0) for c in df.columns], "variable string, n long")
    parts = [none]
    if plain := [c for c in df.columns if c not in nested]:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), text(c).alias("value")) for c in plain]))
        values = df.select(pairs.alias("x")).where("x.value is not null").groupBy("x.variable", "x.value").agg(F.lit(1))
        parts.append(values.groupBy("variable").agg(F.count("*").alias("n")))
    parts += [df.agg(F.lit(c).alias("variable"), F.count_distinct(q(c)).alias("n")) for c in nested]
    return reduce(DataFrame.unionByName, parts).groupBy("variable").agg(F.sum("n").alias("distinct"))  # a row for each column


def _share(part: str) -> Column:
    return F.try_divide(F.col(part) * 100.0, "__rows")


def describe_metrics(df: DataFrame) -> DataFrame:
    """``variable, type, count, distinct, percent_distinct, null, percent_null, not_null, percent_not_null``.

    NaN counts as null, and also as one distinct value. An empty frame has null percentages.
    """
    metrics = {c: {"__rows": F.count("*"), "null": F.count_if(missing(df, c))} for c in df.columns}
    types = {"__rows": "bigint", "null": "bigint"}
    made = _rows(df, metrics, types).join(F.broadcast(_distinct(df)), "variable").withColumn("type", reduce(lambda e, c: e.when(F.col("variable") == c, kind(df, c).simpleString()), df.columns, F.when(F.lit(False), "")))
    made = made.withColumn("not_null", F.col("__rows") - F.col("null"))
    return made.select("variable", "type", F.col("__rows").alias("count"), "distinct", _share("distinct").alias("percent_distinct"), "null", _share("null").alias("percent_null"), "not_null", _share("not_null").alias("percent_not_null"))


def _digits(c: Column) -> tuple[Column, Column]:
    """Characters before the point, a minus sign counted, and digits after it, trailing zeros not counted but at least one."""
    plain = F.call_function("format_number", c, F.lit("0.##############################"))
    whole = F.substring_index(plain, ".", 1)
    rest = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise(F.lit(""))
    return F.length(whole), F.greatest(F.length(F.rtrim(rest, F.lit("0"))), F.lit(1))


def df_describe(df: DataFrame, approx_distinct: bool = False, rsd: float = 0.05) -> DataFrame:
    """The long profile, in this order: variable, type, row_count, distinct, percent_distinct, null, percent_null, not_null,
    percent_not_null, empty, percent_empty, min, max, min_l, max_l, max_l_before_point, min_l_before_point,
    max_l_after_point, min_l_after_point.

    Null means null, NaN is a value (the largest). ``min`` and ``max`` are text, null for text columns; ``empty`` is blank
    text; lengths are of texts, digits of double and decimal columns. Distinct values are counted in a second scan, or with
    ``approx_distinct`` by a sketch for each column in the first.
    """
    types = dict.fromkeys(("__rows", "distinct", "null", "empty", "min_l", "max_l", "max_l_before_point", "min_l_before_point", "max_l_after_point", "min_l_after_point"), "bigint") | {"min": "string", "max": "string"}
    nothing = F.max(F.lit(None).cast("bigint"))
    metrics: dict[str, dict[str, Column]] = {}
    for c in df.columns:
        t, v = kind(df, c), q(c)
        ordered = not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.StringType))
        text = v if is_string(df, c) else v.cast("string") if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) else None
        m = {
            "__rows": F.count("*"),
            "distinct": F.approx_count_distinct(v, rsd) if approx_distinct else nothing,
            "null": F.count_if(v.isNull()),
            "empty": F.count_if(v.rlike(r"^\s*$")) if is_string(df, c) else F.count_if(F.lit(False)),
            "min": F.min(v) if ordered else F.max(F.lit(None).cast("string")),
            "max": F.max(v) if ordered else F.max(F.lit(None).cast("string")),
            "min_l": F.min(F.length(text)) if text is not None else nothing,
            "max_l": F.max(F.length(text)) if text is not None else nothing,
        }
        if isinstance(t, (T.DoubleType, T.DecimalType)):
            before, after = _digits(F.when(~F.isnan(v), v) if is_floating(df, c) else v)
            m |= {"max_l_before_point": F.max(before), "min_l_before_point": F.min(before), "max_l_after_point": F.max(after), "min_l_after_point": F.min(after)}
        else:
            m |= dict.fromkeys(("max_l_before_point", "min_l_before_point", "max_l_after_point", "min_l_after_point"), nothing)
        metrics[c] = m
    made = _rows(df, metrics, types)
    if not approx_distinct:
        made = made.drop("distinct").join(F.broadcast(_distinct(df)), "variable")
    kinds = reduce(lambda e, c: e.when(F.col("variable") == c, kind(df, c).simpleString()), df.columns, F.when(F.lit(False), ""))
    made = made.withColumns({"type": kinds, "not_null": F.col("__rows") - F.col("null")})
    return made.select(
        "variable", "type", F.col("__rows").alias("row_count"), "distinct", _share("distinct").alias("percent_distinct"), "null", _share("null").alias("percent_null"), "not_null", _share("not_null").alias("percent_not_null"), "empty", _share("empty").alias("percent_empty"),
        "min", "max", "min_l", "max_l", "max_l_before_point", "min_l_before_point", "max_l_after_point", "min_l_after_point",
    )


def value_counts(df: DataFrame, limit: int = 20, include_null: bool = True, lowest: bool = False) -> DataFrame:
    """``variable, rank, value, count``: the most (or least) frequent values of every column, as text; ties by value.

    One pass: (variable, value) is counted, then ranked within the variable, with the ranking's limit applied before the
    shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), q(c).cast("string").alias("value")) for c in df.columns]))
    counts = df.select(pairs.alias("x")).groupBy("x.variable", "x.value").count()
    if not include_null:
        counts = counts.where("value is not null")
    order = Window.partitionBy("variable").orderBy(F.col("count").asc() if lowest else F.col("count").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("variable", "rank", "value", "count")


def value_counts_wide(df: DataFrame, limit: int = 20, include_null: bool = True, lowest: bool = False) -> DataFrame:
    """The same side by side, ``<c>`` and ``<c>_count``, padded to ``limit`` rows with '' and 0."""
    long = value_counts(df, limit, include_null, lowest)
    out = df.sparkSession.range(1, limit + 1).select(F.col("id").cast("int").alias("rank"))
    wide = long.groupBy("rank").agg(*[F.first(F.when(F.col("variable") == c, F.struct("value", "count")), ignorenulls=True).alias(f"__{i}") for i, c in enumerate(df.columns)])
    full = out.join(wide, "rank", "left")
    cells = [x for i, c in enumerate(df.columns) for x in (F.when(F.col(f"__{i}").isNull(), F.lit("")).otherwise(F.col(f"__{i}.value")).alias(c), F.coalesce(F.col(f"__{i}.count"), F.lit(0)).alias(f"{c}_count"))]
    return full.orderBy("rank").select(*cells)


def high_low_counts(df: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The most and the least frequent non-null values, side by side."""
    return value_counts_wide(df, limit, False), value_counts_wide(df, limit, False, True)


def regex_match(df: DataFrame, pattern: str, limit: int | None = 10_000, cut_off: float = 0.75) -> list[str]:
    """Columns of which at least that share of the first ``limit`` rows match; columns that never match are not among them."""
    some = df if limit is None else df.limit(limit)
    one = some.agg(F.count("*").alias("__rows"), *[F.count_if(q(c).cast("string").rlike(pattern)).alias(f"__{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if one[f"__{i}"] and one[f"__{i}"] / one["__rows"] >= cut_off]
