"""Per-key results over skewed keys by eager aggregation through joins.

Both inputs are reduced to compact states by join key first (map-side, so a key that holds a third of all rows leaves at
most one state for each task), the states are joined, counts are multiplied and sums are scaled, and the result is rolled
up. No task ever holds the rows of a key, and no joined row is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

COUNT = "decimal(38,0)"


def key_states(df: DataFrame, key: Column, sums: dict[str, Column] | None = None, by: dict[str, Column] | None = None) -> DataFrame:
    """``key``, the columns ``by``, ``n`` (rows) and for each of ``sums`` its total ``<name>`` and ``<name>_n`` (rows with a value)."""
    aggs = [F.count("*").alias("n")]
    for name, value in (sums or {}).items():
        aggs += [F.sum(value).alias(name), F.count(value).alias(f"{name}_n")]
    return df.groupBy(key.alias("key"), *[c.alias(n) for n, c in (by or {}).items()]).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    left_by: dict[str, Column] | None = None,
    right_by: dict[str, Column] | None = None,
    roll_up: list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """What grouping the join of ``left`` and ``right`` gives, without making the join.

    Columns: ``key`` (or the columns ``roll_up``, of ``key`` and the ``by`` columns), ``n_left`` and ``n_right`` (rows of
    either input), ``n_pairs`` (joined rows, a decimal, as it can exceed 64 bits) and the sums over the joined rows. Rows
    with a null key join nothing; ``how="left"`` keeps left keys without a partner, with ``n_right`` 0 and one joined row
    for each left row, as a left join has. Sums skip nulls and are null where there is no value. Names given to ``sums``
    and ``by`` must differ; other columns of the inputs are not read, so clashing names do no harm. Rolled up, ``n_left``
    and ``n_right`` count an input's rows once for each combination of key and ``by`` columns of the other side.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how!r}")
    names = [*(left_sums or {}), *(right_sums or {}), *(left_by or {}), *(right_by or {})]
    if len({*names, "key", "n_left", "n_right", "n_pairs"}) < len(names) + 4:
        raise ValueError("names of sums and by columns must differ")
    a = key_states(left, left_key, left_sums, left_by).withColumnRenamed("n", "n_left").where("key is not null")
    b = key_states(right, right_key, right_sums, right_by).withColumnRenamed("n", "n_right").where("key is not null")
    return _join_states(a, b, list(left_sums or {}), list(right_sums or {}), roll_up if roll_up is not None else ["key"], how)


def _join_states(a: DataFrame, b: DataFrame, left_sums: list[str], right_sums: list[str], by: list[str], how: str) -> DataFrame:
    partners = F.greatest(F.coalesce("n_right", F.lit(0)), F.lit(1)) if how == "left" else F.col("n_right")
    out = [F.sum(F.col("n_left")).alias("n_left"), F.sum(F.coalesce("n_right", F.lit(0))).alias("n_right"), F.sum(F.col("n_left").cast(COUNT) * partners).cast(COUNT).alias("n_pairs")]
    out += [F.sum(F.col(s) * partners).alias(s) for s in left_sums]
    out += [F.sum(F.col(s) * F.col("n_left")).alias(s) for s in right_sums]
    return a.join(b, "key", how).groupBy(*by).agg(*out)


def heavy_keys(df: DataFrame, key: Column, partner: DataFrame, partner_key: Column, one_in: int) -> DataFrame:
    """``key``, ``n_rows`` and ``n_pairs`` (rows of its join with ``partner``) of the non-null keys with at least one in
    ``one_in`` of all rows.

    The states of ``df`` are written once; the row count of the table, null keys included, is rolled up from them, and the
    joined states give the rest: a key's rows are its joined rows by its partners, in whole numbers. A key without a partner
    counts as one joined row for each of its rows. An empty table has no heavy keys.
    """
    own = materialise(key_states(df, key).withColumnRenamed("n", "n_left"))
    other = key_states(partner, partner_key).withColumnRenamed("n", "n_right").where("key is not null")
    total = own.agg(F.sum("n_left").cast(COUNT).alias("total"))  # one row
    joined = _join_states(own.where("key is not null"), other, [], [], ["key"], "left")
    partners = F.greatest("n_right", F.lit(1))
    heavy = joined.crossJoin(F.broadcast(total)).where(F.col("n_pairs") * one_in >= F.col("total") * partners)
    return heavy.select("key", (F.col("n_pairs") / partners).cast("long").alias("n_rows"), "n_pairs")
