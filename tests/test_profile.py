import datetime as dt
from decimal import Decimal

import pytest

from kinweave.operators import disclosure, profile

NAN = float("nan")


@pytest.fixture
def df(spark):
    texts = [None, None, "", "a", "bb", "ccc", "dd", "ee"]
    return spark.createDataFrame(list(zip(texts, [NAN, 1.0, 2.0, 3.0, 4.55, 5.0, 6.0, 7.0])), "colA string, colB double")


def test_describe_metrics(df):
    got = {r.variable: r.asDict() for r in profile.describe_metrics(df).collect()}
    assert got["colB"] == {"variable": "colB", "type": "double", "count": 8, "distinct": 8, "percent_distinct": 100.0, "null": 1, "percent_null": 12.5, "not_null": 7, "percent_not_null": 87.5}
    assert got["colA"]["null"] == 2 and got["colA"]["distinct"] == 6


def test_df_describe(df):
    got = {r.variable: r for r in profile.df_describe(df).collect()}
    b, a = got["colB"], got["colA"]
    assert (b.null, b.max, b.min, b.max_l_after_point, b.min_l_after_point, b.max_l_before_point) == (0, "NaN", "1.0", 2, 1, 1)
    assert (a.null, a.empty, a.percent_empty, a.min, a.min_l, a.max_l, a.max_l_before_point) == (2, 1, 12.5, None, 0, 3, None)
    assert len(profile.df_describe(df).columns) == 19
    assert profile.df_describe(df, approx_distinct=True).count() == 2
    assert profile.df_describe(df.limit(0)).first().percent_null is None


def test_df_describe_of_other_types(spark):
    df = spark.createDataFrame([(Decimal("-1.50"), -12, dt.datetime(2020, 1, 2), True, ["x"]), (Decimal("10.00"), 3, None, False, [])], "d decimal(10,2), i int, t timestamp, b boolean, a array<string>")
    got = {r.variable: r for r in profile.df_describe(df).collect()}
    assert (got["d"].max_l_before_point, got["d"].max_l_after_point, got["d"].min_l_after_point) == (2, 1, 1)
    assert (got["i"].min, got["i"].max) == ("-12", "3") and got["t"].max_l == 19 and got["b"].max_l == 5 and got["a"].distinct == 2


def test_value_counts(spark, rows):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 2), ("y", None)], "s string, n int")
    assert rows(profile.value_counts(df.select("s"))) == [("s", 1, "x", 2), ("s", 2, None, 1), ("s", 3, "y", 1)]
    assert rows(profile.value_counts(df.select("s"), 1, include_null=False, lowest=True)) == [("s", 1, "y", 1)]
    wide = profile.value_counts_wide(df, 4)
    assert wide.columns == ["s", "s_count", "n", "n_count"]
    assert [tuple(r) for r in wide.collect()] == [("x", 2, "2", 2), (None, 1, None, 1), ("y", 1, "1", 1), ("", 0, "", 0)]
    high, low = profile.high_low_counts(df, 2)
    assert [r.s for r in high.collect()] == ["x", "y"] and [r.s for r in low.collect()] == ["y", "x"]


def test_regex_match(spark):
    df = spark.createDataFrame([("a1", "b", "1"), ("a", "b", "2"), ("a", None, "3")], "a string, b string, g string")
    assert profile.regex_match(df, "[0-9]", cut_off=0.0) == ["a", "g"]
    assert profile.regex_match(df, "[0-9]", cut_off=0.6) == ["g"]


def test_outliers_and_percentiles(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,), (-400.0,), (None,), (NAN,)], "x double")
    got = disclosure.numerical_outliers(df, "x").orderBy("x").collect()
    assert [r.x for r in got] == [-400.0, 500.0] and got[0].Outlier.startswith("lower_bound = ") and got[1].Outlier.startswith("upper_bound = ")
    assert disclosure.numerical_outliers(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").count() == 0
    top = disclosure.numerical_percentiles(df, "x", "greater", "0.9")
    assert top.columns == ["x", "0.9_percentile_value"] and top.count() == 3
    with pytest.raises(ValueError):
        disclosure.numerical_percentiles(df, "x", "above", 0.9)


def test_dates_and_postcodes(spark):
    df = spark.createDataFrame([("1990-05-01",), ("1990/13/01",), ("x",), (None,)], "d string")
    assert [tuple(r) for r in disclosure.date_year_quarter(df, "d").collect()] == [("1990", "Q2"), ("input_error", "input_error"), ("input_error", "input_error"), (None, None)]
    pc = spark.createDataFrame([("NW1 2AB", 1)], "p string, k int")
    assert disclosure.postcode_level(pc, "p", "area").columns == ["k", "postcode_area"]


def test_identifying_strings(spark):
    df = spark.createDataFrame([("123456789012", "x"), ("123456789012", "x"), ("KZ66 ZYT", None), ("none", "ann@b.co"), ("none", None)], "a string, b string")
    found, table = disclosure.identifying_strings(df, ["UPRN", "UK Vehicle Reg", "email_1"])
    got = {(r.a, r.b): (r.a_identifier, r.b_identifier) for r in found.collect()}
    assert got == {("123456789012", "x"): ("UPRN", None), ("KZ66 ZYT", None): ("UK Vehicle Reg", None), ("none", "ann@b.co"): (None, "email_1")}
    assert table.count() == 3
    with pytest.raises(ValueError):
        disclosure.identifying_strings(df, ["none"])


def test_check_variables(spark):
    missing, extra = disclosure.check_variables(spark, spark.createDataFrame([(1, 2)], "Id int, b int"), ["ID", "c"])
    assert [r[0] for r in missing.collect()] == ["c"] and [r[0] for r in extra.collect()] == ["b"]


def test_exact_percentiles_by_brackets(spark, monkeypatch):
    import random

    import numpy as np

    draw = random.Random(4)
    for few in (10_000, 5):  # in one look, and by narrowing
        monkeypatch.setattr(disclosure, "FEW", few)
        values = [round(draw.gauss(0, 50), 2) for _ in range(3000)] + [7.5] * 900 + [None, float("nan")]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        shares = [0.0, 0.25, 0.333, 0.5, 0.9, 1.0]
        got = disclosure.exact_percentiles(df, df.x, shares)
        assert np.allclose(got, np.quantile([v for v in values if v is not None and v == v], shares), rtol=1e-12)
    assert disclosure.exact_percentiles(df.limit(0), df.x, [0.5]) == [None]
