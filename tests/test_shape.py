import datetime as dt

import pytest

from kinweave.operators import shape


def test_select_and_drop(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "a", "b")], "identifier long, firstName string, `odd.first` string")
    assert shape.select(df, startswith="first").columns == ["firstName"]
    assert shape.select(df, contains="first", regex=r"\.").columns == ["odd.first"]
    assert shape.select(df, "identifier").count() == 1 and shape.select(df, "identifier", drop_duplicates=False).count() == 2
    assert shape.drop_columns(df, "identifier", endswith="first").columns == ["firstName"]
    with pytest.raises(ValueError):
        shape.select(df, "none")


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert shape.rename_columns(df, {"a": "x"}).columns == ["x", "b"]
    assert shape.prefix_columns(df, "p_", "a").columns == ["a", "p_b"]
    assert shape.suffix_columns(df, "_s").columns == ["a_s", "b_s"]
    assert shape.clone_column(df, "a", "c").first().c == 1
    made = shape.literal_column(df, "new", "v")
    assert made.first().new == "v" and not made.schema["new"].nullable


def test_cast_and_coalesce(spark, rows):
    df = spark.createDataFrame([("1", None), ("x", 5), (None, 6)], "a string, b bigint")
    assert rows(shape.cast_type(df, "a", "int").select("a")) == [(None,), (None,), (1,)]
    got = shape.coalesced(df, ["a", "b"], "c", drop=True)
    assert got.columns == ["c"] and rows(got) == [("1",), ("6",), ("x",)]
    nan = spark.createDataFrame([(float("nan"), 2.0)], "a double, b double")
    assert shape.coalesced(nan, name="c").first().c == 2.0


def test_cut_off(spark, rows):
    df = spark.createDataFrame([(1,), (3,), (4,), (None,)], "n int")
    assert [len(rows(shape.cut_off(df, "n", 3, m))) for m in (">=", ">", "<", "<=")] == [2, 1, 1, 2]
    dates = spark.createDataFrame([(dt.date(1997, 1, 15),), (dt.date(1990, 1, 1),)], "d date")
    assert shape.cut_off(dates, "d", "1997-01-15", ">=").count() == 1
    with pytest.raises(ValueError):
        shape.cut_off(df, "n", 3, "=")


def test_drop_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("five", 3.0), ("b", float("nan"))], "s string, x double")
    assert rows(shape.drop_nulls(df, "s", "five").select("s")) == [("a",), ("b",)]
    assert rows(shape.drop_nulls(df).select("s")) == [("a",), ("five",)]
    assert shape.drop_nulls(df.limit(0)).count() == 0


def test_union(spark, rows):
    a, b = spark.createDataFrame([("x", 1)], "k string, n int"), spark.createDataFrame([("y", "z")], "k string, m string")
    got = shape.union_all(a, b, fill="xd")
    assert got.columns == ["k", "n", "m"] and rows(got) == [("x", 1, "xd"), ("y", None, "z")]
    mixed = shape.union_all(a, spark.createDataFrame([("y", "two")], "k string, n string"))
    assert rows(mixed) == [("x", "1"), ("y", "two")]
    assert shape.union_all(a).collect() == a.collect()


def test_arrays_and_explode(spark, rows):
    df = spark.createDataFrame([("r", "a_b_c"), ("s", "d"), ("t", None)], "k string, v string")
    assert shape.split(df, "v", "parts", "_").first().parts == ["a", "b", "c"]
    assert shape.index_select(shape.split(df, "v", "p", "_"), "p", "one", 1).select("one").first().one == "b"
    assert rows(shape.explode(df, "v", "_")) == [("r", "a"), ("r", "b"), ("r", "c"), ("s", "d"), ("t", None)]
    kept = shape.explode(df, "v", "_", retain=True, flag="new")
    assert kept.columns == ["k", "v", "new"] and ("r", "a_b_c", False) in rows(kept) and ("s", "d", False) in rows(kept) and kept.count() == 6


def test_texts_of_frames(spark):
    df = spark.createDataFrame([("Josh", None, float("nan"))], "a string, b string, c double")
    assert shape.concat(df, "d", ["a", "b", "c"]).first().d == "Josh"
    assert shape.substring(df, "e", "a", 2, 2).first().e == "os"


@pytest.mark.parametrize("units, wanted", [("days", 14600.0), ("months", 470.97), ("years", 40.0)])
def test_date_diff(spark, units, wanted):
    df = spark.createDataFrame([("1983-11-11", "2023-11-01"), ("bad", "2023-11-01")], "a string, b string")
    got = [r.Difference for r in shape.date_diff(df, "a", "b", units=units).collect()]
    assert got == [wanted, None]


def test_date_diff_in_a_zone_with_summer_time(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.createDataFrame([("1983-07-01", "2023-01-01")], "a string, b string")
        assert shape.date_diff(df, "a", "b").first().Difference % 1 != 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
