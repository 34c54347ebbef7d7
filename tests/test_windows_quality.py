import pytest

from kinweave.operators import quality, windows

NAN = float("nan")


@pytest.fixture
def df(spark):
    return spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", None), (None, 3.0), (None, 3.0), ("b", None), ("c", NAN)], "k string, x double")


def made(frame, name="made"):
    return {(r.k, str(r.x)): r[name] for r in frame.collect()}


def test_window_modes(df):
    assert made(windows.window(df, "k", "x", "min", "made")) == {("a", "1.0"): 1.0, ("a", "nan"): 1.0, ("a", "None"): 1.0, (None, "3.0"): 3.0, ("b", "None"): None, ("c", "nan"): None}
    got = made(windows.window(df, "k", "x", "sum", "made"))
    assert got[(None, "3.0")] == 6.0 and got[("b", "None")] is None and got[("c", "nan")] is None and got[("a", "nan")] == 1.0
    assert made(windows.window(df, "k", "x", "count", "made"))[("a", "None")] == 2
    assert windows.window(df, "k", "x", "count", "made").columns == ["k", "x", "made"]
    assert windows.window(df, "k", "x", "max", "made").columns == ["k", "made", "x"]


def test_window_distinct(df):
    got = made(windows.window(df, "k", "x", "countDistinct", "made"))
    assert (got[("a", "1.0")], got[(None, "3.0")], got[("b", "None")], got[("c", "nan")]) == (2, 1, 0, 1)
    got = made(windows.window(df, "k", "x", "countDistinct", "made", drop_na=True))
    assert (got[("a", "1.0")], got[("b", "None")], got[("c", "nan")]) == (1, None, None)


def test_window_names_that_clash(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, count int, value int")
    assert windows.window(df, "k", "value", "count", "n").first().n == 1
    assert windows.filter_window(df, "k", "count", "count", 1).collect() == df.collect()
    with pytest.raises(ValueError):
        windows.window(df, "k", "value", "median")


@pytest.mark.parametrize("mode, value", [("count", 2), ("countDistinct", 1), ("min", None), ("max", None)])
def test_filter_window_parts_the_rows(df, rows, mode, value):
    yes, no = (windows.filter_window(df, "k", "x", mode, value, c) for c in (True, False))
    assert yes.count() + no.count() == df.count()
    assert windows.filter_window(df.limit(0), "k", "x", mode, value).count() == 0


def test_filter_window_extremes(df, rows):
    assert rows(windows.filter_window(df, "k", "x", "max")) == [(None, 3.0), (None, 3.0), ("a", 1.0), ("b", None), ("c", None)]


def test_flags(spark):
    df = spark.createDataFrame([("M", 1.0, 2), (None, NAN, None), ("F", None, 1)], "s string, x double, n int")
    out = quality.flag(quality.flag(df, "s", "==", "M"), "x", ">", column="n", fill_null=False)
    out = quality.flag(quality.flag(out, "x", "isNull"), "x", "isNotNull", prefix="OK")
    out = quality.flag(quality.flag(out, "s", "regex", "^[MF]$", alias="sex"), "n", "==", "two")
    assert out.columns[3:] == ["FLAG_s==M", "FLAG_x>_n", "FLAG_xisNull", "OK_xisNotNull", "FLAG_sex", "FLAG_n==two"]
    assert [tuple(r)[3:] for r in out.collect()] == [(True, False, False, True, True, None), (None, False, True, False, None, None), (False, False, True, False, True, None)]
    with pytest.raises(ValueError):
        quality.flag(df, "s", "~", "M")


def test_flag_summary_and_check(spark):
    df = spark.createDataFrame([(True, None), (False, False), (None, True), (False, None)], "FLAG_a boolean, FLAG_b boolean")
    got = {r.flag: tuple(r)[1:] for r in quality.flag_summary(df).collect()}
    assert got == {"FLAG_a": (1, 3, 4, 25.0, 75.0), "FLAG_b": (1, 3, 4, 25.0, 75.0)}
    out, table = quality.flag_check(df, summary=True)
    assert [(r.flag_count, r.FAIL) for r in out.collect()] == [(1, True), (0, False), (1, True), (0, False)]
    assert [r.flag for r in table.collect()] == ["FLAG_a", "FLAG_b", "FAIL"]
    good, bad = quality.flag_check(df, mode="split")
    assert (good.count(), bad.count()) == (2, 2)
    assert [r.FAIL for r in quality.flag_check(df, null_as=None).collect()] == [None, False, None, None]
    assert quality.flag_summary(df.limit(0)).first().percent_true is None
    for f in (quality.flag_check, quality.flag_summary):
        with pytest.raises(ValueError):
            f(spark.range(1))
    with pytest.raises(ValueError):
        quality.flag_check(df, mode="some")
