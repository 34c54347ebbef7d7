import pytest

from kinweave.operators import clean


def column(df, c):
    return [r[c] for r in df.collect()]


def test_string_columns_only(spark):
    df = spark.createDataFrame([(" a ", 1)], "s string, n int")
    assert clean.trim(df).first() == ("a", 1)
    assert clean.standardise_case(df).first() == (" A ", 1)
    assert clean.remove_punct(df).first() == (" a ", "1")


def test_nulls(spark):
    df = spark.createDataFrame([("", 1.0), ("-999", float("nan")), ("x", None), (None, 2.0)], "s string, x double")
    assert column(clean.standardise_null(df, "^$|^-999$", "s"), "s") == [None, None, "x", None]
    assert column(clean.standardise_null(df, "-9%", "s", regex=False, like=True), "s") == ["", None, "x", None]
    assert column(clean.standardise_null(df, "-9%", "s", regex=False), "s") == ["", "-999", "x", None]
    filled = clean.fill_nulls(df, 0)
    assert column(filled, "s") == ["", "-999", "x", "0"] and column(filled, "x") == [1.0, 0.0, 0.0, 2.0]


def test_fill_that_does_not_fit_the_type(spark):
    assert column(clean.fill_nulls(spark.createDataFrame([(None,), (1,)], "n int"), "none"), "n") == [None, 1]


def test_replace(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a%",), (None,)], "s string")
    assert column(clean.replace(df, "s", {"a": "b", "b": "c"}), "s") == ["b", "c", "a%", None]
    assert column(clean.replace(df, "s", {"a%": "x"}, like=True), "s") == ["x", "b", "x", None]
    assert column(clean.replace(df, "s", {"a%": "x"}), "s") == ["a", "b", "x", None]
    assert column(clean.replace(df, "s", {"^a": None}, use_regex=True), "s") == [None, "b", None, None]
    assert column(clean.replace(df, "s", {None: "n"}), "s") == ["a", "b", "a%", "n"]
    assert sorted(map(str, column(clean.replace(df, "s", {"a": "b", "b": "c"}, use_join=True), "s"))) == ["None", "a%", "b", "c"]
    many = {f"k{i}": f"v{i}" for i in range(300)} | {"a": "z"}
    assert "z" in column(clean.replace(df, "s", many), "s")
    for bad in ({"use_join": True, "use_regex": True}, {"use_join": True}):
        with pytest.raises(ValueError):
            clean.replace(df, "s", {None: "n"}, **bad)


def test_align_forenames(spark):
    df = spark.createDataFrame([("Dan James", "Jim"), ("Ann", "May"), ("Jo Ann", None), (None, "x")], "f string, m string")
    assert [tuple(r) for r in clean.align_forenames(df, "f", "m").collect()] == [("Dan", "James Jim"), ("Ann", "May"), ("Jo", "Ann"), (None, "x")]


def test_dates(spark):
    df = spark.createDataFrame([("14-05-1996",), ("32-01-2020",), ("x",), (None,), ("01-02-1880",)], "d string")
    assert column(clean.standardise_date(df, "d"), "d") == ["1996-05-14", None, None, None, "1880-02-01"]
    assert clean.standardise_date(df, "d", null_counts=True)[1] == (1, 3)
    ages = clean.age_at(spark.createDataFrame([("14/05/1983",), ("bad",), ("01/01/2030",)], "DOB string"), "dob", "dd/MM/yyyy", "2022-11-03", "1993-01-01")
    assert column(ages, "dob_age_at_2022-11-03") == [39, None, -7] and column(ages, "dob_age_at_1993-01-01") == [9, None, -37]


def test_other_verbs(spark):
    df = spark.createDataFrame([("f i v e - x",)], "s string")
    assert clean.group_single_characters(df).count() == 1
    assert clean.reg_replace(df, {"V": "v", "": " "}).first().s == "fiVe-x"
    assert clean.add_leading_zeros(df.selectExpr("1 as n"), 3).first().n == "001"
    for f in (clean.clean_hyphens, clean.clean_forename, clean.clean_surname, clean.standardise_white_space, lambda d: clean.max_hyphen(d, 1), lambda d: clean.max_white_space(d, 1)):
        assert f(df.limit(0)).count() == 0
        once = f(df)
        assert f(once).collect() == once.collect()


def test_verbs_on_a_stream(spark, tmp_path):
    from kinweave.operators import quality
    from kinweave.streaming import standardised_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(" ann ",), (None,)], "s string").write.parquet(src)
    q = standardised_stream(spark, "s string", src, str(tmp_path / "out"), str(tmp_path / "cp"), [clean.trim, clean.standardise_case, lambda d: quality.flag(d, "s", "isNull")])
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("ANN", False), (None, True)}
