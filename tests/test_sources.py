import re
import zipfile

import numpy as np
import pandas as pd
import pytest

from kinweave.sources import catalog, files, report, session


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_files(spark, tmp_path, form, rows):
    df = spark.createDataFrame([("a;b", 1), (None, 2)], "s string, n int")
    files.write_format(df, form, str(tmp_path), "t", sep=";")
    files.write_format(df, form, str(tmp_path), "t", sep=";", mode="append")
    assert files.read_format(spark, form, str(tmp_path), "t", sep=";").count() == 4
    assert files.most_recent(spark, str(tmp_path), form)[0].endswith("/t")
    with pytest.raises(FileNotFoundError):
        files.most_recent(spark, str(tmp_path), form, "nothing")
    with pytest.raises(ValueError):
        files.read_format(spark, "orc", str(tmp_path))


def test_listing_and_searching(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo one\n")
    (tmp_path / "sub" / "b.txt").write_text("x")
    (tmp_path / "bad").write_bytes(b"\xff\xfe\x00one")
    assert files.list_files(spark, str(tmp_path), full_path=False) == ["a.txt", "bad", "sub"]
    assert files.list_files(spark, str(tmp_path), walk=True, regex="txt$", full_path=False) == ["a.txt", "b.txt"]
    assert files.list_files(spark, str(tmp_path / "none")) == []
    assert files.search_files(str(tmp_path), "one") == {"a.txt": [1, 2]}
    assert files.list_checkpoints(spark, str(tmp_path / "none")) == []
    files.copy_local_file(spark, str(tmp_path / "a.txt"), f"file://{tmp_path}/sub/c.txt")
    assert (tmp_path / "sub" / "c.txt").read_text().startswith("one")


def test_catalogue(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS kw_test")
    try:
        df = spark.createDataFrame([(1, "a")], "i int, s string")
        catalog.create_hive_table(df, "kw_test", "t1")
        with pytest.raises(Exception, match="exist"):
            catalog.create_hive_table(df, "kw_test", "t1")
        catalog.clone_hive_table(spark, "kw_test", "t1", "t2", "_x")
        catalog.rename_hive_table(spark, "kw_test", "t2_x", "t3")
        assert sorted(catalog.list_tables(spark, "kw_test")) == ["t1", "t3"]
        assert catalog.hive_dtypes(spark, "kw_test", "t1") == [("i", "int"), ("s", "string")]
        assert rows(catalog.hive_variable_matrix(spark, "kw_test")) == [("i", "int", "int"), ("s", "string", "string")]
        assert "CREATE TABLE" in catalog.create_table_statements(spark, "kw_test", "t1").first().createtab_stmt
        assert files.most_recent(spark, "kw_test", "hive")[0] in ("kw_test.t1", "kw_test.t3")
        files.write_format(df, "hive", "kw_test", "t1", mode="append")
        assert files.read_format(spark, "hive", "kw_test", "t1").count() == 2
    finally:
        for t in ("t1", "t2_x", "t3"):
            catalog.drop_hive_table(spark, "kw_test", t)
        spark.sql("DROP DATABASE IF EXISTS kw_test CASCADE")


def test_pandas(spark):
    pdf = pd.DataFrame({"a": pd.to_datetime(["2020-01-01"]), "b": np.array([1], "int32"), "c": [2], "d": np.array([1.5], "float32"), "e": [2.5], "f": ["x"]})
    assert [t for _, t in files.pandas_to_spark(spark, pdf).dtypes] == ["timestamp", "int", "bigint", "float", "double", "string"]
    assert files.chunk_list(list(range(11)), 4) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]


def test_session_settings():
    assert session.settings("small")["spark.executor.memory"] == "1g" and session.settings("custom", **{"spark.executor.memory": "3g"})["spark.executor.memory"] == "3g"
    with pytest.raises(ValueError):
        session.settings("huge")


def test_styles():
    assert [report.style_on_cutoff(v) for v in (-1, 1, 0, "x")] == [f"background-color : {c};" for c in ("red", "green", "white", "black")]
    assert report.style_on_condition(1, condition=lambda v: v > 0) == "font-weight : bold;" and report.style_on_condition(0) == "font-weight : normal;"
    assert report.style_colour_gradient(4, 1, 10, low_colour="FF0000", high_colour="00DDFF") == "background-color : #AA4955;"
    assert report.style_colour_gradient("e", 1, 10, error="AAAAAA") == "background-color : #AAAAAA;"
    assert [report.style_map_values(v, {"a": "red"}) for v in ("a", "b", [])] == [f"background-color : {c};" for c in ("red", "white", "black")]


def test_workbook(tmp_path):
    df = pd.DataFrame({"name": ["a<b", None], "n": [1, -2.5]})
    path = report.export_to_excel({"first": df, "second": df}, str(tmp_path / "w.xlsx"), {report.style_on_cutoff: "n"}, freeze_panes=(1, 0))
    with zipfile.ZipFile(path) as z:
        sheet, styles, book = (z.read(f"xl/{n}").decode() for n in ("worksheets/sheet1.xml", "styles.xml", "workbook.xml"))
    assert re.findall('sheet name="(.*?)"', book) == ["first", "second"] and "a&lt;b" in sheet and "<v>-2.5</v>" in sheet and 'state="frozen"' in sheet and '"00FF0000"' in styles
