import random
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinweave.operators.column_profile import load_changes, load_profile
from kinweave.operators.eager_aggregation import eager_join_aggregate, heavy_keys

PATTERNS = [("name", "^[A-Za-z]+$"), ("born", "^[0-9]{4}-[0-9]{2}$"), ("sex", "^[MF]$"), ("free", None), ("absent", "x")]


def patterns(spark):
    return spark.createDataFrame(PATTERNS, "field_name string, expected_pattern string")


def brute(rows):
    out = {}
    for load in {r[4] for r in rows if r[4] is not None}:
        for i, (f, p) in enumerate(PATTERNS[:4]):
            v = [r[i] for r in rows if r[4] == load]
            some = [x for x in v if x is not None]
            filled = [x for x in some if x.strip()]
            fits = [x for x in some if p is None or re.fullmatch(p.strip("^$"), x)]
            years = [int(x[:4]) for x in fits] if f == "born" else []
            misfit = sum(x not in fits for x in filled)
            out[load, f] = (len(v), len(v) - len(some), len(some) - len(filled), misfit, len(set(some)), max(map(len, some), default=None), min(some, default=None), max(some, default=None), min(years, default=None), max(years, default=None))
    return out


def profiled(df, spark):
    got, few = load_profile(df, "load_no", patterns(spark), ("born",))
    return {(r.load_no, r.field_name): tuple(r)[2:12] for r in got.collect()}, {tuple(r) for r in few.collect()}


def some_rows(seed, n=400, dirty=True):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeXYZ") for _ in range(draw.randint(1, 6)))
    rows = []
    for _ in range(n):
        name, born, sex, free = word(), f"{draw.randint(1900, 2000)}-{draw.randint(10, 12)}", draw.choice("MF"), word()
        if dirty:
            name, born, sex, free = draw.choice([name, name, None, "", " \t", "a1"]), draw.choice([born, born, "bad", None, "1999-01\n"]), draw.choice([sex, None, "U"]), draw.choice([free, None])
        rows.append((name, born, sex, free))
    return rows


def write(path, parts, group=50):
    path.mkdir()
    for k, rows in enumerate(parts):
        cols = list(zip(*rows)) if rows else [[]] * 5
        table = pa.table({n: pa.array(c, t) for n, c, t in zip(["name", "born", "sex", "free", "load_no"], cols, [pa.string()] * 4 + [pa.int32()])})
        pq.write_table(table, path / f"p{k}.parquet", row_group_size=group)


def test_profile_of_files_of_every_kind(spark, tmp_path):
    clean = [(*r, 1) for r in some_rows(1, dirty=False)]
    nulls = [(None, None, None, None, 2)] * 60
    dirty = [(*r, 3) for r in some_rows(2)]
    mixed = [(*r, 4 + i % 3) for i, r in enumerate(some_rows(3))] + [("lost", None, None, None, None)] * 5
    write(tmp_path / "t", [clean, nulls, dirty, mixed, []])
    rows = clean + nulls + dirty + mixed
    got, few = profiled(spark.read.parquet(str(tmp_path / "t")), spark)
    assert got == brute(rows)
    want = defaultdict(int)
    for r in rows:
        if r[4] is not None and r[2] is not None:
            want[r[4], "sex", r[2]] += 1
    assert {x for x in few if x[1] == "sex"} == {(*k, n) for k, n in want.items()}


def counted(module, path, fields):
    total, scan = defaultdict(int), set()
    for batch in module.file_counts(fields, "load_no")(iter([pa.RecordBatch.from_pydict({"path": [path]})])):
        for r in batch.to_pylist():
            if r["load_no"] is None:
                assert r["value"] == path and r["n"] is None
                scan.add(r["field_name"])
            else:
                total[r["load_no"], r["field_name"], r["value"]] += r["n"]
    return dict(total), scan


def test_what_footers_and_dictionaries_tell(spark, tmp_path, monkeypatch):
    import kinweave.operators.column_profile as module

    monkeypatch.setattr(module, "SMALL_DICTIONARY", 60)
    write(tmp_path / "t", [[("Ann", None, "MFU"[i % 3] if i % 4 else None, f"x{i}", 1) for i in range(60)]])
    path = spark.read.parquet(str(tmp_path / "t")).inputFiles()[0]
    read = []
    inner = module._counted
    monkeypatch.setattr(module, "_counted", lambda column: read.append(column) or inner(column))
    got, scan = counted(module, path, ["name", "born", "sex", "free"])
    assert scan == {"free"} and read and all(c.null_count for c in read)
    assert got == {(1, "name", "Ann"): 60, (1, "born", None): 60, (1, "sex", None): 15, (1, "sex", "M"): 15, (1, "sex", "F"): 15, (1, "sex", "U"): 15}


def test_mixed_loads_and_unknown_files_are_scanned(spark, tmp_path):
    import kinweave.operators.column_profile as module

    assert counted(module, "odd://x", ["name", "sex"]) == ({}, {"name", "sex"})
    write(tmp_path / "t", [[("Ann", None, "M", "x", i % 2) for i in range(60)]])
    assert counted(module, spark.read.parquet(str(tmp_path / "t")).inputFiles()[0], ["name"]) == ({}, {"name"})


def test_profile_of_other_frames(spark, tmp_path):
    rows = [(*r, i % 2) for i, r in enumerate(some_rows(5))]
    df = spark.createDataFrame(rows, "name string, born string, sex string, free string, load_no int")
    assert profiled(df, spark)[0] == brute(rows)
    write(tmp_path / "t", [rows])
    part = spark.read.parquet(str(tmp_path / "t")).where("sex = 'M'")
    assert profiled(part, spark)[0] == brute([r for r in rows if r[2] == "M"])
    assert profiled(df.limit(0), spark) == ({}, set())


def test_changes(spark):
    base = [("Ann", f"19{50 + i % 40}-10", "MF"[i % 2], "x") for i in range(100)]
    nxt = [(None if i < 20 else "A" * 40 if i == 50 else "Ann1" if i < 60 else "Ann", f"18{50 + i % 40}-10", "1" if i < 50 else "M", "x") for i in range(100)]
    df = spark.createDataFrame([(*r, 1) for r in base] + [(*r, 2) for r in nxt] + [(*r, 4) for r in base], "name string, born string, sex string, free string, load_no int")
    got = {tuple(r) for r in load_changes(*load_profile(df, "load_no", patterns(spark), ("born",))).collect()}
    assert got == {(2, "name", x) for x in ("percent_null", "pattern", "max_l", "distinct", "shares")} | {(2, "born", "years"), (2, "sex", "pattern"), (2, "sex", "shares")}


def frames(spark, n=2000):
    draw = random.Random(9)
    left = [(draw.choice(["hot"] * 5 + ["a", "b", None, "only_l"]), draw.randint(0, 9), draw.choice(["p", "q"]), 1) for _ in range(n)]
    right = [(draw.choice(["hot"] * 5 + ["a", "b", None, "only_r"]), draw.choice([1, None, 5]), 2) for _ in range(n // 10)]
    return spark.createDataFrame(left, "k string, x int, g string, n long"), spark.createDataFrame(right, "k string, y int, n long")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_join_against_the_join(spark, rows, how):
    l, r = frames(spark)
    got = eager_join_aggregate(l, r, F.col("k"), F.col("k"), {"sx": F.col("x").cast("long")}, {"sy": F.col("y").cast("long")}, how=how)
    joined = l.where("k is not null").alias("l").join(r.alias("r"), F.col("l.k") == F.col("r.k"), how).groupBy("l.k").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    assert {(r.key, int(r.n_pairs), r.sx, r.sy) for r in got.collect()} == {tuple(r) for r in joined.collect()}
    rolled = eager_join_aggregate(l, r, F.col("k"), F.col("k"), left_by={"g": F.col("g")}, roll_up=["g"], how=how)
    assert {(r.g, int(r.n_pairs)) for r in rolled.collect()} == {tuple(r) for r in l.where("k is not null").join(r.select("k"), "k", how).groupBy("g").count().collect()}


def test_eager_join_plans_no_join_of_rows(spark):
    l, r = frames(spark, 50)
    plan = eager_join_aggregate(l, r, F.col("k"), F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate [k#") == 2


def test_eager_join_edge_cases(spark):
    l, r = frames(spark, 50)
    assert eager_join_aggregate(l.limit(0), r, F.col("k"), F.col("k")).count() == 0
    for bad in ({"how": "outer"}, {"left_sums": {"n_pairs": F.col("x")}}, {"left_sums": {"s": F.col("x")}, "right_sums": {"s": F.col("y")}}):
        with pytest.raises(ValueError):
            eager_join_aggregate(l, r, F.col("k"), F.col("k"), **bad)
    big = spark.range(3).select(F.lit("k").alias("k"))
    assert eager_join_aggregate(big, big, F.col("k"), F.col("k")).first().n_pairs == 9


def test_heavy_keys(spark, rows):
    df = spark.createDataFrame([("a",)] * 50 + [(None,)] * 30 + [(f"k{i}",) for i in range(20)], "k string")
    assert [(r.key, r.n_rows, int(r.n_pairs)) for r in heavy_keys(df, F.col("k"), df, F.col("k"), 4).collect()] == [("a", 50, 2500)]
    assert heavy_keys(df.limit(0), F.col("k"), df, F.col("k"), 4).count() == 0
