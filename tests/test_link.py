import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity
from kinweave.operators import clusters, link
from kinweave.operators.matchkey import MatchKey, any_of, eq, eq_fn, matchkey_dataframe, prefix_of, score, suffix_of


@pytest.fixture
def sides(spark):
    left = [("1", "Ann", "Lee"), ("2", "Bob", "Ray"), ("3", None, "Fox"), ("4", "Dan", "Poe"), ("5", "Eve", "Kay"), (None, "Gus", "Orr")]
    right = [("a", "Ann", "Lee"), ("b", "Bo", "Ray"), ("c", None, "Fox"), ("d", "Dan", "Poe"), ("e", "Dan", "Poe"), ("f", "Eva", "Kay"), ("g", "Gus", "Orr")]
    return spark.createDataFrame(left, "l_id string, f string, s string"), spark.createDataFrame(right, "r_id string, f string, s string")


EXACT = MatchKey(eq("f"), eq("s"))
INITIAL = MatchKey(eq_fn("f", None, prefix_of(1), "initial"), eq("s"))
ONLY_S = MatchKey(eq("s"))


def test_sequential_and_strict(spark, rows):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "l string, r int")
    assert rows(link.one_to_one(pairs, "l", "r")) == [("a", 1)]
    assert rows(link.one_to_one(pairs, "l", "r", strict=True)) == []
    assert rows(link.one_to_one(pairs.limit(0), "l", "r")) == []


def test_matchkey_join(sides, rows):
    assert rows(link.matchkey_join(*sides, "l_id", "r_id", EXACT)) == [("1", "a", 1)]
    assert rows(link.matchkey_join(*sides, "l_id", "r_id", ONLY_S, 4)) == [("1", "a", 4), ("2", "b", 4), ("3", "c", 4), ("5", "f", 4)]


def test_cascade(sides, rows, tmp_path):
    want = [("1", "a", 1), ("2", "b", 2), ("3", "c", 3), ("5", "f", 2)]
    assert rows(link.deterministic_linkage(*sides, "l_id", "r_id", [EXACT, INITIAL, ONLY_S])) == want
    assert rows(link.deterministic_linkage(*sides, "l_id", "r_id", [EXACT, INITIAL, ONLY_S], str(tmp_path))) == want
    links = link.deterministic_linkage(*sides, "l_id", "r_id", [EXACT, INITIAL, ONLY_S])
    link.assert_unique_matches(links, "l_id", "r_id")
    assert rows(link.matchkey_counts(links)) == [(1, 1), (2, 2), (3, 1)]
    sample = link.clerical_sample(links, [EXACT, INITIAL, ONLY_S], sides[0].withColumnsRenamed({"f": "lf", "s": "ls"}), sides[1].withColumnsRenamed({"f": "rf", "s": "rs"}), "l_id", "r_id", 1)
    assert sample.columns == ["matchkey", "l_id", "r_id", "lf", "ls", "rf", "rs", "description"] and sample.count() == 3


def test_cascade_of_nothing(sides):
    l, r = sides
    assert link.deterministic_linkage(l.limit(0), r, "l_id", "r_id", [EXACT, ONLY_S]).count() == 0


def test_scores_and_alternatives(sides, rows):
    near = MatchKey(eq("s"), score(similarity.edit_score, "f", None, 0.6, "edit"))
    assert rows(link.matchkey_join(*sides, "l_id", "r_id", near)) == [("1", "a", 1), ("2", "b", 1), ("5", "f", 1)]
    by_udf = MatchKey(eq("s"), score(similarity.jaro_winkler, "f", None, 0.7, "jw"))
    assert ("5", "f", 1) in rows(link.matchkey_join(*sides, "l_id", "r_id", by_udf))
    either = MatchKey(eq("s"), any_of(eq("f"), eq("s")))
    assert ("3", "c", 1) in rows(link.matchkey_join(*sides, "l_id", "r_id", either))
    assert either.columns("left") == ["s", "f"]
    with pytest.warns(UserWarning):
        MatchKey(score(similarity.edit_score, "f", None, 0.6, "edit"))
    with pytest.raises(ValueError):
        MatchKey()


def test_descriptions_and_order(spark, sides, rows):
    assert rows(matchkey_dataframe(spark, [EXACT, INITIAL])) == [(1, "[f=f,s=s]"), (2, "[initial(f)=initial(f),s=s]")]
    none = MatchKey(eq_fn("f", "s", prefix_of(9), "nine"))
    assert link.order_matchkeys(*sides, "l_id", "r_id", [ONLY_S, EXACT, none]) == [none, EXACT, ONLY_S]
    assert link.mk_dropna(sides[0], EXACT).count() == 5


def test_blocking_keeps_every_pass(spark, rows):
    a = spark.createDataFrame([(1, "x", "p", 7), (2, "y", "q", 8), (3, None, None, 9)], "i int, a string, b string, c int")
    b = spark.createDataFrame([(4, "x", "z", 0), (5, "n", "q", 0), (6, None, None, 9)], "j int, d string, e string, f int")
    got = link.blocking(a, b, {"a": "d", "b": "e", "c": "f"}, ("i", "j"))
    assert [(r.i, r.j) for r in got.orderBy("i").collect()] == [(1, 4), (2, 5), (3, 6)] and len(got.columns) == 8
    with pytest.raises(ValueError):
        link.blocking(a, a, {"a": "a"}, ("i", "i"))


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    link.assert_unique(df, "b")
    link.assert_unique(df, ["a", "b"])
    link.assert_unique_matches(df.limit(0), "a")
    with pytest.raises(AssertionError):
        link.assert_unique(df, "a")


def test_deduplicate(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id int, v string")
    unique, pairs = link.deduplicate(df, "id", [MatchKey(eq("v"))])
    assert rows(unique.select("id")) == [(3,), (4,), (5,)] and rows(pairs) == [(1, 2)]


GRAPHS = {
    "three": [("2a", "1b"), ("1b", "9b"), ("3a", "3b"), ("3b", "7b"), ("1a", "2b"), ("2b", "8b")],
    "chain": [(f"n{i:02}", f"n{i + 1:02}") for i in range(50)],
    "star": [("hub", f"x{i}") for i in range(30)],
    "loops": [("a", "a"), ("b", None), (None, "c"), (None, None), ("d", "e"), ("e", "d")],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_clusters(spark, name):
    edges = GRAPHS[name]
    got = clusters.cluster_number(spark.createDataFrame(edges, "a string, b string").repartition(4), "a", "b")
    assert got.columns == ["a", "b", "Cluster_Number"]
    labels = {r.id: r.least for r in clusters.least_labels(spark.createDataFrame(edges, "a string, b string").repartition(4), "a", "b").collect()}
    if name == "three":
        assert {k: v for k, v in labels.items()} == {"2a": "1b", "1b": "1b", "9b": "1b", "3a": "3a", "3b": "3a", "7b": "3a", "1a": "1a", "2b": "1a", "8b": "1a"}
        assert {r.Cluster_Number for r in got.collect()} == {1, 2, 3}
    elif name == "loops":
        assert labels == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "d"}
        assert [r.Cluster_Number for r in got.where("a is null or b is null").collect()] == [None] * 3
    else:
        assert len(set(labels.values())) == 1


def test_clusters_need_strings(spark):
    with pytest.raises(TypeError):
        clusters.cluster_number(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b")
    assert clusters.cluster_number(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def _counting(monkeypatch):
    """Small cells and parts, as large tables have them, and the numbers of pairs that one join made."""
    import kinweave.operators.link as module

    monkeypatch.setattr(module, "CELL", 50, raising=False)
    monkeypatch.setattr(module, "MANY", 500, raising=False)
    return module


def _people(spark, n, m):
    name = lambda c, k: F.concat(F.lit("Na"), F.pmod(F.xxhash64(c, F.lit(k)), F.lit(40)).cast("string"), F.lit("mé"), F.pmod(F.xxhash64(c, F.lit(k + 1)), F.lit(30)).cast("string"))
    l = spark.range(n).select(F.col("id").alias("a"), name("id", 1).alias("x"), F.when(F.col("id") < n - 5, F.col("id") % 3).alias("g"))
    r = spark.range(m).select(F.col("id").alias("b"), name("id", 5).alias("y"), (F.col("id") % 3).alias("h"))
    return l, r


@pytest.mark.parametrize("strict", [False, True])
def test_one_to_one_of_many_pairs_in_cells_and_parts(spark, rows, monkeypatch, strict):
    module = _counting(monkeypatch)
    l, r = _people(spark, 90, 60)
    key = MatchKey(eq("g", "h"), score(similarity.edit_score, "x", "y", 0.8, "edit"))
    want = rows(link.one_to_one(link.candidate_pairs(l, r, "a", "b", key), "a", "b", strict))
    made = []
    inner = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, **o: made.append(df.columns) or inner(df, **o))
    assert [x[:2] for x in rows(link.matchkey_join(l, r, "a", "b", key, 1, strict))] == want and want
    assert any(c == ["__r", "lo", "hi"] for c in made)  # no pairs are kept, only the ends of each id's


def test_equalities_alone_make_no_pairs(spark, rows):
    l, r = spark.range(3000).selectExpr("id AS a", "0 AS g"), spark.range(3000).selectExpr("id AS b", "0 AS h")
    plan = link.matchkey_join(l, r, "a", "b", MatchKey(eq("g", "h")))._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner"):]
    assert "min(" in join  # the left ids of a value are summed up below the join
    assert link.matchkey_join(l, r, "a", "b", MatchKey(eq("g", "h"))).count() == 0


def test_order_of_match_keys_in_cells(spark, monkeypatch):
    _counting(monkeypatch)
    l, r = _people(spark, 90, 60)
    keys = [MatchKey(eq("g", "h")), MatchKey(eq("g", "h"), score(similarity.edit_score, "x", "y", 0.6, "edit")), MatchKey(eq("g", "h"), eq_fn("x", "y", suffix_of(1), "last"))]
    n = [link.candidate_pairs(l, r, "a", "b", k).count() for k in keys]
    want = [keys[i] for i in sorted(range(3), key=lambda i: (n[i], i))]
    assert link.order_matchkeys(l, r, "a", "b", keys) == want
    assert link.order_matchkeys(l.unionByName(l), r, "a", "b", keys) == want


@pytest.mark.parametrize("name", ["edit_score", "jaro", "jaro_winkler", "sequence_ratio"])
def test_scores_of_all_pairs_in_cells(spark, rows, monkeypatch, name):
    _counting(monkeypatch)
    fn = getattr(similarity, name)
    l, r = _people(spark, 60, 40)
    l = l.withColumn("x", F.when(F.col("a") == 1, None).when(F.col("a") == 2, "").when(F.col("a") == 3, F.repeat("x", F.lit(70))).otherwise(F.col("x")))
    r = r.withColumn("y", F.when(F.col("b") == 4, None).when(F.col("b") == 5, "").otherwise(F.col("y")))
    want = rows(l.join(r, F.col("g") == F.col("h")).select("a", "b", F.round(fn(F.col("x"), F.col("y")), 6).alias("score")))
    got = link.pair_scores(l, r, "a", "b", ("g", "h"), ("x", "y"), fn, 6)
    assert rows(got) == want
    plan = got._jdf.queryExecution().toString()
    assert "__ac" in plan and ("CoGroup" in plan) == (name != "sequence_ratio")  # values are dealt out; not by a row a pair
