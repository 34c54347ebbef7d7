import pytest

from kinweave.llm.mixing import mix_sources

TARGETS = [("a", 0.5, 2), ("b", 0.3, 5), ("c", 0.2, 3), ("gone", 0.1, 2)]


@pytest.fixture
def frames(spark):
    docs = [(i, "one two three four five " * (1 + i % 7), s, 9) for i, s in enumerate(["a"] * 900 + ["b"] * 150 + ["c"] * 300)]
    docs += [(5000, None, "a", 9), (5001, "", "b", 9), (5002, "text", None, 9), (5003, "text", "untargeted", 9)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("exact", [False, True])
def test_shares_and_caps(frames, exact):
    mix, report = mix_sources(*frames, exact_shares=exact)
    uses = {}
    for r in mix.collect():
        uses.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    cap = {s: m for s, _, m in TARGETS}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= cap[s] for (s, _), c in uses.items())
    got = {r.source: r for r in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert got[s].reached_share == pytest.approx(share, abs=0.03)
        assert got[s].short_tokens == 0
    if exact:
        assert max(r.rate / r.max_repeats for r in got.values()) == pytest.approx(1.0)
    else:
        assert sum(r.mix_tokens for r in got.values()) == pytest.approx(sum(r.tokens for r in got.values()), rel=0.1)
    assert got["gone"].reached_share == 0 and "untargeted" not in got
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1.0)
    assert {s for s, _ in uses} == {"a", "b", "c"}
    assert got["a"].mix_docs == sum(len(c) for (s, _), c in uses.items() if s == "a")


def test_a_scarce_source_falls_short_and_cuts_nothing_else(spark):
    docs = spark.createDataFrame([(i, "one two three four five", "a" if i else "b") for i in range(1000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mix_sources(docs, targets)[1].collect()}
    assert got["b"].rate == 4 and got["b"].mix_docs == got["b"].most_uses == 4 and got["b"].short_tokens > 2000
    assert got["a"].mix_docs == pytest.approx(500, rel=0.15) and got["a"].short_tokens == 0
    assert got["b"].reached_share < 0.02
    exact = {r.source: r for r in mix_sources(docs, targets, exact_shares=True)[1].collect()}
    assert exact["b"].rate == 4 and exact["a"].rate == pytest.approx(4 / 999)


def test_repeated_and_unusable_targets(frames, spark):
    docs = frames[0]
    targets = spark.createDataFrame([("a", 0.3, 2), ("a", 0.2, 4), ("b", None, 2), ("c", 0.5, None), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].target_share == 0.5 and got["a"].rate == pytest.approx(1.0)
    assert got["b"].mix_docs == got["c"].mix_docs == 0 and mix.count() == got["a"].mix_docs


def test_same_seed_same_mix(frames, rows):
    assert rows(mix_sources(*frames)[0]) == rows(mix_sources(frames[0].repartition(7), frames[1])[0])
    assert rows(mix_sources(*frames)[0]) != rows(mix_sources(*frames, seed=18)[0])


def test_smaller_total(frames):
    report = mix_sources(*frames, total_tokens=2000.0)[1]
    assert sum(r.mix_tokens for r in report.collect()) == pytest.approx(2000, rel=0.2)
    assert mix_sources(*frames, total_tokens=1e12)[1].agg({"rate": "max"}).first()[0] <= 5


def test_nothing_to_mix(frames):
    docs, targets = frames
    mix, report = mix_sources(docs.limit(0), targets)
    assert mix.count() == 0 and [r.reached_share for r in report.collect()] == [0.0] * 4
    assert mix_sources(docs, targets.limit(0))[0].count() == 0
