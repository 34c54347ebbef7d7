import random

import pytest

from kinweave.llm import group_pairs as module
from kinweave.llm.group_pairs import group_pairs


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], "l string, r string, u int, v string").repartition(3)
    got = group_pairs(df, "l", "r").collect()
    assert len({r.record_id for r in got}) == len(got)
    return {r.record_id: r.group_id for r in got}


DRAW = random.Random(3)
CASES = {
    "empty": [],
    "edge cases": [("a", "a"), ("b", None), (None, "c"), (None, None), ("d", "e"), ("e", "d"), ("d", "e")],
    "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in DRAW.sample(range(60), 60)],
    "star": [("m", f"{c}{i}") for c in "az" for i in range(20)],
    "random": [(f"r{DRAW.randint(0, 90):02}", f"r{DRAW.randint(0, 90):02}") for _ in range(70)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, closure, name):
    assert run(spark, CASES[name]) == closure(CASES[name])


def test_hub_by_broadcast(spark, closure, monkeypatch):
    pairs = [("m", f"x{i:05}") for i in range(10_500)] + [("x00003", "a")]
    assert run(spark, pairs) == closure(pairs)


def test_rounds_that_do_not_suffice(spark):
    df = spark.createDataFrame(CASES["chain"], "l string, r string")
    with pytest.raises(RuntimeError):
        module.group_pairs(df, "l", "r", max_rounds=1)
