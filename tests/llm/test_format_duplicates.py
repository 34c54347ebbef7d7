import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.format_duplicates import CountingTrie, duplicate_counts, format_duplicates, radix_plan

FIELDS = ["dob", "postcode", "surname", "sex", "forename", "middlename"]
SCHEMA = "id long, forename string, middlename string, surname string, dob string, sex string, postcode string, key string, `part` int"


def key(r):
    clean = [re.sub(r"[\W_]", "", r[i] or "").lower() for i in range(1, 7)]
    return (*sorted(clean[:2]), *clean[2:])


def brute(rows):
    sets = {}
    for r in rows:
        sets.setdefault(key(r), []).append(r[0])
    return sorted((min(ids), i, len(ids)) for ids in sets.values() for i in ids)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in format_duplicates(df, "id", FIELDS, ("forename", "middlename"), **kw).collect())


ROWS = [
    (5, "Ann", "Mary", "O'Neil", "1990-01-01", "F", "AB1 2CD"),
    (3, " MARY", "ann.", "oneil", "1990/01/01", "f", "ab12cd"),
    (4, "Annm", "ary", "O'Neil", "1990-01-01", "F", "AB1 2CD"),
    (1, None, None, None, None, None, None),
    (2, " ", "", "--", None, "", "\t"),
    (7, "Ann", None, "O'Neil", "1990-01-01", "F", "AB1 2CD"),
    (8, None, "ANN", "O'Neil", "1990-01-01", "F", "AB1 2CD"),
    (9, "É", None, "ß", None, None, None),
    (10, "é", None, "ß", None, None, None),
    (11, "E", None, "ß", None, None, None),
]


def test_pairs_of_every_kind(spark):
    got = run(spark, ROWS)
    assert got == brute(ROWS)
    keep = {m: k for k, m, _ in got}
    assert keep[5] == keep[3] == 3 and keep[4] == 4 and keep[1] == keep[2] == 1 and keep[7] == keep[8] == 7 and keep[9] == keep[10] and keep[11] == 11


def test_empty_null_ids_and_repeats(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, "a", None, None, None, None, None)]) == []
    assert run(spark, [ROWS[0], ROWS[0]]) == [(5, 5, 2), (5, 5, 2)]


def test_hot_key_long_texts_and_small_buckets(spark):
    draw = random.Random(4)
    hot = [(i, draw.choice(["Ann", "ANN", "a.n n"]), None, "Lee", "1990-01-01", "F", "A1") for i in range(3000)]
    rare = [(10_000 + i, f"n{i % 700}", None, "x" * draw.choice([1, 20_000]) if i < 20 else "Lee", "1990-01-01", "F", "A1") for i in range(1500)]
    assert run(spark, hot + rare, rows_per_bucket=200) == brute(hot + rare)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=200))
def test_trie_counts_like_a_dictionary(keys):
    import kinweave.llm.format_duplicates as module

    before, module.BURST = module.BURST, 3
    try:
        trie, want = CountingTrie(), {}
        for i, k in enumerate(keys):
            trie.add(k, i)
            want.setdefault(k, []).append(i)
    finally:
        module.BURST = before
    assert sorted(t for t in trie.terminals() if t) == sorted(want.values())


@pytest.mark.parametrize("exchangeable", [None, ("forename", "middlename")])
def test_fields_of_any_order(spark, exchangeable):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a")], "id long, forename string, middlename string")
    got = format_duplicates(df, "id", ["forename", "middlename"], exchangeable).collect()
    assert {r.n_copies for r in got} == ({2} if exchangeable else {1})


def test_counts_without_members(spark):
    draw = random.Random(7)
    rows = [(i, draw.choice(["Ann", "ANN", "a.n n", None]), None, draw.choice(["Lee", "lee", f"x{i % 50}"]), "1990-01-01", "F", "A1") for i in range(2000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3)
    want = {}
    for k, _, n in brute(rows):
        want[k] = n
    assert {(r.keep_id, r.n_copies) for r in duplicate_counts(df, "id", FIELDS, ("forename", "middlename"), rows_per_bucket=100).collect()} == set(want.items())


def test_small_neighbours_share_a_bucket(spark):
    df = spark.createDataFrame([(i, bytearray(f"{i % 1000:03}{i}".encode())) for i in range(4000)], "id long, key binary")
    bounds, heavy, rows = radix_plan(df, 300)
    assert rows == 4000 and heavy is None and bounds == sorted(set(bounds)) and bounds[0] == b"" and len(bounds) <= 3 * 4000 // 300
    keys = sorted(bytes(r.key) for r in df.collect())
    import bisect

    sizes = {}
    for k in keys:
        at = bisect.bisect_right(bounds, k)
        sizes[at] = sizes.get(at, 0) + 1
    assert max(sizes.values()) <= 600
