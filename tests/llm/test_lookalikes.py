import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.lookalikes import Classes, Rewriter, known_look_alikes, look_alike_classes, one_form, possible_rules, representatives, visually_identical, visually_identical_groups

CLASSES = look_alike_classes()
RULES = representatives(CLASSES, {"fi": 3, "o": 9, "e": 9})
FORM = Rewriter(RULES)

SAME = [
    ("café", "café"), ("ｈｅｌｌｏ　１", "hello 1"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("co‑op －", "co-op -"),
    ("oﬁce", "ofice"), ("оре́ Τoο", "opé Too"), ("e‍́", "é"), ("f‌i", "ﬁ"), ("ё", "ë"), ("Ό", "Ó"), ("й", "й"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("m²", "m2"), ("a\nb", "a b"), ("end.", "end"), ("a  b", "a b"), ("и", "й"), ("œ", "oe"), ("1", "l"), ("—", "-")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_to_the_eye(a, b):
    assert FORM(a) == FORM(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_to_the_eye(a, b):
    assert FORM(a) != FORM(b)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aоoе́e​ﬁfi ﬀ　２2é̈ёѕ-‑\n" + "\u0344\u0390i\u03b9"), max_size=20))
def test_a_form_is_its_own_form(text):
    once = FORM(text)
    assert FORM(once) == once


def test_classes_are_transitive():
    c = Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        c.join(a, b)
    assert c.members() == {"a": ["a", "b", "c", "d"]}


def test_representatives_follow_frequency():
    assert representatives(CLASSES, {"о": 10, "o": 2})["o"] == "о"
    assert representatives(CLASSES, {"о": 1, "o": 2})["о"] == "o"
    few = possible_rules(RULES, {"о": 1, "x": 1})
    assert "о" in few and "ｘ" not in few


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string").repartition(3)


def test_pairs_against_brute_force(spark, all_pairs):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + [None, "", " ", "　", "​", "plain", "plain", "plаin", "plаin", "long " * 9000, "long " * 9000]
    form = {i: FORM(t) for i, t in enumerate(texts) if t is not None}
    want = sorted((a, b) for a, b in all_pairs(form) if form[a] == form[b] and texts[a] != texts[b] and form[a].strip())
    got = [tuple(r) for r in visually_identical(frame(spark, texts)).collect()]
    assert sorted(got) == want


def test_form_of_nulls_and_empty_tables(spark):
    got = {r.doc_id: r.form for r in one_form(frame(spark, [None, "", "ａ", "abc"])).collect()}
    assert got == {0: None, 1: "", 2: "a", 3: "abc"}
    assert one_form(frame(spark, [None]).limit(0)).columns == ["doc_id", "text", "form"]
    assert visually_identical(frame(spark, [None]).limit(0)).count() == 0


def test_many_copies_of_one_text_make_no_pairs(spark):
    assert visually_identical(frame(spark, ["same text"] * 3000 + ["sаme text"])).count() == 3000


def test_public_look_alikes(spark):
    known = known_look_alikes(spark)
    assert {known.get(x) for x in "αа"} == {"a"} and known["ρ"] == "p" and known["υ"] == "u" and known["ѵ"] == "v" and known["Ꭺ"] == "A" and known["ı"] == "i" and known["ɡ"] == "g"
    assert "σ" not in known and known["ο"] == "o"  # both are o in the table, but no reader of Greek takes one for the other
    assert all(a.isupper() == b.isupper() and b.isascii() for a, b in known.items()) and not any(x in known for x in "éßøþ")
    form = Rewriter(representatives(look_alike_classes(known), {"a": 9, "α": 1}))
    assert form("pάpα") == form("pápa") and form("ɡıve") == form("give") and form("σ") != form("o")


def test_groups_have_a_row_for_each_document(spark):
    texts = ["same", "ѕame", "same", "other", "оther", "alone", "alone", None, "", " "]
    got = {r.doc_id: r for r in visually_identical_groups(frame(spark, texts)).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[0].text_id == got[2].text_id != got[1].text_id
    assert got[0].form_id == got[1].form_id != got[3].form_id == got[4].form_id
    assert visually_identical_groups(frame(spark, [None]).limit(0)).count() == 0
