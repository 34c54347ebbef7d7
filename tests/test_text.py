import pytest
from pyspark.sql import functions as F

from kinweave.functions import arrays, phonetic, places, similarity, strings, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (lambda c: text.white_space(c), "  a \t b\n c ", "a b c"),
        (lambda c: text.white_space(c, "none"), "hello  yes", "helloyes"),
        (lambda c: text.white_space(c, fill="_"), "hello  yes", "hello_yes"),
        (lambda c: text.white_space(c, fill="$1\\"), "a b", "a$1\\b"),
        (lambda c: text.case(c, "title"), "aNNa maRIA", "Anna Maria"),
        (lambda c: text.strip_punctuation(c, "^"), "a^b*c d", "a^bc d"),
        (lambda c: text.strip_punctuation(c, "]"), "a]b-c", "a]bc"),
        (lambda c: text.strip_punctuation(c, "-\\"), "a\\b-c_d", "a\\b-cd"),
        (lambda c: text.limit_white_space(c, 2), "tom    ridley", "tomridley"),
        (lambda c: text.limit_white_space(c, 2), "tom  ridley", "tom  ridley"),
        (lambda c: text.limit_hyphens(c, 2), "tom----ridley", "tom--ridley"),
        (lambda c: text.limit_hyphens(c, 3), "a--b-c-d", "a--b-c-d"),
        (text.clean_hyphens, "--fo - ur", "fo-ur"),
        (text.clean_hyphens, "four-\n", "four-\n"),
        (text.join_single_letters, "f i v e", "five"),
        (text.join_single_letters, "t  e    n", "ten"),
        (text.join_single_letters, "eigh t", "eigh t"),
        (lambda c: text.join_single_letters(c, True), "eigh t", "eight"),
        (text.clean_forename, "MISS Maddie", " Maddie"),
        (text.clean_forename, "NO NAME", ""),
        (text.clean_surname, "VAN DER VAL", "VANDERVAL"),
        (text.clean_surname, "SURNAME", ""),
        (text.clean_surname, "MC CREW", "MCCREW"),
        (lambda c: text.pad_zeros(c, 7), "1-2-12", "01-2-12"),
        (lambda c: text.pad_zeros(c, 3), "12345", "12345"),
        (lambda c: text.substring(c, 1, 3), "TOMATO", "TOM"),
        (lambda c: text.substring(c, -2, 2), "tomatoes", "es"),
        (lambda c: text.substring(c, 2, 3, True), "tomatoes", "toe"),
        (text.sorted_letters, "Romer, Bogdan", " ,ABDEGMNOORR"),
        (text.sorted_letters, None, None),
        (phonetic.soundex, "McDonald", "M235"),
        (phonetic.soundex, "Homer", "H560"),
        (phonetic.metaphone, "Idrissa", "ITRS"),
        (phonetic.metaphone, None, None),
        (lambda c: places.postcode_part(c, "area"), "nw1 2ab", "nw"),
        (lambda c: places.postcode_part(c, "district"), "NW1 2AB", "NW1"),
        (lambda c: places.postcode_part(c, "sector"), "NW1 2AB", "NW12"),
        (lambda c: places.postcode_part(c, "district"), "A", ""),
    ],
)
def test_expression(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


@pytest.mark.parametrize("name, code", [("David", "TFT"), ("Edward", "ETWRT"), ("Gordon", "KRTN"), ("Emma", "EM"), ("Knight", "NT"), ("Philip", "FLP"), ("", ""), ("é1", "")])
def test_metaphone(name, code):
    assert phonetic.metaphone_of(name) == code


@pytest.mark.parametrize("a, b, jaro, winkler", [("Hello", "HHheello", 0.875, 0.8875), ("Hello", " h e l l o", 0.6333, 0.6333), ("Hello", "olleH", 0.6, 0.6), ("Hello", "H1234", 0.4667, 0.4667), ("Hello", "1234", 0, 0), ("Emma", "Emily", 0.6333, 0.6333), ("", "", 1, 1), ("", "a", 0, 0)])
def test_jaro(a, b, jaro, winkler):
    assert round(strings.jaro(a, b), 4) == round(strings.jaro(b, a), 4) == jaro
    assert round(strings.jaro_winkler(a, b), 4) == winkler


@pytest.mark.parametrize("a, b, near", [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "acb", True), ("bac", "abc", True), ("abcd", "badc", False), ("abc", "cba", False), ("", "", True), ("", "a", True), ("", "ab", False)])
def test_one_edit(a, b, near):
    assert strings.one_edit(a, b) is near and strings.one_edit(b, a) is near


def test_scores_of_columns(spark):
    df = spark.createDataFrame([("Emily", "David"), ("Emily", "Emily"), (None, "a"), ("", ""), ("Emily", "Emma")], "a string, b string")
    got = df.select(similarity.edit_score(F.col("a"), F.col("b")), similarity.sequence_ratio(F.col("a"), F.col("b")), similarity.jaro(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [pytest.approx(0.0), 1.0, None, None, pytest.approx(0.4)]
    assert got[0][1] == pytest.approx(0.2) and got[4][1] == pytest.approx(0.4444, abs=1e-4) and got[2][1] is None
    assert got[2][2] is None and got[3][2] == 1.0


@pytest.mark.parametrize("sep, parts, wanted", [(" ", ["Josh", None, "Smith"], "Josh Smith"), ("_", ["Josh", "", "Smith"], "Josh_Smith"), ("||", ["a", "", "b"], "a||b"), (".", ["", None, ""], None), ("", ["", None, ""], ""), ("$", ["a", "b", None], "a$b")])
def test_join_text(spark, sep, parts, wanted):
    df = spark.createDataFrame([tuple(parts)], "a string, b string, c string")
    assert df.select(text.join_text([F.col(c) for c in "abc"], sep)).first()[0] == wanted


@pytest.mark.parametrize("index, wanted", [(0, "a"), (-1, "c"), (9, None), (-9, None), ((0, 2), "a b"), ((1, -1), "b"), ((5, 9), None), ((2, 1), None)])
def test_pick(spark, index, wanted):
    assert spark.createDataFrame([(["a", "b", "c"],)], "x array<string>").select(arrays.pick(F.col("x"), index)).first()[0] == wanted


def test_bad_options(spark):
    for f in (lambda: text.white_space(F.col("x"), "two"), lambda: text.case(F.col("x"), "odd"), lambda: places.postcode_part(F.col("x"), "town")):
        with pytest.raises(ValueError):
            f()


def test_many_jaro_pairs_are_as_one_by_one():
    import random

    import numpy as np
    import pandas as pd

    from kinweave.functions import similarity, strings

    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdé ") for _ in range(draw.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(3000)] + [("", ""), ("a", ""), ("x" * 500, "x" * 499), ("a\0b", "ab"), ("same", "same")]
    a, b = zip(*pairs)
    for many, one in ((similarity.jaro, strings.jaro), (similarity.jaro_winkler, strings.jaro_winkler)):
        got = many.of(pd.Series([*a, None, "x"]), pd.Series([*b, "x", None]))
        assert np.allclose(got[: len(pairs)], [one(x, y) for x, y in pairs], rtol=0, atol=1e-12) and got[len(pairs) :].isna().all()
