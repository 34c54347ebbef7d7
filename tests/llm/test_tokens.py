import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.tokens import Tokenizer, count_tokens, encode_texts, rank_file

TOKENIZER = Tokenizer(rank_file())
WORD = st.sampled_from(["a", "B7", " ", "  ", "\n", "'s", "é", "1", "!!", "\t ", "...", "'re", "　", "日本", "🐝", "<|endoftext|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, max_size=60).map("".join), st.integers(1, 12))
def test_pieces_have_the_ids_of_the_whole(text, size):
    parts = TOKENIZER.pieces(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in TOKENIZER.encoding.encode_ordinary(p)] == TOKENIZER.encoding.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    text = text.encode("utf-8", "replace").decode()
    assert TOKENIZER.decode(TOKENIZER.encode(text)) == text


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer as Other

    other = Other.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ["Hello world's 123  x\n\n y", "  lead", "é日本🐝", "<|endoftext|>", "tail  "]:
        assert TOKENIZER.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_column(spark):
    texts = [None, "", " ", "one two", "word " * 30_000, "one two", "a" * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.ids for r in encode_texts(df, ["doc_id"]).collect()}
    assert got[0] == got[1] == [] and got[2] == [220] and got[3] == got[5] and len(got) == len(texts)
    assert got[4] == TOKENIZER.encoding.encode_ordinary(texts[4]) and got[6] == TOKENIZER.encoding.encode_ordinary(texts[6])
    assert encode_texts(df, ["doc_id"]).schema["ids"].dataType.simpleString() == "array<int>"
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id"]).collect()} == {i: len(x) for i, x in got.items()}
    assert encode_texts(df.limit(0), ["doc_id"]).count() == 0


def test_rank_file_is_checked(tmp_path):
    (tmp_path / "big").write_bytes(b"0" * 17_000_000)
    with pytest.raises(ValueError):
        rank_file(str(tmp_path), "big")
