"""Encoding of texts with a public byte-level BPE vocabulary, given as a rank file.

The rank file has a fixed, small size (one line for each of its ids; MAX_RANK_FILE is checked), so its bytes are broadcast
once; nothing has to be installed on the executors but the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ..runtime import ship

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_RANK_FILE = 16_000_000
LONG_TEXT = 20_000
#: The white space of PATTERN, which is Unicode's; Python's also has four separators of files and records.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: No piece of PATTERN holds white space after anything else, so a text may be cut before any run of white space.
_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Nor does a piece go on from a letter to a digit or back.
_SAFE_IN_WORD = re.compile(r"(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])")


def rank_file(path: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> bytes:
    data = Path(path, name).read_bytes()
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{name} has {len(data)} bytes; a rank file has {MAX_RANK_FILE} at most")
    return data


class Tokenizer:
    """Ids of texts and texts of ids. All of a text is ordinary text: there are no special tokens."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding(hashlib.sha1(ranks).hexdigest(), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    @staticmethod
    def pieces(text: str, size: int = LONG_TEXT) -> list[str]:
        """``text`` in pieces of about ``size`` characters that are cut only where no token can lie across the cut: before
        white space or between an ASCII letter and an ASCII digit. A text that has neither is one piece."""
        cuts, at = [0], size
        while at < len(text):
            m = _SAFE.search(text, at)
            near = m.start() if m else len(text)
            if near - at > size and (w := _SAFE_IN_WORD.search(text, at, near)):
                near = w.start()
            if near >= len(text):
                break
            cuts.append(near)
            at = near + size
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG_TEXT:
            return self.encoding.encode_ordinary(text)
        return [i for p in self.pieces(text) for i in self.encoding.encode_ordinary(p)]

    def decode(self, ids: list[int]) -> str:
        """Ids are decoded to raw bytes first, as a character may lie across ids."""
        return b"".join(self.encoding.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(ranks: bytes) -> Tokenizer:
    return Tokenizer(ranks)


def _runner(ranks: Broadcast, keep: list[str], text: str, out: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value)
        for b in batches:
            texts = b.column(text).to_pylist()
            ids = pa.array([len(t.encode(x)) for x in texts], pa.int64()) if count else pa.array([t.encode(x) for x in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], [*keep, out])

    return run


def _mapped(df: DataFrame, keep: list[str], text: str, out: str, kind: str, ranks: bytes | None, count: bool) -> DataFrame:
    ship(df.sparkSession)
    ranks = rank_file() if ranks is None else ranks
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` {kind}"])
    return df.select(*keep, text).mapInArrow(_runner(df.sparkSession.sparkContext.broadcast(ranks), keep, text, out, count), schema)


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", ranks: bytes | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>) of every row's text; no shuffle, one pass.

    A null or empty text has an empty list, never null; a blank text has the ids of its white space; texts of any length
    are encoded whole; repeated rows stay; an empty table gives no rows. ``keep`` may not hold ``text`` or ``ids``.
    """
    return _mapped(df, keep, text, "ids", "array<int>", ranks, False)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", ranks: bytes | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (0 for a null or empty text)."""
    return _mapped(df, keep, text, "n_tokens", "bigint", ranks, True)
