"""Phonetic codes: Soundex in the JVM, Metaphone (Philips, 1990) as an Arrow function over distinct names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import ship

VOWELS = frozenset("AEIOU")
FRONT = frozenset("EIY")
SAME = {"F": "F", "J": "J", "L": "L", "M": "M", "N": "N", "R": "R", "V": "F", "Q": "K", "Z": "S"}


def soundex(c: Column) -> Column:
    return F.soundex(c)


class _Word:
    """A word to be read letter by letter; outside of it there are blanks."""

    def __init__(self, text: str) -> None:
        letters = [x for x in text.upper() if "A" <= x <= "Z"]
        self.text = "".join(x for i, x in enumerate(letters) if x == "C" or i == 0 or letters[i - 1] != x)

    def __getitem__(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else " "

    def starts(self, i: int, *parts: str) -> bool:
        return i >= 0 and any(self.text.startswith(p, i) for p in parts)


def _start(w: _Word) -> tuple[int, str]:
    """Where reading begins and the code of an unusual beginning."""
    if w.starts(0, "KN", "GN", "PN", "AE", "WR"):
        return 1, ""
    if w[0] == "X":
        return 1, "S"
    if w.starts(0, "WH"):
        return 2, "W"
    return 0, ""


def _letter(w: _Word, i: int) -> tuple[str, int]:
    """The code of the letter at ``i`` and how many letters it takes."""
    c, before, after = w[i], w[i - 1], w[i + 1]
    if c in VOWELS:
        return (c if i == 0 else ""), 1
    if c in SAME:
        return SAME[c], 1
    match c:
        case "B":
            return ("" if before == "M" and after == " " else "B"), 1
        case "C":
            if before == "S" and after in FRONT:
                return "", 1
            if w.starts(i, "CIA"):
                return "X", 1
            if after in FRONT:
                return "S", 1
            if after == "H":
                return ("K" if before == "S" or (i == 0 and w[i + 2] not in VOWELS) else "X"), 2
            return "K", 1
        case "D":
            return ("J", 2) if after == "G" and w[i + 2] in FRONT else ("T", 1)
        case "G":
            if after == "H":
                return ("", 1) if w[i + 2] != " " and w[i + 2] not in VOWELS else ("K" if i == 0 else "", 2) if w[i + 2] == " " else ("K" if i == 0 else "F", 2)
            if after == "N" and (w[i + 2] == " " or w.text[i + 1 :] == "NED"):
                return "", 1
            return ("J" if after in FRONT and before != "G" else "K"), 1
        case "H":
            return ("H" if after in VOWELS and before not in "CSPTG" else ""), 1
        case "K":
            return ("" if before == "C" else "K"), 1
        case "P":
            return ("F", 2) if after == "H" else ("P", 1)
        case "S":
            if after == "H":
                return "X", 2
            return ("X" if w.starts(i, "SIO", "SIA") else "S"), 1
        case "T":
            if after == "H":
                return "0", 2
            if w.starts(i, "TCH"):
                return "", 1
            return ("X" if w.starts(i, "TIO", "TIA") else "T"), 1
        case "W" | "Y":
            return (c if after in VOWELS else ""), 1
        case "X":
            return "KS", 1
    return "", 1


def metaphone_of(text: str) -> str:
    w = _Word(text)
    i, code = _start(w)
    while i < len(w.text):
        part, n = _letter(w, i)
        code += part
        i += n
    return code


def _codes(names: pd.Series) -> pd.Series:
    known = {n: metaphone_of(n) for n in names.dropna().unique()}
    return pd.Series([known.get(n) for n in names], dtype=object)


def metaphone(c: Column) -> Column:
    ship()
    return F.pandas_udf(_codes, "string")(c)  # type: ignore[call-overload]
