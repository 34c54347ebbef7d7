"""Text cleaning as column expressions; all are null for null and stay within generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand in a forename field but are no name.
FORENAME_NOISE = ("MR", "MRS", "DR", "MISS", "NO NAME", "NAME", "FORENAME", "MS", "MX", "MSTR", "PROF", "SIR", "LADY")
#: Words that stand in a surname field but are no name, and prefixes that belong to the word after them.
SURNAME_NOISE = ("NO SURNAME", "SURNAME")
SURNAME_PREFIXES = ("DE", "DA", "DU", "ST", "MC", "MAC", "VAN", "VON", "LA", "LE", "O", "AL", "DER", "EL", "DI", "DEL", "UL", "BIN", "SAN", "BA")

#: Stands on both sides of a word of one letter while such words are joined.
MARK = "\u0001"


def quoted(text: str) -> str:
    """``text`` as a Java regular expression that matches just itself."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def white_space(c: Column, level: str = "one", fill: str | None = None) -> Column:
    """Trimmed, with each run of white space as ``fill``, or one space (``level`` one), or nothing (``level`` none)."""
    if level not in ("one", "none"):
        raise ValueError("level is one or none")
    new = fill if fill is not None else " " if level == "one" else ""
    return F.regexp_replace(F.trim(c), r"\s+", new.replace("\\", "\\\\").replace("$", "\\$"))


def case(c: Column, style: str) -> Column:
    if style not in ("upper", "lower", "title"):
        raise ValueError("style is upper, lower or title")
    return {"upper": F.upper, "lower": F.lower, "title": F.initcap}[style](c)


def strip_punctuation(c: Column, keep: str | None = None) -> Column:
    """Only ASCII letters and digits, spaces and the characters of ``keep``."""
    return F.regexp_replace(c.cast("string"), f"[^A-Za-z0-9 {quoted(keep or '')}]", "")


def limit_white_space(c: Column, limit: int) -> Column:
    """Without any space if there are more than ``limit``."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(F.length(c) - F.length(bare) > limit, bare).otherwise(c)


def limit_hyphens(c: Column, limit: int) -> Column:
    """Runs of more than ``limit`` hyphens are cut to ``limit``."""
    return F.regexp_replace(c, "-{%d,}" % (limit + 1), "-" * limit)


def clean_hyphens(c: Column) -> Column:
    """No spaces beside hyphens, no hyphens at either end."""
    return F.regexp_replace(F.regexp_replace(c, " ?- ?", "-"), r"^-+|-+\z", "")


def join_single_letters(c: Column, terminals: bool = False) -> Column:
    """Spaces between words of one letter vanish; with ``terminals`` also those that part one letter at either end.

    Spaces beside such a word at an end of the text vanish too, and a text of spaces becomes empty. Every space is doubled,
    so that neighbours do not share one; words of one letter are marked; then only marks decide what is joined.
    """
    marked = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("  ")), r"(^| )(\w)( |\z)", f"$1{MARK}$2{MARK}$3")
    out = F.regexp_replace(marked, f"{MARK} +{MARK}", MARK * 2)
    out = F.regexp_replace(F.regexp_replace(out, f"^ +({MARK}|\\z)", "$1"), f"{MARK} +\\z", MARK)
    if terminals:
        out = F.regexp_replace(out, rf"^{MARK}(\w){MARK} +(\w)", "$1$2")
        out = F.regexp_replace(out, rf"(\w|{MARK}) +{MARK}(\w){MARK}\z", "$1$2")
    return F.replace(F.replace(out, F.lit(MARK), F.lit("")), F.lit("  "), F.lit(" "))


def clean_forename(c: Column) -> Column:
    """Without upper-case titles and fillers; the spaces around them stay."""
    return F.regexp_replace(c, rf"\b({'|'.join(FORENAME_NOISE)})\b", "")


def clean_surname(c: Column) -> Column:
    """Without fillers; an upper-case prefix is joined to what follows its space or hyphen."""
    return F.regexp_replace(F.regexp_replace(c, rf"\b({'|'.join(SURNAME_NOISE)})\b", ""), rf"\b({'|'.join(SURNAME_PREFIXES)})[ -]", "$1")


def regex_chain(c: Column, rules: dict[str, str]) -> Column:
    """``rules`` {replacement: pattern}, one after the other."""
    for new, pattern in rules.items():
        c = F.regexp_replace(c, pattern, new)
    return c


def pad_zeros(c: Column, width: int) -> Column:
    """Zeros in front up to ``width``; longer texts stay as they are."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def join_text(columns: list[Column], sep: str = " ") -> Column:
    """Non-null texts joined by ``sep``; repeated separators count once, none is left at the ends, nothing left is null."""
    made = F.concat_ws(sep, *columns)
    if not sep:
        return made
    s, new = quoted(sep), sep.replace("\\", "\\\\").replace("$", "\\$")
    clean = F.regexp_replace(F.regexp_replace(made, f"(?:{s})+", new), rf"^(?:{s})|(?:{s})\z", "")
    return F.nullif(clean, F.lit(""))


def substring(c: Column, start: int, length: int, from_end: bool = False) -> Column:
    """From ``start`` (1 is the first, negative counts from the end); ``from_end`` counts positions from the right."""
    return F.reverse(F.substring(F.reverse(c), start, length)) if from_end else F.substring(c, start, length)


def sorted_letters(c: Column) -> Column:
    """The characters of the upper-case text in order."""
    return F.array_join(F.array_sort(F.split(F.upper(c), "")), "")
