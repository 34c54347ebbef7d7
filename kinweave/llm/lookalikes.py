"""Texts that look the same but are stored with different characters, brought to one form.

Look-alike strings and code points are joined into transitive classes by union-find. Of each class the member that is
most frequent in the corpus becomes the representative, and an automaton over all other members rewrites every text
greedily: leftmost, longest. Letter case, accents, raised digits, line breaks and punctuation are visible and stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, ship

#: Letters and the plain Latin letters they cannot be told from; these hold also where the public table of
#: look-alikes (see known_look_alikes) has several letters of an alphabet for one.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮԌԜаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXYGWaesijopcyxhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv"))
LATIN = dict(zip("ɑıɡ", "aig"))
FIXED = CYRILLIC | GREEK | LATIN
#: Characters without a shape, kinds of hyphen, and marks of text that are not joined letters.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]
VISIBLE_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
LINE_BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85  "


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.above: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.above.setdefault(root, root)) != root:
            root = up
        while self.above[x] != root:
            self.above[x], x = root, self.above[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.above):
            out.setdefault(self.find(x), []).append(x)
        return {k: v for k, v in out.items() if len(v) > 1}


def known_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters and the plain Latin letters they look like, of the same case, from Unicode's public table of confusables.

    Spark's own jars hold that table. Where several letters of an alphabet have one Latin letter in it they differ to a
    reader of that alphabet: of those only the fixed ones above are taken. Without the table the fixed ones are all.
    """
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError:  # the class is not there
        return dict(FIXED)
    letters = [ch for ch in map(chr, range(0x41, 0x20000)) if unicodedata.category(ch) in ("Lu", "Ll") and unicodedata.normalize("NFKC", ch) == ch]
    bare = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")))
    plain = {(bare[ch], ch.isupper()): ch for ch in bare if ch.isascii()}
    found: dict[tuple[str, str], list[str]] = {}
    for ch in bare:
        if not ch.isascii() and (latin := plain.get((bare[ch], unicodedata.category(ch) == "Lu"))):
            found.setdefault((unicodedata.name(ch, "").split(" ")[0], latin), []).append(ch)
    return {chars[0]: latin for (_, latin), chars in found.items() if len(chars) == 1} | FIXED


def look_alike_classes(known: dict[str, str] | None = None) -> Classes:
    """All classes, from the Unicode database by rule and from the ``known`` letters. The empty string is a member too."""
    c = Classes()
    known = FIXED if known is None else known
    same: dict[str, set[str]] = {}
    for a, b in known.items():
        c.join(a, b)
        same.setdefault(b, {b}).add(a)
    for b in list(same):
        same |= dict.fromkeys(same[b], same[b])
    for code in INVISIBLE:
        c.join(chr(code), "")
    for code in HYPHENS:
        c.join(chr(code), "-")
    composed: list[tuple[str, str]] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:  # Hangul is composed by arithmetic, surrogates are no text
            continue
        ch = chr(code)
        if ch in LINE_BREAKS:
            continue
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if unicodedata.category(ch) == "Zs" and ch != " ":
            c.join(ch, " ")
        elif kind in ("<wide>", "<narrow>") or (kind == "<compat>" and unicodedata.category(ch)[0] in "LN" and not code in range(0x2100, 0x2190)) or kind in ("<initial>", "<medial>", "<final>", "<isolated>", "<font>"):
            text = "".join(chr(int(x, 16)) for x in rest.split())
            if " " not in text:
                c.join(ch, text)
                if 1 < len(text) <= 3:  # joined letters, also of look-alikes
                    for letters in product(*(sorted(_fixed_same(x)) for x in text)):
                        c.join(text, "".join(letters))
        elif kind and kind[0] != "<":
            composed.append((ch, unicodedata.normalize("NFD", ch)))
    for ch, parts in composed:
        c.join(ch, parts)
    for ch, parts in composed:  # an accent on a look-alike is a look-alike of the accented letter
        if len(parts) > 1:
            for base in sorted(_same(parts[0], same)):
                c.join(ch, base + parts[1:])
                c.join(ch, unicodedata.normalize("NFC", base + parts[1:]))
    return c


@lru_cache(maxsize=4096)
def _fixed_same(base: str) -> frozenset[str]:
    latin = FIXED.get(base) or base
    return frozenset([latin, *(a for a, b in FIXED.items() if b == latin)])


def _same(base: str, same: dict[str, set[str]]) -> set[str]:
    """The look-alikes of a letter, with those of full width."""
    found = same.get(base, {base}) | {base}
    return found | {chr(ord(b) + 0xFEE0) for b in found if 0x21 <= ord(b) <= 0x7E}


def representatives(classes: Classes, counts: dict[str, int]) -> dict[str, str]:
    """For every member but the representative itself, what it becomes.

    The most frequent composed member is the representative; the shorter, then the smaller, of equally frequent ones. A class with
    the empty string becomes the empty string, one with a plain space the space: those have no frequency to speak for them.
    """
    out = {}
    for members in classes.members().values():
        best = next((x for x in ("", " ", "-") if x in members), None)
        if best is None:
            best = min((x for x in members if unicodedata.normalize("NFC", x) == x), key=lambda x: (-counts.get(x, 0), len(x), x), default=members[0])
        out |= {x: best for x in members if x != best}
    return out


def _automaton(words: dict[str, object]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, value in words.items():
        made.add_word(word, value)
    made.make_automaton()
    return made


def _counter(members: set[str]):
    """Occurrences of code points and of member strings in a partition: the strings by an automaton, overlaps included."""
    strings = [x for x in members if len(x) > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            texts = b.column(0).to_pylist()
            here: Counter[str] = Counter()
            for t in texts:
                here.update(t)
            if words := {x: x for x in strings if all(c in here for c in x)}:  # a small automaton is a fast one
                find = _automaton(words)
                for t in texts:
                    here.update([x for _, x in find.iter(t)])
            seen.update(here)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["member", "n"])

    return run


def possible_rules(rules: dict[str, str], counts: dict[str, int]) -> dict[str, str]:
    """The rules that can fit: those made of code points that the corpus has or that a rule makes."""
    alphabet = {c for c in counts if len(c) == 1}
    while True:
        kept = {a: b for a, b in rules.items() if all(c in alphabet for c in a)}
        more = alphabet | {c for b in kept.values() for c in b}
        if more == alphabet:
            return kept
        alphabet = more


class Rewriter:
    """Greedy rewriting with one automaton over all patterns; what it makes may match again with what follows, so a text is
    rewritten until it stays (a letter, an invisible character and an accent are such a case)."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.ascii_stays = not any(a.isascii() for a in rules)
        self.automaton = _automaton({a: (len(a), b) for a, b in rules.items()}) if rules else None

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (n, new) in self.automaton.iter_long(text):
            out += (text[at : end + 1 - n], new)
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str) -> str:
        if self.automaton is None or self.ascii_stays and text.isascii():
            return unicodedata.normalize("NFC", text)
        while True:
            composed = unicodedata.normalize("NFC", text)
            new = self._once(composed)
            if new == composed:
                return new
            text = new


def _rewrite(rules: dict[str, str], text: str, out: str):
    made: list[Rewriter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made[:] = made or [Rewriter(rules)]
        for b in batches:
            new = pa.array([None if t is None else made[0](t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, out])

    return run


def one_form(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` with the column ``out``: its texts in the corpus' one form. Two scans (frequencies, then rewriting), no shuffle
    of texts; the frequencies are one row for each code point or class member, so at most as many as Unicode has.

    A null text has a null form, an empty one an empty form; texts of any length are rewritten whole; an existing column
    ``out`` is replaced; an empty table keeps its columns.
    """
    ship(df.sparkSession)
    df = df.drop(out)
    classes = look_alike_classes(known_look_alikes(df.sparkSession))
    known = {x for m in classes.members().values() for x in m}
    seen = df.select(text).where(F.col(text).isNotNull()).mapInArrow(_counter(known), "member string, n long")
    counts = {r.member: r.n for r in seen.groupBy("member").agg(F.sum("n").alias("n")).collect()}
    rules = possible_rules(representatives(classes, counts), counts)
    return df.mapInArrow(_rewrite(rules, text, out), df.select("*", F.lit(None).cast("string").alias(out)).schema)


def _hashed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    h = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))
    forms = one_form(df.select(id_col, text), text, "form").where(F.trim(F.regexp_replace("form", r"\s+", "")) != "")
    return forms.select(F.col(id_col).alias("id"), h(F.col("form")).alias("f"), h(F.col(text)).alias("t"))


def visually_identical_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id_col>, form_id, text_id``: documents whose form has several stored texts; those with one ``form_id`` look the
    same, those with one ``text_id`` are the same. One row for each document, so it grows as the table however many
    copies there are. Null and blank forms never count; repeated ids are as many rows."""
    return _several(materialise(_hashed(df, id_col, text))).select(F.col("id").alias(id_col), _short("f").alias("form_id"), _short("t").alias("text_id"))


def _short(c: str) -> Column:
    return F.concat(F.hex(f"{c}.a"), F.lit("-"), F.hex(f"{c}.b"))


def _several(rows: DataFrame) -> DataFrame:
    texts = rows.select("f", "t").distinct()  # as few rows for a text as there are tasks, however many copies it has
    return rows.join(texts.groupBy("f").count().where("count > 1").select("f"), "f", "left_semi")


def visually_identical(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_a < doc_b``: documents with the same form whose stored texts differ, by bytes.

    The corpus is rewritten once and read twice; only texts' 128-bit hashes are written and shuffled. Forms with a single
    stored text, however many copies it has, are dropped before anything is joined, and texts are paired before their
    documents are. All pairs are asked for; :func:`visually_identical_groups` has a row for each document instead.
    """
    rows = materialise(_several(materialise(_hashed(df, id_col, text))))
    texts = rows.select("f", "t").distinct()
    pairs = texts.withColumnRenamed("t", "ta").join(texts.withColumnRenamed("t", "tb"), "f").where("ta < tb").select("ta", "tb")
    a, b = rows.select(F.col("t").alias("ta"), F.col("id").alias("ia")), rows.select(F.col("t").alias("tb"), F.col("id").alias("ib"))
    return pairs.join(a, "ta").join(b, "tb").select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"))
