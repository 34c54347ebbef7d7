"""Variant spellings of names: rows of one person linked across typos, nicknames, initials and exchanged parts.

Rows meet only within a date of birth. There, MinHash signatures over padded q-grams of the name parts (and the postcode
as one long q-gram with some weight) are cut into bands, whose number follows from the collision curve; pairs that share
a band and do not contradict each other in postcode and sex are verified by Monge-Elkan similarity of the name parts;
star clustering makes persons of the links. Names are handled once for each distinct spelling, however many rows it has.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import jaro_winkler, one_edit
from ..runtime import materialise, measured, parallelism, ship

#: Words before or after a name that are no part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof rev revd sir dame lady lord mstr master jr sr".split())
ROWS_PER_BAND = 2
LIKELY_SIMILARITY, RECALL = 0.36, 0.97
POSTCODE_WEIGHT = 4
SMALL_RUN = 24
ROWS_OF_A_DAY = 200_000
ROWS_OF_A_TASK = 100_000
BATCH_ROWS = 20_000
MOST_BROADCAST = 100_000
MAX_NICKNAMES = 100_000
SAME, NEAR, OPEN = 0.82, 0.88, 0.9
#: Words are alike from this Jaro-Winkler similarity on (which takes a Jaro similarity of 0.73); others get a fixed low one.
ALIKE, UNLIKE = 0.84, 0.3


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` hashes with which a pair of that similarity collides with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(LIKELY_SIMILARITY, RECALL, ROWS_PER_BAND)


def plain_date(c: Column) -> Column:
    """A date's digits as year, month, day, from year-first or day-first writing; null where there are not eight digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    day_first = c.rlike(r"^\s*[0-9]{1,2}[^0-9]+[0-9]{1,2}[^0-9]+[0-9]{4}")
    ymd = F.when(day_first, F.concat(F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2))).otherwise(digits)
    usual = F.when(F.length(c) == 10, F.concat(F.substring(c, 1, 4), F.substring(c, 6, 2), F.substring(c, 9, 2)).try_cast("int"))
    plain = F.when((F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-") & (usual > 9_999_999), usual)  # without regular expressions
    return F.coalesce(plain, F.when(F.length(digits) == 8, ymd.cast("int")))


def sex_code(c: Column) -> Column:
    """1 male, 2 female, 0 unknown; from letters or digits."""
    s = F.upper(F.trim(c))
    return F.coalesce(F.when(s.isin("M", "1"), 1).when(s.isin("F", "2"), 2), F.lit(0)).cast("tinyint")


Spelling = tuple[tuple[str, ...], tuple[str, ...]]


class Names:
    """Parts, signatures and similarity of names, each worked out once for each distinct spelling."""

    def __init__(self, nicknames: list[tuple[str, str]], bands: int = BANDS, rows: int = ROWS_PER_BAND) -> None:
        self.full: dict[str, set[str]] = defaultdict(set)
        for short, full in nicknames:
            self.full[short.lower()].add(full.lower())
        draw = np.random.default_rng(20_240_111)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 1 << 62, bands * rows, dtype=np.uint64)
        self.parts_of: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.signature_of: dict[str, np.ndarray] = {}
        self.field_of: dict[str, np.ndarray] = {}
        self.letters_of: dict[str, int] = {}
        self.similar: dict[tuple[str, str], float] = {}

    def trim(self, most: int = 300_000) -> None:
        for known in (self.parts_of, self.signature_of, self.field_of, self.letters_of, self.similar):
            if len(known) > most:
                known.clear()

    def parts(self, field: str | None) -> tuple[str, tuple[str, ...]]:
        """All letters and digits of a field, and its words without titles."""
        if not field:
            return "", ()
        got = self.parts_of.get(field)
        if got is None:
            words = re.findall(r"[^\W_]+", field.replace("'", "").replace("\u2019", ""))
            got = self.parts_of[field] = "".join(words), tuple(w for w in words if w not in TITLES) or tuple(words)
        return got

    def hashes(self, grams: np.ndarray) -> np.ndarray:
        return (grams[:, None] * self.a + self.b) >> np.uint64(31)

    def signature(self, word: str) -> np.ndarray:
        got = self.signature_of.get(word)
        if got is None:
            padded = f"#{word}#"
            grams = np.array([xxhash.xxh64_intdigest(padded[i : i + 2]) for i in range(len(padded) - 1)], np.uint64)
            got = self.signature_of[word] = self.hashes(grams).min(axis=0).astype(np.uint32)
        return got

    def field_signature(self, field: str) -> np.ndarray:
        """The minima over a field's words, the field with its words run together, and the full forms of these."""
        got = self.field_of.get(field)
        if got is None:
            words = self.parts(field)[1]
            elements = {x for w in (*words, "".join(words)) for x in (w, *self.full.get(w, ()))}
            got = self.field_of[field] = np.stack([self.signature(e) for e in elements]).min(axis=0)
        return got

    def words(self, fields: tuple[str | None, ...]) -> Spelling:
        """The words of a name, each once, and its fields with their words run together."""
        parts = [self.parts(f)[1] for f in fields]
        return tuple(dict.fromkeys(w for ws in parts for w in ws)), tuple(dict.fromkeys("".join(ws) for ws in parts if ws))

    def letters(self, word: str) -> int:
        """A bit for each letter's first, second, ... occurrence: bits in common are letters in common, or a few more."""
        got = self.letters_of.get(word)
        if got is None:
            seen: dict[int, int] = defaultdict(int)
            got = 0
            for c in word:
                at = ord(c) & 31
                got |= 1 << (at + 32 * seen[at])
                seen[at] += 1
            self.letters_of[word] = got
        return got

    def word_similarity(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        got = self.similar.get((a, b))
        if got is None:
            got = self._word_similarity(a, b) if (len(a), a) < (len(b), b) else self._word_similarity(b, a)
            self.similar[a, b] = self.similar[b, a] = got
        return got

    def _word_similarity(self, short: str, long: str) -> float:
        if len(short) == 1:
            return 0.86 if long[0] == short else 0.0
        fa, fb = self.full.get(short), self.full.get(long)
        forms = [(x, y) for x in {short, *(fa or ())} for y in {long, *(fb or ())}] if fa or fb else []
        if any(x == y for x, y in forms):
            return 0.96
        common = (self.letters(short) & self.letters(long)).bit_count()
        possible = (common / len(short) + common / len(long) + 1) / 3  # Jaro cannot be more
        s = jaro_winkler(short, long) if possible >= 0.73 else 0.0
        if common >= len(long) - 1 and len(long) > 3 and one_edit(short, long):
            s = max(s, 0.93)
        if any(x != short and (x == long or one_edit(x, long)) or y != long and one_edit(y, short) and len(y) > 3 for x, y in forms):
            return max(s, 0.9)
        if common < min(3, len(short)):
            return s if s >= ALIKE else UNLIKE
        if len(short) >= 3 and long.startswith(short):
            return max(s, 0.9)
        pet = short[:-1] if short[-1:] == "y" else short[:-2] if short[-2:] == "ie" else short
        stem = pet[:-1] if len(pet) > 3 and pet[-1] == pet[-2] else pet
        if len(stem) >= 3 and (long.startswith(stem) or (len(short) < len(long) and stem in long)):
            return max(s, 0.86)
        if short[0] == long[0] and len(short) <= 4:  # a contraction: its letters in order
            at = iter(long)
            if all(c in at for c in short):
                return max(s, 0.86)
        return s if s >= ALIKE else UNLIKE

    def monge_elkan(self, a: tuple[str, ...], b: tuple[str, ...], least: float = 0.0) -> float:
        """Mean, over the words of the name with fewer words (of both, if they have as many), of the best similarity to a
        word of the other name; 0 as soon as it cannot reach ``least``."""
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 0.0
        similar, n = self.word_similarity, len(a)
        both = n == len(b)
        most = 2 * n if both else n  # as if all words to come were equal to one of the other name
        lost, may_lose = 0.0, most * (1 - least) + 1e-9
        for x in a:
            if x not in b:
                lost += 1 - max([similar(x, y) for y in b])
                if lost > may_lose:
                    return 0.0
        if both and lost:
            for y in b:
                if y not in a:
                    lost += 1 - max([similar(x, y) for x in a])
                    if lost > may_lose:
                        return 0.0
        return 1 - lost / most

    def name_similarity(self, a: Spelling, b: Spelling, strict: bool, least: float = 0.0) -> float:
        """Of the words or of the fields run together; unless ``strict``, also of the words of one with the fields of the other."""
        best = self.monge_elkan(a[0], b[0], least)
        if best < 0.999 and (a[0] != a[1] or b[0] != b[1]):
            best = max(best, self.monge_elkan(a[1], b[1], least))
            if not strict:
                best = max(best, self.monge_elkan(a[0], b[1], least), self.monge_elkan(a[1], b[0], least))
        return best


def _pairs_within(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within runs of ``order``, without a loop over runs."""
    left, right = [], []
    for shift in range(1, int(sizes.max(initial=1))):
        of = sizes > shift
        s, n = starts[of], sizes[of] - shift
        i = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        left.append(order[i])
        right.append(order[i + shift])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return order, starts, np.diff(np.concatenate((starts, [len(k)])))


class Postcodes:
    """Which pairs of postcodes do not contradict each other: equal, one edit apart, or one of them unknown in part."""

    def __init__(self, codes: list[str]) -> None:
        self.codes = codes
        self.full = np.array([len(c) > 4 for c in codes], bool)
        self.chars = np.array([c[:8].encode("ascii", "replace") for c in codes], "S8").view(np.uint8).reshape(len(codes), 8) if codes else np.empty((0, 8), np.uint8)
        self.length = np.array([len(c) for c in codes], np.int64)
        self.hash = pd.util.hash_array(np.array(codes, object), categorize=False) if codes else np.empty(0, np.uint64)

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = (self.chars[i] != self.chars[j]).sum(axis=1)
        both = self.full[i] & self.full[j]
        shifted = np.abs(self.length[i] - self.length[j]) == 1
        return ~both | (differ <= 2) | shifted

    def relations(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each pair: 3 the same, 2 one edit apart, 1 open (one of them unknown, or the start of the other), 0 neither."""
        out = np.ones(len(i), np.int8)
        full = self.full[i] & self.full[j]
        equal = full & (self.hash[i] == self.hash[j])
        out[equal] = 3
        codes = self.codes
        at = np.flatnonzero(full & ~equal)
        out[at] = [2 * one_edit(codes[a], codes[b]) for a, b in zip(i[at].tolist(), j[at].tolist())]
        at = np.flatnonzero(~full & (self.length[i] > 0) & (self.length[j] > 0))
        out[at] = [codes[a].startswith(codes[b]) or codes[b].startswith(codes[a]) for a, b in zip(i[at].tolist(), j[at].tolist())]
        return out

    def by_code(self, members: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """The members by their code."""
        of: dict[str, list[int]] = defaultdict(list)
        for m in members.tolist():
            of[self.codes[m]].append(m)
        return [(c, np.array(ms, np.int64)) for c, ms in of.items()]

    def starting(self, members: np.ndarray, code: str) -> np.ndarray:
        """Which members' codes start with ``code``, or are the start of it."""
        return np.array([c.startswith(code) or code.startswith(c) for c in (self.codes[m] for m in members.tolist())], bool)

    def variants(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys under which any two full postcodes at most one edit apart meet: each code, and it with a letter left out."""
        at, key = [], []
        for m in members:
            c = self.codes[m]
            for x in {c, *(c[:k] + c[k + 1 :] for k in range(len(c)))}:
                at.append(m)
                key.append(xxhash.xxh64_intdigest(x) >> 1)
        return np.array(at, np.int64), np.array(key, np.int64)


def candidates(signature: np.ndarray, group: np.ndarray, codes: Postcodes, sex: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band within a group and do not contradict each other in postcode and sex.

    A small run of one band gives all its pairs. In a larger one, full postcodes meet by their variants, and those that
    are unknown in part meet all that start with them, or that they start with: pairs that would be refused anyhow are not made.
    """
    n = len(group)
    found: list[np.ndarray] = []
    for b in range(bands):
        key = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = (key ^ signature[:, b * rows + r]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        order, starts, sizes = _runs(key)
        small = sizes <= SMALL_RUN
        i, j = _pairs_within(order, starts[small & (sizes > 1)], sizes[small & (sizes > 1)])
        left, right = [i], [j]
        for s, m in zip(starts[~small], sizes[~small]):
            members = order[s : s + m]
            full = members[codes.full[members]]
            at, k = codes.variants(full)
            o, st, sz = _runs(k)
            x, y = _pairs_within(at[o], st[sz > 1], sz[sz > 1])
            left.append(x)
            right.append(y)
            unknown = members[~codes.full[members]]
            for code, xs in codes.by_code(unknown):
                others = members[codes.starting(members, code)]
                left.append(np.repeat(xs, len(others)))
                right.append(np.tile(others, len(xs)))
        i, j = np.concatenate(left), np.concatenate(right)
        ok = (i != j) & codes.possible(i, j) & ((sex[i] == 0) | (sex[j] == 0) | (sex[i] == sex[j]))
        i, j = i[ok], j[ok]
        found.append(np.unique(np.minimum(i, j) * n + np.maximum(i, j)))
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return both // max(n, 1), both % max(n, 1)


def star_clusters(n: int, links: list[tuple[int, int, float]], weight: list[int], name: list[int]) -> list[int]:
    """The centre of each of ``n`` vertices. Vertices become centres in the order of their number of links (then weight,
    then the smaller name), unless they are linked to a centre; each other vertex goes to the centre it is most similar to."""
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, s in links:
        near[a][b] = near[b][a] = s
    centre = list(range(n))
    done: set[int] = set()
    for v in sorted(near, key=lambda v: (-len(near[v]), -weight[v], name[v])):
        if v not in done:
            done.add(v)
            done.update(near[v])
            centre[v] = -1
    return [v if v not in near or centre[v] == -1 else max(((s, -name[c], c) for c, s in near[v].items() if centre[c] == -1), default=(0, 0, v))[2] for v in range(n)]


def _settle(links: dict[tuple[int, int], tuple[float, bool]], codes: Postcodes) -> list[tuple[int, int, float]]:
    """Links kept of vertices without a full postcode: those to the postcode they are clearly most similar to, if any."""
    open_at: dict[int, dict[int, float]] = defaultdict(dict)
    for (a, b), (s, is_open) in links.items():
        if is_open:
            for x, y in ((a, b), (b, a)):
                if not codes.full[x] and codes.full[y]:
                    open_at[x][y] = s
    refused: set[tuple[int, int]] = set()
    for x, others in open_at.items():
        best: dict[str, float] = {}
        for y, s in others.items():
            best[codes.codes[y]] = max(s, best.get(codes.codes[y], 0))
        ranked = sorted(((s, c) for c, s in best.items()), reverse=True)
        keep = ranked[0][1] if len(ranked) == 1 or ranked[0][0] - ranked[1][0] > 0.02 else None
        near = {c for c in best if keep is not None and one_edit(c, keep)}
        if keep is None and all(one_edit(ranked[0][1], c) for _, c in ranked):
            near = set(best)
        refused |= {(min(x, y), max(x, y)) for y in others if codes.codes[y] not in near}
    return [(a, b, s) for (a, b), (s, _) in links.items() if (a, b) not in refused]


class Linker:
    """Links the rows of whole groups (dates of birth); gives the pairs of rows with different names."""

    def __init__(self, names: Names) -> None:
        self.names = names

    def signatures(self, fields: list[tuple[np.ndarray, list[str | None]]], codes: Postcodes) -> np.ndarray:
        """Minima of each row, of ``fields`` (which value each row has, and the values) and the full postcodes."""
        names = self.names
        nothing = np.full(names.bands * names.rows, np.iinfo(np.uint32).max, np.uint32)
        signature = np.tile(nothing, (len(codes.codes), 1))
        for at, values in fields:
            by_value = np.stack([names.field_signature(v) if v and names.parts(v)[1] else nothing for v in values])
            np.minimum(signature, by_value[at], out=signature)
        signature[(signature == nothing).all(axis=1)] = names.signature("")
        whole = np.flatnonzero(codes.full)
        for w in range(POSTCODE_WEIGHT):
            h = names.hashes(codes.hash[whole] + np.uint64(w * 0x9E3779B9)).astype(np.uint32)
            signature[whole] = np.minimum(signature[whole], h)
        return signature

    def verified(self, left: np.ndarray, right: np.ndarray, spelt: Callable[[int], Spelling], codes: Postcodes) -> dict[tuple[int, int], tuple[float, bool]]:
        """Similarity, and whether a postcode is open, of those pairs whose names are similar enough for their postcodes' relation."""
        links: dict[tuple[int, int], tuple[float, bool]] = {}
        relation = codes.relations(left, right)
        at = np.flatnonzero(relation)
        least = (0.0, OPEN, NEAR, SAME)
        for a, b, kind in zip(left[at].tolist(), right[at].tolist(), relation[at].tolist()):
            x, y = spelt(a), spelt(b)
            short = 0.15 if len(x[0]) < 2 or len(y[0]) < 2 else 0.0
            s = self.names.name_similarity(x, y, kind == 1, least[kind] + short) - short
            if s >= least[kind]:
                links[a, b] = (s, kind == 1)
        return links

    def spellings(self, table: pa.Table) -> tuple[list[tuple[np.ndarray, list[str | None]]], Callable[[int], Spelling], np.ndarray]:
        """Of the rows' names: which value each row has in each field, and the values; what gives a row's words; and a
        number for the letters and digits of (forename, middlename) in order and of the surname, equal where those are."""
        names, n = self.names, table.num_rows
        coded = pa.chunked_array([c for f in ("forename", "middlename", "surname") for c in table.column(f).chunks], pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
        values, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().reshape(3, n)
        number: dict[str, int] = {}
        clean = np.array([number.setdefault(names.parts(v)[0], len(number)) for v in values], np.int64)[at]
        names_of = np.unique(np.minimum(clean[0], clean[1]) * len(number) + np.maximum(clean[0], clean[1]), return_inverse=True)[1] * len(number) + clean[2]
        known: dict[int, Spelling] = {}
        f, m, s = at.tolist()
        whole = ((at[0].astype(np.int64) * len(values) + at[1]) * len(values) + at[2]).tolist()

        def spelt(i: int) -> Spelling:
            got = known.get(whole[i])
            if got is None:
                got = known[whole[i]] = names.words((values[f[i]], values[m[i]], values[s[i]]))
            return got

        return [(x, values) for x in at], spelt, names_of

    def persons(self, table: pa.Table) -> pa.RecordBatch | None:
        """``person, name, id`` of the rows of those persons who have several names; a person's number is the smallest id of
        the star's centre. ``table`` is sorted by id within its dates."""
        names = self.names
        names.trim()
        fields, spelt, name = self.spellings(table)
        day = table.column("dob").to_numpy()
        postcode = table.column("postcode").combine_chunks().dictionary_encode()
        sex = table.column("sex").to_numpy().astype(np.int8)
        spelling = np.unique(name * 3 + sex, return_inverse=True)[1] * len(postcode.dictionary) + postcode.indices.to_numpy()
        _, spelling = np.unique(spelling, return_inverse=True)
        _, first, vertex = np.unique(np.unique(day, return_inverse=True)[1] * (spelling.max(initial=0) + 1) + spelling, return_index=True, return_inverse=True)
        n = len(first)
        if n < 2:
            return None
        codes = Postcodes(postcode.take(pa.array(first)).to_pylist())
        signature = self.signatures([(at[first], values) for at, values in fields], codes)
        left, right = candidates(signature, day[first].astype(np.int64), codes, sex[first], names.bands, names.rows)
        at = first.tolist()
        links = self.verified(left, right, lambda v: spelt(at[v]), codes)
        if not links:
            return None
        ids = table.column("id").to_numpy()
        centre = np.array(star_clusters(n, _settle(links, codes), np.bincount(vertex, minlength=n).tolist(), ids[first].tolist()), np.int64)
        kinds = np.unique(np.stack([centre, name[first]]), axis=1)[0]
        several = np.bincount(kinds, minlength=n) > 1
        rows = np.flatnonzero(several[centre[vertex]])
        return pa.RecordBatch.from_arrays([pa.array(ids[first][centre[vertex[rows]]]), pa.array(name[rows].astype(np.int64)), pa.array(ids[rows])], ["person", "name", "id"]) if len(rows) else None


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """The batches, which are sorted by ``column``, in tables of some ``rows`` that part no group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


_linkers: dict[tuple, Linker] = {}


def linker_of(nicknames: list[tuple[str, str]], bands: int, rows: int) -> Linker:
    """This worker's linker: what it knows of spellings serves its next tasks too."""
    key = (tuple(nicknames), bands, rows)
    if key not in _linkers:
        _linkers.clear()
        _linkers[key] = Linker(Names(nicknames, bands, rows))
    return _linkers[key]


def _link(nicknames: list[tuple[str, str]], bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinweave.llm.name_variants import linker_of  # the worker's module, not this function's copy of it

        linker = linker_of(nicknames, bands, rows)
        for t in whole_groups(batches, "dob"):
            made = linker.persons(t)
            if made is not None:
                yield made

    return run


def learned_forms(rows: DataFrame) -> DataFrame:
    """``short, full``: first names that one person is known by, learned from the rows (dob, postcode, surname, forename).

    Where just two rows share birth, full postcode and surname and differ in first name (of one word), they are one
    person's or two kin's. Kin's names meet as chance has it; a familiar form meets its full form in most cases. So two names belong
    together if half of all such meetings of the rarer one are with the other, and at least three, and one in 100,000 of
    all meetings (so there are at most 100,000 forms). Names within one edit of each other, or of which one begins with
    the other, are left to the similarity of words. Only hashes are shuffled, and groups are counted map-side.
    """
    surname = F.regexp_replace("surname", r"[^\p{L}]", "")
    names = rows.where(F.col("forename").rlike(r"^\s*\p{L}{2,}\s*$")).select(F.trim("forename").alias("f"), surname.alias("s"), "dob", "postcode").where("length(s) > 1 and length(postcode) > 4")
    h = F.xxhash64("f")
    two = names.groupBy(F.xxhash64("dob", "postcode", "s").alias("k")).agg(F.min(h).alias("x"), F.max(h).alias("y"), F.count("*").alias("n")).where("n = 2 and x <> y")
    met = materialise(two.groupBy("x", "y").agg(F.count("*").alias("n")))
    of = met.select(F.col("x").alias("h"), "n").unionByName(met.select(F.col("y").alias("h"), "n")).groupBy("h").agg(F.sum("n").alias("m"))
    total = met.agg(F.sum("n").alias("total"))  # one row
    often = met.crossJoin(F.broadcast(total)).where("n >= 3 and n * 100000 >= total").select("x", "y", "n")
    both = often.join(of.select(F.col("h").alias("x"), F.col("m").alias("mx")), "x").join(of.select(F.col("h").alias("y"), F.col("m").alias("my")), "y").where(2 * F.col("n") >= F.least("mx", "my"))
    both = materialise(both.select(F.when(F.col("mx") < F.col("my"), F.col("x")).otherwise(F.col("y")).alias("short_h"), F.when(F.col("mx") < F.col("my"), F.col("y")).otherwise(F.col("x")).alias("full_h")))
    wanted = both.select(F.col("short_h").alias("h")).unionByName(both.select(F.col("full_h").alias("h"))).distinct()  # at most 200,000
    spelt = materialise(names.select("f", h.alias("h")).join(F.broadcast(wanted), "h").distinct())
    found = both.join(spelt.select(F.col("h").alias("short_h"), F.col("f").alias("short")), "short_h").join(spelt.select(F.col("h").alias("full_h"), F.col("f").alias("full")), "full_h")
    alike = F.startswith("short", "full") | F.startswith("full", "short") | (F.levenshtein("short", "full") <= 1)
    return found.where(~alike).select("short", "full")


def name_variants(df: DataFrame, nicknames: DataFrame, id_col: str = "id", bands: int = BANDS, rows: int = ROWS_PER_BAND, rows_of_a_day: int = ROWS_OF_A_DAY, learn: bool = True) -> DataFrame:
    """``person, name, id``: the rows of each person who has several names, with numbers of the person and the name.

    ``df`` has forename, middlename, surname, dob, sex and postcode as strings. Rows without a date of birth of eight
    digits, or with a null id, are linked to none; missing names, sexes and postcodes contradict nothing; equal rows are
    one spelling; texts of any length are used whole; an empty table has no persons. Names that differ in more than white
    space, case, punctuation and the order of forename and middlename have different numbers within a person. Familiar
    forms are those of ``nicknames`` and, with ``learn``, those :func:`learned_forms` finds.

    A date's rows are linked within one task, as a stream of dates. A date with more than ``rows_of_a_day`` rows (a default
    that stands for "unknown", say) is split: its spellings are shuffled by band instead, and stars are found by rounds of
    joins. Both ways give the same links.
    """
    from .crowded_days import crowded_persons

    spark = df.sparkSession
    ship(spark)
    short = nicknames.where("short_name is not null and full_name is not null").select("short_name", "full_name").limit(MAX_NICKNAMES + 1).collect()
    if len(short) > MAX_NICKNAMES:
        raise ValueError(f"more than {MAX_NICKNAMES} nicknames")
    given = [(r.short_name, r.full_name) for r in short]
    low = [F.lower(F.col(c)).alias(c) for c in ("forename", "middlename", "surname")]
    code = F.coalesce(F.regexp_replace(F.upper("postcode"), "[^A-Z0-9]", ""), F.lit("")).alias("postcode")
    rows_in = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), plain_date(F.col("dob")).alias("dob"), *low, sex_code(F.col("sex")).alias("sex"), code)
    rows_in, seen = measured(rows_in.where("dob is not null"), rows=F.count("*"))
    parts = parallelism(spark, seen["rows"], ROWS_OF_A_TASK)
    if learn:
        given += [(r.short, r.full) for r in learned_forms(rows_in).collect()]  # at most 100,000
    days, seen = measured(rows_in.groupBy("dob").agg(F.count("*").alias("n")).where(F.col("n") > rows_of_a_day), crowded=F.count("*"))
    usual, crowded = rows_in, None
    if seen["crowded"]:
        many = days.select("dob")
        many = F.broadcast(many) if seen["crowded"] <= MOST_BROADCAST else many
        usual, crowded = rows_in.join(many, "dob", "left_anti"), rows_in.join(many, "dob", "left_semi")
    found = usual.repartition(parts, "dob").sortWithinPartitions("dob", "id").mapInArrow(_link(given, bands, rows), "person long, name long, id long")
    return found.unionByName(crowded_persons(crowded, given, bands, rows)) if crowded is not None else found


def variant_pairs(persons: DataFrame) -> DataFrame:
    """``id_a < id_b``: the pairs of a person's rows, as :func:`name_variants` gives them, that differ in name."""
    persons = materialise(persons)
    a, b = (persons.select("person", F.col("name").alias(f"n_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    return a.join(b, "person").where("n_a <> n_b and id_a < id_b").select("id_a", "id_b")
