"""Matching entities across two sources without a common key, by a label model over heuristic votes.

Records meet by several block keys of two or three attributes each. The keys are shuffled one part after another, with the
records, and a pair is kept where it meets by the first key that the two have in common, so no pairs are shuffled. Heuristic functions compare first name, last name, date of birth and address number of each pair and vote. Only the
counts of vote patterns leave the cluster; the label model fitted on them gives every pattern its confidence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialise, measured, settings, together
from .label_model import LabelModel
from .name_variants import MAX_NICKNAMES, learned_forms, plain_date

#: Votes, by their number of levels; level 0 abstains, as an attribute is missing.
LEVELS = {"first": 6, "last": 5, "born": 5, "place": 5, "common": 3}
#: Where the model starts. Levels: first name differs, sounds alike, initial, near, same; last name differs, sounds alike,
#: near, same; birth differs, in part, near, same; address differs, near, same but crowded, same; name common, rare.
KINDS = {
    "match": [[0.01, 0.01, 0.06, 0.17, 0.75], [0.04, 0.01, 0.17, 0.78], [0.005, 0.03, 0.05, 0.915], [0.06, 0.07, 0.02, 0.85], [0.7, 0.3]],
    "twins": [[0.87, 0.05, 0.05, 0.03, 0], [0.01, 0.01, 0.13, 0.85], [0.01, 0.01, 0.03, 0.95], [0.10, 0.07, 0.03, 0.80], [0.7, 0.3]],
    "kin of one name": [[0.01, 0.01, 0.05, 0.13, 0.80], [0.01, 0.01, 0.13, 0.85], [0.994, 0.004, 0.002, 0], [0.04, 0.07, 0.03, 0.86], [0.7, 0.3]],
    "family": [[0.87, 0.05, 0.05, 0.03, 0], [0.02, 0.02, 0.13, 0.83], [0.93, 0.05, 0.02, 0], [0.04, 0.07, 0.08, 0.81], [0.7, 0.3]],
    "strangers of one name": [[0.01, 0.01, 0.01, 0.02, 0.95], [0.01, 0.01, 0.03, 0.95], [0.35, 0.49, 0.16, 0], [0.97, 0.015, 0.015, 0], [0.97, 0.03]],
    "strangers of one day, last name": [[0.88, 0.05, 0.04, 0.028, 0.002], [0.02, 0.10, 0.05, 0.83], [0.005, 0.005, 0.01, 0.98], [0.97, 0.015, 0.015, 0], [0.8, 0.2]],
    "strangers of one day, first name": [[0.02, 0.05, 0.03, 0.10, 0.80], [0.94, 0.04, 0.02, 0], [0.005, 0.005, 0.01, 0.98], [0.97, 0.015, 0.015, 0], [0.8, 0.2]],
    "strangers of one address": [[0.85, 0.05, 0.05, 0.05, 0], [0.90, 0.05, 0.05, 0], [0.93, 0.05, 0.02, 0], [0.01, 0.01, 0.90, 0.08], [0.8, 0.2]],
    "strangers of one name, crowded": [[0.02, 0.05, 0.03, 0.10, 0.80], [0.02, 0.10, 0.05, 0.83], [0.93, 0.05, 0.02, 0], [0, 0, 1, 0], [0.97, 0.03]],
    "strangers of one day, crowded": [[0.88, 0.05, 0.04, 0.028, 0.002], [0.95, 0.03, 0.01, 0.01], [0.005, 0.005, 0.01, 0.98], [0, 0, 1, 0], [0.8, 0.2]],
}
SHARES = [0.6, 0.02, 0.02, 0.02, 0.1, 0.1, 0.1, 0.04, 0.01, 0.01]
#: Kinds of pairs that have a vote's distribution in common, in the order of KINDS: whether it compares an attribute of one
#: person, of different ones, or one by which a block selected the pair (kin whose first names differ are so by their births).
TIES = {"first": [0, 1, 0, 1, 2, 3, 2, 1, 2, 3], "last": [0, 0, 0, 0, 1, 1, 2, 2, 1, 3], "born": [0, 0, 1, 3, 2, 4, 4, 3, 3, 4], "place": [0, 0, 0, 0, 1, 1, 1, 2, 3, 3], "common": [0, 0, 0, 0, 1, 2, 2, 2, 1, 2]}
#: Distributions that are known: births of two people whom no birth selected agree in part by the calendar's chance only.
HELD = {("born", 1)}
#: Kinds of which there are more as there are more records, and how many of them have one address of few.
PEOPLE, AT_HOME = ["match", "twins", "kin of one name", "family"], 0.75
#: What is learned of them from pairs of one address, if there are so many such pairs: votes and numbers of distributions.
PERSONAL, LEAST_AT_HOME, ENOUGH_AT_HOME = [("first", 0), ("first", 1), ("last", 0), ("born", 0), ("common", 0)], 100, 40_000
CROWDED = 20
USUAL = 20_000
MATCH = 0.5
#: A key that one in this many of the sampled keys has is dealt out over cells of some CELL rows on either side.
HOT_SHARE, CELL, SAMPLED = 2000, 3000, 50
MOST_BROADCAST = 100_000


#: The shuffle files of a query are deleted when it ends, not when the driver's garbage is collected. Code of more than 8000 bytes
#: a method, which the JVM would only interpret, is generated in smaller ones.
WHILE_LINKING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: Tables that are kept for long are packed well.
SMALL = {"compression": "zstd"}


@dataclass(frozen=True)
class Part:
    """Work done at a time: some kinds of block keys, about so many keys for each record, or of these one hash class."""

    kinds: tuple[int, ...]
    keys: float = 1
    of: int = 1
    at: int = 0


#: In the order of the kinds, as a pair belongs to the first key that it has in common.
WORK = [Part((0, 1, 2)), Part((3,), 1, 2, 0), Part((3,), 1, 2, 1), Part((4,)), Part((5,)), Part((6,)), Part((7,)), Part((8, 9)), Part((10,)), Part((11,)), Part((12,))]
ALL = Part(tuple(range(13)))
#: Parts are merged while they have fewer keys.
PART_KEYS = 500_000
#: What is asked of two records that share a key, to know whether they share one that comes before it.
ASKED = ("f", "forms", "s", "d", "u", "crowded", "usual")


@dataclass(frozen=True)
class Source:
    df: DataFrame
    id_col: str


def _letters(c: Column) -> Column:
    x = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.when(x != "", x)


def _plain(source: Source) -> DataFrame:
    number = F.regexp_replace(F.regexp_replace("uprn", r"\.0*\s*$", ""), "[^0-9]", "")
    parts = F.filter(F.split(F.regexp_replace(F.lower("last_name"), "['\u2019]", ""), r"[^\p{L}]+"), lambda x: F.length(x) > 2)
    parts = F.when(F.col("last_name").rlike(r"\p{L}[^\p{L}'\u2019]+\p{L}"), parts)  # of one word there is no need to carry parts
    return source.df.where(F.col(source.id_col).isNotNull()).select(F.col(source.id_col).alias("id"), _letters(F.col("first_name")).alias("f"), _letters(F.col("last_name")).alias("s"), parts.alias("parts"), plain_date(F.col("date_of_birth")).alias("d"), F.when(number != "", number).alias("u"))


def _forms(nicknames: DataFrame, rows: DataFrame) -> DataFrame:
    """``f, forms``: for every short form, the full forms it may stand for: those given, and those learned from records that
    share last name, birth and address."""
    given = nicknames.where("short_name is not null and full_name is not null").select(_letters(F.col("short_name")).alias("short"), _letters(F.col("full_name")).alias("full"))
    if given.limit(MAX_NICKNAMES + 1).count() > MAX_NICKNAMES:
        raise ValueError(f"more than {MAX_NICKNAMES} nicknames")
    learned = learned_forms(rows.select(F.col("f").alias("forename"), F.col("s").alias("surname"), F.col("d").alias("dob"), F.col("u").alias("postcode")))
    return materialise(given.unionByName(learned).where("short is not null and full is not null").groupBy(F.col("short").alias("f")).agg(F.array_sort(F.collect_set("full")).alias("forms")))


def prepared(left: Source, right: Source, nicknames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sources with plain attributes, a number ``n`` for each record, and whether its address is that of many and its
    name a usual one: counted over both sources. Hashes are made anew where they are needed, as they cannot be compressed."""
    hu, hn = F.when(F.col("u").isNotNull(), F.xxhash64("u")), F.when(F.col("f").isNotNull() & F.col("s").isNotNull(), F.xxhash64("f", "s"))

    def numbered(source: Source) -> tuple[DataFrame, int]:
        out, seen = measured(_plain(source).withColumn("n", F.monotonically_increasing_id()), SMALL, n=F.count("*"))
        return out, seen["n"]

    (l, n_l), (r, n_r) = numbered(left), numbered(right)
    made = _forms(nicknames, l.unionByName(r))
    forms = F.broadcast(made)  # at most as many as nicknames may be, twice
    both = l.unionByName(r).select(hu.alias("hu"), hn.alias("hn"))
    many = both.where("hu is not null").groupBy("hu").agg(F.count("*").alias("lives")).where(F.col("lives") > CROWDED)
    many, seen = measured(many.select("hu", F.lit(True).alias("crowded")), n=F.count("*"))
    often = both.where("hn is not null").groupBy("hn").agg(F.count("*").alias("k")).where(F.col("k") * USUAL > n_l + n_r)
    often = materialise(often.select("hn", F.lit(True).alias("usual")))  # fewer than USUAL

    def flagged(plain: DataFrame) -> DataFrame:
        rows = plain.withColumns({"hu": hu, "hn": hn}).join(forms, "f", "left")
        if seen["n"] <= MOST_BROADCAST:
            rows = rows.join(F.broadcast(many), "hu", "left")
        else:  # unknown addresses are spread: a number that is no address' joins nothing
            rows = rows.withColumn("at", F.coalesce("hu", F.xxhash64("n"))).join(many.withColumnRenamed("hu", "at"), "at", "left").drop("at")
            rows = rows.withColumn("crowded", F.col("crowded") & F.col("hu").isNotNull())
        rows = rows.join(F.broadcast(often), "hn", "left").drop("hu", "hn")
        out = materialise(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("crowded", "usual")}), **SMALL)
        discard(plain)
        return out

    out = flagged(l), flagged(r)
    discard(made, many, often)
    return out


def _block_keys(side: str, p: str = "") -> list[list[Column]]:
    """Block keys, their kind first; a key with a missing part blocks nothing. ``p``: prefix of the record's columns.

    An address of few comes first, but for those pairs of whom :func:`_if` says that they are kin. The two of kind 3 are names
    with a date: names that were exchanged meet too. Same sounding names meet by any two parts of their dates. A name that is
    not usual also meets a record of that name without a date. For same names the address number is cut in four, the first
    half counted from its start and the second from its end: two changed digits, a swap or one digit more or less leave two
    cuts whole, one of the second half or both of the first. The first two alone are what numbers of one district have in
    common, so a usual name must agree in eight digits there: only changes on both sides of the ninth are lost.
    """
    f, forms, s, d, u, crowded, usual = (F.col(p + c) for c in ("f", "forms", "s", "d", "u", "crowded", "usual"))
    g = F.coalesce(F.get(forms, F.lit(0)), f)
    year, month, day = (d / 10000).cast("int"), (d / 100).cast("int") % 100, d % 100
    sound, last = F.soundex(g), F.soundex(s)
    crowd, rare = F.when(crowded, u), F.when(~usual, f)
    undated = F.when(d.isNull(), rare)
    return [
        [0, F.when(~crowded, u)],
        [1, d, crowd],
        [2, crowd, last, sound],
        [3, d, last],
        [3, d, sound],
        [4, month, day, last, sound],
        [5, year, month, last, sound],
        [6, year, day, last, sound],
        [7, year, F.least(month, day), F.greatest(month, day), last, sound],
        [8, undated if side == "l" else rare, s],
        [9, rare if side == "l" else undated, s],
        [10, f, s, F.when(usual, F.substring(u, 1, 8)).otherwise(F.substring(u, 1, 6))],
        [11, f, s, _cuts(u)[2]],
        [12, f, s, _cuts(u)[3]],
    ]


def _cuts(u: Column) -> list[Column]:
    return [F.substring(u, at, 3) for at in (1, 4, -6, -3)]


def _if() -> dict[int, Column]:
    """What else two records must have that share a key of some kinds: at an address, a birth or an initial that agrees in any
    way, or one that is unknown; with a cut of the number's second half, another cut."""
    unknown = reduce(lambda x, y: x | y, [F.col(f"{p}_{c}").isNull() for p in "lr" for c in "dfs"])
    initial = lambda c: F.substring(c, 1, 1)
    named = reduce(lambda x, y: x | y, [initial(_full("l")) == initial(_full("r")), *[initial(f"l_{a}") == initial(f"r_{b}") for a, b in ("ff", "fs", "sf")]])
    ld, rd = F.col("l_d"), F.col("r_d")
    born = (ld % 10000 == rd % 10000) | ((ld / 100).cast("int") == (rd / 100).cast("int")) | (((ld / 10000).cast("int") == (rd / 10000).cast("int")) & ((ld % 100 == rd % 100) | (ld % 100 == (rd / 100).cast("int") % 100)))
    a, b, c, d = (x == y for x, y in zip(_cuts(F.col("l_u")), _cuts(F.col("r_u"))))
    return {0: unknown | named | born, 11: a | b | d, 12: a | b}


def _first_meeting(last: int) -> Column:
    """The first pair of block keys, as 100 times the left one's number and the right one's, that two records have in common,
    among those of no later kind than the last."""
    out, others = F, _if()
    for i, (kind, *a) in enumerate(_block_keys("l", "l_")):
        for j, (other, *b) in enumerate(_block_keys("r", "r_")):
            if kind == other <= last:
                same = reduce(lambda x, y: x & y, [x == y for x, y in zip(a, b)])
                out = out.when(same & others[kind] if kind in others else same, 100 * i + j)
    return out


def _keyed(rows: DataFrame, side: str, work: Part = ALL) -> DataFrame:
    """The records once for each of their block keys, with the key and its number ``k``."""
    known = lambda parts: reduce(lambda x, y: x & y, [c.isNotNull() for c in parts])
    keys = [(k, F.xxhash64(F.lit(kind), *parts), known(parts)) for k, (kind, *parts) in enumerate(_block_keys(side)) if kind in work.kinds]
    if len(keys) == 1:
        out = rows.where(keys[0][2]).withColumns({"key": keys[0][1], "k": F.lit(keys[0][0])})
    else:
        made = [F.when(whole, F.struct(key.alias("key"), F.lit(k).alias("k"))) for k, key, whole in keys]
        out = rows.withColumn("met", F.explode(F.array_compact(F.array(*made)))).select("*", "met.*").drop("met")
    return out if work.of == 1 else out.where(F.pmod("key", F.lit(work.of)) == work.at)


def _hot_keys(keys: DataFrame) -> DataFrame | None:
    """``key, cells``: keys that hold at least 1/HOT_SHARE of those of a hundredth of the records, and into how many cells to deal
    them on either side; None if there are none. Being among them changes where a pair is made, not whether it is."""
    some = keys.where(F.pmod(F.xxhash64("n"), F.lit(100)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    some, seen = measured(some, all=F.sum("n"))
    floor = max(SAMPLED, (seen["all"] or 0) / HOT_SHARE)
    hot, seen = measured(some.where(F.col("n") >= floor).select("key", F.ceil(F.col("n") * 100 / CELL).cast("int").alias("cells")), n=F.count("*"))
    discard(some)
    return F.broadcast(hot) if seen["n"] else None  # fewer than HOT_SHARE


def _dealt(keyed: DataFrame, hot: DataFrame | None, side: str) -> DataFrame:
    """Hot keys are made one with their cell: a left record has a row of cells, a right one a column, so any two meet in just one."""
    if hot is None:
        return keyed
    own = F.pmod(F.xxhash64("n"), "cells").cast("int")
    other = F.sequence(F.lit(0), F.col("cells") - 1)
    cells = F.transform(other, lambda x: F.xxhash64("key", own * F.col("cells") + x if side == "l" else x * F.col("cells") + own))
    dealt = F.explode(F.when(F.col("cells").isNull(), F.array("key")).otherwise(cells))
    return keyed.join(hot, "key", "left").withColumn("dealt", dealt).drop("key", "cells").withColumnRenamed("dealt", "key")


def _hot(l: DataFrame, r: DataFrame) -> DataFrame | None:
    return _hot_keys(_keyed(l, "l").select("key", "n").unionByName(_keyed(r, "r").select("key", "n")))


def _meetings(l: DataFrame, r: DataFrame, hot: DataFrame | None, columns: list[str], work: Part = ALL) -> DataFrame:
    """The columns of both records (``l_``, ``r_``) of the pairs whose first key in common is in this part of the work."""
    carried = dict.fromkeys(["k", *ASKED, *columns])
    side = lambda rows, p: _dealt(_keyed(rows, p, work), hot, p).select("key", *[F.col(c).alias(f"{p}_{c}") for c in carried])
    return side(l, "l").join(side(r, "r"), "key").where(_first_meeting(max(work.kinds)) == F.col("l_k") * 100 + F.col("r_k"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``l_n, r_n`` with a block key in common, of records as :func:`prepared` makes them, however many have it."""
    return _meetings(left, right, _hot(left, right), ["n"]).select("l_n", "r_n")


def _parts(records: int) -> list[Part]:
    """The work in parts of about one key a record each, or more where the tables are small."""
    most, out = max(1.0, PART_KEYS / max(1, records)), []
    for work in WORK:
        if out and work.of == 1 and out[-1].of == 1 and out[-1].keys + work.keys <= most:
            out[-1] = Part(out[-1].kinds + work.kinds, out[-1].keys + work.keys)
        elif work.of > 1 and work.keys * work.of <= most:
            out += [Part(work.kinds, work.keys * work.of)] if work.at == 0 else []
        else:
            out.append(work)
    return out


def _near(a: Column, b: Column, apart: Column) -> Column:
    """At most one edit, two in words of seven letters or more; a text's levenshtein distance stops counting beyond that."""
    most = F.when(F.least(F.length(a), F.length(b)) >= 7, 2).otherwise(1)
    return (apart >= 0) & (apart <= most) & (F.least(F.length(a), F.length(b)) >= 3)


def _swapped(a: Column, b: Column, apart: Column) -> Column:
    """One exchange of neighbouring letters: the same letters, two of them elsewhere."""
    return (F.length(a) == F.length(b)) & (apart == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))


def _full(p: str) -> Column:
    return F.coalesce(F.get(f"{p}_forms", F.lit(0)), f"{p}_f")


def distances() -> dict[str, Column]:
    """Edits between the attributes of a pair, up to two, else -1; as columns that are worked out once and read by several votes."""
    apart = lambda a, b: F.when(a != b, F.levenshtein(a, b, 2)).otherwise(F.when(a == b, 0))
    own = {f"apart_{x}": apart(F.col(f"l_{x}"), F.col(f"r_{x}")) for x in "fsu"}
    forms = F.col("l_forms").isNotNull() | F.col("r_forms").isNotNull()
    return own | {"apart_g": F.when(forms, apart(_full("l"), _full("r"))).otherwise(own["apart_f"]), "apart_d": apart(F.col("l_d").cast("string"), F.col("r_d").cast("string"))}


def votes() -> dict[str, Column]:
    """The heuristic functions, over the columns f, forms, s, parts, d, u of the left (l_) and the right (r_) record
    and their :func:`distances`."""
    c = lambda x: (F.col(f"l_{x}"), F.col(f"r_{x}"))
    (lf, rf), (lo, ro), (ls, rs), (lp, rp), (ld, rd), (lu, ru) = (c(x) for x in ("f", "forms", "s", "parts", "d", "u"))
    lg, rg = _full("l"), _full("r")
    af, ag, as_, ad, au = (F.col(f"apart_{x}") for x in "fgsdu")
    every = lambda forms, f: F.concat(F.coalesce(forms, F.array().cast("array<string>")), F.array(f))
    familiar = (lo.isNotNull() | ro.isNotNull()) & F.arrays_overlap(every(lo, lf), every(ro, rf))
    in_part = (lp.isNotNull() | rp.isNotNull()) & F.arrays_overlap(F.coalesce(lp, F.array(ls)), F.coalesce(rp, F.array(rs)))
    exchanged = (lf == rs) & (ls == rf)
    short = F.least(F.length(lf), F.length(rf)) == 1
    first = (
        F.when(lf.isNull() | rf.isNull(), 0)
        .when((lf == rf) & ~short, 5)
        .when(exchanged, 5)
        .when(short, F.when((F.substring(lf, 1, 1) == F.substring(rf, 1, 1)) | (F.substring(lg, 1, 1) == F.substring(rg, 1, 1)), 3).otherwise(1))
        .when(familiar | _near(lf, rf, af) | _near(lg, rg, ag) | _swapped(lf, rf, af), 4)
        .when(F.startswith(lf, F.substring(rf, 1, 3)) & (F.startswith(lf, rf) | F.startswith(rf, lf) | (F.soundex(lf) == F.soundex(rf))), 4)
        .when(F.soundex(lg) == F.soundex(rg), 2)
        .otherwise(1)
    )
    last = (
        F.when(ls.isNull() | rs.isNull(), 0)
        .when(ls == rs, 4)
        .when(exchanged, 4)
        .when(_near(ls, rs, as_) | _swapped(ls, rs, as_) | in_part, 3)
        .when(F.soundex(ls) == F.soundex(rs), 2)
        .otherwise(1)
    )
    ldt, rdt = ld.cast("string"), rd.cast("string")
    turned = (F.substring(ldt, 1, 4) == F.substring(rdt, 1, 4)) & (F.substring(ldt, 5, 2) == F.substring(rdt, 7, 2)) & (F.substring(ldt, 7, 2) == F.substring(rdt, 5, 2))
    born = (
        F.when(ld.isNull() | rd.isNull(), 0)
        .when(ld == rd, 4)
        .when(turned | (ad == 1) | _swapped(ldt, rdt, ad), 3)
        .when((ld % 10000 == rd % 10000) | ((ld / 100).cast("int") == (rd / 100).cast("int")) | ((ld / 10000).cast("int") == (rd / 10000).cast("int")) & (ld % 100 == rd % 100), 2)
        .otherwise(1)
    )
    crowded = F.col("l_crowded") | F.col("r_crowded")
    place = F.when(lu.isNull() | ru.isNull(), 0).when(lu == ru, F.when(crowded, 3).otherwise(4)).when(_near(lu, ru, au) | _swapped(lu, ru, au), 2).otherwise(1)
    common = F.when(ls.isNull() | rs.isNull() | lf.isNull() | rf.isNull(), 0).when(F.col("l_usual") | F.col("r_usual"), 1).otherwise(2)
    return {k: v.cast("int") for k, v in {"first": first, "last": last, "born": born, "place": place, "common": common}.items()}


def label_model(patterns: np.ndarray | None = None, counts: np.ndarray | None = None) -> LabelModel:
    """The model as it starts. Of the pairs counted, those of strangers grow with the square of the records, those of PEOPLE
    with the records: so many start in these kinds as have one address of few, which strangers have not."""
    shares = np.array(SHARES) / sum(SHARES)
    people = np.isin(list(KINDS), PEOPLE)
    if patterns is not None and (at_home := counts[patterns[:, list(LEVELS).index("place")] == 4].sum()):
        most = min(shares[people].sum(), at_home / AT_HOME / counts.sum())
        shares = np.where(people, shares / shares[people].sum() * most, shares / shares[~people].sum() * (1 - most))
    return LabelModel(KINDS, shares.tolist(), list(TIES.values()), {(list(LEVELS).index(v), g) for v, g in HELD})


def fitted(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """The model, fitted in two steps. Strangers meet at one address of few by chance only, however many records there are, so what
    PEOPLE's votes look like is learned from the pairs that have one; then shares and strangers' votes from all pairs."""
    model, home = label_model(patterns, counts), patterns[:, list(LEVELS).index("place")] == 4
    if counts[home].sum() >= LEAST_AT_HOME:
        some = counts[home] * min(1, ENOUGH_AT_HOME / counts[home].sum())  # of more pairs, what the model starts from would count for less
        model.hold(label_model().fit(patterns[home], some), [(list(LEVELS).index(v), g) for v, g in PERSONAL])
        model.hold(label_model(), [(list(LEVELS).index("place"), 0)])
    return model.fit(patterns, counts)


def _voted(l: DataFrame, r: DataFrame) -> DataFrame:
    """``l_id, r_id`` and the votes on all candidate pairs, of records as :func:`prepared` makes them. One part of the block keys
    is shuffled at a time, with the attributes, so a pair needs no other shuffle and the disk holds no more than one part."""
    hot, cast = _hot(l, r), [v.alias(k) for k, v in votes().items()]
    made = [materialise(_meetings(l, r, hot, ["id", "parts"], work).withColumns(distances()).select("l_id", "r_id", *cast), **SMALL) for work in _parts(l.count() + r.count())]
    discard(l, r, hot)
    return together(made)


def link_sources(left: Source, right: Source, nicknames: DataFrame) -> tuple[DataFrame, LabelModel | None]:
    """``l_id, r_id, confidence`` of all candidate pairs, and the model that gave the confidence.

    Both sources have first_name, last_name, date_of_birth and uprn as strings. Missing and blank values abstain; a record
    without any block key (two known attributes at least) meets none; equal rows under several ids are all paired; ids
    must be unique within a source, rows with a null id are left out; empty sources give no pairs and no model.
    """
    with settings(left.df.sparkSession, WHILE_LINKING):
        voted = _voted(*prepared(left, right, nicknames))
    names = list(LEVELS)
    counts = voted.groupBy(*names).count().collect()  # at most as many rows as the levels have combinations
    if not counts:
        return voted.select("l_id", "r_id", F.lit(0.0).alias("confidence")), None
    patterns = np.array([[row[k] for k in names] for row in counts], int)
    weights = np.array([row["count"] for row in counts], float)
    model = fitted(patterns, weights)
    sure = [(*map(int, p), float(q)) for p, q in zip(patterns, model.posterior(patterns))]
    table = left.df.sparkSession.createDataFrame(sure, ", ".join(f"{k} int" for k in names) + ", confidence double")
    return voted.join(F.broadcast(table), names).select("l_id", "r_id", "confidence"), model
