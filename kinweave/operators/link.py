"""Linkage of two frames by match keys: blocking, one-to-one links, the residual cascade and what describes its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.every_pair import every_pair
from ..runtime import discard, materialise, measured, parallelism, ship
from ..types import q
from .matchkey import MatchKey, matchkey_dataframe, sides


#: A key with more pairs is dealt over cells of so many, so that no task has all pairs of a value; pairs of a task.
CELL, TASK = 1_000_000, 20_000_000
#: With more pairs to compare than these, ids are looked up in a part of the other side first: those with two partners are settled.
MANY, PARTS = 20_000_000, ((0, 1), (1, 8), (8, 64))


def mk_dropna(df: DataFrame, key: MatchKey, side: str = "left") -> DataFrame:
    return key.prune(df, side)


def candidate_pairs(df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, key: MatchKey) -> DataFrame:
    """Distinct ``(id_l, id_r)`` that the key joins; only ids and compared columns are read, null ids are left out."""
    l, r, at_l, at_r = sides(key.prune(df_l, "left"), key.prune(df_r, "right"), [id_l, *key.columns("left")], [id_r, *key.columns("right")])
    joined = l.where(at_l(id_l).isNotNull()).join(r.where(at_r(id_r).isNotNull()), key.condition(at_l, at_r), "inner")
    return joined.select(at_l(id_l).alias(id_l), at_r(id_r).alias(id_r)).distinct()


def one_to_one(pairs: DataFrame, id_l: str, id_r: str, strict: bool = False) -> DataFrame:
    """Distinct pairs ``id_l, id_r`` whose right id has one candidate and then, among those left, whose left id has one.

    ``strict`` counts both on all pairs instead. ``{(a,1),(a,2),(b,2)}`` keeps (a,1), strictly it keeps nothing. An id that
    is alone needs no window: the least partner of a group of one is its partner, and groups are counted map-side.
    """

    def alone(rows: DataFrame, of: str, other: str) -> DataFrame:
        return rows.groupBy(q(of)).agg(F.min(q(other)).alias(other), F.count("*").alias("__n")).where("__n = 1").select(q(id_l), q(id_r))

    right = alone(pairs, id_r, id_l)
    return right.join(alone(pairs, id_l, id_r), [id_l, id_r], "left_semi") if strict else alone(right, id_l, id_r)


@dataclass(frozen=True)
class _Sides:
    """Rows of either side with an id (``__l``, ``__r``), what must be equal (``__a0``.., ``__b0``..) and the columns of the other
    comparisons, whose condition is ``rest``."""

    l: DataFrame
    r: DataFrame
    same: list[tuple[str, str]]
    rest: Column | None
    #: If the rest is a score of texts that has a way for all pairs of two lists: that, the columns and what it must exceed.
    score: tuple[tuple[Callable, Callable], str, str, float] | None = None

    def turned(self) -> _Sides:
        return _Sides(self.r.withColumnRenamed("__r", "__l"), self.l.withColumnRenamed("__l", "__r"), [(b, a) for a, b in self.same], self.rest, self.score and (self.score[0], self.score[2], self.score[1], self.score[3]))


def _sides(df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, key: MatchKey) -> _Sides:
    l, r, at_l, at_r = sides(key.prune(df_l, "left"), key.prune(df_r, "right"), [id_l, *key.columns("left")], [id_r, *key.columns("right")])
    equal = key.equalities()
    columns = lambda side: [q(f"__{side[0]}_{c}") for c in dict.fromkeys(c for x in key.comparisons if not x.own for c in getattr(x, side))]
    l = l.where(at_l(id_l).isNotNull()).select(at_l(id_l).alias("__l"), *columns("left"), *[x.own(at_l(x.left[0])).alias(f"__a{i}") for i, x in enumerate(equal)], F.lit(0).alias("__a"))
    r = r.where(at_r(id_r).isNotNull()).select(at_r(id_r).alias("__r"), *columns("right"), *[x.own(at_r(x.right[0])).alias(f"__b{i}") for i, x in enumerate(equal)], F.lit(0).alias("__b"))
    others = [x for x in key.comparisons if not x.own]
    every = getattr(others[0].score[0], "every", None) if len(others) == 1 and others[0].score else None
    text = every and {l.schema[f"__l_{others[0].left[0]}"].dataType.typeName(), r.schema[f"__r_{others[0].right[0]}"].dataType.typeName()} == {"string"}
    score = (every, f"__l_{others[0].left[0]}", f"__r_{others[0].right[0]}", others[0].score[1]) if text else None
    return _Sides(l, r, [(f"__a{i}", f"__b{i}") for i in range(len(equal))] or [("__a", "__b")], key.rest(at_l, at_r), score)


def _equal(same: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in same])


def _sizes(s: _Sides) -> DataFrame:
    """The values in common and how many pairs agree in each, without making the pairs."""
    n = lambda df, at, name: df.groupBy(*[pair[at] for pair in s.same]).agg(F.count("*").alias(name))
    return n(s.l, 0, "__n").join(n(s.r, 1, "__m"), _equal(s.same)).withColumn("pairs", F.col("__n") * F.col("__m"))


def _dealt(s: _Sides, sizes: DataFrame, pairs: int) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Both sides and what must be equal in them. A value of many pairs is dealt out by the left id, each of its right rows meets
    every cell."""
    l, r, same, n = s.l, s.r, list(s.same), parallelism(s.l.sparkSession, pairs, TASK)
    if all(l.schema[a].dataType == r.schema[b].dataType for a, b in same):  # else a value may have several spellings
        hot = sizes.where(F.col("pairs") > CELL).select(*[c for pair in same for c in pair], F.ceil(F.col("pairs") / CELL).cast("int").alias("cells"))
        cells = lambda df, at: df.join(F.broadcast(hot.select(*[pair[at] for pair in same], "cells")), [pair[at] for pair in same], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        l = cells(l, 0).withColumn("__ac", F.pmod(F.xxhash64("__l"), "cells").cast("int")).drop("cells")
        r = cells(r, 1).withColumn("__bc", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
        same.append(("__ac", "__bc"))
    return l.repartition(n, *[a for a, _ in same]), r.repartition(n, *[b for _, b in same]), same


def _round(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves away from zero, of the number as it is written."""
    seen, at = np.unique(values, return_inverse=True)
    return np.array([v if v != v else float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in seen])[at].reshape(values.shape)


def _scores(l: DataFrame, r: DataFrame, same: list[tuple[str, str]], every: tuple[Callable, Callable], text_l: str, text_r: str, above: float | None, digits: int | None) -> DataFrame:
    """``__l, __r, score`` of the pairs that agree, those above a score only if there is such; a missing text has no score."""
    ship(l.sparkSession)
    kinds = pa.schema([("__l", "int64"), ("__r", "int64"), ("score", "float64")])

    def of(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column("__l").combine_chunks(), b.column("__r").combine_chunks()
        schema = pa.schema([("__l", ids[0].type), ("__r", ids[1].type), kinds.field("score")])
        x, y = a.column(text_l).to_pylist(), b.column(text_r).to_pylist()
        known = [np.array([i for i, t in enumerate(z) if t is not None], np.int64) for z in (x, y)]
        out = []

        def add(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
            if above is not None:
                m, n = np.nonzero(score > above)
                i, j, score = i[m], j[n], score[m, n]
            else:
                i, j, score = np.repeat(i, len(j)), np.tile(j, len(i)), (score if digits is None else _round(score, digits)).ravel()
            out.append(pa.table([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(score, mask=np.isnan(score))], schema=schema))

        for i, j, score in every_pair([x[k] for k in known[0]], [y[k] for k in known[1]], *every):
            add(known[0][i], known[1][j], score)
        if above is None:
            lost = [np.setdiff1d(np.arange(len(z)), k) for z, k in zip((x, y), known)]
            for i, j in ((lost[0], np.arange(len(y))), (known[0], lost[1])):
                add(i, j, np.full((len(i), len(j)), np.nan))
        return pa.concat_tables(out).combine_chunks() if out else schema.empty_table()

    schema = f"__l {l.schema['__l'].dataType.simpleString()}, __r {r.schema['__r'].dataType.simpleString()}, score double"
    names = [f"__s{i}" for i in range(len(same))]
    l = l.select("__l", text_l, *[F.col(a).alias(n) for n, (a, _) in zip(names, same)])
    r = r.select("__r", text_r, *[F.col(b).alias(n) for n, (_, b) in zip(names, same)])
    return l.where(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names])).groupBy(*names).cogroup(r.groupBy(*names)).applyInArrow(of, schema)


def _joined(s: _Sides, sizes: DataFrame, pairs: int) -> DataFrame:
    """``__l, __r`` and what else there is of the pairs that the key joins."""
    l, r, same = _dealt(s, sizes, pairs) if pairs > CELL else (s.l, s.r, s.same)
    if s.score and pairs > CELL and len(same) > len(s.same):
        every, text_l, text_r, above = s.score
        return _scores(l, r, same, every, text_l, text_r, above, None)
    return l.join(r, _equal(same) if s.rest is None else _equal(same) & s.rest)


def pair_scores(df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, same: tuple[str, str], texts: tuple[str, str], fn: Callable[[Column, Column], Column], digits: int) -> DataFrame:
    """``id_l, id_r, score``: all pairs of rows with an equal value in ``same``, and the similarity of their texts, rounded. Ids are
    of the rows, also where they repeat or are null."""
    l = df_l.select(q(id_l).alias("__l"), q(same[0]).alias("__a0"), q(texts[0]).alias("__lt"))
    r = df_r.select(q(id_r).alias("__r"), q(same[1]).alias("__b0"), q(texts[1]).alias("__rt"))
    s = _Sides(l, r, [("__a0", "__b0")], None)
    sizes, all_ = measured(_sizes(s), pairs=F.sum("pairs"))
    pairs = all_["pairs"] or 0
    l, r, keys = _dealt(s, sizes, pairs) if pairs > CELL else (l, r, s.same)
    if hasattr(fn, "every") and len(keys) > 1:
        made = _scores(l, r, keys, fn.every, "__lt", "__rt", None, digits)
    else:
        made = l.join(r, _equal(keys)).select("__l", "__r", F.round(fn(F.col("__lt"), F.col("__rt")), digits).alias("score"))
    return made.select(F.col("__l").alias(id_l), F.col("__r").alias(id_r), "score")


def _alone(s: _Sides) -> DataFrame:
    """``__l, __r``: right ids with just one left id that the key joins, and that one.

    A right id has one partner if the least and the greatest of its partners are the same, so no pairs are kept, nor even made where all must be
    equal: the ids of a value are summed up first. Of a comparison, all pairs are tried for ids that have less than two partners.
    """
    ends = lambda df: df.groupBy("__r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    alone = lambda df: df.where(F.col("lo") == F.col("hi")).select(F.col("lo").alias("__l"), "__r")
    if s.rest is None:
        l = s.l.groupBy(*[a for a, _ in s.same]).agg(F.min("__l").alias("lo"), F.max("__l").alias("hi"))
        return alone(ends(l.join(s.r, _equal(s.same))))
    sizes, all_ = measured(_sizes(s), pairs=F.sum("pairs"))
    pairs, seen = all_["pairs"] or 0, []
    part = F.pmod(F.xxhash64("__l", F.lit(7)), F.lit(PARTS[-1][1]))
    for first, end in PARTS if pairs > MANY else ((0, PARTS[-1][1]),):
        r = s.r
        if seen:
            settled = ends(reduce(DataFrame.unionByName, seen)).where("lo <> hi").select("__r")
            r = r.join(settled, "__r", "left_anti")
            if r.isEmpty():
                break
        l = s.l if pairs <= MANY else s.l.where((part >= first) & (part < end))
        met = _joined(_Sides(l, r, s.same, s.rest, s.score), sizes, pairs * (end - first) // PARTS[-1][1]).withColumns({"lo": F.col("__l"), "hi": F.col("__l")})
        seen.append(materialise(ends(met)))
    discard(sizes)
    return alone(ends(reduce(DataFrame.unionByName, seen)))


def matchkey_join(df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, key: MatchKey, number: int = 1, strict: bool = False) -> DataFrame:
    """``id_l, id_r, matchkey``: the one-to-one links of one key, as :func:`one_to_one` has them of :func:`candidate_pairs`."""
    s = _sides(df_l, df_r, id_l, id_r, key)
    right = _alone(s)
    if strict:
        right = materialise(right)
        left = _alone(_Sides(s.l.join(right.select("__l"), "__l", "left_semi"), s.r, s.same, s.rest, s.score).turned())
        out = right.join(left.select(F.col("__r").alias("__l"), F.col("__l").alias("__r")), ["__l", "__r"], "left_semi")
    else:
        out = right.groupBy("__l").agg(F.min("__r").alias("__r"), F.count("*").alias("__n")).where("__n = 1")
    return out.select(F.col("__l").alias(id_l), F.col("__r").alias(id_r), F.lit(number).alias("matchkey"))


def deterministic_linkage(df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, keys: list[MatchKey], out_dir: str | None = None, strict: bool = False) -> DataFrame:
    """``id_l, id_r, matchkey``: every key in turn links what the keys before it have not linked.

    Each pass is written (to ``out_dir``/linked_identifiers, else to the shared folder), which keeps plans short: pass k
    reads links, it does not repeat joins.
    """
    passes: list[DataFrame] = []
    for number, key in enumerate(keys, 1):
        l, r = df_l, df_r
        if passes:
            done = reduce(DataFrame.unionByName, passes)
            l = df_l.join(done.select(q(id_l)), id_l, "left_anti")
            r = df_r.join(done.select(q(id_r)), id_r, "left_anti")
        found = matchkey_join(l, r, id_l, id_r, key, number, strict)
        if out_dir is None:
            passes.append(materialise(found))
        else:
            path = f"{out_dir}/linked_identifiers"
            found.write.mode("overwrite" if number == 1 else "append").parquet(path)
            passes = [df_l.sparkSession.read.parquet(path)]
    return reduce(DataFrame.unionByName, passes)


def blocking(df_l: DataFrame, df_r: DataFrame, blocks: dict[str, str], ids: tuple[str, str]) -> DataFrame:
    """Pairs with an equal value in any of the block columns {left: right}, once, with all columns of both frames.

    A pair comes from the first block that it shares, so nothing has to be deduplicated. Column names of the two frames
    must differ; where an id repeats, each of its rows is paired. Rows with a null id are left out.
    """
    if clash := set(df_l.columns) & set(df_r.columns):
        raise ValueError(f"columns of both frames: {', '.join(sorted(clash))}")
    df_l, df_r = df_l.where(q(ids[0]).isNotNull()), df_r.where(q(ids[1]).isNotNull())
    made, earlier = [], []
    for a, b in blocks.items():
        same = q(a) == q(b)
        joined = df_l.join(df_r, same, "inner")
        made.append(reduce(lambda d, e: d.where(~F.coalesce(e, F.lit(False))), earlier, joined))
        earlier.append(same)
    return reduce(DataFrame.unionByName, made)


def order_matchkeys(df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, keys: list[MatchKey]) -> list[MatchKey]:
    """The keys, those with the fewest candidate pairs first; equal ones keep their order, keys without pairs stay. Unless an id
    repeats, pairs need not be told apart, and those of equalities are not even made."""
    repeats = any(not df.where(q(c).isNotNull()).groupBy(q(c)).count().where("count > 1").isEmpty() for df, c in ((df_l, id_l), (df_r, id_r)))

    def counted(key: MatchKey) -> DataFrame:
        if repeats:
            return candidate_pairs(df_l, df_r, id_l, id_r, key).agg(F.count("*").alias("n"))
        s = _sides(df_l, df_r, id_l, id_r, key)
        if s.rest is None:
            return _sizes(s).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"))
        sizes, all_ = measured(_sizes(s), pairs=F.sum("pairs"))
        return _joined(s, sizes, all_["pairs"] or 0).agg(F.count("*").alias("n"))

    counts = [counted(k).withColumn("i", F.lit(i)) for i, k in enumerate(keys)]
    n = {r.i: r.n for r in reduce(DataFrame.unionByName, counts).collect()}  # one row for each key
    return [keys[i] for i in sorted(n, key=lambda i: (n[i], i))]


def matchkey_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("matchkey").count().orderBy(F.desc("count"), "matchkey")


def assert_unique(df: DataFrame, columns: str | list[str]) -> None:
    """AssertionError if rows repeat in the columns taken together."""
    names = [columns] if isinstance(columns, str) else columns
    if not df.groupBy(*map(q, names)).count().where("count > 1").isEmpty():
        raise AssertionError(f"{', '.join(names)} repeat")


def assert_unique_matches(links: DataFrame, *columns: str) -> None:
    """AssertionError if any of the columns, taken alone, repeats a value; an empty frame passes."""
    for c in columns:
        assert_unique(links, c)


def clerical_sample(links: DataFrame, keys: list[MatchKey] | DataFrame, df_l: DataFrame, df_r: DataFrame, id_l: str, id_r: str, n_ids: int = 100, seed: int = 1) -> DataFrame:
    """Up to ``n_ids`` random pairs of each key beside both records and the key's description."""
    about = keys if isinstance(keys, DataFrame) else matchkey_dataframe(links.sparkSession, keys)
    order = Window.partitionBy("matchkey").orderBy(F.xxhash64(F.lit(seed), q(id_l), q(id_r)), q(id_l), q(id_r))
    some = links.select(q(id_l), q(id_r), "matchkey").distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n_ids).drop("__n")
    full = some.join(df_l, id_l).join(df_r, id_r).join(about, "matchkey")
    rest = sorted(set(full.columns) - {"matchkey", id_l, id_r, "description"})
    return full.select("matchkey", q(id_l), q(id_r), *map(q, rest), "description").orderBy("matchkey", q(id_l))


def deduplicate(df: DataFrame, record_id: str, keys: list[MatchKey]) -> tuple[DataFrame, DataFrame]:
    """Rows in no match of the frame with itself, and the matched pairs ``(record_id_1, record_id_2)``, smaller id first."""
    found = []
    for key in keys:
        l, r, at_l, at_r = sides(key.prune(df, "left"), key.prune(df, "right"), [record_id, *key.columns("left")], [record_id, *key.columns("right")])
        found.append(l.join(r, key.condition(at_l, at_r) & (at_l(record_id) < at_r(record_id))).select(at_l(record_id).alias(f"{record_id}_1"), at_r(record_id).alias(f"{record_id}_2")))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    seen = pairs.select(q(f"{record_id}_1").alias(record_id)).unionByName(pairs.select(q(f"{record_id}_2").alias(record_id)))
    return df.join(seen, record_id, "left_anti"), pairs
