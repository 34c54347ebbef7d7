"""Name variants within dates of birth that hold too many rows for a task: the same links, by shuffles instead of streams.

Spellings (distinct names, postcodes and sexes of a date) are made by a grouped aggregate; each goes to the buckets of its
bands; pairs are verified there; rows of unknown postcodes are settled by aggregates; stars are found by rounds in which
the first of its undecided neighbours becomes a centre. A bucket (spellings of a date that share two minima of their elements)
that is too large for a task is cut into cells: its spellings are dealt into parts, and every two parts meet in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialise, measured, parallelism
from .name_variants import MOST_BROADCAST, Linker, Names, Postcodes, candidates, whole_groups

VERTEX = "v long, weight long, dob int, forename string, middlename string, surname string, sex byte, postcode string"


BUCKET_ROWS = 10_000


def _to_buckets(nicknames, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(nicknames, bands, rows)
        linker = Linker(names)
        for b in batches:
            if not b.num_rows:
                continue
            names.trim()
            codes = Postcodes(b.column("postcode").to_pylist())
            signature = linker.signatures(linker.spellings(pa.Table.from_batches([b]))[0], codes).astype(np.uint64)
            day = b.column("dob").to_numpy(zero_copy_only=False).astype(np.uint64)
            for k in range(bands):
                key = day * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                for r in range(rows):
                    key = (key ^ signature[:, k * rows + r]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], ["bucket", *b.schema.names])

    return run


def _cells(buckets: DataFrame, most: int) -> DataFrame:
    """The buckets, those of more than ``most`` rows as cells: of k parts, part i goes to the cells (i, j) and (j, i), so any
    two rows of the bucket meet, and a cell has some 2 ``most`` rows at most. Sizes are counted map-side."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("k"))
    sizes, seen = measured(sizes, large=F.count("*"))
    if not seen["large"]:
        return buckets
    sizes = F.broadcast(sizes) if seen["large"] <= MOST_BROADCAST else sizes
    own = F.pmod(F.xxhash64("v"), "k").cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
    columns = [c for c in buckets.columns if c != "bucket"]
    cut = buckets.join(sizes, "bucket").select(F.explode(cell).alias("bucket"), *columns)
    return buckets.join(sizes, "bucket", "left_anti").select("bucket", *columns).unionByName(cut)


def _verified(nicknames, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(nicknames, bands, rows)
        linker = Linker(names)
        for t in whole_groups(batches, "bucket"):
            names.trim()
            _, group = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
            group = group * 200_000_000 + t.column("dob").to_numpy()  # a bucket's hash may be of two days
            codes, spelt = Postcodes(t.column("postcode").to_pylist()), linker.spellings(t)[1]
            left, right = candidates(np.zeros((t.num_rows, rows), np.uint32), group, codes, t.column("sex").to_numpy().astype(np.int8), 1, rows)
            v, code = t.column("v").to_pylist(), codes.codes
            found = [(v[a], v[b], s, is_open, code[a], code[b]) for (a, b), (s, is_open) in linker.verified(left, right, spelt, codes).items()]
            found = [x if x[0] < x[1] else (x[1], x[0], x[2], x[3], x[5], x[4]) for x in found]
            columns = list(zip(*found)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.string()))], ["a", "b", "s", "open", "code_a", "code_b"])

    return run


def _one_edit(a: Column, b: Column) -> Column:
    turned = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | turned


def _settled(links: DataFrame) -> DataFrame:
    """Links of rows with a postcode unknown in part that lead to one clearly best postcode, and all other links."""
    full = lambda c: F.length(c) > 4
    a = links.where(F.col("open") & ~full("code_a") & full("code_b")).select(F.col("a").alias("x"), "a", "b", "s", F.col("code_b").alias("code"))
    b = links.where(F.col("open") & ~full("code_b") & full("code_a")).select(F.col("b").alias("x"), "a", "b", "s", F.col("code_a").alias("code"))
    offers = a.unionByName(b)
    best = offers.groupBy("x", "code").agg(F.max("s").alias("s"))
    top = best.groupBy("x").agg(F.max(F.struct("s", "code")).alias("top"))
    compared = best.join(top, "x").withColumn("near", _one_edit(F.col("code"), F.col("top.code")))
    verdict = compared.groupBy("x").agg(F.first("top.code").alias("keep"), F.first("top.s").alias("most"), F.max(F.when(F.col("code") != F.col("top.code"), F.col("s"))).alias("next"), F.min("near").alias("all_near"))
    sure = verdict.where(F.col("next").isNull() | (F.col("most") - F.col("next") > 0.02) | F.col("all_near")).select("x", "keep")
    refused = offers.join(sure, "x", "left").where(F.col("keep").isNull() | ~_one_edit(F.col("code"), F.col("keep"))).select("a", "b").distinct()
    return links.join(refused, ["a", "b"], "left_anti").select("a", "b", "s")


def _stars(links: DataFrame, vertices: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``v, centre``: centres in the order of links, weight, smaller name; others go to the most similar linked centre."""
    ends = links.select(F.col("a").alias("v"), F.col("b").alias("n"), "s").unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("n"), "s"))
    rank = ends.groupBy("v").agg(F.count("*").alias("degree")).join(vertices.select("v", "weight"), "v").select("v", F.struct(-F.col("degree"), -F.col("weight"), "v").alias("rank"))
    ends = materialise(ends.join(rank, "v").join(rank.select(F.col("v").alias("n"), F.col("rank").alias("n_rank")), "n").select("v", "n", "s", "rank", "n_rank"))
    state = materialise(rank.select("v", F.lit(0).alias("is")))  # 0 undecided, 1 centre, 2 not
    for _ in range(max_rounds):
        open_ = state.where("is = 0").select("v")
        if open_.isEmpty():
            break
        live = ends.join(open_, "v", "left_semi").join(open_.select(F.col("v").alias("n")), "n", "left_semi")
        beaten = live.where("n_rank < rank").select("v").distinct()
        new = materialise(open_.join(beaten, "v", "left_anti"))
        near = live.join(new.select(F.col("v").alias("n")), "n", "left_semi").select("v").distinct()
        marks = new.select("v", F.lit(1).alias("now")).unionByName(near.select("v", F.lit(2).alias("now")))
        after = materialise(state.join(marks, "v", "left").select("v", F.coalesce("now", "is").alias("is")))
        discard(state)
        discard(new)
        state = after
    else:
        raise RuntimeError(f"stars have not settled in {max_rounds} rounds")
    centres = state.where("is = 1").select(F.col("v").alias("n"))
    choice = ends.join(centres, "n", "left_semi").join(state.where("is = 2").select("v"), "v", "left_semi").groupBy("v").agg(F.max(F.struct("s", -F.col("n"))).alias("best"))
    return choice.select("v", (-F.col("best.col2")).alias("centre")).unionByName(centres.select(F.col("n").alias("v"), F.col("n").alias("centre")))


def crowded_persons(rows_in: DataFrame, nicknames: list[tuple[str, str]], bands: int, rows: int, bucket_rows: int | None = None) -> DataFrame:
    """``person, name, id`` of the rows (id, dob, forename, middlename, surname, sex, postcode), as name_variants has them."""
    plain = lambda c: F.coalesce(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit(""))
    f, m = plain("forename"), plain("middlename")
    keyed = rows_in.withColumn("key", F.struct(F.least(f, m).alias("a"), F.greatest(f, m).alias("b"), plain("surname").alias("c")))
    spellings = keyed.groupBy("dob", "key", "postcode", "sex").agg(F.min("id").alias("v"), F.count("*").alias("weight"), F.min(F.struct("id", "forename", "middlename", "surname")).alias("one"))
    spellings, seen = measured(spellings.select("v", "weight", "dob", "key", "one.forename", "one.middlename", "one.surname", "sex", "postcode"), n=F.count("*"))
    vertices = spellings.drop("key").select(*[F.col(c.split()[0]) for c in VERTEX.split(", ")])
    buckets = materialise(vertices.mapInArrow(_to_buckets(nicknames, bands, rows), "bucket long, " + VERTEX))
    cells = _cells(buckets, bucket_rows or BUCKET_ROWS).repartition(parallelism(rows_in.sparkSession, bands * (seen["n"] or 0)), "bucket").sortWithinPartitions("bucket")
    found = materialise(cells.mapInArrow(_verified(nicknames, bands, rows), "a long, b long, s double, open boolean, code_a string, code_b string").distinct())
    discard(buckets)
    links = materialise(_settled(found))
    discard(found)
    members = _stars(links, vertices).join(spellings.select("v", "dob", "key", "postcode", "sex"), "v").select("centre", "dob", "key", "postcode", "sex")
    members = materialise(members)
    discard(links)
    several = members.select("centre", "key").distinct().groupBy("centre").count().where("count > 1").select("centre")
    people = keyed.join(members.join(several, "centre", "left_semi"), ["dob", "key", "postcode", "sex"])
    return people.select(F.col("centre").alias("person"), F.xxhash64("key").alias("name"), "id")
