"""Duplicates hidden by formatting differences.

Records are compared by canonical bytes: of every field only letters and digits, in lower case. Those bytes are split by
recursive radix partitioning, prefix by longer prefix, until every bucket fits into a task; inside a bucket a trie with
terminal counters finds the copies. Rows whose *whole* key is more frequent than a bucket may hold cannot be split by
bytes; their key is known from the histogram, so they meet their keeper by a broadcast of at most rows/bucket keys.

A bucket holds 250,000 rows, or one in MOST_BUCKETS of all rows where that is more, and small neighbours share one. So there
are at most three times MOST_BUCKETS lower bounds, and as many oversized prefixes: what is broadcast does not grow with the
rows beyond that.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialise, measured, parallelism, ship

SEPARATOR = "\u0001"
FIRST_DEPTH = 8
BURST = 4096
MOST_BUCKETS = 400_000


def canonical_bytes(fields: list[str], exchangeable: tuple[str, str] | None = None) -> Column:
    """Letters and digits of ``fields`` in lower case, one separator between fields; null and blank give no bytes.

    The two ``exchangeable`` fields come last, in sorted order. One regular expression runs over the whole record.
    """
    rest = [f for f in fields if not exchangeable or f not in exchangeable]
    whole = F.concat_ws(SEPARATOR, *[F.coalesce(F.translate(F.col(f).cast("string"), SEPARATOR, ""), F.lit("")) for f in [*rest, *(exchangeable or ())]])
    clean = F.lower(F.regexp_replace(whole, rf"[^\p{{L}}\p{{N}}{SEPARATOR}]+", ""))
    if not exchangeable:
        return F.encode(clean, "UTF-8")
    a, b = (F.substring_index(F.substring_index(clean, SEPARATOR, k), SEPARATOR, 1 if k == -2 else -1) for k in (-2, -1))
    head = F.substring_index(clean, SEPARATOR, len(rest))
    return F.encode(F.concat_ws(SEPARATOR, *([head] if rest else []), F.least(a, b), F.greatest(a, b)), "UTF-8")


class CountingTrie:
    """A burst trie over bytes: small sets of suffixes are kept in one dictionary, which bursts by its first byte when full.

    A terminal counts the rows seen under its key and keeps their smallest id; with ``members`` it has all their ids.
    """

    def __init__(self, members: bool = True) -> None:
        self.root: list = [{}, None]  # suffixes in a container, or children by byte
        self.members = members

    def add(self, key: bytes, i: int) -> None:
        found = self.terminal(key)
        if self.members:
            found.append(i)
        elif found:
            found[0] += 1
            found[1] = min(found[1], i)
        else:
            found += (1, i)

    def terminal(self, key: bytes) -> list[int]:
        node, at = self.root, 0
        while node[1] is not None:
            if at == len(key):
                return node[0].setdefault(b"", [])
            node = node[1].setdefault(key[at], [{}, None])
            at += 1
        suffix = key[at:]
        found = node[0].get(suffix)
        if found is None:
            found = node[0][suffix] = []
            if len(node[0]) > BURST:
                node[1] = {}
                for s in [s for s in node[0] if s]:
                    node[1].setdefault(s[0], [{}, None])[0][s[1:]] = node[0].pop(s)
        return found

    def terminals(self) -> Iterator[list[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            yield from node[0].values()
            stack.extend((node[1] or {}).values())


def radix_plan(keyed: DataFrame, rows_per_bucket: int | None = None) -> tuple[list[bytes], DataFrame | None, int]:
    """Lower bounds of the radix buckets in byte order, the keys too frequent for any bucket (or None) and the row count.

    A level is a distributed count of prefixes, rolled up to all shorter ones. A prefix of more rows than a bucket holds is
    split by its next byte; its children share a bucket with their neighbours up to that size. Deeper levels read only the
    rows of prefixes that are still oversized at the level's full depth, by a broadcast of those.
    """
    bounds: set[bytes] = {b""}
    hot: DataFrame | None = None
    rows, cap, part, depth, done = 0, rows_per_bucket, keyed, FIRST_DEPTH, 0
    while True:
        counts = part.groupBy(F.substring("key", 1, depth).alias("p"), (F.octet_length("key") <= depth).alias("whole")).count()
        counts, seen = measured(counts, rows=F.sum("count"))
        if not done:
            rows = seen["rows"] or 0
            cap = cap or max(1000, rows // MOST_BUCKETS, min(250_000, rows // (4 * parallelism(keyed.sparkSession))))
        lengths = F.sequence(F.lit(done + 1 if done else 0), F.lit(depth))
        rolled = (
            counts.select("p", "whole", "count", F.explode(lengths).alias("d"))
            .where(f"d <= octet_length(p) or d = {depth}")
            .groupBy(F.expr("substring(p, 1, d)").alias("p"), "d", (F.col("whole") & (F.col("d") >= F.octet_length("p"))).alias("whole"))
            .agg(F.sum("count").alias("n"))
        )
        rolled, seen = measured(rolled, deeper=F.count_if((F.col("n") > cap) & (F.octet_length("p") == depth) & ~F.col("whole")), hot=F.count_if((F.col("n") > cap) & F.col("whole")))
        discard(counts)
        large = rolled.where(F.col("n") > cap)
        parents = large.where(~F.col("whole") & (F.col("d") < depth)).select(F.col("p").alias("parent"), F.col("d").alias("at"))
        children = rolled.where("d > 0").withColumns({"parent": F.expr("substring(p, 1, d - 1)"), "at": F.col("d") - 1}).join(F.broadcast(parents), ["parent", "at"])
        before = Window.partitionBy("parent").orderBy("p", "whole").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 bytes
        shared = children.withColumn("share", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / cap)).groupBy("parent", "share").agg(F.min("p").alias("p"))
        bounds.update(bytes(r.p) for r in shared.select("p").unionByName(large.select("p")).toLocalIterator())
        if seen["hot"]:
            found = large.where("whole").select(F.col("p").alias("key"))
            hot = found if hot is None else hot.unionByName(found)
        if not seen["deeper"]:
            break
        over = large.where(~F.col("whole") & (F.octet_length("p") == depth)).select(F.col("p").alias("over"))
        part = keyed.join(F.broadcast(over), F.substring("key", 1, depth) == F.col("over"), "left_semi")
        done, depth = depth, depth * 2
    heavy = None
    if hot is not None:
        heavy = keyed.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where(F.col("n") > cap)
        heavy = materialise(heavy)
    return sorted(bounds), heavy, rows


def _assign(bounds: Broadcast, parts: int):
    """Buckets to Spark partitions: consecutive buckets, dealt out round robin so that dense ranges spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = bounds.value
        for b in batches:
            at = np.fromiter((bisect.bisect_right(lower, k) - 1 for k in b.column("key").to_pylist()), np.int32, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(at % parts), pa.array(at), b.column("key"), b.column("id")], ["part", "bucket", "key", "id"])

    return run


def _count(members: bool):
    """A partition's buckets, which come one after the other: one trie at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = CountingTrie(members), None
        keep, member, copies = [], [], []

        def batch() -> pa.RecordBatch:
            columns, names = ([keep, member, copies], ["keep_id", "member_id", "n_copies"]) if members else ([keep, copies], ["keep_id", "n_copies"])
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            for x in (keep, member, copies):
                x.clear()
            return out

        def drained() -> Iterator[pa.RecordBatch]:
            for found in trie.terminals():
                if not found:
                    continue
                if members:
                    n, least = len(found), min(found)
                    keep.extend([least] * n)
                    member.extend(found)
                    copies.extend([n] * n)
                else:
                    copies.append(found[0])
                    keep.append(found[1])
                if len(keep) > 20_000:
                    yield batch()

        for b in batches:
            for bucket, key, i in zip(b.column("bucket").to_pylist(), b.column("key").to_pylist(), b.column("id").to_pylist()):
                if bucket != current:
                    yield from drained()
                    trie, current = CountingTrie(members), bucket
                trie.add(key, i)
        yield from drained()
        yield batch()

    return run


def _bucketed(df: DataFrame, id_col: str, fields: list[str], exchangeable: tuple[str, str] | None, rows_per_bucket: int | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``id, key`` of all records, ``bucket, key, id`` of those in buckets, one bucket after the other within a partition,
    and the keys too frequent for a bucket."""
    spark = df.sparkSession
    ship(spark)
    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), canonical_bytes(fields, exchangeable).alias("key"))
    bounds, heavy, rows = radix_plan(keyed, rows_per_bucket)
    parts = parallelism(spark, rows)
    rest = keyed.join(F.broadcast(heavy.select("key")), "key", "left_anti").select("id", "key") if heavy is not None else keyed
    assigned = rest.mapInArrow(_assign(spark.sparkContext.broadcast(bounds), parts), "part int, bucket int, key binary, id long")
    return keyed, assigned.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("bucket"), heavy


def format_duplicates(df: DataFrame, id_col: str, fields: list[str], exchangeable: tuple[str, str] | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """One row for each record: ``keep_id`` (smallest id of its set of copies), ``member_id`` and ``n_copies`` of the set.

    Null and blank fields are equal to each other; a record of only nulls is a copy of other such records; records with
    a null id are left out, repeated ids count each time; other columns are not read; an empty table gives no rows.
    """
    keyed, buckets, heavy = _bucketed(df, id_col, fields, exchangeable, rows_per_bucket)
    counted = buckets.mapInArrow(_count(True), "keep_id long, member_id long, n_copies long")
    if heavy is None:
        return counted
    return keyed.join(F.broadcast(heavy), "key").select("keep_id", F.col("id").alias("member_id"), F.col("n").alias("n_copies")).unionByName(counted)


def duplicate_counts(df: DataFrame, id_col: str, fields: list[str], exchangeable: tuple[str, str] | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """One row for each set of copies, ``keep_id`` and ``n_copies``, counted without holding the members; see
    :func:`format_duplicates`."""
    _, buckets, heavy = _bucketed(df, id_col, fields, exchangeable, rows_per_bucket)
    counted = buckets.mapInArrow(_count(False), "keep_id long, n_copies long")
    return counted if heavy is None else heavy.select("keep_id", F.col("n").alias("n_copies")).unionByName(counted)
