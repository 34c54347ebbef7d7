"""Cluster numbers for pairs of records: local union-find, then merging by record, until every record has one root."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialise, parallelism, ship
from ..types import is_string, q


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: every record but the roots, once, with the smallest record it is linked to there."""
    above: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for b in batches:
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                above[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in list(above) if above[x] != x]
    for k in range(0, len(found), 50_000):
        part = found[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.array([y for _, y in part], pa.string())], ["x", "y"])


def least_labels(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``id, least``: every id of the pairs (strings) with the smallest id that it reaches.

    The first pass links within partitions as they are, so a hub leaves each of them once. Each round then brings a
    record's roots together and links them, and lets a record skip to its root's root. A partition holds some 250,000
    links. Rounds end when every record has one root that has none itself.
    """
    spark = pairs.sparkSession
    ship(spark)
    links = materialise(pairs.select(q(a).alias("x"), q(b).alias("y")).where("x is not null and y is not null and x <> y").mapInArrow(_local_roots, "x string, y string"))
    for _ in range(max_rounds):
        n, children = links.agg(F.count("*"), F.count_distinct("x")).first()
        tops = links.select("y").distinct()
        if n == children and tops.join(links, tops.y == links.x, "left_semi").isEmpty():
            break
        merged = links.repartition(parallelism(spark, n), "x").mapInArrow(_local_roots, "x string, y string")
        merged = materialise(merged)
        further = merged.groupBy(F.col("x").alias("y")).agg(F.min("y").alias("z"))
        new = materialise(merged.join(further, "y", "left").select("x", F.coalesce("z", "y").alias("y")).unionByName(merged.join(further, "y", "left_semi").select("x", "y")).distinct())
        discard(merged)
        discard(links)
        links = new
    else:
        raise RuntimeError(f"clusters have not settled in {max_rounds} rounds")
    ids = pairs.select(q(a).alias("id")).unionByName(pairs.select(q(b).alias("id"))).where("id is not null").distinct()
    return ids.join(links, F.col("id") == F.col("x"), "left").select("id", F.coalesce("y", "id").alias("least"))


def cluster_number(pairs: DataFrame, id_1: str, id_2: str) -> DataFrame:
    """The pairs, sorted by ``Cluster_Number``: 1..k in the order of the clusters' smallest ids.

    Both columns hold ids of one kind and must be strings. Pairs with a null id get no number. The numbers are dense, so
    all clusters are counted: range-partitioned by smallest id, then offset by the counts of the partitions before.
    """
    if not (is_string(pairs, id_1) and is_string(pairs, id_2)):
        raise TypeError("ids must be strings")
    labels = materialise(least_labels(pairs, id_1, id_2))
    ranked = materialise(labels.select("least").distinct().repartitionByRange("least").sortWithinPartitions("least").withColumn("part", F.spark_partition_id()))
    own = ranked.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("least")))
    before = own.groupBy("part").agg(F.max("n").alias("size")).withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    numbers = own.join(F.broadcast(before), "part").select("least", (F.col("n") + F.col("offset")).cast("int").alias("Cluster_Number"))
    return pairs.join(labels.withColumnRenamed("id", "__id"), q(id_1) == F.col("__id"), "left").join(numbers, "least", "left").select(*map(q, pairs.columns), F.when(q(id_2).isNotNull(), F.col("Cluster_Number")).alias("Cluster_Number")).orderBy("Cluster_Number")
