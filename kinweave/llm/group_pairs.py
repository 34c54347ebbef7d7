"""Consolidating pairwise matches into groups: connected components by alternating large-star and small-star rewrites.

Ids are numbered once, in their own order, so all rewrites compare and hash 64-bit numbers. Each rewrite is a grouped
minimum and a join, both distributed. A hub's edges never meet in one task: the few nodes that hold at least 1/1000 of all
edge ends (so at most 1000 of them) get their minimum by a broadcast, all others by a shuffle join. Every rewrite is written
to the shared folder, which cuts the lineage, and measured while it is written; the one before it is deleted.

Before a rewrite, upper ends with a single neighbour are set aside: they go where that neighbour goes, and parting them
leaves the rest of their component connected. A component that has become a star is thus out of the rewrites at once, so
only long chains take part in all of them; the rewrites end when no edge is left. Then the last parted get their group
first, and those before them through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialise, measured

HUB_SHARE = 1000
HUB_LEAST = 10_000


def _looked_up(rows: DataFrame, key: str, values: DataFrame, value: str, floor: int, hubs: bool) -> DataFrame:
    """``rows`` with ``value`` of ``values`` (``key, value, degree``), by broadcast for keys of at least ``floor`` rows."""
    if not hubs:
        return rows.join(values.select(key, value), key)
    few = F.broadcast(values.where(F.col("degree") >= floor).select(key, value))  # at most 1000 in all
    others = values.where(F.col("degree") < floor).select(key, value)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(others, key))


def _degrees(rows: DataFrame, key: str, value: Column | None, ends: int) -> tuple[DataFrame, int, bool]:
    """``key``, the least ``value`` and the number of rows of each key, what makes a hub of it, and whether there are any."""
    floor = max(HUB_LEAST, -(-ends // HUB_SHARE))
    out = rows.groupBy(key).agg(*([F.min(value).alias("m")] if value is not None else []), F.count("*").alias("degree"))
    least, seen = measured(out, hubs=F.count_if(F.col("degree") >= floor))
    return least, floor, bool(seen["hubs"])


def _parted(edges: DataFrame, ends: DataFrame, floor: int, hubs: bool) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """What was written, the edges whose upper end has no other neighbour, the other edges, and how many there are."""
    degree = ends.select(F.col("v").alias("u"), "degree", F.col("degree").alias("d"))
    flagged = _looked_up(edges, "u", degree, "d", floor, hubs).select("u", "v", (F.col("d") == 1).alias("leaf"))
    made, seen = measured(flagged, leaves=F.count_if("leaf"), edges=F.count_if(~F.col("leaf")))
    return made, made.where("leaf").select("u", "v"), made.where("not leaf").select("u", "v"), seen


def _large_star(edges: DataFrame, ends: DataFrame, floor: int, hubs: bool) -> DataFrame:
    """Every neighbour above a node moves to the node's smallest neighbour, or to the node itself if that is smaller.

    ``edges`` have u > v. An edge moves its upper end only, so there are no more edges than before.
    """
    moved = _looked_up(edges, "v", ends.withColumn("m", F.least("v", "m")), "m", floor, hubs)
    return materialise(moved.select("u", F.col("m").alias("v")))


def _small_star(edges: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The neighbours below a node, and the node itself, move to the smallest of them. ``edges`` have u > v."""
    least, floor, hubs = _degrees(edges, "u", F.col("v"), count)
    moved = _looked_up(edges, "u", least, "m", floor, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out, seen = measured(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), edges=F.count("*"))
    discard(least)
    return out, seen["edges"]


def _numbered(pairs: DataFrame, a: Column, b: Column) -> tuple[DataFrame, bool]:
    """``id, n, degree``: every id with a number, in the order of the ids, and how many rows hold it."""
    ids = pairs.select(a.alias("id")).unionByName(pairs.select(b.alias("id"))).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))
    ids, seen = measured(ids, rows=F.sum("degree"))
    floor = max(HUB_LEAST, -(-(seen["rows"] or 0) // HUB_SHARE))
    ordered = ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id())
    out, seen = measured(ordered.select("id", "n", F.when(F.col("degree") >= floor, F.col("degree")).otherwise(F.lit(0)).alias("degree")), hubs=F.count_if(F.col("degree") >= floor))
    discard(ids)
    return out, bool(seen["hubs"])


def group_pairs(pairs: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """``group_id, record_id``: every id of either column once, with the smallest id it is linked to, directly or not.

    The two columns are one set of ids. A pair with a null id or of a record with itself links nothing, but its ids are
    records; repeated pairs count once; a record without links is its own group; an empty table gives no rows. Ids are
    compared as they are (strings in byte order). Raises RuntimeError if the rewrites do not settle in ``max_rounds``.
    """
    a, b = F.col(left), F.col(right)
    numbers, hubs = _numbered(pairs, a, b)
    linked = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("id"), b.alias("other"))
    half = _looked_up(linked, "id", numbers, "n", 1, hubs).select(F.col("n").alias("x"), F.col("other").alias("id"))
    both = _looked_up(half, "id", numbers, "n", 1, hubs)
    edges, seen = measured(both.select(F.greatest("x", "n").alias("u"), F.least("x", "n").alias("v")).distinct(), edges=F.count("*"))
    count, aside = seen["edges"], []
    for _ in range(max_rounds):
        if not count:
            break
        both_ways = edges.select("v", F.col("u").alias("n")).unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("n")))
        ends, floor, hubs = _degrees(both_ways, "v", F.col("n"), 2 * count)
        flagged, leaves, core, seen = _parted(edges, ends, floor, hubs)
        aside.append((flagged, leaves))
        discard(edges)
        if not seen["edges"]:
            discard(ends)
            break
        large = _large_star(core, ends, floor, hubs)
        edges, count = _small_star(large, seen["edges"])
        discard(large, ends)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    group = None
    for flagged, leaves in reversed(aside):
        if group is None:
            group = leaves
            continue
        further = leaves.join(group.select(F.col("u").alias("v"), F.col("v").alias("g")), "v", "left").select("u", F.coalesce("g", "v").alias("v"))
        done = materialise(further.unionByName(group))
        discard(group, flagged)
        group = done
    if group is None:
        return numbers.select(F.col("id").alias("group_id"), F.col("id").alias("record_id"))
    named = group.select(F.col("u").alias("n"), "v").join(numbers.select(F.col("n").alias("v"), F.col("id").alias("group_id")), "v")
    return numbers.select("id", "n").join(named.select("n", "group_id"), "n", "left").select(F.coalesce("group_id", "id").alias("group_id"), F.col("id").alias("record_id"))
