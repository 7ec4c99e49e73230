"""Splits that keep related records together.

Records and the entities they share are the nodes of a graph.  Connected
components come from local union-find forests: each task reduces its edges to a
forest, forests are contracted to the edges between their roots, and so on with
larger tasks until the rest fits one bounded task; while it does not, roots are
contracted towards their smallest neighbour in a random order, which takes away
a constant share of the nodes per level.  Labels of the levels are composed
afterwards by joins.  Nothing but sizes is ever collected.

Groups are then assigned largest first to the split furthest below its target.
Equal sizes are handled in bulk: the driver sees the histogram of group sizes
(at most sqrt(2 * records) rows), computes how many groups of each size every
split takes, and the groups find their split by their rank within the size.

Defined cases: null nodes make no edge; a record without an entity is a group
of its own; repeated edges count once; no records give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palatine.llm.common import checkpoint, hot_split_join

#: Edges between roots that one task may finish alone (about 100 MB of Python memory).
LOCAL_EDGES = 1_000_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition to (node, root), root the smallest node of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent[root]) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ru = find(u) if u in parent else parent.setdefault(u, u)
            rv = find(v) if v in parent else parent.setdefault(v, v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, max_levels: int = 60) -> DataFrame:
    """(node, component) of the bigint edges (u, v); the component is one of its nodes."""
    levels: list[DataFrame] = []
    rest = edges.where("u is not null and v is not null").select("u", "v")
    for level in range(max_levels):
        forest = rest.mapInArrow(_local_forest, "node bigint, root bigint")
        # each node's smallest root over all forests, and the links between roots that met in a node
        labels = checkpoint(forest.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
        levels.append(labels.select("node", "root"))
        rest = checkpoint(
            labels.where(F.size("roots") > 1)
            .select(F.explode("roots").alias("u"), F.col("root").alias("v"))
            .where("u <> v")
            .distinct()
        )
        n = rest.count()
        if n == 0:
            break
        if n <= local_edges:
            rest = rest.coalesce(1)
        elif level % 2:
            order = lambda c: F.xxhash64(F.lit(level), c)  # noqa: B023, E731
            both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = checkpoint(both.groupBy("u").agg(F.min(F.struct(order("v"), F.col("v"))).alias("m")).select("u", F.when(F.col("m.col1") < order("u"), F.col("m.v")).otherwise(F.col("u")).alias("to")))
            levels.append(low.select(F.col("u").alias("node"), F.col("to").alias("root")))
            rest = rest.join(low, "u").select(F.col("to").alias("a"), F.col("v").alias("u")).join(low, "u").select(F.col("a").alias("u"), F.col("to").alias("v")).where("u <> v").distinct()
    else:
        raise RuntimeError("components did not converge")
    # from the last level back; the nodes of a level are among those of the level before
    out = levels[-1]
    for labels in reversed(levels[:-1]):
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = labels.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out.select("node", F.col("root").alias("component"))


def quotas(histogram: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, end rank): greedy largest-first in bulk.  ``histogram`` is (size, groups)."""
    total = sum(s * n for s, n in histogram)
    names = list(shares)
    lack = np.array([shares[k] * total / sum(shares.values()) for k in names])
    out = []
    for size, left in sorted(histogram, reverse=True):
        taken = np.zeros(len(names), np.int64)
        while left:
            order = np.argsort(-lack, kind="stable")
            ahead = lack[order[0]] - lack[order[1]] if len(names) > 1 else np.inf
            if ahead <= size and left > 4 * len(names) and lack.max() - lack.min() <= size:
                each = left // len(names) - 1  # all level: the turn goes round
                taken += each
                lack -= each * size
                left -= each * len(names)
                continue
            k = int(min(left, max(1, ahead // size)))
            taken[order[0]] += k
            lack[order[0]] -= k * size
            left -= k
        at = 0
        for name, n in zip(names, taken):
            if n:
                out.append((int(size), name, at, at + int(n)))
                at += int(n)
    return out


def assign_splits(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(group, size, split) of ``groups`` (group bigint, size bigint); whole groups, sizes as near to ``shares`` as greedy gets.

    The rank of a group within its size is exact and distributed: groups are
    range-partitioned by (size, hash), ranked within the partition, and shifted
    by the partition's offsets.
    """
    spark = groups.sparkSession
    histogram = [(r[0], r[1]) for r in groups.groupBy("size").agg(F.count(F.lit(1))).collect()]
    if not histogram:
        return groups.select("group", "size", F.lit(None).cast("string").alias("split"))
    h = F.xxhash64("group")
    parts = checkpoint(groups.withColumn("h", h).repartitionByRange("size", "h", "group").withColumn("part", F.spark_partition_id()))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).select("size", "part", offset.alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part", "size").orderBy("h", "group")) - 1
    ranked = parts.select("group", "size", "part", rank.alias("rank")).join(offsets, ["size", "part"]).select("group", "size", (F.col("rank") + F.col("offset")).alias("rank"))
    plan = spark.createDataFrame(quotas(histogram, shares), "size bigint, split string, lo bigint, hi bigint")
    return ranked.join(F.broadcast(plan), "size").where("rank >= lo and rank < hi").select("group", "size", "split")


def node_id(kind: str, c: str):
    """A 64-bit node of a record or entity; kinds do not clash, equal keys meet."""
    return F.xxhash64(F.lit(kind), F.col(c).cast("string"))


def group_records(records: DataFrame) -> DataFrame:
    """(record, entity, group): the component of every record; ``records`` has (record string, entity).

    A record listed with several entities ties them together.
    """
    keyed = checkpoint(records.where("record is not null").select("record", "entity", node_id("r", "record").alias("u"), node_id("e", "entity").alias("v")))
    linked = connected_components(keyed.where("entity is not null").select("u", "v"))
    return keyed.join(linked.select(F.col("node").alias("u"), "component"), "u", "left").select("record", "entity", F.coalesce("component", "u").alias("group"))


def split_records(records: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(record, group, split): the assignment of every record."""
    grouped = checkpoint(group_records(records).select("record", "group").distinct())
    sizes = checkpoint(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("size")))
    return hot_split_join(grouped, checkpoint(assign_splits(sizes, shares)), "group", "size").select("record", "group", "split")


def split_breakers(grouped: DataFrame, splits: DataFrame) -> DataFrame:
    """(entity) of the groups whose records' recorded splits differ; ``grouped`` as above, ``splits`` (record, split)."""
    with_split = grouped.join(splits.where("split is not null"), "record")
    wide = with_split.groupBy("group").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("group")
    return grouped.where("entity is not null").select("group", "entity").distinct().join(wide, "group", "left_semi").select("entity").distinct()
