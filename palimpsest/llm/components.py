"""Connected components of an undirected graph: a forest of each part in its task, then one task or star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

#: Links that are finished in one task; more of them take large-star and small-star steps. A task also holds at most so
#: many nodes while it makes a forest.
HELD = 1 << 18


class Union(dict):
    """Node to a node with a smaller name that it is linked with; the least of a group is named by itself or not at all."""

    def find(self, x):
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self[x]
        return top

    def link(self, x, y) -> bool:
        """Whether x and y were apart until now."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def forest(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: for the links (u, v) of each partition, every node tied to the least node it reaches over them."""

    def out(found: Union) -> pa.RecordBatch:
        u = list(found)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([found.find(x) for x in u], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Union()
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.link(u, v)
            if len(found) > HELD:
                yield out(found)
                found.clear()
        if found:
            yield out(found)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    # Two half-width sums cannot overflow a long.
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(h, 33))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them. Edges come as (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns (u, v): links between long node ids. Returns (node, root) for every node that has a link.

    ``root`` is the smallest node of the component. Self links are ignored, repeated links count once and an
    empty table gives an empty table. Each partition's links are folded to a forest first, so a group of many links is
    a link for each of its nodes and partitions. Up to HELD links are finished in one task. Of more no neighbourhood
    is gathered: each step is a minimum per node and a join back, both of which aggregate before they shuffle; each
    round ends in the shared checkpoint folder. Every step that is saved is some stages less for the driver to keep.
    """
    now = cut(forest(edges))
    if now.count() <= HELD:
        now = cut(forest(now.coalesce(1)))
    else:
        now, before = cut(now.distinct()), None
        while (sign := _signature(now)) != before:
            before = sign
            now = cut(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
