"""Weakly connected components, labelled with the smallest vertex id.

Alternating large-star and small-star steps (Kiveris et al., 2014) on an edge table: each is
an aggregation and a join, and every edge comes to point at the smallest vertex of its
component in a number of rounds that grows with the logarithm of the longest path. A vertex with
very many edges is only ever aggregated (with partial sums) or joined against one row, which
adaptive execution can split. Nothing but a few counts per round reaches the driver.

As soon as no more than ``local_edges`` edges are left, a size that one task holds in a few dozen
megabytes whatever the graph was, that task finishes them in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.scratch import Scratch


#: Edges that one task finishes in memory (16 bytes each).
LOCAL_EDGES = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the smallest vertex of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        if np.array_equal(label[x], label[y]):
            return ids, ids[label]
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(up := label[label], label):
            label = up


def _finish(edges: DataFrame) -> DataFrame:
    """(a, b) stars of a bounded number of edges, in one task."""

    def run(batches):
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            ids, least = least_labels(t["a"].to_numpy(), t["b"].to_numpy())
            other = ids != least
            yield pa.record_batch([pa.array(least[other]), pa.array(ids[other])], ["a", "b"])

    return edges.coalesce(1).mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest vertex among u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them. Edges have a < b."""
    least = scratch.table(edges.groupBy("b").agg(F.min("a").alias("m")))
    own = least.select(F.col("m").alias("a"), "b")
    return edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(own).distinct()


def _stars(edges: DataFrame, count: int) -> bool:
    """Whether every edge points at the smallest vertex of its component already."""
    if edges.select("b").distinct().count() < count:
        return False
    return edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() == 0


def component_edges(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, comp) of every vertex that is not the smallest of its component.

    Direction, loops, repeated edges and null ends do not matter.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.table(edges.where(f"`{a}` <> `{b}`").select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).distinct())
    for _ in range(max_rounds):
        count = now.count()
        if not count or count > local_edges and _stars(now, count):
            break
        if count <= local_edges:
            now = scratch.table(_finish(now))
            break
        large = scratch.table(_large_star(now, scratch))
        after = scratch.table(_small_star(large, scratch))
        scratch.drop(now, large)
        now = after
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("b").alias("id"), F.col("a").alias("comp"))


def components(vertices: DataFrame, edges: DataFrame, vertex: str = "v", src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, comp) for every vertex; those without edges are components of their own."""
    linked = component_edges(edges, src, dst)
    ids = vertices.select(F.col(vertex).cast("long").alias("id"))
    return ids.join(linked, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
