"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


class UnionFind:
    """Over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def forest_edges(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition that join something new in it: at most one
    per id, however many edges a dense group has.  Same components."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, where = np.unique(np.concatenate((a, b)), return_inverse=True)
            sets, keep = UnionFind(len(ids)), []
            for k, (i, j) in enumerate(zip(where[: len(a)].tolist(), where[len(a) :].tolist(), strict=True)):
                if sets.union(i, j):
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b); component is the least id.

    Each round hangs the neighbours of every node on its least neighbour, first
    the larger ones, then the smaller ones, until the edges are stars.  Rounds grow
    with the logarithm of the diameter.  Minima are pre-aggregated and written before
    the join, so that Spark can split the join at a hub (adaptive skew joins)."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = materialize(e, "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        small = materialize(hung.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(e)
        discard(large)
        discard(least)
        e, now = small, mark(small)
        if now == seen:
            break
        seen = now
    roots = e.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
