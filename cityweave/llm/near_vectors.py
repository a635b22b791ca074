"""Embedding near-dedup by a forest of random-projection trees with spill.

Each tree splits recursively: at a node the projection on a random direction is
cut near the median of a bounded sample (SAMPLE rows), and rows within a margin that
follows from the wanted cosine go to both sides.  Depth and number of trees follow
from the number of rows (class Forest).  Inside a leaf all pairs are
compared in double precision; a leaf with more rows is cut into blocks and each
pair of blocks is a task of its own.  A pair that shares several leaves of the
forest counts in the first of them only, so link counts need no list of pairs;
only spanning edges leave a task, and components are their union.

Equal vectors are one class and are never compared with each other.  Vectors that
are null, empty, zero, or hold null or non-finite parts link with nothing.  Vectors of
different lengths have no cosine; each length has leaves of its own.  The FORESTS most
common lengths have a forest each; vectors of a rarer length lie in one leaf, which is
compared whole, in blocks.  So does a table that fits a leaf: one tree, no splits.
A leaf of m rows that no direction can part makes about (m / (3 * LEAF))^2 / 2 tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .graph import components, forest_edges
from .streams import runs
from .vectors import matrix, usable

TREES, MOST_TREES = 6, 24
LEAF = 2048
SPILL = 0.35
#: For that spill, the mean excess of a pair's difference over both margins, times the
#: density of a normal variable at its median (in standard deviations).
PARTED = 0.286 * 0.4
MISSED = 1e-3
#: Lengths of vectors that get a forest.
FORESTS = 16
#: Levels at most, and those whose nodes have cuts of their own.
MOST_LEVELS, OWN_LEVELS = 40, 12
SAMPLE = 20_000
STEP = 512


class Forest:
    """Directions by tree and level, cuts by node; the same for all workers.

    A pair at the limit differs by sqrt(2 - 2 * least) in length, and on a direction by
    that times a normal variable: the margin is SPILL such standard deviations.  It
    does not grow with the spread of the data, so few rows go to both sides.  Levels
    are added until a leaf is expected to hold LEAF rows, copies included; trees, so
    that a pair at the limit is parted by all of them in about one case of 1 / MISSED."""

    def __init__(self, sample: np.ndarray, total: int, least: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims, n = sample.shape[1], len(sample)
        self.margin = SPILL * math.sqrt(max(0.0, 2 - 2 * least) / dims)
        self.directions: list[np.ndarray] = []
        self.cuts: list[list[np.ndarray]] = []  # by tree and level: of each node, or of all
        self.depth, parted = MOST_LEVELS, 1.0
        # without a split one tree holds all pairs; otherwise as many as the limit needs
        while not self.cuts or self.depth and len(self.cuts) < TREES or self.depth and len(self.cuts) < MOST_TREES and parted ** len(self.cuts) > MISSED:
            d = rng.standard_normal((dims, self.depth)) / math.sqrt(dims)
            p = sample @ d
            row, node, cuts, survive = np.arange(n), np.zeros(n, np.int64), [], 1.0
            for level in range(self.depth):
                if not self.cuts and total * len(row) / max(1, n) / (1 << level) <= LEAF:
                    self.depth = level
                    break
                x = p[:, level]
                whole, spread = self._cut(x), max(float(x.std()), 1e-12) if n else 1.0
                # the chance that a pair at the limit lies on both sides, beyond the margins
                survive *= 1 - min(0.5, PARTED * (self.margin / max(SPILL, 1e-9)) / spread)
                nodes = 1 << level
                cut = np.full(nodes if level < OWN_LEVELS else 1, whole)
                if level < OWN_LEVELS:
                    by = np.argsort(node, kind="stable")
                    at = np.searchsorted(node[by], np.arange(nodes + 1))
                    for k in range(nodes):
                        if at[k + 1] - at[k] >= 32:
                            cut[k] = self._cut(x[row[by[at[k] : at[k + 1]]]])
                cuts.append(cut)
                off = x[row] - cut[node if len(cut) > 1 else np.zeros(len(node), np.int64)]
                left, right = off <= self.margin, off > -self.margin
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            self.directions.append(d[:, : self.depth])
            self.cuts.append(cuts[: self.depth])
            parted = 1 - survive

    def _cut(self, x: np.ndarray) -> float:
        """Near the median, where fewest rows lie within the margin."""
        if not len(x):
            return 0.0
        x = np.sort(x)
        tried = np.quantile(x, (0.5, 0.45, 0.55, 0.4, 0.6))
        within = np.searchsorted(x, tried + self.margin) - np.searchsorted(x, tried - self.margin)
        return float(tried[np.argmin(within)])

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all rows; leaves are numbered through the forest."""
        rows, out = [], []
        for t, d in enumerate(self.directions):
            p = unit @ d
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for level, cut in enumerate(self.cuts[t]):
                off = p[row, level] - (cut[node] if len(cut) > 1 else cut[0])
                left, right = off <= self.margin, off > -self.margin
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(row)
            out.append(node + (t << self.depth))
        return np.concatenate(rows), np.concatenate(out)


def _compare(x: np.ndarray, y: np.ndarray | None, weight_x, weight_y, least: float, before_x, before_y):
    """Link counts (by the other side's weight) and edges that span what is linked, as
    places in x and then y."""
    other = x if y is None else y
    shift = 0 if y is None else len(x)
    n_x, n_y = np.zeros(len(x), np.int64), np.zeros(len(other), np.int64)
    group = np.arange(shift + len(other))  # of the places that are joined so far
    edges = []
    norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((other * other).sum(axis=1))
    for a in range(0, len(x), STEP):
        for b in range(a if y is None else 0, len(other), STEP):
            close = x[a : a + STEP] @ other[b : b + STEP].T >= least * (norm_x[a : a + STEP, None] * norm_y[None, b : b + STEP])
            if y is None and a == b:
                close = np.triu(close, 1)
            if not close.any():
                continue
            if before_x.shape[1]:
                close &= (before_x[a : a + STEP].astype(np.float32) @ before_y[b : b + STEP].astype(np.float32).T) == 0
            n_x[a : a + STEP] += close @ weight_y[b : b + STEP]
            n_y[b : b + STEP] += weight_x[a : a + STEP] @ close
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                near = np.flatnonzero(close[i]) + b + shift
                for g, first in zip(*np.unique(group[near], return_index=True), strict=True):
                    mine = group[i + a]
                    if g != mine:
                        edges.append((i + a, int(near[first])))
                        group[group == g] = mine
    return n_x, n_y, edges


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): one row per input row.

    n_links counts the other rows whose cosine with this one is >= least;
    component_id is the smallest id that links reach, kept whether that is the row's
    own.  Rows with a null id have no links and a null component, and are not kept."""
    spark = vectors.sparkSession
    n_parts = shuffle_partitions(spark)
    good = materialize(usable(vectors, id_col, vector_col), "vectors")
    # one row per distinct vector; equal ones meet only as partial aggregates
    one = materialize(good.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "distinct-vectors")
    size = one.select("fp", "rep", "copies")
    shapes = one.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(FORESTS).collect()
    if shapes:
        forests = {}
        for dims, total in shapes:
            sample = np.empty((0, dims))
            if total > LEAF:
                drawn = one.where(F.size("vector") == dims).select("vector", F.xxhash64("rep").alias("h")).where(F.pmod("h", F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 1.2 * SAMPLE / total))).limit(SAMPLE).collect()
                sample = np.array([r[0] for r in drawn], np.float64).reshape(-1, dims)
                sample /= np.sqrt((sample * sample).sum(axis=1))[:, None]
            forests[dims] = Forest(sample, total, least)
        sent = spark.sparkContext.broadcast(forests)

        def route(batches):
            for batch in batches:
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                for dims in np.unique(sizes).tolist():
                    part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                    x = matrix(part.column(2))
                    if dims in sent.value:
                        row, leaf = sent.value[dims].leaves(x / np.sqrt((x * x).sum(axis=1))[:, None])
                    else:
                        row, leaf = np.arange(len(x)), np.zeros(len(x), np.int64)
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    cut = np.searchsorted(row, np.arange(len(x) + 1))
                    every = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(leaf))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dims, np.int32)), pa.array(leaf), part.column(0).take(at), part.column(1).take(at), every.take(at), part.column(2).take(at)], names=["dims", "leaf", "rep", "copies", "leaves", "vector"])

        routed = one.select("rep", "copies", "vector").mapInArrow(route, "dims int, leaf bigint, rep bigint, copies bigint, leaves array<bigint>, vector array<double>")
        routed = materialize(routed, "routed-vectors")
        blocks = F.ceil(F.col("count") / (3 * LEAF)).cast("int")
        count = routed.groupBy("dims", "leaf").count().select("dims", "leaf", blocks.alias("blocks"))
        placed = routed.join(count, ["dims", "leaf"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "dims", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "leaves", "vector"
        )

        def compare(batches):
            for (_, leaf, i, j), group in runs(batches, ["dims", "leaf", "i", "j"]):
                block, ids = np.array(group.column("block").to_pylist()), np.array(group.column("rep").to_pylist())
                weight, x = np.array(group.column("copies").to_pylist()), matrix(group.column("vector"))
                # earlier leaves that two or more of these rows share: a pair counts in its first
                lists = group.column("leaves").combine_chunks()
                lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
                values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                values, row = values[values < leaf], row[values < leaf]
                seen, where, times = np.unique(values, return_inverse=True, return_counts=True)
                column = np.cumsum(times > 1) - 1
                twice = (times > 1)[where]
                before = np.zeros((len(ids), int((times > 1).sum())), np.uint8)
                before[row[twice], column[where[twice]]] = 1
                left = np.flatnonzero(block == i)
                right = left if i == j else np.flatnonzero(block == j)
                order = np.concatenate((left, right)) if i != j else left
                n_x, n_y, edges = _compare(x[left], None if i == j else x[right], weight[left], weight[right], least, before[left], before[right])
                n = n_x + n_y if i == j else np.concatenate((n_x, n_y))
                found = np.flatnonzero(n)
                a = np.concatenate((ids[order][found], np.array([ids[order][p] for p, _ in edges], np.int64)))
                b = np.concatenate((n[found], np.array([ids[order][q] for _, q in edges], np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(found) + [1] * len(edges), pa.int8()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        dealt = pairs.repartition(n_parts, "dims", "leaf", "i", "j").sortWithinPartitions("dims", "leaf", "i", "j", "rep")
        found = materialize(dealt.mapInArrow(compare, "kind tinyint, a bigint, b bigint"), "vector-links")
    else:
        found = spark.createDataFrame([], "kind tinyint, a bigint, b bigint")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    reach = components(forest_edges(found.where("kind = 1").select("a", "b"))).withColumnRenamed("id", "rep")
    per_class = size.join(counts, "rep", "left").join(reach, "rep", "left").select("fp", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    per_row = good.select("id", "fp").join(per_class, "fp").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"))
    out = rows.join(per_row, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
