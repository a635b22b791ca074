"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has PROJECTIONS random Gaussian directions; a vector's bucket is the
cells floor((a.x + b) / width) of its projections.  A query visits its
own bucket and perturbed ones in the order of their estimated success: the
chance that a neighbour's projections fall into the bucket's cells.  A
neighbour's projection given the query's is normal; its slope and variance are
those of the query's own nearest rows in a bounded sample (SAMPLE rows), in GROUPS
from near to far.  Probing stops when the
visited buckets hold TARGET of that chance, so easy data take few probes and hard
data many.  Where directions say so little that a table would take more than PROBES
buckets, or where the visited buckets of both tables hold fewer than K + 1 rows, such
a query is compared with all rows instead, in blocks, which is exact.  A query thus
has at most TABLES * PROBES rows of probes, whatever the data.  Candidates of
all tables are merged and ranked by exact inner products in double precision on the
original vectors.

Buckets are dealt to groups of at most about GROUP rows, and to more groups while
shuffle partitions are free.  A bucket with more than BUCKET rows is cut
into slots that are visited one by one, so a hot bucket is spread out and every
row of it is still compared.  Equal vectors are one class with its first K + 1
ids.  Vectors that are null, zero or hold null or non-finite parts take no part,
and neither do those whose length differs from the most common one.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .streams import runs
from .vectors import classes, matrix, usable

TABLES = 2
WIDTH = 1.2  # of a cell, in standard deviations of a projection
BUCKET = 1024
GROUP = 32_768  # rows of a group, or of a block that all of a query's rows are compared with
SAMPLE = 4096
GROUPS = 4  # of a query's neighbours in the sample, each with an estimate of its own
TARGET = 0.86  # of each table; two tables together reach about 1 - 0.14**2
PROBES = 4096  # of a query and table at most
CELLS = 6  # cells at each side of the middle that are told apart; the outer ones are open


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to seven places (a rational approximation of erf)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z) / 2
    return np.where(x > 0, 1 - tail, tail)


class Hashes:
    """The tables: directions, offsets, and what was learnt about near pairs."""

    def __init__(self, sample: np.ndarray, total: int, nearest: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        per_cell = max(2.0, 4.13 / WIDTH)  # cells that a normal projection mostly fills
        self.k = max(1, min(10, math.ceil(math.log(max(2, total / BUCKET)) / math.log(per_cell))))
        self.directions = [rng.standard_normal((dims, self.k)) for _ in range(TABLES)]
        self.scale = [np.maximum((sample @ d).std(axis=0), 1e-12) for d in self.directions]
        self.centre = [(sample @ d).mean(axis=0) for d in self.directions]
        self.offset = [rng.uniform(0, WIDTH, self.k) for _ in range(TABLES)]
        self.sample, self.norms, self.nearest, self.most = sample, (sample * sample).sum(axis=1), nearest, PROBES

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and remaining spread of the neighbours of each row, by GROUPS of them: for
        those in the sample with the largest inner products, nearest group first."""
        own = np.maximum((x * x).sum(axis=1), 1e-300)[:, None]
        inner = x @ self.sample.T
        inner[np.abs(own + self.norms - 2 * inner) <= 1e-9 * (own + self.norms)] = -np.inf  # the row itself
        k = min(self.nearest, inner.shape[1])
        at = np.argpartition(-inner, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(inner, at, 1)
        order = np.argsort(-top, axis=1, kind="stable")
        at, top = np.take_along_axis(at, order, 1), np.take_along_axis(top, order, 1)
        lost = ~np.isfinite(top)
        top = np.where(lost, own, top)  # no other row in the sample: look at the own place
        rest = np.where(lost, 0.0, np.maximum(self.norms[at] - top * top / own, 0.0))
        parts = np.array_split(np.arange(k), min(GROUPS, k))
        slope = np.stack([(top[:, g] / own).mean(axis=1) for g in parts], 1)
        return slope, np.sqrt(np.maximum(np.stack([rest[:, g].mean(axis=1) for g in parts], 1), 1e-12))

    def _placed(self, x: np.ndarray, t: int) -> np.ndarray:
        return ((x @ self.directions[t]) - self.centre[t]) / self.scale[t]

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        cell = np.clip(np.floor((self._placed(x, t) + self.offset[t]) / WIDTH), -CELLS, CELLS).astype(np.int64) + CELLS
        return cell @ (2 * CELLS + 1) ** np.arange(self.k)

    def probes(self, x: np.ndarray, t: int) -> list[np.ndarray | None]:
        """The buckets that each query visits until their estimated success is TARGET; None
        if they are more than PROBES."""
        edges = (np.arange(-CELLS, CELLS + 2) * WIDTH)[None, None, :] - self.offset[t][None, :, None]
        raw = x @ self.directions[t]
        slopes, rests = self.near(x)
        chance = np.zeros((len(x), self.k, 2 * CELLS + 1))
        for slope, rest in zip(slopes.T, rests.T, strict=True):
            mean = (raw * slope[:, None] - self.centre[t]) / self.scale[t]
            upto = _phi((edges - mean[:, :, None]) / (rest[:, None] / self.scale[t])[:, :, None])
            upto[:, :, 0], upto[:, :, -1] = 0.0, 1.0
            chance += np.diff(upto, axis=2) / slopes.shape[1]
        own = self.buckets(x, t)
        found = [self._visit(one) for one in chance]
        return [None if codes is None else np.unique(np.append(codes, b)) for codes, b in zip(found, own, strict=True)]

    def _visit(self, chance: np.ndarray) -> np.ndarray | None:
        """Best-first over products of per-direction chances until TARGET is reached."""
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, 1)
        # directions are folded in one by one; what can never be needed is left out
        mass, code = np.ones(1), np.zeros(1, np.int64)
        for j in range(self.k):
            m = (mass[:, None] * ranked[j][None, :]).ravel()
            c = (code[:, None] + order[j][None, :] * (2 * CELLS + 1) ** j).ravel()
            by = np.argsort(-m, kind="stable")
            total = np.cumsum(m[by])
            # the kept share must still allow TARGET after the remaining directions
            keep = by[: int(np.searchsorted(total, TARGET + (1 - TARGET) * (1 - (j + 1) / self.k) * 0.98)) + 1]
            if len(keep) >= self.most:
                return None
            mass, code = m[keep], c[keep]
        return code


def _top(scores: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest finite scores of each row and of all that tie
    with the last of them, to within slack."""
    k = min(k, scores.shape[1])
    last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return np.nonzero(np.isfinite(scores) & (scores >= (last - slack)[:, None]))


def nearest(vectors: DataFrame, query_step: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by query_step the
    k rows found nearest by inner product, itself left out."""
    spark = vectors.sparkSession
    n_parts = shuffle_partitions(spark)
    good = materialize(usable(vectors, id_col, vector_col), "vectors")
    every = materialize(classes(good, k + 1), "vector-classes")
    shapes = every.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    result = "query_id bigint, rank int, id bigint, score double"
    if not shapes:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_col)
    dims, total = shapes[0]
    every = every.where(F.size("vector") == dims)
    asked = good.where(F.pmod("id", F.lit(query_step)) == 0).select("id", "fp")
    drawn = every.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 1.2 * SAMPLE / total))).select("vector").limit(SAMPLE).collect()
    hashes = spark.sparkContext.broadcast(Hashes(np.array([r[0] for r in drawn], np.float64).reshape(-1, dims), total, k))

    def index(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(hashes.value.buckets(x, t)), batch.column(0), batch.column(1)], names=["t", "bucket", "rep", "vector"])

    def visits(batches):
        """(t, bucket, query); one row of table -1 for a query that takes too many."""
        for batch in batches:
            x = matrix(batch.column(1))
            lists = [hashes.value.probes(x, t) for t in range(TABLES)]
            hard = np.array([any(one[i] is None for one in lists) for i in range(len(x))], bool)
            for t, one in ((-1, [np.zeros(int(h), np.int64) for h in hard]), *((t, [np.empty(0, np.int64) if h else p for p, h in zip(one, hard, strict=True)]) for t, one in enumerate(lists))):
                at = np.repeat(np.arange(len(x)), [len(p) for p in one])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.concatenate([*one, np.empty(0, np.int64)])), batch.column(0).take(pa.array(at))], names=["t", "bucket", "query"])

    stored = materialize(every.select("rep", "vector").mapInArrow(index, "t int, bucket bigint, rep bigint, vector array<double>"), "buckets")
    slots = F.ceil(F.col("count") / BUCKET).cast("int")
    filled = stored.groupBy("t", "bucket").count().select("t", "bucket", slots.alias("slots"), "count")
    filled = materialize(filled, "filled-buckets")
    groups = max(math.ceil(total / GROUP), min(math.ceil(total / (4 * BUCKET)), n_parts // TABLES), 1)
    group = F.pmod(F.xxhash64("t", "bucket", "slot"), F.lit(groups)).cast("int")
    rows = stored.join(filled.drop("count"), ["t", "bucket"]).withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("slots")).cast("int"))
    rows = rows.select("t", group.alias("g"), F.lit(0).alias("kind"), F.col("rep").alias("id"), F.array("bucket").alias("buckets"), "vector")
    # vectors of the asked classes, by class
    wanted = materialize(every.join(asked.select("fp").distinct(), "fp", "left_semi").select(F.col("rep").alias("query"), "vector"), "queries")
    probes = materialize(wanted.mapInArrow(visits, "t int, bucket bigint, query bigint"), "probes")
    met = materialize(probes.where("t >= 0").join(filled, ["t", "bucket"]), "visited")
    held = met.groupBy("query", "t").agg(F.sum("count").alias("n")).where(F.col("n") > k).select("query").distinct()
    exact = materialize(wanted.select("query").join(held, "query", "left_anti"), "exact-queries")
    met = met.join(exact, "query", "left_anti").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    met = met.select("t", group.alias("g"), "query", "bucket").groupBy("t", "g", "query").agg(F.collect_set("bucket").alias("buckets"))
    asks = met.join(wanted, "query").select("t", "g", F.lit(1).alias("kind"), F.col("query").alias("id"), "buckets", "vector")
    if not exact.isEmpty():
        blocks = max(math.ceil(total / GROUP), min(math.ceil(total / (4 * BUCKET)), n_parts))
        whole = F.array(F.lit(0).cast("long")).alias("buckets")
        rows = rows.unionByName(every.select(F.lit(-1).alias("t"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("g"), F.lit(0).alias("kind"), F.col("rep").alias("id"), whole, "vector"))
        asks = asks.unionByName(wanted.join(exact, "query").select(F.lit(-1).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g"), F.lit(1).alias("kind"), F.col("query").alias("id"), whole, "vector"))

    def rank(batches):
        ids = bucket = x = longest = None
        current = None
        for (t, g, kind), part in runs(batches, ["t", "g", "kind"]):
            if kind == 0:
                current, ids, x = (t, g), np.array(part.column("id").to_pylist()), matrix(part.column("vector"))
                bucket = np.array([b[0] for b in part.column("buckets").to_pylist()])
                longest = np.linalg.norm(x, axis=1).max()
                numbers, place = np.unique(bucket, return_inverse=True)
                spot = {b: i for i, b in enumerate(numbers.tolist())}
                continue
            if current != (t, g):
                continue
            for a in range(0, part.num_rows, 64):
                some = part.slice(a, 64)
                q = matrix(some.column("vector"))
                asked_ = np.array(some.column("id").to_pylist())
                visited = np.zeros((len(q), len(numbers)), bool)
                for i, bs in enumerate(some.column("buckets").to_pylist()):
                    visited[i, [spot[b] for b in bs if b in spot]] = True
                scores = np.where(visited[:, place], q @ x.T, -np.inf)
                row, col = _top(scores, k + 1, 1e-12 * longest * np.linalg.norm(q, axis=1))
                exact = (q[row] * x[col]).sum(axis=1)
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(q)))))
                keep = np.arange(len(row)) - start[row] < k + 1
                yield pa.RecordBatch.from_arrays([pa.array(asked_[row[keep]]), pa.array(ids[col[keep]]), pa.array(exact[keep])], names=["query", "rep", "score"])

    dealt = rows.unionByName(asks).repartition(n_parts, "t", "g").sortWithinPartitions("t", "g", "kind", "id")
    found = dealt.mapInArrow(rank, "query bigint, rep bigint, score double").dropDuplicates(["query", "rep"])
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    full = top.join(every.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("id"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    listed = full.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("query", "score", "id")
    owner = asked.join(every.select("fp", F.col("rep").alias("query")), "fp").select("query", F.col("id").alias("query_id")).distinct()
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = owner.join(listed, "query").where("id <> query_id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
