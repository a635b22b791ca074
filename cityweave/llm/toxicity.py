"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is lower-cased and cut into words at white space.  The character n-grams
(N_GRAMS) of each word, with a mark at its start and end, hash to DIMS buckets,
and each bucket has an embedding of WIDTH numbers.  The embeddings of a passage
of PASSAGE words are averaged, and a softmax over two classes reads the average;
embeddings and softmax are learnt together, by Adagrad steps in numpy.  A misspelt
or inflected word that no label has shown shares most of its n-grams with known ones.

A few words make a text toxic, and an average over thousands of words hides
them, so a text scores as its highest passage.  Training follows that: each
passage of a clean text is clean, and of a toxic text the passage that scores
highest at the time is toxic.

The fit takes at most SAMPLE labelled rows of each class and SAMPLE_BYTES of text
in all (the documented bound), chosen by a hash, and runs on the driver, whose
memory that bound limits.  Scoring reads every whole text, in one pass without a
shuffle; the softmax over two classes is one dot product, so a bucket is sent as
one number (DIMS * 4 bytes).

Null and empty texts have one passage without n-grams and score by the bias alone.
Without training rows of both classes every score is the share of label 1 (0.5
with no rows at all).  Rows that share an id are scored row by row; label rows
that share an id count once, with the largest label.  A word of over LONG
characters is cut into pieces of LONG.  A column named as the score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import small_batches

N_GRAMS = (3, 4, 5, 6)
DIMS = 1 << 18
WIDTH = 10
PASSAGE = 4
#: A text scores as the mean of its highest 1 / TOP of passages (one at least).
TOP = 16
LONG = 48
SAMPLE = 1500
SAMPLE_BYTES = 1 << 23
EPOCHS = 10
#: Random clean passages a text in each epoch, the most weight of a toxic passage, and the pace of the softmax.
MORE, HEAVY, SOFT = 2, 4.0, 0.2
#: Characters that are hashed at a time.
WINDOW = 1 << 19
# Fixed value: an odd multiplier that mixes code points.
_MIX = np.uint32(0x9E3779B1)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Code points of the marked words, " w1 w2 ... wn ", at most about WINDOW at a time;
    each piece holds whole passages."""
    words = (text or "").lower().split()
    if any(len(w) > LONG for w in words):
        words = [w[a : a + LONG] for w in words for a in range(0, len(w), LONG)]
    step = max(1, WINDOW // (LONG * PASSAGE)) * PASSAGE
    for a in range(0, len(words), step):
        yield np.frombuffer(f" {' '.join(words[a : a + step])} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, passage) of every n-gram that has no space but at its ends."""
    space = points == 32
    word = np.cumsum(space) - 1
    inner = np.concatenate(([0], np.cumsum(space)))
    buckets, passages = [], []
    h = points * _MIX
    for n in range(2, max(N_GRAMS) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] ^ (h[: len(points) - n + 1] >> np.uint32(13)) ^ points[n - 1 :]) * _MIX
        if n in N_GRAMS:
            ok = np.flatnonzero(inner[n - 1 : len(points)] == inner[1 : len(points) - n + 2])
            mixed = h[ok]
            buckets.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(8)) & np.uint32(DIMS - 1))
            passages.append(word[ok] // PASSAGE)
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(passages)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: its embedding times the difference of the two softmax rows
    bias: float

    def score(self, text: str | None) -> float:
        found = []
        for points in pieces(text):
            bucket, passage = grams(points)
            if len(bucket):
                n = np.bincount(passage)
                found.append((np.bincount(passage, self.weights[bucket]) / np.maximum(n, 1))[n > 0])
        z = self.bias
        if found:
            m = np.concatenate(found)
            k = -(-len(m) // TOP)
            z += float(np.partition(m, len(m) - k)[len(m) - k :].mean())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, batch: int = 64, seed: int = 11) -> Model:
    """Embeddings and softmax of whole texts with labels 0 or 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMS, np.float32), math.log(share / (1 - share)))
    bags, parts = [], []  # buckets of each passage
    owner: list[int] = []  # text of each passage
    for i, text in enumerate(texts):
        for points in pieces(text):
            bucket, passage = grams(points)
            by = np.argsort(passage, kind="stable")
            cuts = np.flatnonzero(np.diff(passage[by])) + 1
            parts = np.split(bucket[by].astype(np.int32), cuts) if len(by) else []
            bags += parts
            owner += [i] * len(parts)
    own = np.array(owner, np.int64)
    size = np.array([len(x) for x in bags], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    flat = _concat(bags)
    del bags, parts  # the driver holds each n-gram once
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (DIMS, WIDTH)).astype(np.float32) / WIDTH
    seen = np.full(DIMS, 1e-9, np.float32)  # Adagrad: summed squares of a bucket's gradients
    soft, bias = rng.normal(0, 0.1, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    soft_seen, bias_seen = np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    clean = np.flatnonzero(labels[own] == 0) if len(own) else np.empty(0, np.int64)
    toxic = np.flatnonzero(labels[own] == 1) if len(own) else np.empty(0, np.int64)
    if not len(clean) or not len(toxic):
        return Model(np.zeros(DIMS, np.float32), math.log(share / (1 - share)))

    def margins() -> np.ndarray:
        return np.add.reduceat((table @ (soft[1] - soft[0]))[flat], start[:-1]) / size

    # the place of each passage in its text, and how many of the text's highest count
    place = np.arange(len(own)) - np.searchsorted(own, own)
    high = place < -(-np.bincount(own)[own] // TOP)
    for epoch in range(epochs):
        m = margins()
        hardest = np.lexsort((-m, own))[high]  # texts stay where they are
        top = labels[own[hardest]] == 1
        if epoch == 0:  # nothing is known yet: every passage of a toxic text counts
            chosen, weight = toxic, 1 / np.bincount(own)[own[toxic]]
        else:
            chosen = hardest[top]
            weight = 1 / np.bincount(own[chosen])[own[chosen]]
        other = np.union1d(hardest[~top], rng.choice(clean, min(len(clean), MORE * len(texts)), replace=False))
        rows = np.concatenate((other, chosen))
        y = np.concatenate((np.zeros(len(other), np.int64), np.ones(len(chosen), np.int64)))
        heavy = np.concatenate((np.ones(len(other)), weight * min(len(other) / weight.sum(), HEAVY)))
        perm = rng.permutation(len(rows))
        pace = rate * (1 - epoch / epochs)
        for a in range(0, len(perm), batch):
            at = perm[a : a + batch]
            p, n = rows[at], size[rows[at]]
            ids = np.concatenate([flat[start[i] : start[i + 1]] for i in p])
            ends = np.concatenate(([0], np.cumsum(n)[:-1]))
            mean = np.add.reduceat(table[ids], ends) / n[:, None]
            z = mean @ soft.T + bias
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(p)), y[at]] -= 1
            q *= heavy[at][:, None] / len(p)
            by = np.argsort(ids, kind="stable")
            same = np.concatenate(([0], np.flatnonzero(np.diff(ids[by])) + 1))
            used = ids[by[same]]
            g = np.add.reduceat(((q @ soft) / n[:, None])[np.repeat(np.arange(len(p)), n)[by]], same)
            seen[used] += (g * g).mean(axis=1)
            table[used] -= (pace * g / np.sqrt(seen[used])[:, None]).astype(np.float32)
            gs, gb = q.T @ mean, q.sum(axis=0)
            soft_seen += gs * gs
            bias_seen += gb * gb
            soft -= (SOFT * pace * gs / np.sqrt(soft_seen)).astype(np.float32)
            bias -= (SOFT * pace * gb / np.sqrt(bias_seen)).astype(np.float32)
    table[seen <= 1e-9] = 0  # buckets that no label has shown say nothing
    return Model((table @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of label_col (0/1) from at most `sample` labelled rows of docs a class."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit("toxicity"), "id")
    few = [known.where(F.col("label") == k).withColumn("h", order).where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * sample / n))).orderBy("h").limit(sample) for k, n in sorted(sizes.items())]
    if not few:
        return fit([], np.empty(0, np.int64))
    chosen = few[0] if len(few) == 1 else few[0].union(few[1])
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null")
    joined = rows.join(F.broadcast(chosen), "id").select("h", "label", F.coalesce("text", F.lit("")).alias("text"))
    # rows may share an id: the bounds hold for rows, and repeated texts count once
    rank = Window.partitionBy("label").orderBy("h", "text")
    upto = Window.orderBy("rank", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = joined.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= sample).withColumn("size", F.sum(F.octet_length("text")).over(upto)).where(F.col("size") <= sample_bytes)
    found = drawn.select("rank", "label", "text").orderBy("rank", "label").collect()
    return fit([r["text"] for r in found], np.array([r["label"] for r in found], np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, which replaces one of that name; one pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scored = pa.array([sent.value.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), scored], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))
