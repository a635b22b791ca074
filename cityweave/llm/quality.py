"""Quality classifier: naive Bayes support vectors over byte n-grams.

Features are indicators of the byte n-grams (N_GRAMS) of a text, hashed to DIMS
slots.  Log-count ratios come from all labelled training rows.  A linear hinge
loss over the scaled indicators is then fitted by dual coordinate descent on at
most SAMPLE labelled rows of SAMPLE_BYTES in all (the documented bound), chosen by a
hash; the fit runs on the driver, whose memory that bound limits.  Weights are drawn
towards their mean magnitude (interpolation BETA) and margins mapped to 0..1 by
a logistic curve fitted on a held-back fifth of the sample.

Null and empty texts have no features and score by the bias alone.  Without
training rows of both classes every score is the share of label 1 (0.5 with no
rows at all).  Ids that occur several times are scored row by row; a label row
that repeats an id counts once, with the largest label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import discard, materialize, small_batches

N_GRAMS = (2, 3)
DIMS = 1 << 18
SAMPLE = 6000
#: Bytes of features that the fit takes at most (4 a feature), whatever the texts' length.
SAMPLE_BYTES = 1 << 27
BETA = 0.25
WINDOW = 1 << 20
#: Label rows up to which they are broadcast (16 bytes each); beyond, a shuffle join.
BROADCAST_LABELS = 1_000_000
_BLOCK = 1 << 12
# Odd multipliers that mix the bytes of an n-gram.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


class Features:
    """Distinct feature numbers of a text; keeps one scratch array per worker."""

    def __init__(self):
        self.last = np.zeros(DIMS, np.int32)

    @staticmethod
    def hashed(raw: np.ndarray) -> np.ndarray:
        out = []
        for n in N_GRAMS:
            if len(raw) >= n:
                h = np.full(len(raw) - n + 1, np.uint32(n * 0x165667B1 & 0xFFFFFFFF))
                for i in range(n):
                    h = (h ^ raw[i : len(raw) - n + 1 + i]) * _MIX[i]
                    h ^= h >> np.uint32(15)
                out.append((h >> np.uint32(3)) & np.uint32(DIMS - 1))
        return np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32)

    @staticmethod
    def repeats(text: str | None) -> np.ndarray:
        """n-grams of the sequence "same word as the one before, or not": its runs of
        "same" up to six, and their share in tenths.  Slots 0-16 of the space."""
        words = (text or "").split()
        if len(words) < 2:
            return np.empty(0, np.int32)
        same = "".join(["S" if a == b else "d" for a, b in zip(words, words[1:], strict=False)])
        runs = [n for n in range(1, 7) if "S" * n in same]
        return np.array([*runs, 7 + same.count("S") * 9 // len(same)], np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8"), np.uint8).astype(np.uint32)
        if len(raw) > WINDOW:
            there = np.zeros(DIMS, bool)
            there[self.repeats(text)] = True
            for a in range(0, len(raw), WINDOW):
                there[self.hashed(raw[a : a + WINDOW + max(N_GRAMS) - 1])] = True
            return np.flatnonzero(there).astype(np.int32)
        h = np.concatenate((self.hashed(raw), self.repeats(text)))
        place = np.arange(len(h), dtype=np.int32)
        self.last[h] = place
        return h[self.last[h] == place]


@dataclass
class Model:
    weights: np.ndarray  # of each slot, the log-count ratio included
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum(dtype=np.float64)) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.offset))))


def hinge_dual(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear L1-loss SVM with a bias feature of 1."""
    w, b, rng = np.zeros(len(scale)), 0.0, np.random.default_rng(seed)
    values = [scale[x] for x in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step) * math.sqrt(square[i]))
        if moved < 1e-4:
            break
    return w, b


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps with smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    size = float(np.abs(margin).mean()) or 1.0
    z, a, b = margin / size, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-9)
        ha, hb, hab = (s * z * z).sum() + 1e-3, s.sum() + 1e-3, (s * z).sum()
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum()
        det = ha * hb - hab * hab
        da, db = (hb * ga - hab * gb) / det, (ha * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-6) / size, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of label_col (0/1) from the labelled rows of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n = sum(sizes.values())
    known = known.withColumn("chosen", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * sample / max(1, n))))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    joined = rows.join(F.broadcast(known) if n <= BROADCAST_LABELS else known, "id").select("label", "chosen", "text")

    def gather(batches):
        features, counts, rows_ = Features(), np.zeros((2, DIMS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for label, chosen, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = features(text)
                counts[label][f] += 1
                rows_[label] += 1
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - label]), pa.array([f.astype("<i4").tobytes()])], names=["block", "data"])
        if rows_.any():
            for k in range(DIMS // _BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([counts[:, k * _BLOCK : (k + 1) * _BLOCK].tobytes()])], names=["block", "data"])

    found = materialize(joined.mapInArrow(gather, "block bigint, data binary"), "quality-features")

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(2 * _BLOCK, np.int64)
        for x in pdf["data"]:
            total += np.frombuffer(x, np.int32)
        return pd.DataFrame({"block": [key[0]], "data": [total.tobytes()]})

    counts = np.zeros((2, DIMS), np.float64)
    for block, data in found.where("block >= 0").groupBy("block").applyInPandas(add, "block bigint, data binary").collect():
        counts[:, block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(data, np.int64).reshape(2, _BLOCK)
    few = found.where("block < 0").select("block", "data", F.xxhash64("data").alias("h")).orderBy("h", "block").limit(sample)
    upto = Window.orderBy("h", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = few.withColumn("size", F.sum(F.length("data")).over(upto)).where(F.col("size") <= SAMPLE_BYTES).select("block", "data").collect()
    discard(found)
    return fit([np.frombuffer(d, "<i4") for _, d in drawn], np.array([1 if b == -2 else -1 for b, _ in drawn]), counts)


def fit(rows: list[np.ndarray], y: np.ndarray, counts: np.ndarray) -> Model:
    share = float((y > 0).mean()) if len(y) else 0.5
    if min((y > 0).sum(), (y < 0).sum()) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMS, np.float32), 0.0, 1.0, math.log(share / (1 - share)))
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[counts.sum(axis=0) < 3] = 0  # seen too seldom to say anything
    weight = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    cost = 0.01 * weight

    def learn(idx):
        w, b = hinge_dual([rows[i] for i in idx], y[idx], ratio, cost[idx])
        return (1 - BETA) * np.abs(w).mean() + BETA * w, b

    part = np.arange(len(y)) % 5 == 0
    w, b = learn(np.flatnonzero(~part))
    held = np.flatnonzero(part)
    full = (w * ratio).astype(np.float32)
    margin = np.array([float(full[rows[i]].sum(dtype=np.float64)) + b for i in held])
    if len(set(y[held].tolist())) < 2:
        held, margin = np.arange(len(y)), np.array([float(full[x].sum(dtype=np.float64)) + b for x in rows])
    slope, offset = logistic_fit(margin, y[held])
    return Model(full, b, slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, which replaces one of that name; one pass, no shuffle.
    The weights are broadcast (1 MB)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batches):
        features = Features()
        for batch in batches:
            scored = pa.array([sent.value.score(features(t)) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), scored], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))
