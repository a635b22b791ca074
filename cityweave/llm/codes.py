"""Vector code compression: product quantisation in exact integers.

Each component x becomes the integer floor(4096 * x) and each vector is cut into
PARTS equal parts.  A part position has a codebook of ENTRIES entries, which starts
as that part of the vectors of the smallest ids; each round assigns every part to
its nearest entry (squared Euclidean distance, ties to the lower index) and replaces
each entry by the componentwise floor of its parts' mean.

Distances come from a limb-split GEMM: integers are broken into limbs of LIMB bits,
so that a dot product of two limbs stays below 2^53 and a float64 BLAS product is
exact; the products are shifted and added in int64, and argmin takes the first least
entry.  Results are thus the same on any machine, BLAS and partitioning.

Spark quantises, and each round is one pass over the quantised table: a task
assigns its rows in batches and gives sums and counts per entry, which Spark adds
up.  Only the codebooks (ENTRIES integers per component) meet in the driver.

Rows whose vector is null, or holds null or non-finite parts, are left out; zero
vectors stay.  Shorter vectors, and those whose length PARTS does not divide, are
filled up with zeros to the longest length, rounded up; an empty vector is all
zeros.  Rows that share an id start the codebooks in the order of their integers;
rows without an id come after all others.  With fewer than ENTRIES rows the missing
entries are absent.  Integers saturate at those of a long, and so do errors; where
a distance might leave int64, Python's integers take over.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a limb: two limbs hold the integers of unit vectors.
LIMB = 12
#: Labels up to which their error sums are broadcast; beyond, a shuffle join.
BROADCAST_LABELS = 1_000_000
_LONG = 2**63 - 1


def limbs(x: np.ndarray, n: int) -> list[np.ndarray]:
    """n float64 arrays with x = sum of limb[i] << (i * LIMB); the last one has the sign."""
    out = []
    for i in range(n):
        out.append(((x >> (i * LIMB)) & ((1 << LIMB) - 1) if i + 1 < n else x >> (i * LIMB)).astype(np.float64))
    return out


def limbs_of(most: int) -> int:
    """Limbs for integers of magnitude `most`: the last one, with the sign, fits LIMB bits too."""
    return max(1, -(-(int(most).bit_length() + 1) // LIMB))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, exactly; the caller knows that it fits int64."""
    if x.shape[1] << (2 * LIMB) >= 1 << 53:
        raise ValueError("too many components for limbs of this width")
    total = np.zeros((len(x), len(y)), np.int64)
    nx, ny = (limbs_of(max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))) for m in (x, y))
    right = limbs(y, ny)
    for i, a in enumerate(limbs(x, nx)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << ((i + j) * LIMB)
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of book for each row of x."""
    most = max(abs(int(m.min(initial=0))) + abs(int(m.max(initial=0))) for m in (x, book))
    if 4 * most * most * max(1, x.shape[1]) > _LONG:
        x, book = x.astype(object), book.astype(object)
        both = x @ book.T
    else:
        both = dots(x, book)
    far = (book * book).sum(axis=1)[None, :] - 2 * both
    at = far.argmin(axis=1)  # the first least
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Lists of int64 as rows, filled up with zeros to `width`."""
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        n = np.diff(column.offsets.to_numpy(zero_copy_only=False))
        out[np.arange(width)[None, :] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Codebooks:
    parts: np.ndarray  # (PARTS, entries, components) of int64
    width: int

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Indexes (rows, PARTS) and the distances by part."""
        step = self.width // len(self.parts)
        found = [nearest(vectors[:, p * step : (p + 1) * step], book) for p, book in enumerate(self.parts)]
        return np.stack([at for at, _ in found], axis=1), [d for _, d in found]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.parts.ravel().tolist())).encode()).hexdigest()


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, q): the rows that take part, as integers; no Python."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.lit(float(2**62))
    return rows.where(F.col("v").isNotNull() & ~bad).select("id", "label", F.transform("v", lambda x: F.floor(F.greatest(-top, F.least(top, x * F.lit(float(SCALE)))))).alias("q"))


def first_books(q: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    first = [r["q"] for r in q.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()]
    rows = np.array([[*v, *[0] * (width - len(v))] for v in first], np.int64)
    return Codebooks(np.ascontiguousarray(rows.reshape(len(first), parts, width // parts).transpose(1, 0, 2)), width)


def improved(q: DataFrame, books: Codebooks) -> Codebooks:
    """One round: the floors of the means of what is nearest to each entry."""
    sent, width = q.sparkSession.sparkContext.broadcast(books), books.width
    n_parts, n_entries, step = books.parts.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches):
        from decimal import Decimal

        total, count = np.zeros((n_parts, n_entries, step), object), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            vectors = integers(batch.column(0), width)
            codes, _ = sent.value.assign(vectors)
            # 2^62 / rows of a batch bounds what an int64 sum holds
            wide = np.abs(vectors).max(initial=0) >= (1 << 62) // max(1, len(vectors))
            for p in range(n_parts):
                sums = np.zeros((n_entries, step), object if wide else np.int64)
                np.add.at(sums, codes[:, p], vectors[:, p * step : (p + 1) * step].astype(sums.dtype))
                total[p] += sums.astype(object)
                count[p] += np.bincount(codes[:, p], minlength=n_entries)
        used = [(p, e, a, Decimal(int(total[p, e, a])), int(count[p, e])) for p, e in np.argwhere(count).tolist() for a in range(step)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in used], f.type) for i, f in enumerate(schema)], schema=schema)

    sums = q.select("q").mapInArrow(run, "part int, entry int, at int, total decimal(38,0), n bigint").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    parts = books.parts.copy()
    for r in sums.collect():
        parts[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    sent.unpersist()
    return Codebooks(parts, width)


def coded(q: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of quantised rows."""
    sent, width = q.sparkSession.sparkContext.broadcast(books), books.width
    label_type = q.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            codes, far = sent.value.assign(integers(batch.column(2), width))
            error = [min(sum(map(int, d)), _LONG) for d in zip(*far, strict=True)]
            names = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return q.select("id", "label", "q").mapInArrow(run, f"id bigint, label {label_type}, code string, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of each row that takes part, and the codebooks
    (None for an empty table)."""
    q = materialize(quantised(vectors, id_col, vector_col, label_col), "code-integers")
    longest = q.agg(F.max(F.size("q")).alias("n")).first()["n"]
    if longest is None:
        none = q.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, None
    books = first_books(q, max(1, -(-longest // parts)) * parts, parts, entries)
    for _ in range(rounds):
        better = improved(q, books)
        if (better.parts == books.parts).all():
            break  # further rounds change nothing
        books = better
    rows = materialize(coded(q, books), "codes")
    discard(q)
    per_label = rows.groupBy(F.struct("label").alias("key")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    per_label = per_label.select("key", F.least("sum", F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = per_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    # a struct with a null inside equals itself, so null labels meet each other
    joined = rows.withColumn("key", F.struct("label")).join(F.broadcast(per_label) if few else per_label, "key")
    return joined.select("id", "label", "code", "error", "label_error"), books


def decoded(codes: DataFrame, books: Codebooks, code_col: str = "code", out: str = "vector") -> DataFrame:
    """codes with the approximate vectors that their codes stand for."""
    n = len(books.parts)
    pick = [F.element_at(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in entry)) for entry in books.parts[p])), F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p in range(n)]
    return codes.withColumn(out, F.concat(*pick))
