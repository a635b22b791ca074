"""Embedding columns as numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows all have one length, as float64 rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, fp): rows with an id and a vector of finite numbers, not all zero.
    fp is a digest of the values."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("fp", pa.binary())])

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            keep, prints = [], []
            for i, v in enumerate(lists.to_pylist()):
                x = np.array([np.nan if y is None else y for y in v]) + 0.0
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    prints.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), lists.take(at), pa.array(prints, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "id bigint, vector array<double>, fp binary")


def classes(rows: DataFrame, members: int) -> DataFrame:
    """(fp, rep, vector, ids): one row per distinct vector, with its `members` smallest
    ids.  Spark limits the ranks before the shuffle, so a very common vector does
    not meet in one task."""
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("id"))
    first = rows.select("fp", "id").withColumn("rank", rank).where(F.col("rank") <= members)
    ids = first.groupBy("fp").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
    return ids.join(rows.withColumnRenamed("id", "rep"), ["fp", "rep"]).dropDuplicates(["fp"]).select("fp", "rep", "vector", "ids")
