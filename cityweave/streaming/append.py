"""Restartable appends: dialogue files are converted as they arrive.

The batch form of resuming is sources.tables.pending; this is the same job for a
folder that grows.  Spark's checkpoint remembers which files were read, so a
restart goes on where the last run ended."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.dialogues import to_sharegpt
from ..sources.tables import DIALOGUE


def convert_dialogues(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Dialogue JSON lines below `source` to sharegpt JSON lines below `target`."""
    rows = spark.readStream.schema(DIALOGUE).json(source).withColumnRenamed("diag", "messages")
    writer = to_sharegpt(rows).writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
