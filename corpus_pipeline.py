"""A corpus pipeline: filter, de-duplicate, redact, mix and encode documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies
them to the documents table, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.bpe import round_trip_digests
from cityweave.llm.common import materialize, table
from cityweave.llm.mixing import mix
from cityweave.llm.ngram_join import similar_components
from cityweave.llm.quality import score, train
from cityweave.llm.queries import vocabulary_path
from cityweave.llm.secrets import redact

#: Documents score under this are rejected.
LEAST_QUALITY = 0.3


def sized(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast if they are at most a million rows."""
    return F.broadcast(keys) if keys.limit(1_000_001).count() <= 1_000_000 else keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labels, accepts.

    Null and empty texts score by the bias alone; rows that repeat an id are judged each
    by its text.  Without labels of both classes all scores are the share of label 1."""
    model = train(docs, table(spark, sf_dir, "labels"))
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, out=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group that five-word shingles of a
    Jaccard similarity of 0.8 or more link.

    It is rows that are kept or go, known by a hash of id and text: of several texts that
    share an id each is judged by itself, and of rows equal in both one stays.  Null and
    empty texts link with nothing, and rows without an id take no part, so all of them
    stay.  An empty table stays empty; other columns pass through."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = similar_components(keyed.select(F.col(name).alias("doc_id"), "text"), words=5, percent=80).where("n_shingles > 0 and doc_id is not null")
    rows = keyed.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("key")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    known = materialize(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct().join(rows, "key"), "near-duplicates")
    best = known.groupBy("component").agg(F.min(F.struct("id", "key")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", F.col("m.key").alias("best"))
    gone = materialize(known.join(sized(best), "component").where("key <> best").select(F.col("key").alias(name)), "near-duplicates-gone")
    again = materialize(known.where("copies > 1").select(F.col("key").alias(name)), "near-duplicates-again")
    kept = keyed.join(sized(gone), name, "left_anti")
    single = kept.join(sized(again), name, "left_anti")
    if not again.isEmpty():
        single = single.unionByName(kept.join(sized(again), name, "left_semi").dropDuplicates([name]))
    return single.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span, in any decoded layer, is replaced by a mark; n_chars follows the
    text.  Null texts stay null; no row goes."""
    clean = redact(docs, "text")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to tempered weights, none over twice, none below once, in the
    order of the block permutations.  A null source is one of its own; no row goes."""
    return mix(docs, target_entropy=0.99, max_repeat=2.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row for each document;
    null counts as empty."""
    return round_trip_digests(docs, vocabulary_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: Neither the classifier nor the codec can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
