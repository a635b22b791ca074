"""The registered queries of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file: $TOKENIZER_DIR/name, else from the public_tokenizers module."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans

    spans = secret_spans(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), query_step=20, k=20)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .mixing import drawn, mixing_plan, token_rows

    rows = materialize(token_rows(table(spark, sf_dir, "documents")), "token-rows")
    plan = materialize(mixing_plan(rows, target_entropy=0.999, max_repeat=4.0), "mixing-cuts")
    return drawn(rows, plan).select(F.col("id").alias("doc_id"), "source", "pass", "block", "place", "tokens", F.round("alpha", 4).alias("alpha"), F.round("weight", 4).alias("weight"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score, train

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = train(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_conversations(rows.unionByName(extra)))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary_path()))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = train(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def queries() -> dict:
    found = {f.__name__: f for f in globals().values() if callable(f) and getattr(f, "__name__", "").startswith("op")}
    return dict(found)


OP3_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id AS id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents
), total AS (
  SELECT source, count(*) AS n_rows, sum(tokens)::BIGINT AS tokens FROM doc GROUP BY source
), share AS (
  SELECT source, ln(tokens / (SELECT sum(tokens) FROM total)::DOUBLE) AS lp FROM total WHERE tokens > 0
), spread AS (
  SELECT max(lp) - min(lp) AS width, count(*) AS n, max(lp) AS top FROM share
), search AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1,
    CASE WHEN ent >= 0.999 * ln(n) THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN ent >= 0.999 * ln(n) THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN (1 - (lo2 + hi2) / 2) * width > ln(4.0) THEN (lo2 + hi2) / 2 ELSE lo2 END,
    CASE WHEN (1 - (lo2 + hi2) / 2) * width > ln(4.0) THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM (SELECT s.*, w.width, w.n, (SELECT ln(sum(exp((s.lo + s.hi) / 2 * lp))) - sum((s.lo + s.hi) / 2 * lp * exp((s.lo + s.hi) / 2 * lp)) / sum(exp((s.lo + s.hi) / 2 * lp)) FROM share) AS ent
        FROM search s, spread w WHERE s.i < 40)
), best AS (
  SELECT round(greatest((lo + hi) / 2, (lo2 + hi2) / 2), 6) AS alpha FROM search WHERE i = 40
), plan AS (
  SELECT t.source, t.tokens, b.alpha,
    CASE WHEN t.tokens > 0 THEN round(exp(b.alpha * lp) / (SELECT sum(exp(b.alpha * lp)) FROM share), 6) ELSE 0 END AS weight,
    CASE WHEN t.tokens > 0 THEN round(exp((1 - b.alpha) * (w.top - lp)), 4) ELSE 1 END AS repeats,
    greatest(1, least(greatest(4096, ceil(sqrt(t.n_rows))), ceil(t.n_rows / 256.0)))::BIGINT AS blocks
  FROM total t LEFT JOIN share USING (source), best b, spread w
), cut AS (
  SELECT *, floor(repeats)::BIGINT AS passes, floor(tokens * round((repeats - floor(repeats)) * 10000)::BIGINT / 10000.0)::BIGINT AS rest FROM plan
), placed AS (
  SELECT d.id, d.tokens, c.* EXCLUDE (tokens), ('0x' || substr(md5('17#' || d.id), 1, 8))::BIGINT % c.blocks AS block FROM doc d JOIN cut c USING (source)
), hashed AS (
  SELECT *, md5(concat_ws('#', '17', passes + 1, source, block)) AS bh, md5(concat_ws('#', '17', passes + 1, id)) AS dh FROM placed
), running AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bh, dh RANGE UNBOUNDED PRECEDING) AS through FROM hashed
), taken AS (
  SELECT *, passes + CASE WHEN rest > 0 AND through - tokens < rest THEN 1 ELSE 0 END AS last FROM running
)
SELECT doc_id, source, pass, block, concat(substr(md5(concat_ws('#', '17', pass, source, block)), 1, 16), substr(md5(concat_ws('#', '17', pass, doc_id)), 1, 16)) AS place, tokens, alpha, weight
FROM (SELECT id AS doc_id, source, unnest(range(1, last + 1)) AS pass, block, tokens, round(alpha, 4) AS alpha, round(weight, 4) AS weight FROM taken)
"""


def codes_sql(rounds: int = 6) -> str:
    """The rounds one after the other, over one row per component."""
    far = """far{i} AS MATERIALIZED (
  SELECT k.vec_id, k.part, c.entry, sum((k.v - c.v) * (k.v - c.v))::BIGINT AS d FROM piece k JOIN book{i} c USING (part, pos) GROUP BY ALL
), code{i} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM far{i} GROUP BY ALL
)"""
    better = """mean{j} AS (
  SELECT part, entry, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM (SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM code{i} JOIN piece USING (vec_id, part) GROUP BY ALL)
), book{j} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{j} m USING (part, entry, pos)
)"""
    steps = [part.format(i=i, j=i + 1) for i in range(rounds) for part in (far, better)] + [far.format(i=rounds)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), placed AS (
  SELECT vec_id, q, len(q) // 8 AS step, unnest(range(len(q))) AS i FROM kept
), piece AS MATERIALIZED (
  SELECT vec_id, (i // step)::INT AS part, (i % step)::INT AS pos, q[i + 1] AS v FROM placed
), book0 AS MATERIALIZED (
  SELECT part, f.entry, pos, v FROM piece JOIN (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS entry FROM kept ORDER BY vec_id LIMIT 16) f USING (vec_id)
), {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM code{rounds} GROUP BY ALL
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


OP11_SQL = r"""
WITH turn_rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), orig AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM turn_rows
), conv AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(1, 9)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turn_rows)
), size AS (
  SELECT conv_id AS base, count(*) AS n FROM orig GROUP BY ALL
), rebuilt AS (
  SELECT c, pos, role, text FROM conv JOIN orig ON conv_id = base AND pos <= h
  UNION ALL
  SELECT c, pos - h + least(h, coalesce(n, 0)), role, text FROM conv JOIN orig ON conv_id = c AND pos > h LEFT JOIN size USING (base)
), seq AS (
  SELECT c, list(md5(len(role) || ':' || role || text) ORDER BY pos) AS said, list(len(text) ORDER BY pos) AS chars FROM rebuilt GROUP BY ALL
), step AS (
  SELECT c, d, md5(array_to_string(said[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(said[1:d - 1], ',')) END AS p, coalesce(chars[d], 0) AS chars, d = len(said) AS last
  FROM (SELECT c, coalesce(said, []) AS said, chars, unnest(range(0, coalesce(len(said), 0) + 1)) AS d FROM conv LEFT JOIN seq USING (c))
), node AS (
  SELECT d, k, any_value(p) AS p, min(c) AS conv, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM step GROUP BY ALL
), child AS (
  SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), worth AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, k)
), subtree AS (
  SELECT s.d, s.k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n - 1) * w.chars)::BIGINT AS saved_tokens FROM worth w JOIN step s ON s.c = w.conv AND s.d <= w.d GROUP BY ALL
)
SELECT w.conv AS conv_id, w.d::BIGINT AS depth, u.conv AS parent_conv_id, w.n AS n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM worth w JOIN subtree USING (d, k) LEFT JOIN node u ON u.d = w.d - 1 AND u.k = w.p
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_trie": OP11_SQL, "op3_temperature_mixing": OP3_SQL, "op13_vector_codes": codes_sql()}
