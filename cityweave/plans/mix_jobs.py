"""Queries over instruction data: sampling, mixing, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import keyed
from ..operators import dialogues, sampling, sequences
from .base import Tables, md5_sql, number_sql, query


@query("w13_stratified_cap", f"SELECT doc_id, data_source FROM (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY {md5_sql('doc_id', seed=1)}, doc_id) AS k FROM sft WHERE data_source IS DISTINCT FROM 'src19') WHERE k <= 20")
def capped(t: Tables):
    return sampling.stratified_cap(t.sft, "data_source", 20, "doc_id", ("src19",), seed=1).select("doc_id", "data_source")


@query("w14_samples", f"SELECT 'sample' AS kind, doc_id FROM (SELECT doc_id FROM sft ORDER BY {md5_sql('doc_id', seed=3)}, doc_id LIMIT 50) UNION ALL SELECT 'head', doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY data_source ORDER BY doc_id) AS k FROM sft) WHERE k <= 3 UNION ALL SELECT 'tail', doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY data_source ORDER BY doc_id DESC) AS k FROM sft) WHERE k <= 3")
def samples(t: Tables):
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "doc_id")
    return kind(sampling.sample_n(t.sft, 50, "doc_id", 3), "sample").union(kind(sampling.head_n(t.sft, "data_source", "doc_id", 3), "head")).union(kind(sampling.head_n(t.sft, "data_source", "doc_id", 3, tail=True), "tail"))


@query("w16_shuffle_rows", f"SELECT doc_id, {md5_sql('doc_id', seed=9)} AS draw FROM sft")
def shuffled(t: Tables):
    return sampling.shuffle_rows(t.sft, "doc_id", 9).select("doc_id", "draw")


@query("w19_style_segments", f"SELECT doc_id, ntile(8) OVER (ORDER BY {md5_sql('doc_id', seed=4)}, doc_id)::BIGINT AS style FROM (SELECT doc_id FROM sft ORDER BY {md5_sql('doc_id', seed=4)}, doc_id LIMIT 1000)")
def styles(t: Tables):
    return sampling.style_segments(t.sft, 8, "doc_id", seed=4).select("doc_id", F.col("style").cast("long"))


def groups_sql(areas: str, per_size: int, seed: int) -> str:
    """The SQL twin of sampling.aoi_groups(): grp (group_id, size, ids)."""
    return f"""gs AS (SELECT aoi_id, size, {number_sql(64, 'aoi_id', 'size', seed=seed)} AS shard FROM ({areas}), (SELECT unnest(range(1, 6)) AS size)),
 gn AS (SELECT *, (row_number() OVER (PARTITION BY size, shard ORDER BY {md5_sql('aoi_id', 'size', "'order'", seed=seed)}, aoi_id) - 1) // size AS no FROM gs),
 gl AS (SELECT size, list_sort(list(aoi_id)) AS ids FROM gn GROUP BY size, shard, no HAVING count(*) = size),
 grp AS (SELECT concat(size, '-', rank) AS group_id, size, ids FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY {md5_sql('size', "array_to_string(ids, '_')", seed=seed)}) AS rank FROM gl) WHERE rank <= {per_size})"""


@query("w18_aoi_groups", f"WITH {groups_sql('SELECT aoi_id FROM aoi', 10, 8)} SELECT group_id, size, array_to_string(ids, ',') AS aoi_ids FROM grp")
def groups(t: Tables):
    g = sampling.aoi_groups(t.aoi, 10, seed=8)
    return g.select("group_id", "size", F.array_join(F.transform("aoi_ids", lambda x: x.cast("string")), ",").alias("aoi_ids"))


@query(
    "u1_mix",
    f"""WITH m AS (SELECT doc_id, 'en' AS data_source FROM (SELECT doc_id FROM sft WHERE lang = 'en' ORDER BY doc_id LIMIT 100) UNION ALL SELECT doc_id, 'de' FROM (SELECT doc_id FROM sft WHERE lang = 'de' ORDER BY doc_id LIMIT 50) UNION ALL SELECT doc_id, 'fr' FROM sft WHERE lang = 'fr')
SELECT doc_id, data_source, {md5_sql("concat(data_source, '/', doc_id)", seed=2)} AS draw FROM m""",
)
def mix(t: Tables):
    s = {k: t.sft.where(F.col("lang") == k).drop("data_source") for k in ("en", "de", "fr")}
    return sampling.mixed(s, {"en": 100, "de": 50, "fr": 0}, "doc_id", 2).select("doc_id", "data_source", "draw")


@query("u2_repeat", "SELECT doc_id, unnest(range(1, 4)) AS copy FROM sft WHERE lang = 'es'")
def repeat(t: Tables):
    return sampling.repeated(t.sft.where("lang = 'es'"), 3).select("doc_id", F.col("copy").cast("long"))


@query("u3_head_tail_split", "SELECT doc_id, CASE WHEN k <= n - 5 THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY data_source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY data_source) AS n FROM sft)")
def split(t: Tables):
    test = sampling.head_n(t.sft, "data_source", "doc_id", 5, tail=True).select("doc_id")
    train = t.sft.join(test, "doc_id", "left_anti").select("doc_id", F.lit("train").alias("part"))
    return train.union(test.select("doc_id", F.lit("test").alias("part")))


_POS = "pos AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p, CASE lang WHEN 'en' THEN 0.5 ELSE 0.25 END AS prob FROM sft WHERE lang IN ('en', 'de', 'fr'))"


@query("u4_interleave_under", f"WITH {_POS}, b AS (SELECT min(e) AS bound FROM (SELECT max(p / prob) AS e FROM pos GROUP BY lang)) SELECT doc_id, round(p / prob, 6)::DOUBLE AS time FROM pos, b WHERE p / prob <= bound /* sft */")
def under(t: Tables):
    return _interleaved(t, "under").select("doc_id", F.round("time", 6).alias("time"))


@query("u4_interleave_over", f"WITH {_POS}, e AS (SELECT lang, max(p) AS n, max(p / prob) AS e FROM pos GROUP BY lang), x AS (SELECT doc_id, unnest(range(0, ceil((SELECT max(e) FROM e) / e.e)::BIGINT)) AS r, p, n, prob FROM pos JOIN e USING (lang)) SELECT doc_id, round((r*n + p) / prob, 6)::DOUBLE AS time FROM x WHERE (r*n + p) / prob <= (SELECT max(e) FROM e) /* sft */")
def over(t: Tables):
    return _interleaved(t, "over").select("doc_id", F.round("time", 6).alias("time"))


def _interleaved(t: Tables, mode: str):
    pos = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return sampling.interleaved(t.sft.withColumn("p", pos), "lang", "p", {"en": 0.5, "de": 0.25, "fr": 0.25}, mode)


@query("a10_task_counts", "SELECT data_source, lang, count(*) AS n FROM sft GROUP BY data_source, lang")
def task_counts(t: Tables):
    return t.sft.groupBy("data_source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("a11_score_histogram", "SELECT s.data_source, quality::BIGINT AS score, count(*) AS n FROM sft s JOIN labels USING (doc_id) GROUP BY 1, 2")
def histogram(t: Tables):
    return t.sft.join(t.raw("labels"), "doc_id").groupBy("data_source", F.col("quality").cast("long").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("f8_filter_by_score", "SELECT s.doc_id, s.data_source FROM sft s JOIN labels USING (doc_id) WHERE quality >= 1")
def scored(t: Tables):
    rows = t.sft.join(t.raw("labels").withColumnRenamed("quality", "score"), "doc_id")
    return dialogues.filter_by_score(rows, 1).select("doc_id", "data_source")


@query("a12_length_cdf", "WITH b AS (SELECT (length(text) // 1000)*1000 AS bucket, count(*) AS n FROM sft GROUP BY 1) SELECT bucket, n, (sum(n) OVER (ORDER BY bucket))::BIGINT AS upto, round(100.0::DOUBLE * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS percent FROM b")
def cdf(t: Tables):
    return sequences.length_cdf(t.sft.withColumn("n_chars", F.length("text")), "n_chars", 1000).withColumn("percent", F.round("percent", 6))


_COUNT = f"[{dialogues.CJK}]|[^\\s{dialogues.CJK}]+"


@query("a13_token_stats", f"WITH w AS (SELECT data_source, len(regexp_extract_all(concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(' 城市road道路', doc_id, 'かな 도로') ELSE '' END), '{_COUNT}')) AS n FROM sft) SELECT coalesce(data_source, 'all') AS data_source, sum(n)::BIGINT AS total, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.75), 4) AS p75, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95 FROM w GROUP BY ROLLUP (data_source)")
def token_stats(t: Tables):
    """Counts of texts of which a third goes on in other scripts."""
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" 城市road道路"), F.col("doc_id").cast("string"), F.lit("かな 도로"))).otherwise("")
    return dialogues.token_stats(t.sft.withColumn("text", F.concat(F.coalesce("text", F.lit("")), more)), "text", "data_source")


@query("a14_valid_token_ratio", "WITH w AS (SELECT role, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM dialogue) SELECT sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS trained, sum(n)::BIGINT AS total, round(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::DOUBLE / sum(n), 8) AS ratio FROM w")
def valid_ratio(t: Tables):
    n = dialogues.word_count(F.col("text"))
    r = t.dialogue.agg(F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("trained"), F.sum(n).alias("total"))
    return r.withColumn("ratio", F.round(F.col("trained") / F.col("total"), 8))


@query("a15_perplexity", "SELECT user_id, round(exp(sum(CASE WHEN event_type <> 'view' THEN value ELSE 0 END)/100 / nullif(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END), 0)), 5) AS ppl FROM events GROUP BY user_id")
def perplexity(t: Tables):
    losses = t.raw("events").select(F.col("user_id").alias("sample_pos"), (F.col("value") / 100).alias("nll"), (F.col("event_type") != "view").alias("masked"))
    return dialogues.perplexity(losses).select(F.col("sample_pos").alias("user_id"), F.round("ppl", 5).alias("ppl"))


@query("j17_attach_by_position", "SELECT s.doc_id, coalesce(l.quality, -1)::BIGINT AS weight FROM sft s LEFT JOIN labels l ON l.doc_id = s.doc_id")
def positions(t: Tables):
    return t.sft.select("doc_id").join(t.raw("labels").select("doc_id", F.col("quality").cast("long").alias("weight")), "doc_id", "left").fillna(-1, ["weight"])


@query("s4_latest_snapshot", "WITH n AS (SELECT concat('map_city', o_custkey % 50, CASE WHEN o_orderkey % 3 = 0 THEN '_fsq' ELSE '' END, '_', strftime(o_orderdate, '%y%m%d')) AS name FROM orders), p AS (SELECT name, regexp_extract(name, '^map_(city\\d+)_(\\d{6})$', 1) AS city, regexp_extract(name, '_(\\d{6})$', 1) AS day FROM n WHERE name NOT LIKE '%fsq%') SELECT city, max(name) AS name FROM p GROUP BY city")
def latest(t: Tables):
    from ..sources.tables import latest_snapshot

    name = F.concat(F.lit("map_city"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "_fsq").otherwise(""), F.lit("_"), F.date_format("o_orderdate", "yyMMdd"))
    return latest_snapshot(t.raw("orders").select(name.alias("name")), fsq=False)


@query("s12_pending", "SELECT doc_id FROM sft WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(t: Tables):
    from ..sources.tables import pending as todo

    return todo(t.sft, t.raw("labels"), "doc_id").select("doc_id")


@query("s3_split_map", "SELECT class, count(*) AS n, min(id) AS first FROM (SELECT 'poi' AS class, poi_id AS id FROM poi UNION ALL SELECT 'aoi', aoi_id FROM aoi UNION ALL SELECT 'road', road_id FROM road) GROUP BY class")
def split_map(t: Tables):
    from ..sources.tables import split_map as split_

    one = lambda df, c, k: df.select(F.lit(c).alias("class"), F.struct(F.col(k).alias("id"), F.col("name").alias("name")).alias("data"))
    tagged = one(t.poi, "poi", "poi_id").union(one(t.aoi, "aoi", "aoi_id")).union(one(t.road, "road", "road_id"))
    parts = split_(tagged)
    out = [parts[c].agg(F.lit(c).alias("class"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first")) for c in ("poi", "aoi", "road")]
    return out[0].union(out[1]).union(out[2])


@query("s8_normalize_registered", "SELECT conv_id, string_agg(concat(CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END, ':', length(text)), '|' ORDER BY turn) AS shape FROM dialogue GROUP BY conv_id")
def normalized(t: Tables):
    from ..sources.tables import normalize_registered

    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(F.when(s["role"] == "user", "human").when(s["role"] == "assistant", "gpt").otherwise("system").alias("from"), s["text"].alias("value")))
    raw = t.dialogue.groupBy("conv_id").agg(turns.alias("conversations"))
    entry = {"formatting": "sharegpt", "columns": {"messages": "conversations"}, "tags": {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "system_tag": "system"}}
    got = normalize_registered(raw, entry, keep=("conv_id",))
    return got.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), "|").alias("shape"))


@query("a5_w16_mix_order", f"SELECT lang, first(doc_id ORDER BY {md5_sql('doc_id', seed=7)}, doc_id) AS first_doc FROM sft GROUP BY lang")
def first_by_draw(t: Tables):
    return t.sft.groupBy("lang").agg(F.min(F.struct(keyed(F.col("doc_id"), seed=7).alias("h"), "doc_id")).alias("m")).select("lang", F.col("m.doc_id").alias("first_doc"))
