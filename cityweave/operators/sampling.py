"""Deterministic sampling, mixing and option drawing: order by md5 of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyed, keyed_number, letter


def stratified_cap(df: DataFrame, key: str, n: int, row_key: str, exclude: tuple[str, ...] = (), seed: int = 0, salts: int = 64) -> DataFrame:
    """At most n rows per value of key, drawn by hash; null is a value.

    Ranks run in two steps, first within salted parts of a key, so that a key with most
    of all rows meets in no task: the second step sees at most salts * n of its rows."""
    rows = df.where(~F.coalesce(F.col(key).isin(*exclude), F.lit(False))) if exclude else df
    marked = rows.withColumn("_draw", keyed(F.col(row_key), seed=seed)).withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)))
    for by in ((key, "_salt"), (key,)):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_draw", row_key))
        marked = marked.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return marked.select(*df.columns)


def sample_n(df: DataFrame, n: int, row_key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(keyed(F.col(row_key), seed=seed), row_key).limit(n)


def head_n(df: DataFrame, by: str, order: str, n: int, tail: bool = False) -> DataFrame:
    """The first (or last) n rows of each source."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order) if tail else F.asc(order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def shuffle_rows(df: DataFrame, row_key: str, seed: int = 0) -> DataFrame:
    """A global order by hash: a range-partitioned sort."""
    return df.withColumn("draw", keyed(F.col(row_key), seed=seed)).orderBy("draw", row_key)


def mixed(sources: dict[str, DataFrame], quotas: dict[str, int], row_key: str, seed: int = 0) -> DataFrame:
    """Head-N of each source (all for a quota of 0 or less), united by name, shuffled."""
    parts = []
    for name, df in sources.items():
        n = quotas.get(name, 0)
        part = df.orderBy(row_key).limit(n) if n > 0 else df
        parts.append(part.withColumn("data_source", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return shuffle_rows(out.withColumn("mix_key", F.concat_ws("/", "data_source", F.col(row_key).cast("string"))), "mix_key", seed)


def repeated(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


def interleaved(df: DataFrame, source: str, position: str, probs: dict[str, float], mode: str = "under") -> DataFrame:
    """Mix by probability: row number p of a source stands at virtual time p / prob.

    under: cut where the first source runs out; over: sources that run out start
    again until the last one has been read once.  position counts from 1."""
    share = F.element_at(F.create_map(*[F.lit(x) for kv in probs.items() for x in kv]), F.col(source))
    timed = df.where(F.col(source).isin(*probs)).withColumn("prob", share)
    ends = timed.groupBy(source).agg(F.max(position).alias("n"), F.max("prob").alias("prob")).withColumn("end", F.col("n") / F.col("prob"))
    if mode == "under":
        bound = ends.agg(F.min("end").alias("bound"))
        return timed.withColumn("time", F.col(position) / F.col("prob")).join(F.broadcast(bound), F.lit(True)).where("time <= bound").drop("bound", "prob")
    bound = ends.agg(F.max("end").alias("bound"))
    rounds = ends.join(F.broadcast(bound), F.lit(True)).select(source, "n", F.ceil(F.col("bound") / F.col("end")).cast("int").alias("rounds"), "bound")
    again = timed.join(F.broadcast(rounds), source).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    return again.withColumn("time", (F.col("round") * F.col("n") + F.col(position)) / F.col("prob")).where("time <= bound").drop("bound", "prob", "n", "rounds")


def negatives(keys: DataFrame, key: str, universe: DataFrame, item: str, positives: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(key, item, rank): k items per key that are no positive of it; all there are, if fewer.

    No cross join: items are numbered in hash order (ranks in hash shards plus the
    shards' offsets), and a key takes the k + p items that follow a place of its own
    hash, round the end; p is the number of its positives, so k are left when those are
    anti-joined away."""
    digest = universe.select(item).where(F.col(item).isNotNull()).distinct().withColumn("_h", keyed(F.col(item), seed=seed)).withColumn("_shard", F.substring("_h", 1, 3))
    within = F.row_number().over(Window.partitionBy("_shard").orderBy("_h", item)) - 1
    sizes = digest.groupBy("_shard").count()  # at most 4096 rows
    offset = F.coalesce(F.sum("count").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = digest.withColumn("_in", within).join(F.broadcast(sizes.withColumn("_from", offset)), "_shard").select((F.col("_from") + F.col("_in")).alias("_no"), item)
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("_total"))
    own = positives.select(key, item).distinct()
    asked = keys.select(key).distinct().join(own.groupBy(key).agg(F.count(F.lit(1)).alias("_p")), key, "left").join(F.broadcast(total), F.lit(True)).where("_total > 0")
    start = F.pmod(F.conv(F.substring(keyed(F.col(key), "start", seed=seed), 1, 8), 16, 10).cast("long"), F.col("_total"))
    some = F.least(F.col("_total"), F.lit(k) + F.coalesce("_p", F.lit(0))).cast("long")
    drawn = asked.select(key, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), some - 1), lambda i: F.pmod(start + i, F.col("_total")))).alias("_no"))
    free = drawn.join(placed, "_no").select(key, item).join(own, [key, item], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(keyed(F.col(key), F.col(item), seed=seed), item))
    return free.withColumn("rank", rank).where(F.col("rank") <= k)


def outside_group(keys: DataFrame, key: str, group: str, universe: DataFrame, item: str, item_group: str, k: int, seed: int = 0) -> DataFrame:
    """(key, item, rank): k items of other groups than the key's own; all there are, if fewer.

    Items are numbered by group and hash (ranks in hash shards plus the shards' offsets),
    so a group is one interval.  A key takes k numbers at even strides from a place of
    its own hash on the ring without that interval, so nothing is tried in vain,
    however large the group."""
    shard = F.substring("_h", 1, 2)
    digest = universe.select(F.col(item_group).alias("_g"), F.col(item).alias(item)).where("_g is not null").where(F.col(item).isNotNull()).distinct().withColumn("_h", keyed(F.col(item), seed=seed)).withColumn("_shard", shard)
    within = F.row_number().over(Window.partitionBy("_g", "_shard").orderBy("_h", item)) - 1
    sizes = digest.groupBy("_g", "_shard").count()  # at most 256 rows a group
    before = Window.orderBy("_g", "_shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("count").over(before), F.lit(0)))
    placed = digest.withColumn("_in", within).join(sizes.drop("count"), ["_g", "_shard"]).select((F.col("_from") + F.col("_in")).alias("_no"), item)
    spans = sizes.groupBy("_g").agg(F.min("_from").alias("_lo"), F.sum("count").alias("_n"))
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("_total"))
    asked = keys.select(key, F.col(group).alias("_g")).distinct().join(spans, "_g", "left").join(F.broadcast(total), F.lit(True)).withColumn("_out", F.col("_total") - F.coalesce("_n", F.lit(0))).where("_out > 0")
    start = F.pmod(F.conv(F.substring(keyed(F.col(key), "start", seed=seed), 1, 8), 16, 10).cast("long"), F.col("_out"))
    stride = F.greatest(F.floor(F.col("_out") / k), F.lit(1))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("_out"), F.lit(k)) - 1), lambda i: F.pmod(start + i * stride, F.col("_out")))
    number = F.transform(place, lambda p: F.when(p < F.coalesce("_lo", "_total"), p).otherwise(p + F.coalesce("_n", F.lit(0))))
    drawn = asked.select(key, F.posexplode(number).alias("rank", "_no"))
    return drawn.join(placed, "_no").select(key, item, (F.col("rank") + 1).alias("rank"))


def make_mcq(df: DataFrame, key: str, question: Column, answer: Column, distractors: Column, seed: int = 0) -> DataFrame:
    """(key, question, options, answer): options in hash order of their place, so
    that equal texts stay apart, and the letter of the true one.  Options and letter
    are taken by place, never by value."""
    options = F.concat(F.array(answer), distractors)
    placed = F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws("#", F.col(key).cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), i.alias("i"), o.alias("o")))
    ordered = df.withColumn("_opts", F.array_sort(placed)).withColumn("_q", question)
    place = F.array_position(F.transform("_opts", lambda o: o["i"]), F.lit(0)) - 1
    return ordered.select(key, F.col("_q").alias("question"), F.transform("_opts", lambda o: o["o"]).alias("options"), letter(place).alias("answer"))


def representatives(pois: DataFrame, seed: int = 0) -> DataFrame:
    """count / 4 + 1 points of each (aoi_id, category)."""
    w = Window.partitionBy("aoi_id", "category")
    rank = F.row_number().over(w.orderBy(keyed(F.col("poi_id"), seed=seed), "poi_id"))
    counted = pois.withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(w))
    return counted.where(F.col("_rank") <= F.floor(F.col("_n") / 4) + 1).drop("_rank", "_n")


def style_segments(df: DataFrame, n: int, row_key: str, first: int = 1000, seed: int = 0) -> DataFrame:
    """The first 1000 rows in hash order in n equal segments (style 1..n)."""
    order = Window.orderBy(keyed(F.col(row_key), seed=seed), row_key)
    return sample_n(df, first, row_key, seed).withColumn("style", F.ntile(n).over(order))


def aoi_groups(aois: DataFrame, per_size: int, sizes: int = 5, seed: int = 0) -> DataFrame:
    """(group_id, size, aoi_ids): distinct random groups of 1..sizes areas.

    Each group is a run of neighbours in one hash order per size; runs are cut from
    hashed shards so that no task sees all areas."""
    spread = aois.select("aoi_id").withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(sizes))))
    shard = keyed_number(64, F.col("aoi_id"), F.col("size"), seed=seed)
    order = Window.partitionBy("size", "shard").orderBy(keyed(F.col("aoi_id"), F.col("size"), "order", seed=seed), "aoi_id")
    numbered = spread.withColumn("shard", shard).withColumn("no", F.floor((F.row_number().over(order) - 1) / F.col("size")))
    groups = numbered.groupBy("size", "shard", "no").agg(F.array_sort(F.collect_list("aoi_id")).alias("aoi_ids")).where(F.size("aoi_ids") == F.col("size"))
    rank = F.row_number().over(Window.partitionBy("size").orderBy(keyed(F.col("size"), F.array_join("aoi_ids", "_"), seed=seed)))
    return groups.withColumn("rank", rank).where(F.col("rank") <= per_size).select(F.concat_ws("-", "size", "rank").alias("group_id"), F.col("size").cast("long").alias("size"), "aoi_ids")
