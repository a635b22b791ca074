"""Prefix trie over conversations, with totals by depth-band rollup.

A node stands for a distinct sequence of first turns and is known by its depth and
a 128-bit fingerprint of the sequence: the exclusive or of a hash of each turn with
its place.  Prefix fingerprints thus add up over blocks of BLOCK turns, so a
conversation of any length is spread over many tasks, and so are its places, which
come from a range-partitioned sort.  Texts are hashed first; no shuffle moves them.

Subtree totals: depths are cut into bands of BAND levels.  A node explodes only to
its ancestors inside its band, which gives totals within bands in one pass.  The
top nodes of the bands form a tree of their own, BAND times less deep, whose totals
are made in the same way; the completed total of a top is then added to its BAND
ancestors in the band above.  Rounds grow with the logarithm of the depth, rows with
BAND.  Spark sums partly before each shuffle, so an opening that most conversations
share costs one row a task.

The ids of the conversations that end at a node are listed in chunks of CHUNK
consecutive ids and hashed chunk by chunk, so no row and no task holds them all.

Rows without a conversation id are left out.  Turns stand by turn (null first);
rows that repeat a turn stand by role, then by the digest of the turn; repeated rows are
turns of their own.  Null roles and texts are empty.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions

#: An opening has fewer than OPENINGS turns; SHARED consecutive ids share one.
OPENINGS, SHARED = 6, 100
BAND, BLOCK, CHUNK = 8, 1024, 4096
#: Rows up to which a side of three integers a row is broadcast, after a count.
BROADCAST_ROWS = 500_000
KEY = ["depth", "k1", "k2"]


def _sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hashed_turns(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, t1, t2, chars): each turn with 128 bits of its digest."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in ("role", "text"))
    found = rows.select(rows["conv_id"].cast("long").alias("conv"), rows["turn"].cast("long").alias("turn"), role.alias("role"), F.length(text).cast("long").alias("chars"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"))
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    return found.where("conv is not null").select("conv", "turn", "role", half(1).alias("t1"), half(17).alias("t2"), "chars")


def placed(turns: DataFrame) -> DataFrame:
    """turns with pos, from 1 in each conversation.

    A range-partitioned sort, rows counted within each partition, and offsets for
    the conversations that go on from one partition to the next (one a partition)."""
    order = [F.col("turn").asc_nulls_first(), "role", "t1", "t2"]
    part = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv", *order).withColumn("part", F.spark_partition_id())
    local = materialize(part.withColumn("row", F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))).drop("turn", "role"), "trie-local")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = local.groupBy("conv", "part").agg(F.max("row").alias("n")).withColumn("offset", F.sum("n").over(before)).where("offset > 0").drop("n")
    return local.join(F.broadcast(offset), ["conv", "part"], "left").select("conv", (F.col("row") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"), "t1", "t2", "chars")


def opening(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % OPENINGS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): every conversation's id; its turns after the first h are kept
    behind the first h of the conversation that its SHARED ids share."""
    base = F.col("conv") - F.col("conv") % SHARED
    convs = turns.groupBy("conv").agg(F.lit(1).alias("one")).select("conv", opening(F.col("conv")).alias("h"), base.alias("base"))
    heads = turns.where((F.col("conv") % SHARED == 0) & (F.col("pos") < OPENINGS)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("head"))
    first = convs.join(heads, "base").select("conv", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t")).select("conv", "t.pos", "t.t1", "t.t2", "t.chars")
    size = heads.select("base", F.size("head").cast("long").alias("n"))
    own = turns.withColumn("h", opening(F.col("conv"))).where("pos > h").withColumn("base", base).join(_sized(size), "base", "left")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("pos"), "t1", "t2", "chars")
    return convs.select("conv"), first.union(own)


def steps_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars): a conversation's nodes from the root on, with
    the parent's fingerprint and the length of the last turn."""
    turns = turns.select("conv", "pos", F.xxhash64("pos", "t1", "t2").alias("h1"), F.xxhash64("t2", "pos", "t1").alias("h2"), "chars", F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    turns = materialize(turns, "trie-turns")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    blocks = blocks.select("conv", "block", F.bit_xor("b1").over(earlier).alias("b1"), F.bit_xor("b2").over(earlier).alias("b2")).where("block > 0")
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = turns.withColumn("w1", F.bit_xor("h1").over(upto)).withColumn("w2", F.bit_xor("h2").over(upto)).join(_sized(blocks), ["conv", "block"], "left")
    for k in ("1", "2"):
        inside = inside.withColumn(f"k{k}", F.col(f"w{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0).cast("long"))))
    inside = inside.select("conv", F.col("pos").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "chars")
    zero = F.lit(0).cast("long")
    out = materialize(inside.union(convs.select("conv", zero, zero, zero, zero, zero, zero)), "trie-steps")
    discard(turns)
    return out


def nodes_of(steps: DataFrame) -> DataFrame:
    """A row per node: its key, its parent's, smallest member, members and children."""
    nodes = steps.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """(depth, k1, k2, conv, values): the sums over each node's subtree.

    nodes: (depth, k1, k2, conv, values), conv being the smallest member; steps:
    (conv, depth, k1, k2), the path of every such member from depth 0 on."""
    path = steps.select("conv", F.floor(F.col("depth") / band).alias("band"), F.struct(*KEY).alias("key")).groupBy("conv", "band").agg(F.array_sort(F.collect_list("key")).alias("path"))
    sums = [F.sum(v).alias(v) for v in values]
    inside = nodes.withColumn("band", F.floor(F.col("depth") / band)).join(path, ["conv", "band"])
    inside = inside.select("conv", *values, F.explode(F.slice("path", F.lit(1), (F.col("depth") % band + 1).cast("int"))).alias("key"))
    # a node's own row is among its pairs, and its smallest member is that of the subtree
    within = inside.groupBy("key").agg(F.min("conv").alias("conv"), *sums).select("key.*", "conv", *values)
    if deepest < band:
        return within
    within = materialize(within, "trie-bands")
    tops = [df.where(F.col("depth") % band == 0).withColumn("depth", F.floor(F.col("depth") / band)) for df in (within, steps)]
    whole = materialize(subtree_sums(*tops, values, deepest // band, band), "trie-tops").where("depth > 0")
    above = whole.withColumn("band", F.col("depth") - 1).select("conv", "band", *values).join(path, ["conv", "band"]).select("conv", *values, F.explode("path").alias("key"))
    both = within.select(*KEY, "conv", *values).union(above.select("key.*", "conv", *values))
    return both.groupBy(*KEY).agg(F.min("conv").alias("conv"), *sums)


def end_digests(steps: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end."""
    last = steps.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("key")).select("key.*", "conv", F.floor(F.col("conv") / CHUNK).alias("chunk"))
    listed = last.groupBy(*KEY, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = pa.schema([*((k, pa.int64()) for k in KEY), ("ends_sha256", pa.string())])

    def run(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == at:
                    sha.update(b",")
                else:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, sha.hexdigest()), schema, strict=True)], schema=schema)

    sorted_ = listed.repartition(shuffle_partitions(steps.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    return sorted_.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def conversation_trie(rows: DataFrame) -> DataFrame:
    """A row per node of the trie over the rebuilt conversations of (conv_id, turn, role, text)."""
    convs, turns = rebuilt(placed(hashed_turns(rows)))
    steps = steps_of(turns, convs)
    nodes = materialize(nodes_of(steps), "trie-counted")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    worth = nodes.select(*KEY, "conv", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_sums(worth, steps.select("conv", *KEY), ["n_leaves", "saved_tokens"], deepest).drop("conv")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    named = nodes.join(parent, ["depth", "p1", "p2"], "left")
    out = named.join(totals, KEY).join(end_digests(steps), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
