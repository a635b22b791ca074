"""Temperature mixing of sources, realised as budgeted block permutations.

A source of token share p gets the weight p**alpha, normalised.  alpha is found
by bisection: the largest one in [0, 1] whose weights reach the target entropy
(a share of the highest possible), but not below the smallest one that keeps
every source within max_repeat repetitions; the repetition limit wins.  The
token budget is the least one that takes every source at least once, so no
document is lost: source i is read p_i**(alpha-1) / min_j p_j**(alpha-1) times.

Repetitions are whole passes and one partial pass.  Each pass orders the
source's blocks by a hash of (seed, pass, source, block) and the rows of a block
by a hash of (seed, pass, id); the partial pass stops with the row that reaches
the budget.  Block and row where it stops are kept per source as hash values, so
each row decides by itself and only one row per source is joined to the texts.  The
hashes of block and row are also the place of each taken row in the mixed order.

A null source counts as the source ''.  Texts that are null, empty or blank have
no tokens; a source of only such texts is taken once.  Rows that repeat an id
share its hash and are taken or left together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a block, and blocks of a source (or the root of its rows, if that is more),
#: so that both windows grow with the root.
BLOCK_ROWS, MAX_BLOCKS = 256, 4096
#: Sources up to which their table is broadcast (under 200 bytes each).
BROADCAST_SOURCES = 50_000
SALTS = 32
HALVINGS = 40


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, tokens) of each row."""
    tokens = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), tokens.alias("tokens"))


def source_weights(rows: DataFrame, target_entropy: float | None, max_repeat: float) -> DataFrame:
    """(source, n_rows, tokens, alpha, weight, repeats); repeats to four places."""
    total = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tokens").alias("tokens"))
    some = total.where("tokens > 0")
    shares = some.agg(F.collect_list(F.col("tokens").cast("double")).alias("t")).select(F.transform("t", lambda x: F.log(x / F.aggregate("t", F.lit(0.0), lambda a, b: a + b))).alias("logs"))
    n = F.size("logs")
    add = lambda a, b: a + b

    def entropy(alpha: Column) -> Column:
        z = F.aggregate(F.transform("logs", lambda v: F.exp(alpha * v)), F.lit(0.0), add)
        m = F.aggregate(F.transform("logs", lambda v: alpha * v * F.exp(alpha * v)), F.lit(0.0), add)
        return F.log(z) - m / z

    def bisect(high_side_ok) -> Column:
        """The middle of the last interval; high_side_ok(alpha): the answer is above."""
        step = lambda acc, _: F.struct(
            F.when(high_side_ok((acc["lo"] + acc["hi"]) / 2), (acc["lo"] + acc["hi"]) / 2).otherwise(acc["lo"]).alias("lo"),
            F.when(high_side_ok((acc["lo"] + acc["hi"]) / 2), acc["hi"]).otherwise((acc["lo"] + acc["hi"]) / 2).alias("hi"),
        )
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)

    spread = F.array_max("logs") - F.array_min("logs")
    by_repeats = bisect(lambda a: (1 - a) * spread > F.log(F.lit(float(max_repeat))))
    if target_entropy is None:
        alpha = by_repeats
    else:
        goal = F.lit(float(target_entropy)) * F.log(n.cast("double"))
        alpha = F.greatest(bisect(lambda a: entropy(a) >= goal), by_repeats)
    found = shares.select(F.round(alpha, 6).alias("alpha"), F.array_max("logs").alias("top"), F.aggregate("logs", F.lit(0.0), add).alias("unused"), "logs")
    found = found.select("alpha", "top", F.aggregate(F.transform("logs", lambda v: F.exp(F.col("alpha") * v)), F.lit(0.0), add).alias("z"), F.aggregate("logs", F.lit(0.0), lambda a, v: a + F.exp(v)).alias("one"))
    whole = some.agg(F.sum("tokens").cast("double").alias("whole"))
    joined = total.join(F.broadcast(found.join(F.broadcast(whole), F.lit(True))), F.lit(True), "left")
    log_p = F.log(F.col("tokens") / F.col("whole"))
    return joined.select(
        "source",
        "n_rows",
        "tokens",
        "alpha",
        F.when(F.col("tokens") > 0, F.round(F.exp(F.col("alpha") * log_p) / F.col("z"), 6)).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(F.exp((1 - F.col("alpha")) * (F.col("top") - log_p)), 4)).otherwise(1.0).alias("repeats"),
    )


def block_of(key: Column, blocks: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), blocks)


def block_hash(turn: Column, source: Column, block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), turn.cast("string"), source, block.cast("string")))


def row_hash(turn: Column, key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), turn.cast("string"), key.cast("string")))


def place_of(turn: Column, source: Column, block: Column, key: Column, seed: int) -> Column:
    """Half of the block's hash and half of the row's."""
    return F.concat(F.substring(block_hash(turn, source, block, seed), 1, 16), F.substring(row_hash(turn, key, seed), 1, 16))


def mixing_plan(rows: DataFrame, target_entropy: float | None, max_repeat: float, seed: int = 17) -> DataFrame:
    """One row per source: weights, passes, and where the partial pass stops.

    `rows` is (id, source, tokens); it is read three times, so hand in a table."""
    weights = source_weights(rows, target_entropy, max_repeat)
    passes = F.floor("repeats").cast("long")
    tenths = F.round((F.col("repeats") - F.floor("repeats")) * 10000, 0).cast("long")
    most = F.greatest(F.lit(MAX_BLOCKS), F.ceil(F.sqrt("n_rows")))
    blocks = F.greatest(F.lit(1), F.least(most, F.ceil(F.col("n_rows") / BLOCK_ROWS))).cast("long")
    plan = weights.select("source", "n_rows", "tokens", "alpha", "weight", "repeats", passes.alias("passes"), F.floor(F.col("tokens") * tenths / 10000).cast("long").alias("rest"), blocks.alias("blocks"))
    plan = materialize(plan, "mixing-plan")
    part = with_sources(rows, plan.where("rest > 0").select("source", "passes", "rest", "blocks"))
    turn = F.col("passes") + 1
    part = part.withColumn("block", block_of(F.col("id"), F.col("blocks"), seed)).withColumn("bh", block_hash(turn, F.col("source"), F.col("block"), seed))
    size = part.groupBy("source", "bh", "rest").agg(F.sum("tokens").alias("size"))
    upto = Window.partitionBy("source").orderBy("bh").rowsBetween(Window.unboundedPreceding, -1)
    last = size.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where("before < rest and before + size >= rest").select("source", "bh", F.col("before"))
    inside = part.join(F.broadcast(last) if plan.count() <= BROADCAST_SOURCES else last, ["source", "bh"]).withColumn("dh", row_hash(turn, F.col("id"), seed))
    rows_upto = Window.partitionBy("source").orderBy("dh").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = inside.withColumn("through", F.sum("tokens").over(rows_upto) + F.col("before")).where("through >= rest").groupBy("source").agg(F.min("dh").alias("cut_row"), F.min("bh").alias("cut_block"))
    return plan.join(kept, "source", "left")


def with_sources(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows joined with one row per source: broadcast where they are few; beyond
    that a shuffle join over salted keys, so that a hot source is spread out."""
    if per_source.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), "source")
    salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")


def drawn(rows: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """rows (with id and source), once for each pass that takes them; adds pass, block
    and place.  Sorting by place gives the mixed order: blocks of all sources and
    passes in the order of their hash, and in a block the rows in the order of theirs."""
    joined = with_sources(rows, plan.select("source", "alpha", "weight", "passes", "blocks", "cut_block", "cut_row"))
    placed = joined.withColumn("block", block_of(F.col("id"), F.col("blocks"), seed))
    extra = F.col("passes") + 1
    bh = block_hash(extra, F.col("source"), F.col("block"), seed)
    in_part = F.coalesce((bh < F.col("cut_block")) | ((bh == F.col("cut_block")) & (row_hash(extra, F.col("id"), seed) <= F.col("cut_row"))), F.lit(False))
    return placed.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.when(in_part, extra).otherwise(F.col("passes"))))).drop("passes", "blocks", "cut_block", "cut_row").withColumn("place", place_of(F.col("pass"), F.col("source"), F.col("block"), F.col("id"), seed))


def mix(docs: DataFrame, target_entropy: float | None = 0.95, max_repeat: float = 4.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with rows repeated to the mixing weights, in the order of the mix: sorted
    within partitions, and partition by partition; the columns of docs."""
    rows = materialize(token_rows(docs, id_col, text_col, source_col), "token-rows")
    plan = materialize(mixing_plan(rows, target_entropy, max_repeat, seed), "mixing-cuts")
    row = F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row")
    keyed = docs.select(row, docs[id_col].cast("long").alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"))
    mixed = drawn(keyed, plan, seed).select("row", "place")
    # places are even, so their first 32 bits deal out equal ranges without a look at the data
    n = shuffle_partitions(docs.sparkSession)
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")
    return mixed.repartitionById(n, part).sortWithinPartitions("place").select("row.*")
