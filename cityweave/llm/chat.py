"""Chat formatting from reply trees.

A conversation is a tree of messages.  Root-to-leaf paths are found by iterative
self-joins that double the reach each round, so a tree of depth d takes log2(d)
rounds up and as many down.  Paths
are ranked by score, and each chosen path becomes one text with a loss mask.

Template: <|turn|>role<|text|>content<|end|> for every message, one after
another.  Control strings inside roles and contents are broken up by a backslash
after their first character, and backslashes are doubled, so the text can be
read back exactly.  Null roles and contents count as empty.  The rows without a
conversation id are one conversation, whose id is null.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates, broken up inside messages.
CONTROL = r"<(?=\|)|\|(?=>)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)|<(?=/SYS>>)|<(?=SYS>>)"
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
_UNDO = re.compile(r"\\(\\?)")


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({CONTROL})", r"$1\\")


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def turns_as_tree(rows: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score): linear conversations as chains.

    Rows stand by turn; rows that repeat a turn by role and text.  The score is the
    number of characters."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    return rows.select("conv_id", node.alias("node"), "role", "text").select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")
    )


def leaf_paths(tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): the messages on the path of each leaf, `up` steps
    above it.

    Self-joins double the reach: jump k leads from a message to its ancestor 2**k
    above and holds only the messages that have one.  Then each leaf spreads over
    its ancestors from the widest jump to the narrowest, meeting each of them once.
    Messages whose parent is missing are roots; those that lead into a cycle have no
    root and are left out."""
    links = tree.select("conv_id", "node", "parent")
    known = links.select("conv_id", F.col("node").alias("parent"))
    jump = materialize(links.where(F.col("parent").isNotNull()).join(known, ["conv_id", "parent"], "left_semi").select("conv_id", "node", F.col("parent").alias("to")), "reply-jump")
    jumps, sizes = [], []
    while True:
        n = jump.count()
        if not n or sizes and n == sizes[-1]:
            break
        jumps.append(jump)
        sizes.append(n)
        above = jump.select("conv_id", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = materialize(jump.join(above, ["conv_id", "to"]).select("conv_id", "node", F.col("next").alias("to")), "reply-jump")
    cyclic = jump.select("conv_id", "node")  # empty, or those that never run out of ancestors
    inner = links.where(F.col("parent").isNotNull()).select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = links.select("conv_id", "node").join(inner, ["conv_id", "node"], "left_anti").join(cyclic, ["conv_id", "node"], "left_anti")
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        further = paths.join(jumps[k], ["conv_id", "node"]).select("conv_id", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = materialize(paths.union(further), "reply-paths")
    return paths


def best_branches(tree: DataFrame, paths: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, turns): per conversation the `keep` paths of the highest
    total score (ties: the smaller leaf), turns as an array of (role, text)."""
    full = paths.withColumn("pos", -F.col("up")).join(tree.select("conv_id", "node", "role", "text", "score"), ["conv_id", "node"])
    one = full.groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "leaf"))
    return one.withColumn("branch", rank).where(F.col("branch") <= keep).select("conv_id", "branch", F.expr("transform(turns, t -> struct(t.role, t.text))").alias("turns"))


def format_turns(branches: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, branch, formatted, loss): the text and the code-point spans
    [start, end) of the contents to be learnt."""
    ready = branches.withColumn("parts", F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["role"].eqNullSafe(F.lit(trained_role)).alias("learn"))))
    piece = lambda p: F.concat(F.lit(TURN), p["role"], F.lit(TEXT), p["text"], F.lit(END))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        a = acc["at"] + F.length(p["role"]) + len(TURN) + len(TEXT)
        b = a + F.length(p["text"])
        spans = F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["spans"])
        return F.struct((b + len(END)).alias("at"), spans.alias("spans"))

    return ready.select("conv_id", "branch", F.array_join(F.transform("parts", piece), "").alias("formatted"), F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the mask, from formatted texts alone."""
    small_batches(formatted.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
                learnt = [unescape(text[s["start"] : s["end"]]) for s in loss]
                turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                for role, content in turns:
                    turns_sha.update(f"{role}\n{content}\n".encode())
                for content in learnt:
                    loss_sha.update(content.encode())
                rows.append((conv, len(turns), turns_sha.hexdigest(), sum(map(len, learnt)), loss_sha.hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return formatted.select(F.col("conv_id").cast("long"), "formatted", "loss").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_conversations(rows: DataFrame, keep: int = 1) -> DataFrame:
    """(conv_id, branch, formatted, loss) of every conversation of (conv_id, turn, role, text)."""
    one = rows.withColumn("conv_id", F.struct("conv_id"))  # equal to itself where the id is null
    tree = materialize(turns_as_tree(one), "reply-nodes")
    return format_turns(best_branches(tree, leaf_paths(tree), keep)).withColumn("conv_id", F.col("conv_id.conv_id"))
