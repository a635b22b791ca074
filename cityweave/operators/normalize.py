"""Records of public instruction sets as (prompt, messages, prompt_id, data_source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialogues
from .dialogues import to_messages


def _record(df: DataFrame, prompt: Column, messages: Column, source: Column, key: Column | None = None) -> DataFrame:
    """A record without a key of its own gets a digest of its source and messages."""
    out = df.select(prompt.alias("prompt"), messages.alias("messages"), source.alias("data_source"), *([key.cast("string").alias("prompt_id")] if key is not None else []))
    if key is None:
        out = out.withColumn("prompt_id", F.md5(F.concat_ws("#", "data_source", F.to_json("messages"))))
    return out.select("prompt", "messages", "prompt_id", "data_source")


def turns_of(conversations: Column) -> Column:
    """(from, value) turns as (role, content); human is the user, gpt the assistant."""
    role = lambda m: F.when(m["from"] == "human", "user").when(m["from"] == "gpt", "assistant").otherwise(m["from"])
    return F.transform(conversations, lambda m: F.struct(role(m).alias("role"), m["value"].alias("content")))


def conversations(df: DataFrame, name: str, phrases: list[str] | None = None, key: str | None = None) -> DataFrame:
    """conversations: array of (from, value).  With phrases given, only those that start
    with the user and hold none of the phrases."""
    d = df.withColumn("messages", turns_of(F.col("conversations"))).where(F.size("conversations") > 0)
    if phrases is not None:
        d = dialogues.drop_bad_dialogues(d, phrases)
    return _record(d, F.col("conversations")[0]["value"], F.col("messages"), F.lit(name), F.col(key) if key else None)


def pairs(df: DataFrame, name: str, key: str) -> DataFrame:
    """conversation: array of (human, assistant), one pair a round."""
    messages = F.flatten(F.transform("conversation", lambda p: to_messages(p["human"], p["assistant"])))
    return _record(df.where(F.size("conversation") > 0), F.col("conversation")[0]["human"], messages, F.lit(name), F.col(key))


def instructions(df: DataFrame, name: str, question: str = "instruction", answer: str = "output", parts: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
    """One question and one answer a row; the source is the columns `parts` and the
    name, joined by '_'.  An answer that is a list means its first item."""
    d = df if only is None else df.where(only)
    said = F.col(answer)[0] if df.schema[answer].dataType.typeName() == "array" else F.col(answer)
    return _record(d, F.col(question), to_messages(F.col(question), said), F.concat_ws("_", *parts, F.lit(name)))


def json_lines(df: DataFrame, name: str, text: str = "value") -> DataFrame:
    """Each row a JSON text with instruction and output; line feeds around them go."""
    strip = lambda k: F.regexp_replace(F.get_json_object(text, f"$.{k}"), r"^\n+|\n+$", "")
    return _record(df, strip("instruction"), to_messages(strip("instruction"), strip("output")), F.lit(name))


def dialogue_records(df: DataFrame, name: str) -> DataFrame:
    """(task, id, diag): the prompt is the system text, if it comes first, and the first
    user turn on a new line."""
    first = F.try_element_at(F.filter("diag", lambda m: m["role"] == "user"), F.lit(1))["content"]
    system = F.when(F.col("diag")[0]["role"] == "system", F.col("diag")[0]["content"]).otherwise("")
    return _record(df.where(F.size("diag") > 0), F.concat_ws("\n", system, first), F.col("diag"), F.concat_ws("_", F.lit(name), "task"), F.col("id"))


def choices(df: DataFrame, name: str, most: int, order: str) -> DataFrame:
    """The first `most` questions (question, options, answer letter) as prompt and answer text."""
    from ..functions.text import mcq_prompt

    d = df.orderBy(order).limit(most)
    at = F.instr(F.lit("ABCDEFGH"), F.col("answer"))
    return _record(d, mcq_prompt(F.col("question"), F.col("options")), to_messages(mcq_prompt(F.col("question"), F.col("options")), F.concat("answer", F.lit(". "), F.element_at("options", at))), F.lit(name))
