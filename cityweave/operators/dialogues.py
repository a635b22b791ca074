"""Dialogue and instruction records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


#: Characters that count one each: kana, ideographs (with extension A and the compatible ones) and Hangul.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}"
SHARES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def word_count(text: Column) -> Column:
    """The default estimate of tokens: words by white space, in which each CJK character
    counts by itself."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[{CJK}]|[^\s{CJK}]+")), F.lit(0)).cast("long")


def arrow_count(text: str, make: Callable[[], Callable[[str], int]]) -> Column:
    """A token counter of one's own, in Arrow batches.  make() builds the function from a text
    to its number of tokens (a loaded tokenizer, say), once a batch of batches; null counts 0."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for texts in batches:
            yield pd.Series([0 if t is None else int(count(t)) for t in texts], dtype="int64")

    return run(text)


def token_stats(df: DataFrame, text: str, source: str, count: Column | None = None, sketch: int | None = None) -> DataFrame:
    """Totals and percentiles of token counts by source and over all ("all").

    `count` takes another counter (see arrow_count).  Percentiles are exact; with `sketch`
    they come from KLL sketches of that k, which merge in any order and stay small: a
    rank is then off by about 2.3 / k (k = 200: 1.3 % with 99 % confidence)."""
    n = df.withColumn("n", word_count(F.col(text)) if count is None else count)
    if sketch is None:
        p = F.percentile("n", F.array(*map(F.lit, SHARES.values())))
        stats = n.rollup(source).agg(F.sum("n").alias("total"), p.alias("p"), F.grouping(source).alias("all"))
        found = [F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(SHARES)]
    else:
        # one sketch a source, merged for the whole: the texts are read once
        part = n.groupBy(source).agg(F.sum("n").alias("total"), F.kll_sketch_agg_bigint("n", sketch).alias("s"))
        stats = part.rollup(source).agg(F.sum("total").alias("total"), F.kll_merge_agg_bigint("s", sketch).alias("s"), F.grouping(source).alias("all"))
        found = [F.kll_sketch_get_quantile_bigint("s", F.lit(q)).cast("double").alias(k) for k, q in SHARES.items()]
    return stats.select(F.when(F.col("all") == 1, "all").otherwise(F.col(source)).alias(source), "total", *found)


def perplexity(losses: DataFrame) -> DataFrame:
    """(sample_pos, ppl) from token losses under a mask; null where nothing is masked in."""
    m = F.when(F.col("masked"), 1).otherwise(0)
    return losses.groupBy("sample_pos").agg(F.exp(F.sum(F.when(F.col("masked"), F.col("nll")).otherwise(0.0)) / F.nullif(F.sum(m), F.lit(0))).alias("ppl"))


def filter_by_score(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= least).drop(score)


def drop_bad_dialogues(df: DataFrame, phrases: list[str], messages: str = "messages") -> DataFrame:
    """First turn (after a system turn) is the user's, and no turn holds a phrase."""
    turns = F.filter(messages, lambda m: m["role"] != "system")
    bad = F.exists(messages, lambda m: F.lower(m["content"]).rlike("|".join(phrases)) if phrases else F.lit(False))
    return df.where((F.size(turns) > 0) & (F.try_element_at(turns, F.lit(1))["role"] == "user") & ~bad)


def to_messages(first: Column, second: Column, system: Column | None = None) -> Column:
    """A question and an answer as a message list."""
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    pair = F.concat(one("user", first), one("assistant", second))
    return pair if system is None else F.when(F.coalesce(system, F.lit("")) != "", F.concat(one("system", system), pair)).otherwise(pair)


def to_alpaca(df: DataFrame, messages: str = "messages", last_turn: bool = True) -> DataFrame:
    """instruction, output, system, history of each dialogue.

    The last pair is the instruction and the earlier ones its history; with
    last_turn=False the first pair is the instruction and there is no history."""
    of = lambda role: F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])
    d = df.withColumn("_user", of("user")).withColumn("_said", of("assistant")).withColumn("_system", F.coalesce(F.try_element_at(of("system"), F.lit(1)), F.lit("")))
    n = F.least(F.size("_user"), F.size("_said"))
    d = d.withColumn("_n", n).where("_n > 0")
    at = F.col("_n") if last_turn else F.lit(1)
    history = F.when(F.col("_n") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("_n") - 1, F.lit(1))), lambda i: F.array(F.element_at("_user", i), F.element_at("_said", i)))).otherwise(F.array().cast("array<array<string>>"))
    keep = [c for c in df.columns if c != messages]
    return d.select(*keep, F.element_at("_user", at).alias("instruction"), F.element_at("_said", at).alias("output"), F.col("_system").alias("system"), (history if last_turn else F.array().cast("array<array<string>>")).alias("history"))


def to_sharegpt(df: DataFrame, messages: str = "messages") -> DataFrame:
    names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    turns = F.transform(messages, lambda m: F.struct(F.coalesce(F.try_element_at(names, m["role"]), m["role"]).alias("from"), m["content"].alias("value")))
    return df.select(*[c for c in df.columns if c != messages], turns.alias("conversations"))


def cleaned(log: Column, marks: tuple[str, str]) -> Column:
    """Messages without the worked example and the list of possible actions, trimmed."""
    cut = rf"(?s)\Q{marks[0]}\E.*?\Q{marks[1]}\E"
    bare = lambda text: F.regexp_replace(F.regexp_replace(F.regexp_replace(text, cut, ""), r"(?m)^Possible actions:.*$", ""), r"^\s+|\s+$", "")
    return F.transform(log, lambda m: F.struct(m["role"].alias("role"), bare(m["content"]).alias("content")))


def training_session(log: Column, marks: tuple[str, str] = ("[example]", "[/example]"), one_round: bool = False) -> Column:
    """A walk log's session as a training dialogue: the worked example is cut out of
    each message, the list of possible actions dropped, and roles swapped, so that
    what the walker said is the answer; one_round keeps the first exchange."""
    swapped = F.transform(cleaned(log, marks), lambda m: F.struct(F.when(m["role"] == "user", "assistant").when(m["role"] == "assistant", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    kept = F.filter(swapped, lambda m: m["content"] != "")
    return F.slice(kept, 1, 2) if one_round else kept


def walk_dialogue(log: Column, marks: tuple[str, str] = ("[example]", "[/example]"), one_round: bool = False) -> Column:
    """A walk log as a training dialogue in which the walk is told, not steered.

    The log is a task (user), a first steering answer (assistant), and then what the walker
    saw (user) and how it steered (assistant) in turn.  Worked examples and lists of
    actions are cut out and empty messages dropped.  The task stays; the first answer
    goes.  Of the rest, what was seen becomes the answer, behind "After "; a steering
    message becomes the question, and its text is the movement sentence, the first line
    of the message that follows it (its own text, where none follows).  one_round keeps
    the task and the first answer."""
    kept = F.filter(cleaned(log, marks), lambda m: m["content"] != "")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    line = lambda m: F.split(m["content"], "\n", 2)[0]

    def told(m, i):
        after = F.get(kept, i + 1)
        return F.when(m["role"] == "assistant", turn("user", F.coalesce(line(after), m["content"]))).when(m["role"] == "user", turn("assistant", F.concat(F.lit("After "), m["content"]))).otherwise(m)

    moved = F.filter(F.transform(kept, lambda m, i: F.when(i == 0, m).when(i != 1, told(m, i))), lambda m: m.isNotNull())
    if not one_round:
        return moved
    first = lambda role: F.slice(F.filter(moved, lambda m: m["role"] == role), 1, 1)
    return F.concat(first("user"), first("assistant"))


def pretraining_text(messages: Column, task: Column) -> Column:
    """The task text and all assistant turns, joined by line feeds."""
    said = F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"])
    return F.concat_ws("\n", task, F.array_join(said, "\n"))


# Full names of address tags.
TAG_NAMES = {"roadno": "road_number", "cellno": "cell_number", "floorno": "floor_number", "prov": "province", "houseno": "house_number"}


def address_tag_dialogues(df: DataFrame) -> DataFrame:
    """(id, question, answer) from (id, tokens, tags): the elements of a tagged address
    as JSON, in the order in which they first occur; of a repeated one the last text."""
    from ..functions.text import bio_components

    names = F.create_map(*[F.lit(x) for pair in TAG_NAMES.items() for x in pair])
    parts = F.transform(bio_components(F.col("tokens"), F.col("tags")), lambda p: F.struct(F.coalesce(F.try_element_at(names, p["kind"]), p["kind"]).alias("kind"), p["text"].alias("text")))
    d = df.withColumn("_parts", parts).withColumn("_kinds", F.array_distinct(F.transform("_parts", lambda p: p["kind"])))
    values = F.transform("_kinds", lambda k: F.element_at(F.filter("_parts", lambda p: p["kind"] == k), -1)["text"])
    whole = F.replace(F.array_join("tokens", ""), F.lit("_"), F.lit(" "))
    return d.select("id", F.concat(F.lit("Name "), F.array_join("_kinds", ", "), F.lit(" of: "), whole).alias("question"), F.to_json(F.map_from_arrays("_kinds", values)).alias("answer"))


def matching_pairs(df: DataFrame, place: str) -> DataFrame:
    """Pairs (sentence1, sentence2) labelled exact_match of which one mentions the place."""
    near = F.col("sentence1").contains(place) | F.col("sentence2").contains(place)
    return df.where((F.col("label") == "exact_match") & near).withColumns({"question": F.concat(F.lit("Which address is the same as "), "sentence1", F.lit("?")), "answer": F.col("sentence2")})


def story_dialogues(df: DataFrame) -> DataFrame:
    """(id, question, answer) from (id, story, question, q_type, candidates, truth, said).

    truth holds places in the candidates (q_type CO, FR) or the texts themselves; rows
    without one are left out, and so are those whose final answer is another.  The
    question names the candidates; the answer comes before the model's reasoning."""
    from ..functions.text import parse_final_answer

    by_place = F.col("q_type").isin("CO", "FR") & (F.size("candidates") > 0)
    meant = F.transform("truth", lambda x: F.try_element_at("candidates", x.try_cast("int") + 1))
    true = F.array_join(F.when(by_place, meant).otherwise(F.col("truth")), ", ")
    final = parse_final_answer(F.col("said"))
    kept = df.where((F.size("truth") > 0) & (F.trim(true) == final))
    reasons = F.when(F.col("said").contains("Final Answer:"), F.regexp_replace(F.element_at(F.split("said", "Final Answer:"), 1), r"^\s+|\s+$", "")).otherwise("No reasoning provided.")
    options = F.when(F.size("candidates") > 0, F.concat(F.lit(" The possible answers are: "), F.array_join("candidates", ", "), F.lit("."))).otherwise("")
    return kept.select("id", F.concat("story", F.lit(" "), "question", options).alias("question"), F.concat(F.lit("Answer: "), final, F.lit("\n"), reasons).alias("answer"))
