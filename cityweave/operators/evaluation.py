"""Scores of model outputs, navigation runs and generated trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_choice, keyed, letter, mcq_prompt
from . import sequences
from .helpers import best_option
from .sampling import make_mcq, negatives
from .spatial import sized_broadcast


def score_mcq(outputs: DataFrame) -> DataFrame:
    """(model, task, n, correct, accuracy); an empty output counts as wrong."""
    hit = F.when(extract_choice(F.col("text")) == F.col("answer"), 1).otherwise(0)
    return outputs.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"), F.avg(hit).alias("accuracy"))


def leaderboard(scores: DataFrame, tasks: DataFrame, categories: tuple[str, ...], reasoning: tuple[str, ...] = (), expected: int | None = None) -> DataFrame:
    """Mean accuracy by category (4 decimals), the mean of the reasoning categories among
    them that have one (of the rounded means), the number of tasks found, and whether
    these are the expected number (the number of tasks, if None)."""
    j = scores.join(sized_broadcast(tasks), "task")
    means = j.groupBy("model").pivot("category", list(categories)).agg(F.round(F.avg("accuracy"), 4))
    known = F.filter(F.array(*map(F.col, reasoning)), lambda m: m.isNotNull()) if reasoning else F.array().cast("array<double>")
    both = F.round(F.aggregate(known, F.lit(0.0), lambda a, m: a + m) / F.nullif(F.size(known), F.lit(0)), 4)
    found = j.groupBy("model").agg(F.count_distinct("task").alias("tasks"))
    wanted = tasks.agg(F.count_distinct("task").alias("_all")) if expected is None else None
    board = means.withColumn("all_reasoning", both).join(found, "model")
    if wanted is None:
        return board.withColumn("complete", F.col("tasks") == expected)
    return board.join(F.broadcast(wanted), F.lit(True)).withColumn("complete", F.col("tasks") == F.col("_all")).drop("_all")


def subject_accuracy(outputs: DataFrame, subject: str) -> DataFrame:
    hit = F.when(extract_choice(F.col("text")) == F.col("answer"), 1.0).otherwise(0.0)
    r = outputs.rollup(subject).agg(F.avg(hit).alias("accuracy"), F.grouping(subject).alias("all"))
    return r.select(F.when(F.col("all") == 1, "Average").otherwise(F.col(subject)).alias("subject"), "accuracy")


def token_accuracy(tokens: Column) -> Column:
    """Share of right predictions among the used tokens (pred, label, use)."""
    used = F.filter(tokens, lambda s: s["use"])
    right = F.filter(used, lambda s: s["pred"] == s["label"])
    return F.size(right) / F.nullif(F.size(used), F.lit(0))


def pairwise(chosen: Column, rejected: Column) -> Column:
    return F.when(chosen > rejected, 1.0).otherwise(0.0)


def navigation_score(steps: DataFrame, reach: float = 500.0, far: float = 2000.0, most: int = 50) -> DataFrame:
    """Per model and case: successes, mean steps (failures count `most`), completion, and
    whether a start beyond `far` puts the case aside.

    steps: model, case_id, round, step, distance."""
    w = Window.partitionBy("model", "case_id", "round").orderBy("step")
    r = steps.withColumn("no", F.row_number().over(w))
    runs = r.groupBy("model", "case_id", "round").agg(F.min_by("distance", "step").alias("initial"), F.min("distance").alias("shortest"), F.min(F.when(F.col("distance") < reach, F.col("no"))).alias("hit"))
    return runs.groupBy("model", "case_id").agg(
        (F.max("initial") > far).alias("skipped"), F.count("hit").alias("successes"), F.avg(F.coalesce("hit", F.lit(most))).alias("steps"), (1 - F.sum("shortest") / F.sum("initial")).alias("completion")
    )


def next_place_inputs(visits: DataFrame, seed: int = 0, per_user: int = 5, others: int = 5) -> DataFrame:
    """(traj_id, question, options, answer): the last place among `others` more, drawn from
    all places, asked from the history."""
    h = sequences.history_target(visits).join(visits.select("traj_id", "user_id").distinct(), "traj_id").where(F.size("history") > 0)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(keyed(F.col("traj_id"), seed=seed), "traj_id"))
    h = h.withColumn("k", rank).where(F.col("k") <= per_user)
    drawn = negatives(h, "traj_id", visits, "loc_id", h.select("traj_id", F.col("target").alias("loc_id")), others, seed)
    wrong = drawn.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "loc_id"))), lambda s: s["loc_id"].cast("string")).alias("wrong")).where(F.size("wrong") == others)
    question = F.concat(F.lit("Places so far: "), F.array_join(F.transform("history", lambda x: x.cast("string")), ", "), F.lit(". Which is next?"))
    m = make_mcq(h.join(wrong, "traj_id"), "traj_id", question, F.col("target").cast("string"), F.col("wrong"), seed)
    return m.select("traj_id", "question", F.array_join("options", "|").alias("options"), "answer")


def match_options(df: DataFrame, text: str, options: str, out: str = "place") -> DataFrame:
    """df with the place (from 0) of the option that a text names, -1 for none.

    A text that equals an option once both are trimmed (the first of equal ones), and a text
    or a list with nothing in it, are settled by built-in expressions; only the rest goes
    to Python, in Arrow batches of distinct pairs."""
    said = F.trim(F.coalesce(text, F.lit("")))
    listed = F.transform(options, lambda o: F.coalesce(o, F.lit("")))
    exact = F.array_position(listed, said) - 1
    sure = F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, F.lit(-1)).when(exact >= 0, exact).when(said == "", F.lit(-1)).cast("long")
    marked = df.withColumn(out, sure)
    done, rest = marked.where(F.col(out).isNotNull()), marked.where(F.col(out).isNull()).drop(out)
    pairs = rest.select(text, options).distinct()
    best = pairs.select(F.col(text).alias("_text"), F.col(options).alias("_options"), best_option(text, options).alias(out))
    return done.unionByName(rest.join(best, (F.col(text) == F.col("_text")) & F.col(options).eqNullSafe(F.col("_options"))).drop("_text", "_options"))


def next_place_accuracy(df: DataFrame, text: str, options: str, answer: str, key: str) -> DataFrame:
    """(key, n, by_letter, by_name): the shares of texts that give the letter of the answer (a
    place counted from 0), and of those whose wording comes nearest to the answer."""
    named = match_options(df, text, options, "_named")
    letter_hit = F.when(extract_choice(F.col(text)) == letter(F.col(answer)), 1.0).otherwise(0.0)
    name_hit = F.when(F.col("_named") == F.col(answer), 1.0).otherwise(0.0)
    return named.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(letter_hit).alias("by_letter"), F.avg(name_hit).alias("by_name"))


def few_shot(questions: DataFrame, support: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(id, messages): each question after n drawn support rows of its subject, as a dialogue.

    Both: id, subject, question, options (an array), answer (a letter).  The first
    message names the subject.  A subject's shots are few and the same for all of its
    questions, so they are gathered once a subject and joined."""
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(keyed(F.col("id"), seed=seed), "id"))
    asked = lambda: mcq_prompt(F.col("question"), F.col("options"))
    pair = F.array(F.struct(F.lit("user").alias("role"), asked().alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    shots = support.withColumn("k", rank).where(F.col("k") <= n).select("subject", "k", pair.alias("pair"))
    shots = shots.groupBy("subject").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "pair"))), lambda s: s["pair"])).alias("shots"))
    joined = questions.join(sized_broadcast(shots), "subject", "left").withColumn("m", F.concat(F.coalesce("shots", F.array().cast("array<struct<role:string,content:string>>")), pair))
    head = F.concat(F.lit("Questions on "), F.col("subject").cast("string"), F.lit(" with their answers:\n\n"))
    return joined.select("id", F.transform("m", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(head, m["content"])).otherwise(m["content"]).alias("content"))).alias("messages"))


def normalized_histogram(df: DataFrame, key: str, value: str, width: float, low: float, high: float) -> DataFrame:
    """(key, bin, n, share) of the values in [low, high); empty bins are left out."""
    b = df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(key, F.floor((F.col(value) - low) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def divergence(values: DataFrame, bins: Column | None, top: float, high_closed: bool) -> DataFrame:
    """One row (bins, jsd) for (kind, v): Jensen-Shannon divergence of the histograms.

    bins None: int(3.5 * std / n^(1/3)); null where that is 0."""
    stats = values.agg(F.floor(F.lit(3.5) * F.stddev_pop("v") / F.pow(F.count(F.lit(1)).cast("double"), F.lit(1 / 3))).cast("long").alias("bins"))
    if bins is not None:
        stats = stats.select(bins.cast("long").alias("bins"))
    stats = stats.select(F.nullif(F.greatest("bins", F.lit(0)), F.lit(0)).alias("bins"))
    j = values.join(F.broadcast(stats), F.lit(True)).withColumn("w", F.lit(top) / F.col("bins"))
    edge = F.lit(top) if high_closed else (F.col("bins") - 1) * F.col("w")
    last = F.col("bins") - 1 if high_closed else F.col("bins") - 2
    binned = j.where((F.col("v") >= 0) & (F.col("v") <= edge)).withColumn("bin", F.least(F.floor(F.col("v") / F.col("w")), last))
    n = binned.groupBy("bin").agg(F.count(F.when(F.col("kind") == "real", 1)).alias("r"), F.count(F.when(F.col("kind") == "generated", 1)).alias("g"))
    total = n.agg(F.sum("r").alias("tr"), F.sum("g").alias("tg"))
    p = n.join(F.broadcast(total), F.lit(True)).select((F.col("r") / F.col("tr")).alias("p"), (F.col("g") / F.col("tg")).alias("q"))
    half = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log(2 * F.col(a) / (F.col(a) + F.col(b)))).otherwise(0.0)
    out = p.agg(((F.sum(half("p", "q")) + F.sum(half("q", "p"))) / 2).alias("jsd"))
    return stats.join(out, F.lit(True))


def trajectory_jsd(visits: DataFrame) -> DataFrame:
    """(measure, bins, jsd) for step distance, radius, duration and repeat rate."""
    kinds = visits.select("traj_id", "kind").distinct()
    steps = sequences.step_distances(visits).select("kind", F.col("distance").alias("v"))
    radius = sequences.gyration_radius(visits).join(kinds, "traj_id").select("kind", F.col("radius").alias("v"))
    stay = visits.select("kind", F.col("duration").alias("v"))
    rate = visits.groupBy("traj_id", "kind").agg((F.count_distinct("loc_id") / F.count(F.lit(1))).alias("v")).select("kind", "v")
    parts = [("distance", divergence(steps, None, 10000.0, False)), ("radius", divergence(radius, None, 10000.0, False)), ("duration", divergence(stay, F.lit(48), 1.0, True)), ("repeat_rate", divergence(rate, F.lit(48), 1.0, True))]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("measure"), "bins", F.round("jsd", 6).alias("jsd"))
        out = row if out is None else out.union(row)
    return out
