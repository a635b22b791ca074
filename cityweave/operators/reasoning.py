"""Worked answers: dialogues that reason from a route's stretches to a choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mcq_prompt
from .sampling import make_mcq

THINK = "Let us think step by step."
CHOOSE = "Given these directions, choose the most suitable answer. " + THINK
#: Stands between the parts of a text that is split again.
SEP = "\x1f"


def whole(v: Column) -> Column:
    return F.round(F.round(v, 3), 0).cast("long").cast("string")


def tenths(v: Column) -> Column:
    """One decimal."""
    n = F.round(v * 10, 0).cast("long")
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 10).cast("string"), F.lit("."), (F.abs(n) % 10).cast("string"))


def totals_text(t: Column, number=whole) -> Column:
    said = [F.concat(F.lit(f"{d} "), number(t[d])) for d in ("north", "east", "south", "west")]
    return F.concat(F.lit("Step 1. Metres by direction, diagonal ones at 0.7 for both: "), F.concat_ws(", ", *said), F.lit(". "))


def axes_text(t: Column, number=whole) -> Column:
    """What is left on each of the two axes."""

    def axis(a: str, b: str) -> Column:
        more, less = F.greatest(t[a], t[b]), F.least(t[a], t[b])
        return F.concat(number(more), F.lit("-"), number(less), F.lit("="), number(more - less), F.lit(" towards "), F.when(F.round(t[a], 3) >= F.round(t[b], 3), a).otherwise(b))

    return F.concat(F.lit("Step 2. South-north "), axis("north", "south"), F.lit("; east-west "), axis("east", "west"), F.lit(". "))


def lengths_text(lengths: Column) -> Column:
    return F.concat(F.lit("Step 1. The stretches: "), F.array_join(F.transform(lengths, lambda v: F.concat(v.cast("string"), F.lit("m"))), ", "), F.lit(". "))


def reasoned(df: DataFrame, key: str, route: Column, question: Column, steps: Column, right: Column, wrong: Column, seed: int, several: Column | None = None) -> DataFrame:
    """(key, diag): the question with its options, and the letter with the worked steps.

    In one turn the question holds the route; where `several` is true the assistant
    first recalls the route and then answers."""
    told = F.concat_ws(SEP, route, question, steps, F.when(F.coalesce(several, F.lit(False)), "2").otherwise("1") if several is not None else F.lit("1"))
    m = make_mcq(df, key, told, right.cast("string"), F.transform(wrong, lambda w: w.cast("string")), seed)
    part = lambda i: F.split("question", SEP)[i]
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    answer = turn("assistant", F.concat(F.lit("Answer: "), "answer", F.lit(". "), part(2)))
    one = F.array(turn("user", mcq_prompt(F.concat(part(0), F.lit(". "), part(1)), F.col("options"), suffix=THINK)), answer)
    two = F.array(turn("user", mcq_prompt(part(1), F.col("options"), suffix="Recall the way first.")), turn("assistant", part(0)), turn("user", F.lit(CHOOSE)), answer)
    return m.select(key, F.when(part(3) == "2", two).otherwise(one).alias("diag"))
