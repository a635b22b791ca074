"""Dialogues, token counts, scores and readers: worked cases and odd input."""

import random

import pytest
from pyspark.sql import functions as F

from cityweave import registry
from cityweave.functions.text import bio_components
from cityweave.operators import dialogues, evaluation, helpers, sequences
from cityweave.plans import mcq_jobs
from cityweave.sources import tables as src


def log(*turns):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in turns])


def told(spark, turns, **how):
    m = spark.range(1).select(dialogues.walk_dialogue(log(*turns), **how).alias("m")).first().m
    return [(x.role, x.content) for x in m]


def test_walk_dialogue(spark):
    turns = [
        ("user", "Find the mill. [example]walk here[/example]"), ("assistant", "navigate"), ("user", "you walked 50 m north.\nA mill is ahead.\nPossible actions: left, right"),
        ("assistant", "go left"), ("user", "you turned left.\nA bridge."), ("assistant", "stop"),
    ]
    want = [
        ("user", "Find the mill."), ("assistant", "After you walked 50 m north.\nA mill is ahead."), ("user", "you turned left."), ("assistant", "After you turned left.\nA bridge."), ("user", "stop"),
    ]
    assert told(spark, turns) == want
    assert told(spark, turns, one_round=True) == want[:2]
    assert told(spark, turns[:1]) == want[:1] and told(spark, [("user", " ")]) == []


def test_token_counts(spark):
    texts = [None, "", "two words", "北京大学", "北京 road 大学", "ひらがなkana한글 x", "é1, ü2"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", dialogues.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 0, 2, 4, 5, 8, 2]


def test_own_counter_runs_in_batches(spark):
    df = spark.createDataFrame([("a", "xyz"), ("a", None), ("b", "xyzzy")], "s string, t string")
    got = {r.s: r.total for r in dialogues.token_stats(df, "t", "s", dialogues.arrow_count("t", lambda: len)).collect()}
    assert got == {"a": 3, "b": 5, "all": 8}


def test_sketched_percentiles_are_near(spark):
    rng = random.Random(1)
    values = sorted(int(rng.lognormvariate(4, 1)) for _ in range(20_000))
    df = spark.createDataFrame([("s" if i % 3 else "r", v) for i, v in enumerate(values)], "source string, v long").repartition(7)
    got = {r.source: r for r in dialogues.token_stats(df, "v", "source", F.col("v"), sketch=200).collect()}
    assert got["all"].total == sum(values) == got["s"].total + got["r"].total
    for k, q in dialogues.SHARES.items():
        found = got["all"][k]
        below, upto = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
        assert below - 0.02 <= q <= upto + 0.02


def test_leaderboard_checks_its_rows(spark):
    scores = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 0.5), ("m", "c", 0.25), ("n", "a", 0.3), ("n", "c", 0.6)], "model string, task string, accuracy double")
    tasks = spark.createDataFrame([("a", "memory"), ("b", "route"), ("c", "noroute")], "task string, category string")
    got = {r.model: (r.memory, r.route, r.noroute, r.all_reasoning, r.tasks, r.complete) for r in evaluation.leaderboard(scores, tasks, ("memory", "route", "noroute"), ("route", "noroute")).collect()}
    assert got == {"m": (1.0, 0.5, 0.25, 0.375, 3, True), "n": (0.3, None, 0.6, 0.6, 2, False)}
    assert not any(r.complete for r in evaluation.leaderboard(scores, tasks, ("memory",), expected=39).collect())


def test_staged_match_equals_the_rule(spark):
    options = ["the old mill", "a bridge", "", None, "go up", "go wets", "the old mill"]
    texts = ["the old mill", " a bridge\n", "old mill there", "go west", "nothing", "", None, "a bridge now", "go"]
    rows = [(i, t, o) for i, t in enumerate(texts * 3) for o in (options, options[::-1], [], None)]
    df = spark.createDataFrame(rows, "i long, t string, o array<string>")
    for r in evaluation.match_options(df, "t", "o").collect():
        want = helpers.best_option_of(r.t, r.o)
        assert r.place == want
    assert evaluation.match_options(df, "t", "o").count() == len(rows)
    assert helpers.best_option_of("go west", options) == 5  # tied in words, more letters shared


def test_few_shots_are_messages(spark):
    schema = "id long, subject string, question string, options array<string>, answer string"
    support = spark.createDataFrame([(i, "s", f"q{i}", ["x", "y"], "B") for i in range(5)], schema)
    ask = spark.createDataFrame([(10, "s", "Q", ["u"], "A"), (11, "other", "R", ["v"], "A")], schema)
    got = {r.id: [(m.role, m.content) for m in r.messages] for r in evaluation.few_shot(ask, support, 2).collect()}
    assert [r for r, _ in got[10]] == ["user", "assistant"] * 3 and got[10][-1] == ("assistant", "A") and got[10][-2][1] == "Q\nA. u\nAnswer:"
    assert got[10][0][1].startswith("Questions on s") and not got[10][2][1].startswith("Questions on")
    assert got[11] == [("user", "Questions on other with their answers:\n\nR\nA. v\nAnswer:"), ("assistant", "A")]


def test_mass_leaves_padding_out(spark):
    v = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, 5)], "traj_id string, seq long, loc_id long")
    got = {r.loc_id: (r.n, r.share) for r in sequences.topk_mass(v, 3).collect()}
    assert got == {5: (2, pytest.approx(2 / 3)), 6: (1, pytest.approx(1 / 3))}


@pytest.mark.parametrize(
    "tags,want",
    [
        (["B-a", "I-a", "E-a"], [("a", "xyz")]), (["B-a", "O", "I-a"], [("a", "x"), ("a", "z")]), (["I-a", "I-b", "B-b"], [("a", "x"), ("b", "y"), ("b", "z")]),
        (["B-a", "E-a", "I-a"], [("a", "xyz")]), (["O", "O", "O"], []), ([], []),
    ],
)
def test_tag_runs(spark, tags, want):
    df = spark.createDataFrame([(list("xyz")[: len(tags)], tags)], "tokens array<string>, tags array<string>")
    assert [(p.kind, p.text) for p in df.select(bio_components(F.col("tokens"), F.col("tags")).alias("p")).first().p] == want


def test_dump_of_many_files(spark, tmp_path):
    """Files that lack a column are found by one scan; the driver opens none of them."""
    at = str(tmp_path / "dump")
    rows = spark.range(300).select((F.col("id") % 90).cast("double").alias("latitude"), (F.col("id") % 170).cast("double").alias("longitude"), F.array(F.lit("k")).alias("fsq_category_labels"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), "id")).alias("name"))
    rows.repartition(60).write.parquet(at)
    for gone in ("name", "fsq_category_labels", "latitude"):
        rows.drop(gone).repartition(5).write.mode("append").parquet(at)
    got = src.read_poi_dump(spark, at, (10.0, 5.0, 60.0, 50.0))
    want = rows.where("longitude between 10 and 60 and latitude between 5 and 50")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_axis_rule_is_checked():
    with pytest.raises(ValueError, match="axis_rule"):
        mcq_jobs.road_rows(None, "name", "none")


def test_turns_without_a_tagged_run_are_as_in_the_sql(spark, tmp_path):
    import duckdb

    path = f"{tmp_path}/conversations.parquet"
    duckdb.execute(f"COPY (SELECT i AS conv_id, 0 AS turn, 'user' AS role, CASE WHEN i % 5 = 0 THEN '' ELSE concat('w', i) END AS text FROM range(300) t(i)) TO '{path}'")
    got = {r.id: r.parts for r in registry.queries()["t18_bio_components"](spark, str(tmp_path)).collect()}
    want = dict(duckdb.connect().execute(registry.oracle_sql()["t18_bio_components"].replace("FROM conversations", f"FROM '{path}'")).fetchall())
    assert got == want and "=" in want.values()


def test_traces_by_file_and_by_line(spark, tmp_path):
    """The same traces, a file each (over several lines) or a line each; what cannot be read is counted."""
    one, two = '[["home","(08:00, 09:00)","7","a"]]', '[["work","(09:00, 10:00)","8"],["home","(10:00, 11:00)","x"]]'
    files, rows = tmp_path / "files" / "m", tmp_path / "rows" / "m"
    for folder in (files, rows):
        folder.mkdir(parents=True)
    for name, text in (("a", one), ("b", two.replace("],", "],\n")), ("c", "no trace")):
        (files / name).write_text(text)
    (rows / "all").write_text(f"{one}\n{two}\nno trace\n")
    want = [("m", 0, "home", "(08:00, 09:00)", 7, ["a"]), ("m", 0, "work", "(09:00, 10:00)", 8, []), ("m", 1, "home", "(10:00, 11:00)", None, [])]
    for path, lines in ((files.parent, False), (rows.parent, True)):
        good, bad = src.read_traces(spark, f"file://{path}", lines=lines)
        assert sorted(tuple(r) for r in good.drop("file").select("model", "seq", "event", "span", "poi_id", "extra").collect()) == sorted(want)
        assert [tuple(r) for r in bad.collect()] == [("m", 1)]
