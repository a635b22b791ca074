"""Small worked cases of the relational operators, and independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from cityweave.operators import dialogues, evaluation, helpers, sampling, sequences, spatial, topology
from cityweave.sources import tables as src


def steps(*rows):
    return F.array(*[F.struct(F.lit(n).alias("road_name"), F.lit(d).alias("direction"), F.lit(m).cast("long").alias("road_length")) for n, d, m in rows])


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("A", "n", 50), ("A", "n", 60)], [("A", 110)]),
        ([("A", "n", 50), ("B", "n", 200)], [("B", 200)]),
        ([("A", "n", 200), ("B", "n", 50)], [("A", 200)]),
        ([("A", "n", 200), ("A", "e", 150), ("A", "e", 120)], [("A", 200), ("A", 150), ("A", 120)]),
        ([("A", "n", 10)], []),
    ],
)
def test_merge_steps(spark, rows, want):
    got = spark.range(1).select(sequences.merge_steps(steps(*rows), 100).alias("m")).first().m
    assert [(m.road_name, m.length) for m in got] == want


def places(spark, n=200):
    p = spark.range(n).select(F.col("id").alias("poi_id"), ((F.col("id") * 37) % 101).cast("double").alias("x"), ((F.col("id") * 53) % 97).cast("double").alias("y"), F.concat(F.lit("k"), F.col("id") % 3).alias("category"))
    a = spark.range(6).select(F.col("id").alias("aoi_id"), *[((F.col("id") * 17) % 80).cast("double").alias("x0")], ((F.col("id") * 29) % 70).cast("double").alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    return p, a.withColumn("ring", F.array(corner(0, 0), corner(25, 0), corner(25, 20), corner(0, 20)))


def test_attach_against_brute_force(spark):
    p, a = places(spark)
    areas = [(r.aoi_id, r.x0, r.y0) for r in a.collect()]
    want = {(r.poi_id, min(k)) for r in p.collect() if (k := [i for i, x, y in areas if x < r.x < x + 25 and y < r.y < y + 20])}
    for size in (7.0, 50.0):
        got = spatial.attach_pois(p.repartition(5), a, size)
        assert {(r.poi_id, r.aoi_id) for r in got.collect()} == want


def test_radius_join_against_brute_force(spark):
    p, _ = places(spark)
    c = spark.range(9).select(F.col("id").alias("center_id"), (F.col("id") * 11.0).alias("cx"), (F.col("id") * 9.0).alias("cy"))
    pts = [(r.poi_id, r.x, r.y, r.category) for r in p.collect()]
    got = {(r.center_id, r.prefix, r.rank, r.poi_id) for r in spatial.pois_near(c, p, 20.0, ["k0", "k"], 2).collect()}
    want = set()
    for i in range(9):
        for prefix in ("k0", "k"):
            near = sorted((((x - i * 11) ** 2 + (y - i * 9) ** 2) ** 0.5, q) for q, x, y, k in pts if k.startswith(prefix) and (x - i * 11) ** 2 + (y - i * 9) ** 2 <= 400)
            want |= {(i, prefix, r + 1, q) for r, (_, q) in enumerate(near[:2])}
    assert got == want


def test_widening_takes_the_first_ring_with_points(spark):
    p = spark.createDataFrame([(1, 0.0, 1400.0), (2, 0.0, 1900.0)], "poi_id long, x double, y double")
    c = spark.createDataFrame([(0, 0.0, 0.0)], "center_id long, cx double, cy double")
    assert [(r.ring, r.poi_id) for r in spatial.search_widening(c, p).collect()] == [(1500.0, 1)]


def test_stratified_cap_is_exact(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "few").otherwise("hot").alias("key"))
    got = sampling.stratified_cap(df, "key", 30, "id", seed=1)
    counts = {r.key: r["count"] for r in got.groupBy("key").count().collect()}
    assert counts == {"few": 30, "hot": 30}
    odd = df.union(spark.range(9000, 9003).select("id", F.lit(None).cast("string")))
    assert {r.key: r["count"] for r in sampling.stratified_cap(odd, "key", 30, "id", ("few",)).groupBy("key").count().collect()} == {"hot": 30, None: 3}
    again = sampling.stratified_cap(df.repartition(7), "key", 30, "id", seed=1)
    assert {r.id for r in got.collect()} == {r.id for r in again.collect()}


def test_negatives_are_never_positives(spark):
    keys = spark.range(20).select(F.col("id").alias("k"))
    items = spark.range(300).select(F.col("id").alias("i"))
    positives = keys.crossJoin(items.where("i % 3 = 0"))
    got = sampling.negatives(keys, "k", items, "i", positives, 4)
    rows = got.collect()
    assert all(r.i % 3 for r in rows) and sorted((r.k, r["rank"]) for r in rows) == [(k, r) for k in range(20) for r in range(1, 5)]
    few = sampling.negatives(keys, "k", items, "i", keys.crossJoin(items.where("i <> 7")), 4).collect()
    assert sorted((r.k, r.i) for r in few) == [(k, 7) for k in range(20)]


def test_mcq_answer_is_by_place(spark):
    df = spark.createDataFrame([(i, "same") for i in range(30)], "k long, a string")
    m = sampling.make_mcq(df, "k", F.lit("?"), F.col("a"), F.array(F.lit("same"), F.lit("other"))).collect()
    assert {len(r.options) for r in m} == {3} and {r.answer for r in m} == {"A", "B", "C"}
    assert all(r.options["ABC".index(r.answer)] == "same" for r in m)


def test_interleave_modes(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", i) for i in range(1, 4)], "s string, p long")
    under = sampling.interleaved(df, "s", "p", {"a": 0.5, "b": 0.5}, "under").groupBy("s").count().collect()
    over = sampling.interleaved(df, "s", "p", {"a": 0.5, "b": 0.5}, "over").groupBy("s").count().collect()
    assert {(r.s, r["count"]) for r in under} == {("a", 3), ("b", 3)}
    assert {(r.s, r["count"]) for r in over} == {("a", 10), ("b", 10)}


def test_road_length_counts_side_lanes_once(spark):
    lanes = spark.createDataFrame([(1, 10, 1, 100.0, [2]), (2, 10, 2, 100.0, [1]), (3, 11, 1, 50.0, [])], "lane_id long, road_id long, no long, length double, side_ids array<long>")
    roads = spark.createDataFrame([(10, "A"), (11, "A")], "road_id long, name string")
    assert topology.road_length_estimate(lanes, roads).first().length == 75.0


def test_similarity_helpers():
    assert helpers.bleu("a b c d".split(), "a b c d".split()) == pytest.approx(1)
    assert helpers.bleu(["a"], []) == 0
    assert helpers.rouge_l("a b c".split(), "a c".split()) == pytest.approx(0.8)
    assert helpers.best_option_of("the red house", ["blue barn", "the red houses", "the red house"]) == 2
    assert helpers.best_option_of("zzz", ["blue barn"]) == -1
    ring = [{"x": 0, "y": 0}, {"x": 2, "y": 0}, {"x": 2, "y": 2}, {"x": 0, "y": 2}]
    assert helpers.polygon_line_distance(ring, [{"x": 5, "y": 0}, {"x": 5, "y": 5}]) == 3
    assert helpers.polygon_line_distance(ring, [{"x": -1, "y": 1}, {"x": 5, "y": 1}]) == 0
    assert helpers.polygon_line_distance(ring, [{"x": 0.5, "y": 1}, {"x": 1, "y": 1}]) == 0


def test_navigation_and_divergence(spark):
    s = spark.createDataFrame([("m", 1, 0, 1, 1000.0), ("m", 1, 0, 2, 400.0), ("m", 1, 1, 1, 1000.0)], "model string, case_id long, round long, step long, distance double")
    r = evaluation.navigation_score(s).first()
    assert (r.successes, r.steps, r.skipped) == (1, 26.0, False) and r.completion == pytest.approx(0.3)
    v = spark.createDataFrame([("real", 0.1), ("generated", 0.1), ("real", 0.9), ("generated", 0.9)], "kind string, v double")
    assert evaluation.divergence(v, F.lit(48), 1.0, True).first().jsd == pytest.approx(0)
    w = spark.createDataFrame([("real", 0.1), ("generated", 0.9)], "kind string, v double")
    assert evaluation.divergence(w, F.lit(48), 1.0, True).first().jsd == pytest.approx(0.693147, abs=1e-5)


def test_alpaca_variants(spark):
    m = [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    df = spark.createDataFrame([(1, m), (2, [])], "k long, messages array<struct<role:string,content:string>>")
    last, first = dialogues.to_alpaca(df).collect(), dialogues.to_alpaca(df, last_turn=False).collect()
    assert [(r.instruction, r.output, r.system, r.history) for r in last] == [("c", "d", "s", [["a", "b"]])]
    assert [(r.instruction, r.output, r.history) for r in first] == [("a", "b", [])]


def test_training_session_cuts_example_and_swaps(spark):
    m = [("user", "go [example]x\ny[/example] now\nPossible actions: a, b"), ("assistant", "left")]
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    got = df.select(dialogues.training_session(F.col("m")).alias("s")).first().s
    assert [(x.role, x.content) for x in got] == [("assistant", "go  now"), ("user", "left")]


def test_latest_snapshot(spark):
    names = spark.createDataFrame([(n,) for n in ("map_paris_240101", "map_paris_240301", "map_paris_fsq_240501", "map_rome_230101", "other")], "name string")
    assert {tuple(r) for r in src.latest_snapshot(names, False).collect()} == {("paris", "map_paris_240301"), ("rome", "map_rome_230101")}
    assert {tuple(r) for r in src.latest_snapshot(names, True).collect()} == {("paris", "map_paris_fsq_240501")}


def test_normalize_alpaca(spark):
    df = spark.createDataFrame([("q", "x", "a", [["h", "g"]])], "instruction string, input string, output string, history array<array<string>>")
    got = src.normalize_registered(df, {"columns": {"history": "history"}}).first().messages
    assert [(m.role, m.content) for m in got] == [("user", "h"), ("assistant", "g"), ("user", "q\nx"), ("assistant", "a")]


def test_streaming_append(spark, tmp_path):
    from cityweave.streaming.append import convert_dialogues

    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    df = spark.createDataFrame([("t", "1", [("user", "x"), ("assistant", "y")])], src.DIALOGUE)
    for n in (1, 2):
        df.write.mode("append").json(a)
        convert_dialogues(spark, a, b, c).awaitTermination(60)
        assert spark.read.json(b).count() == n
