"""Queries that score model outputs, navigation runs and trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation
from ..operators.helpers import similarity_scores
from .base import Tables, md5_sql, query
from .mcq_jobs import asked_sql
from .place_jobs import negatives_sql

_SCORED = "sc AS (SELECT model, task, count(*) AS n, sum(CASE WHEN said = answer THEN 1 ELSE 0 END)::BIGINT AS correct FROM output GROUP BY model, task)"


@query("e1_score_mcq", f"WITH {_SCORED} SELECT model, task, n, correct, round(correct::DOUBLE / n, 8) AS accuracy FROM sc /* output */")
def score(t: Tables):
    return scored(t).withColumn("accuracy", F.round("accuracy", 8))


def scored(t: Tables):
    return evaluation.score_mcq(t.output)


@query(
    "e2_a17_leaderboard",
    f"""WITH {_SCORED}, m AS (SELECT model, CASE WHEN task = 'click' THEN 'route' WHEN task = 'view' THEN 'noroute' ELSE 'memory' END AS category, correct::DOUBLE / n AS acc FROM sc),
 p AS (SELECT model, round(avg(CASE WHEN category = 'memory' THEN acc END), 4) AS memory, round(avg(CASE WHEN category = 'route' THEN acc END), 4) AS route, round(avg(CASE WHEN category = 'noroute' THEN acc END), 4) AS noroute, count(*) AS tasks FROM m GROUP BY model)
SELECT *, round(coalesce((route + noroute)/2, route, noroute), 4) AS all_reasoning, tasks = (SELECT count(DISTINCT task) FROM output) AS complete FROM p /* output */""",
)
def board(t: Tables):
    """Means by category, that of the two reasoning ones, and the check of the number of tasks."""
    tasks = t.output.select("task").distinct().withColumn("category", F.when(F.col("task") == "click", "route").when(F.col("task") == "view", "noroute").otherwise("memory"))
    return evaluation.leaderboard(scored(t), tasks, ("memory", "route", "noroute"), ("route", "noroute"))


@query("a18_subject_accuracy", f"WITH {_SCORED}, x AS (SELECT task, sum(correct) AS c, sum(n) AS n FROM sc GROUP BY task) SELECT coalesce(task, 'Average') AS subject, round(sum(c)::DOUBLE / sum(n), 8) AS accuracy FROM x GROUP BY ROLLUP (task) /* output */")
def subjects(t: Tables):
    return evaluation.subject_accuracy(t.output, "task").withColumn("accuracy", F.round("accuracy", 8))


@query("e3_token_and_pairwise_accuracy", "SELECT user_id, round(avg(CASE WHEN event_type <> 'view' THEN CASE WHEN event_id % 5 = event_id % 4 THEN 1.0 ELSE 0.0 END END), 8) AS token_accuracy, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 8) AS pairwise FROM events GROUP BY user_id")
def accuracies(t: Tables):
    e = t.raw("events")
    seqs = e.groupBy("user_id").agg(F.collect_list(F.struct((F.col("event_id") % 5).alias("pred"), (F.col("event_id") % 4).alias("label"), (F.col("event_type") != "view").alias("use"))).alias("s"), F.round(F.avg(evaluation.pairwise(F.col("value"), F.lit(10.0))), 8).alias("pairwise"))
    return seqs.select("user_id", F.round(evaluation.token_accuracy(F.col("s")), 8).alias("token_accuracy"), "pairwise")


@query("e4_similarity")
def similar(t: Tables):
    """BLEU-4 and ROUGE of each question against the answer after it, by conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t.dialogue.withColumn("next", F.lead("text").over(w)).where("role = 'user' and next is not null")
    return d.select("conv_id", "turn", similarity_scores("text", "next").alias("s")).groupBy("conv_id").agg(*(F.round(F.avg(f"s.{k}"), 6).alias(k) for k in ("bleu4", "rouge1", "rouge2", "rougel")))


_NAV = "nav AS (SELECT user_id AS case_id, user_id % 2 AS model, (event_id % 5)::BIGINT AS round, event_id AS step, abs((value*7919) % 2600) AS distance FROM events)"


@query(
    "e5_a19_navigation_score",
    f"""WITH {_NAV}, f AS (SELECT model, case_id, round, first(distance ORDER BY step) AS initial, min(distance) AS shortest, count(*) AS steps, min(CASE WHEN distance < 500 THEN step END) AS hit FROM nav GROUP BY 1, 2, 3),
 g AS (SELECT f.*, (SELECT count(*) FROM nav n WHERE n.case_id = f.case_id AND n.round = f.round AND n.model = f.model AND n.step <= f.hit) AS hit_no FROM f),
 c AS (SELECT model, case_id, max(initial) > 2000 AS skipped, sum(CASE WHEN hit IS NULL THEN 0 ELSE 1 END)::BIGINT AS successes, avg(CASE WHEN hit IS NULL THEN 50 ELSE hit_no END) AS steps, 1 - sum(shortest)/sum(initial) AS completion FROM g GROUP BY 1, 2)
SELECT model, case_id, skipped, successes, round(steps, 6) AS steps, round(completion, 6) AS completion FROM c""",
)
def navigation(t: Tables):
    e = t.raw("events")
    steps = e.select((F.col("user_id") % 2).alias("model"), F.col("user_id").alias("case_id"), (F.col("event_id") % 5).alias("round"), F.col("event_id").alias("step"), F.abs(F.col("value") * 7919 % 2600).alias("distance"))
    s = evaluation.navigation_score(steps)
    return s.select("model", "case_id", "skipped", "successes", F.round("steps", 6).alias("steps"), F.round("completion", 6).alias("completion"))


@query(
    "e6_next_place_inputs",
    f"""WITH h AS (SELECT traj_id, user_id, string_agg(CASE WHEN seq < m THEN loc_id::VARCHAR END, ', ' ORDER BY seq) AS history, max(CASE WHEN seq = m THEN loc_id END) AS target FROM (SELECT *, max(seq) OVER (PARTITION BY traj_id) AS m FROM visit) GROUP BY traj_id, user_id HAVING count(*) > 1),
 few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {md5_sql('traj_id', seed=3)}, traj_id) AS k FROM h) WHERE k <= 5),
 {negatives_sql('SELECT traj_id FROM few', 'traj_id', 'SELECT loc_id FROM visit', 'loc_id', 'SELECT traj_id, target AS loc_id FROM few', 5, 3)}, w AS (SELECT traj_id, list(loc_id ORDER BY rank) AS ws_ FROM neg GROUP BY traj_id HAVING count(*) = 5),
 src AS (SELECT few.*, ws_ FROM few JOIN w USING (traj_id)), {asked_sql('src', 'traj_id', "concat('Places so far: ', history, '. Which is next?')", 'target', 'ws_', 3)}""",
)
def next_place(t: Tables):
    """At most five trajectories a user, the last place to be told from five others."""
    return evaluation.next_place_inputs(t.visit, seed=3)


# What is said of a place and four options, by the case a row falls in: equal, equal but for
# blanks, near, near but for another letter, tied and settled by shared characters, tied
# to the last and so the first, and nothing alike.  The places of the options are known from how they are made.
_CASES = 7
_SAID = ("{n} lies by the old bridge", "  {n} lies by the old bridge ", "C. {n} lies near the bridge", "B. {n} lies by the new bridge", "go west", "tie", "nothing of it")
_OPTIONS = ("the market {k}", "{n} lies by the old bridge", "go up", "go wets", "tie one", "tie two")
_MEANT = (1, 1, 1, 1, 3, 4, -1)
_GIVEN = ("Z", "Z", "C", "B", "Z", "Z", "Z")


def phrased(t: Tables):
    """(model, poi_id, said, options, truth): answers in free words; the true place is 1, or 4
    in the tied cases of odd points."""
    i = (F.col("poi_id") % _CASES + 1).cast("int")
    fill = lambda form: F.replace(F.replace(F.lit(form), F.lit("{n}"), F.col("name")), F.lit("{k}"), F.col("category"))
    truth = F.when((F.col("poi_id") % _CASES == 5) & (F.col("poi_id") % 2 == 1), 4).otherwise(1)
    return t.poi.select((F.col("poi_id") % 3).alias("model"), "poi_id", F.element_at(F.array(*map(fill, _SAID)), i).alias("said"), F.array(*map(fill, _OPTIONS)).alias("options"), truth.alias("truth"))


_MEANT_SQL = f"phr AS (SELECT poi_id % 3 AS model, poi_id, ({list(_MEANT)})[poi_id % {_CASES} + 1] AS place, ({list(_GIVEN)})[poi_id % {_CASES} + 1] AS given, CASE WHEN poi_id % {_CASES} = 5 AND poi_id % 2 = 1 THEN 4 ELSE 1 END AS truth FROM poi)"


@query("e7_next_place_accuracy", f"WITH {_MEANT_SQL} SELECT model, count(*) AS n, round(avg((given = ['A', 'B', 'C', 'D', 'E'][truth + 1])::INT), 8) AS by_letter, round(avg((place = truth)::INT), 8) AS by_name FROM phr GROUP BY model")
def next_accuracy(t: Tables):
    """Accuracy by the letter given and by the option that the words come nearest to."""
    a = evaluation.next_place_accuracy(phrased(t), "said", "options", "truth", "model")
    return a.select("model", "n", F.round("by_letter", 8).alias("by_letter"), F.round("by_name", 8).alias("by_name"))


@query("e8_best_option", f"WITH {_MEANT_SQL} SELECT poi_id, place FROM phr")
def fuzzy(t: Tables):
    return evaluation.match_options(phrased(t), "said", "options").select("poi_id", "place")


def _jsd_sql(name: str, source: str, bins: str, top: float, closed: bool) -> str:
    edge, last = (str(top), "bins - 1") if closed else (f"(bins - 1)*({top}/bins)", "bins - 2")
    return f"""SELECT '{name}' AS measure, bins, (SELECT round((sum(CASE WHEN p > 0 THEN p*ln(2*p/(p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q*ln(2*q/(p + q)) ELSE 0 END))/2, 6) FROM
 (SELECT r/sum(r) OVER () AS p, g/sum(g) OVER () AS q FROM (SELECT count(*) FILTER (kind = 'real') AS r, count(*) FILTER (kind = 'generated') AS g FROM (SELECT kind, least(floor(v/({top}/bins)), {last}) AS bin FROM {source} WHERE v >= 0 AND v <= {edge}) GROUP BY bin))) AS jsd
 FROM (SELECT nullif(greatest({bins}, 0), 0)::BIGINT AS bins FROM {source} LIMIT 1)"""


_BINS = "(SELECT floor(3.5*stddev_pop(v)/pow(count(*), 1/3.0)) FROM {0})".format


@query("e9_trajectory_jsd", f"""WITH sd AS (SELECT kind, sqrt((x - nx)*(x - nx) + (y - ny)*(y - ny)) AS v FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM visit WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) WHERE nx IS NOT NULL),
 gr AS (SELECT kind, avg(sqrt((x - mx)*(x - mx) + (y - my)*(y - my))) AS v FROM (SELECT *, avg(x) OVER (PARTITION BY traj_id) AS mx, avg(y) OVER (PARTITION BY traj_id) AS my FROM visit) GROUP BY traj_id, kind),
 du AS (SELECT kind, duration AS v FROM visit), rp AS (SELECT kind, count(DISTINCT loc_id)::DOUBLE/count(*) AS v FROM visit GROUP BY traj_id, kind)
{_jsd_sql('distance', 'sd', _BINS('sd'), 10000.0, False)} UNION ALL {_jsd_sql('radius', 'gr', _BINS('gr'), 10000.0, False)} UNION ALL {_jsd_sql('duration', 'du', '48', 1.0, True)} UNION ALL {_jsd_sql('repeat_rate', 'rp', '48', 1.0, True)}""")
def jsd(t: Tables):
    return evaluation.trajectory_jsd(t.visit)


@query("e10_normalized_histogram", "WITH h AS (SELECT event_type, floor(value/5)::BIGINT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 500 GROUP BY 1, 2) SELECT event_type, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY event_type), 8) AS share, round(ln(n), 6) AS log_n FROM h")
def histogram(t: Tables):
    h = evaluation.normalized_histogram(t.raw("events"), "event_type", "value", 5.0, 0.0, 500.0)
    return h.select("event_type", "bin", "n", F.round("share", 8).alias("share"), F.round(F.log("n"), 6).alias("log_n"))


_SHOT = "concat(left(text, 40), chr(10), 'A. ', length(text), chr(10), 'B. ', item_id, chr(10), 'Answer:')"


@query("e11_few_shot", f"""WITH q AS (SELECT item_id, item_id % 5 AS subject, {_SHOT} AS said, substr('AB', (item_id % 2 + 1)::INT, 1) AS answer FROM benchmark), s AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {md5_sql('item_id', seed=1)}, item_id) AS k FROM q WHERE item_id % 4 < 2),
 m AS (SELECT b.item_id, b.subject, s.k, s.said, s.answer FROM q b JOIN s ON s.subject = b.subject AND s.k <= 3 WHERE b.item_id % 4 >= 2 UNION ALL SELECT item_id, subject, 4, said, answer FROM q WHERE item_id % 4 >= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS i FROM m)
SELECT item_id, string_agg(concat('user:', CASE WHEN i = 1 THEN concat('Questions on ', subject, ' with their answers:', chr(10), chr(10)) ELSE '' END, said, '|assistant:', answer), '|' ORDER BY k) AS messages FROM r GROUP BY item_id""")
def few_shot(t: Tables):
    """Three drawn questions of the same subject before each question, as messages."""
    i = F.col("item_id")
    b = t.raw("benchmark").select(i.alias("id"), (i % 5).alias("subject"), F.substring("text", 1, 40).alias("question"), F.array(F.length("text").cast("string"), i.cast("string")).alias("options"), F.substring(F.lit("AB"), (i % 2 + 1).cast("int"), F.lit(1)).alias("answer"))
    m = evaluation.few_shot(b.where("id % 4 >= 2"), b.where("id % 4 < 2"), 3, seed=1)
    return m.select(F.col("id").alias("item_id"), F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))
