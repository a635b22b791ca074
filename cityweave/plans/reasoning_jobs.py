"""Reasoning dialogues: from points and areas to roads, areas and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routes, text
from ..operators import sampling
from ..operators.reasoning import CHOOSE, THINK, axes_text, lengths_text, reasoned, tenths, totals_text, whole
from .base import Tables, md5_sql, query
from .mcq_jobs import _ENDS, ends_of, others, road_rows, road_rows_sql
from .sequence_jobs import TOTALS

FIRST = 1000

# the SQL twins of operators.reasoning
_WHOLE = "round(round({0}, 3), 0)::BIGINT".format


def _TENTHS(v: str) -> str:
    return f"concat(CASE WHEN round(({v})*10, 0) < 0 THEN '-' ELSE '' END, abs(round(({v})*10, 0)::BIGINT) // 10, '.', abs(round(({v})*10, 0)::BIGINT) % 10)"


def _totals_sql(number=_WHOLE) -> str:
    return "concat('Step 1. Metres by direction, diagonal ones at 0.7 for both: ', " + ", ', ', ".join(f"'{d} ', {number(d)}" for d in ("north", "east", "south", "west")) + ", '. ')"


def _axes_sql(number=_WHOLE) -> str:
    def axis(a: str, b: str) -> str:
        more, less = f"greatest({a}, {b})", f"least({a}, {b})"
        return f"{number(more)}, '-', {number(less)}, '=', {number(f'{more} - {less}')}, ' towards ', CASE WHEN round({a}, 3) >= round({b}, 3) THEN '{a}' ELSE '{b}' END"

    return f"concat('Step 2. South-north ', {axis('north', 'south')}, '; east-west ', {axis('east', 'west')}, '. ')"


def reasoned_sql(source: str, key: str, task: str, route: str, question: str, steps: str, right: str, wrong: str, seed: int, several: str = "false") -> str:
    """The SQL twin of reasoned() as (id, diag), where wrong is a list; ends a WITH."""
    return f"""dlg AS (SELECT {key} AS k, {route} AS way, {question} AS q, {steps} AS st, ({right})::VARCHAR AS o, {wrong} AS ws, {several} AS several FROM {source}),
 dopt AS (SELECT k, 0 AS i, o FROM dlg UNION ALL SELECT k, unnest(range(1, len(ws) + 1)), unnest(ws)::VARCHAR FROM dlg), dpl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws('#', k, i, '{seed}'))) AS place FROM dopt),
 dch AS (SELECT k, string_agg(concat(substr('ABCD', place::INT, 1), '. ', o), chr(10) ORDER BY place) AS lines, substr('ABCD', max(CASE WHEN i = 0 THEN place END)::INT, 1) AS letter FROM dpl GROUP BY k)
SELECT concat('city-{task}-', k) AS id, CASE WHEN several THEN concat('user:', q, chr(10), lines, chr(10), 'Recall the way first.', '|assistant:', way, '|user:{CHOOSE}|assistant:Answer: ', letter, '. ', st)
 ELSE concat('user:', way, '. ', q, chr(10), lines, chr(10), '{THINK}', '|assistant:Answer: ', letter, '. ', st) END AS diag FROM dlg JOIN dch USING (k)"""


def flat(df: DataFrame, key: str, task: str) -> DataFrame:
    said = F.array_join(F.transform("diag", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return df.select(F.concat(F.lit(f"city-{task}-"), F.col(key).cast("string")).alias("id"), said.alias("diag"))


def with_totals(d: DataFrame) -> DataFrame:
    return d.withColumns({"t": routes.direction_totals(F.col("steps")), "lengths": F.transform("steps", lambda s: s["road_length"])})


# R1: to a road


def _to_road(t: Tables, ends: str, kind: str, seed: int) -> DataFrame:
    d = with_totals(road_rows(t, ends, "geometric"))
    n = F.abs("off")
    runs = F.when(F.col("up"), "south-north").otherwise("east-west")
    steps = F.concat(totals_text(F.col("t")), axes_text(F.col("t")), F.lit("Step 3. "), "road", F.lit(" runs "), runs, F.lit(", so the metres across it count: "), n.cast("string"), F.lit(" towards "), "main", F.lit("."))
    start = f"start_{ends}"
    if kind == "dis":
        q, right, wrong = F.concat(F.lit("How far is "), "road", F.lit(" from "), start, F.lit("?")), n, F.array((n / 2).cast("long"), n * 2, n + 500)
    else:
        q, right, wrong = F.concat(F.lit("In which direction is "), "road", F.lit(" from "), start, F.lit("?")), F.col("main"), others(F.col("main"))
    return reasoned(d, "route_id", F.col("text"), q, steps, right, wrong, seed)


def _to_road_sql(ends: str, kind: str, task: str, seed: int) -> str:
    steps = f"concat({_totals_sql()}, {_axes_sql()}, 'Step 3. ', road_, ' runs ', CASE WHEN up_ THEN 'south-north' ELSE 'east-west' END, ', so the metres across it count: ', abs(off_), ' towards ', main_, '.')"
    question = f"concat('{'How far is ' if kind == 'dis' else 'In which direction is '}', road_, ' from ', start_{ends}, '?')"
    right, wrong = ("abs(off_)", "[trunc(abs(off_)/2)::BIGINT, abs(off_)*2, abs(off_) + 500]") if kind == "dis" else ("main_", "list_filter(['north','east','south','west'], lambda x: x <> main_)")
    return f"{road_rows_sql(ends, "geometric")}, full_ AS (SELECT * FROM src JOIN tot USING (route_id)), {reasoned_sql('full_', 'route_id', task, 'text', question, steps, right, wrong, seed)} /* poi aoi inside ends lane road step */"


for _ends, _what in (("name", "poi2rd"), ("aoi", "aoi2rd")):
    for _kind in ("dis", "dir"):
        _task = f"{_what}_{_kind}"
        query(f"r1_{_task}", _to_road_sql(_ends, _kind, _task, 31))(lambda t, e=_ends, k=_kind, n=_task: flat(_to_road(t, e, k, 31), "route_id", n))


# R2: from a point to an area


def _drawn(t: Tables, dest: str) -> DataFrame:
    d = with_totals(ends_of(t)).where(F.col("start_name").isNotNull() & F.col(dest).isNotNull())
    return sampling.sample_n(d, FIRST, "route_id", 1)


def _drawn_sql(dest: str) -> str:
    return f"""{_ENDS}, {TOTALS}, sl AS (SELECT route_id, list(road_length ORDER BY no, road_id, aoi_id, road_length) AS lengths FROM step GROUP BY route_id),
 src AS (SELECT rr.*, north, east, south, west, de, dn, lengths FROM rr JOIN tot USING (route_id) JOIN net USING (route_id) JOIN sl USING (route_id) WHERE start_name IS NOT NULL AND {dest} IS NOT NULL ORDER BY {md5_sql('rr.route_id', seed=1)}, rr.route_id LIMIT {FIRST})"""


_CHAIN = "CASE WHEN len(lengths) > 1 THEN array_to_string(list_transform(range(2, len(lengths) + 1), lambda i: concat(list_sum(lengths[1:i - 1])::BIGINT, '+', lengths[i], '=', list_sum(lengths[1:i])::BIGINT)), ', ') ELSE '' END"
_STRETCHES = "concat('Step 1. The stretches: ', array_to_string(list_transform(lengths, lambda v: concat(v, 'm')), ', '), '. ')"


def distance_steps(total: Column) -> Column:
    chain, _ = text.sum_chain_text(F.col("lengths"))
    return F.concat(lengths_text(F.col("lengths")), F.lit("Step 2. Added up: "), chain, F.lit(". So it is "), total, F.lit(" m."))


def _distance_steps_sql(total: str) -> str:
    return f"concat({_STRETCHES}, 'Step 2. Added up: ', {_CHAIN}, '. So it is ', {total}, ' m.')"


@query("r2_poi2aoi_dis", f"WITH {_drawn_sql('dest_aoi')}, {reasoned_sql('src', 'route_id', 'poi2aoi_dis', 'text', "concat('How many metres is it from ', start_name, ' to ', dest_aoi, '?')", _distance_steps_sql('length'), 'length', '[trunc(length/2)::BIGINT, length*2, length + 500]', 32)} /* poi aoi inside ends lane road step */")
def poi2aoi_dis(t: Tables):
    n = F.col("length")
    q = F.concat(F.lit("How many metres is it from "), "start_name", F.lit(" to "), "dest_aoi", F.lit("?"))
    return flat(reasoned(_drawn(t, "dest_aoi"), "route_id", F.col("text"), q, distance_steps(n.cast("string")), n, F.array((n / 2).cast("long"), n * 2, n + 500), 32), "route_id", "poi2aoi_dis")


def main_of(d: DataFrame) -> DataFrame:
    """Adds the overall direction; ties are left out."""
    r = d.withColumn("r", F.struct(F.round(F.col("t.east") - F.col("t.west"), 3).alias("east"), F.lit(0.0).alias("west"), F.round(F.col("t.north") - F.col("t.south"), 3).alias("north"), F.lit(0.0).alias("south")))
    e, n, _, main = routes.net_direction(F.col("r"))
    return r.withColumns({"de": e, "dn": n, "main": main}).where("main is not null")


def direction_steps(number) -> Column:
    more, less = F.greatest(F.abs("de"), F.abs("dn")), F.least(F.abs("de"), F.abs("dn"))
    return F.concat(totals_text(F.col("t"), number), axes_text(F.col("t"), number), F.lit("Step 3. "), number(more), F.lit(" is more than "), number(less), F.lit(", so it lies "), "main", F.lit("."))


_MAIN = "mn AS (SELECT *, CASE WHEN abs(de) > abs(dn) THEN CASE WHEN de > 0 THEN 'east' ELSE 'west' END ELSE CASE WHEN dn > 0 THEN 'north' ELSE 'south' END END AS main FROM src WHERE abs(de) <> abs(dn))"


def _direction_steps_sql(number) -> str:
    return f"concat({_totals_sql(number)}, {_axes_sql(number)}, 'Step 3. ', {number('greatest(abs(de), abs(dn))')}, ' is more than ', {number('least(abs(de), abs(dn))')}, ', so it lies ', main, '.')"


_WRONG_DIR = "list_filter(['north','east','south','west'], lambda x: x <> main)"


@query("r2_poi2aoi_dir", f"WITH {_drawn_sql('dest_aoi')}, {_MAIN}, {reasoned_sql('mn', 'route_id', 'poi2aoi_dir', 'text', "concat('In which direction is ', dest_aoi, ' from ', start_name, '?')", _direction_steps_sql(_WHOLE), 'main', _WRONG_DIR, 33)} /* poi aoi inside ends lane road step */")
def poi2aoi_dir(t: Tables):
    d = main_of(_drawn(t, "dest_aoi"))
    q = F.concat(F.lit("In which direction is "), "dest_aoi", F.lit(" from "), "start_name", F.lit("?"))
    return flat(reasoned(d, "route_id", F.col("text"), q, direction_steps(whole), F.col("main"), others(F.col("main")), 33), "route_id", "poi2aoi_dir")


# R3: between points, in styles


_STYLES = "sty AS (SELECT *, ntile({n}) OVER (ORDER BY {h}, route_id) AS style FROM {source})"


@query("r3_poi2poi_dir", f"WITH {_drawn_sql('dest_name')}, {_MAIN}, {_STYLES.format(n=4, h=md5_sql('route_id', seed=1), source='mn')}, {reasoned_sql('sty', 'route_id', 'poi2poi_dir', 'text', "concat('In which direction is ', dest_name, ' from ', start_name, '?')", f'CASE WHEN style % 2 = 1 THEN {_direction_steps_sql(_WHOLE)} ELSE {_direction_steps_sql(_TENTHS)} END', 'main', _WRONG_DIR, 34, 'style > 2')} /* poi aoi inside ends lane road step */")
def poi2poi_dir(t: Tables):
    """Four styles by hash segment: one or two rounds, whole metres or tenths."""
    d = sampling.style_segments(main_of(_drawn(t, "dest_name")), 4, "route_id", FIRST, 1)
    q = F.concat(F.lit("In which direction is "), "dest_name", F.lit(" from "), "start_name", F.lit("?"))
    steps = F.when(F.col("style") % 2 == 1, direction_steps(whole)).otherwise(direction_steps(tenths))
    return flat(reasoned(d, "route_id", F.col("text"), q, steps, F.col("main"), others(F.col("main")), 34, F.col("style") > 2), "route_id", "poi2poi_dir")


_ONLY = "Count nothing but the metres on the way. "
_WALK = f"concat(CASE WHEN style % 4 IN (3, 0) THEN '{_ONLY}' ELSE '' END, 'How many metres do I walk from ', start_name, ' to ', dest_name, '?')"


def _either_sql(v: str, half: bool = False) -> str:
    return f"CASE WHEN style % 2 = 0 THEN ({f'trunc({v})::BIGINT' if half else v})::VARCHAR ELSE {_TENTHS(v)} END"


@query("r3_poi2poi_dis", f"WITH {_drawn_sql('dest_name')}, {_STYLES.format(n=8, h=md5_sql('route_id', seed=1), source='src')}, {reasoned_sql('sty', 'route_id', 'poi2poi_dis', 'text', _WALK, _distance_steps_sql(_either_sql('length')), _either_sql('length'), f"[{_either_sql('length*2')}, {_either_sql('length/2', True)}, {_either_sql('length - 1000')}]", 35, 'style > 4')} /* poi aoi inside ends lane road step */")
def poi2poi_dis(t: Tables):
    """Eight styles by hash segment: one or two rounds, with or without the limit to
    roads, tenths or whole metres."""
    d = sampling.style_segments(_drawn(t, "dest_name"), 8, "route_id", FIRST, 1)
    n, even = F.col("length"), F.col("style") % 2 == 0
    either = lambda v: F.when(even, v.cast("long").cast("string")).otherwise(tenths(v))
    q = F.concat(F.when((F.col("style") % 4).isin(3, 0), _ONLY).otherwise(""), F.lit("How many metres do I walk from "), "start_name", F.lit(" to "), "dest_name", F.lit("?"))
    return flat(reasoned(d, "route_id", F.col("text"), q, distance_steps(either(n)), either(n), F.array(either(n * 2), either(n / 2), either(n - 1000)), 35, F.col("style") > 4), "route_id", "poi2poi_dis")
