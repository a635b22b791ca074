"""Queries over trajectories and routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, routes
from ..operators import sequences, spatial
from .base import Tables, number_sql, query


@query("w1_step_distances", "SELECT traj_id, seq, round(d, 6) AS distance FROM (SELECT traj_id, seq, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM visit WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) WHERE d IS NOT NULL")
def steps(t: Tables):
    return sequences.step_distances(t.visit).select("traj_id", "seq", F.round("distance", 6).alias("distance"))


@query("w2_durations", "SELECT traj_id, round(sum(duration)*1440, 2) AS stayed, count(*) AS n FROM visit GROUP BY traj_id")
def durations(t: Tables):
    return t.visit.groupBy("traj_id").agg(F.round(F.sum("duration") * 1440, 2).alias("stayed"), F.count(F.lit(1)).alias("n"))


@query("w3_gyration_radius", "WITH c AS (SELECT traj_id, avg(x) AS mx, avg(y) AS my FROM visit GROUP BY 1) SELECT traj_id, round(avg(sqrt((x-mx)*(x-mx)+(y-my)*(y-my))), 4) AS radius FROM visit JOIN c USING (traj_id) GROUP BY traj_id")
def radius(t: Tables):
    return sequences.gyration_radius(t.visit).select("traj_id", F.round("radius", 4).alias("radius"))


@query("w4_periodicity", "SELECT traj_id, round(count(DISTINCT loc_id)::DOUBLE / count(*), 6) AS rate FROM visit GROUP BY traj_id")
def periodicity(t: Tables):
    return t.visit.groupBy("traj_id").agg(F.round(F.count_distinct("loc_id") / F.count(F.lit(1)), 6).alias("rate"))


_TOP = """n AS (SELECT traj_id, loc_id, count(*) AS n FROM visit GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY n DESC, loc_id) AS rank, n::DOUBLE / sum(n) OVER (PARTITION BY traj_id) AS freq FROM n),
 s AS (SELECT traj_id, unnest(range(1, 4)) AS rank FROM (SELECT DISTINCT traj_id FROM visit)), topk AS (SELECT s.traj_id, s.rank, coalesce(loc_id, -1) AS loc_id, coalesce(freq, 0) AS freq FROM s LEFT JOIN r USING (traj_id, rank))"""


@query("w5_topk_locations", f"WITH {_TOP} SELECT traj_id, rank, loc_id, round(freq, 6) AS freq FROM topk /* visit */")
def topk(t: Tables):
    return sequences.topk_locations(t.visit, 3).withColumn("freq", F.round("freq", 6))


@query("w5_topk_profile", f"WITH {_TOP} SELECT rank, round(avg(freq), 6) AS mean_freq, count(*) FILTER (WHERE loc_id >= 0) AS n FROM topk GROUP BY rank /* visit */")
def profile(t: Tables):
    return sequences.topk_locations(t.visit, 3).groupBy("rank").agg(F.round(F.avg("freq"), 6).alias("mean_freq"), F.count(F.when(F.col("loc_id") >= 0, 1)).alias("n"))


@query("w5_topk_mass", f"WITH {_TOP}, m AS (SELECT loc_id, count(*) AS n FROM topk WHERE loc_id <> -1 GROUP BY 1) SELECT loc_id, n, round(n::DOUBLE / sum(n) OVER (), 8) AS share FROM m /* visit */")
def mass(t: Tables):
    return sequences.topk_mass(t.visit, 3).withColumn("share", F.round("share", 8))


@query("w6_history_target", "SELECT traj_id, coalesce(string_agg(CASE WHEN seq < m THEN loc_id::VARCHAR END, ',' ORDER BY seq), '') AS history, max(CASE WHEN seq = m THEN loc_id END) AS target FROM (SELECT *, max(seq) OVER (PARTITION BY traj_id) AS m FROM visit) GROUP BY traj_id")
def split(t: Tables):
    h = sequences.history_target(t.visit)
    return h.select("traj_id", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"), "target")


def merged_routes(t: Tables, least: int = 300):
    return t.route.select("route_id", "start_id", "dest_id", sequences.merge_steps(F.col("routes"), least).alias("merged"))


_MERGE = """s AS (SELECT route_id, road_name AS name, direction AS dir, road_length AS len, row_number() OVER (PARTITION BY route_id ORDER BY no, road_id, aoi_id, road_length) AS i FROM step),
 fold AS (SELECT route_id, i, ''::VARCHAR AS done, name, dir, len FROM s WHERE i = 1
  UNION ALL SELECT s.route_id, s.i,
   CASE WHEN f.name = s.name AND f.dir = s.dir AND (f.len < 300 OR s.len < 300) THEN f.done WHEN f.len < 300 THEN f.done ELSE concat(f.done, f.name, '/', f.dir, '/', f.len, ';') END,
   s.name, s.dir, CASE WHEN f.name = s.name AND f.dir = s.dir AND (f.len < 300 OR s.len < 300) THEN f.len + s.len ELSE s.len END FROM fold f JOIN s ON s.route_id = f.route_id AND s.i = f.i + 1),
 ended AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY i DESC) AS r FROM fold)"""


@query("w7_merge_route", f"WITH RECURSIVE {_MERGE} SELECT route_id, concat(done, CASE WHEN len >= 300 THEN concat(name, '/', dir, '/', len, ';') ELSE '' END) AS stretches FROM ended WHERE r = 1 /* step */")
def merge(t: Tables):
    text = F.transform("merged", lambda m: F.concat(m["road_name"], F.lit("/"), m["direction"], F.lit("/"), m["length"].cast("string"), F.lit(";")))
    return merged_routes(t).select("route_id", F.array_join(text, "").alias("stretches"))


NARRATED = f"""{_MERGE}, stretch AS (SELECT route_id, list_filter(string_split(concat(done, CASE WHEN len >= 300 THEN concat(name, '/', dir, '/', len, ';') ELSE '' END), ';'), lambda x: x <> '') AS l FROM ended WHERE r = 1),
 told AS (SELECT route_id, list_transform(l, lambda x, i: concat(CASE WHEN i > 1 THEN concat('at the junction turn into ', split_part(x, '/', 1), ', ') ELSE '' END, 'walk along ', split_part(x, '/', 1), ' for ', split_part(x, '/', 3), ' meters ', split_part(x, '/', 2))) AS parts FROM stretch)"""


@query("w8_narrate_route", f"WITH RECURSIVE {NARRATED} SELECT route_id, array_to_string(parts, '; ') AS text FROM told /* step */")
def narrated(t: Tables):
    return merged_routes(t).select("route_id", sequences.narrate(F.col("merged")).alias("text"))


@query("w9_step_landmarks", """WITH sn AS (SELECT DISTINCT route_id, aoi_id FROM step), nr AS (SELECT a.aoi_id, a.cx, a.cy, p.poi_id, p.x, p.y, sqrt((p.x - a.cx)*(p.x - a.cx) + (p.y - a.cy)*(p.y - a.cy)) AS d FROM aoi a JOIN poi p ON abs(p.x - a.cx) <= 200 AND abs(p.y - a.cy) <= 200),
 rk AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY d, poi_id) AS rank FROM nr WHERE d <= 200), v AS (SELECT sn.route_id, rk.*, (b.x - cx)*(rk.y - cy) - (b.y - cy)*(rk.x - cx) AS side FROM sn JOIN rk USING (aoi_id) JOIN ends e ON e.route_id = sn.route_id JOIN poi b ON b.poi_id = e.dest_id WHERE rank <= 3)
SELECT concat(route_id, '-', aoi_id) AS center_id, rank, poi_id, CASE WHEN side > 0 THEN 'left' WHEN side < 0 THEN 'right' ELSE 'on the line' END AS side FROM v /* lane road */""")
def landmarks(t: Tables):
    """The three nearest points within 200 m of each step's area centre, with their
    side of the heading to the destination."""
    ends = t.route.select("route_id", "start_id", "dest_id").join(t.poi.select(F.col("poi_id").alias("dest_id"), F.col("x").alias("dx"), F.col("y").alias("dy")), "dest_id")
    centre = t.aoi.select("aoi_id", "cx", "cy")
    steps_ = t.step.select("route_id", "aoi_id").distinct().join(centre, "aoi_id").join(ends, "route_id")
    c = steps_.select(F.concat_ws("-", "route_id", "aoi_id").alias("center_id"), "cx", "cy", "dx", "dy")
    near = spatial.nearest_points(centre, t.poi.select("poi_id", "x", "y", F.lit("any").alias("kind")), 200.0, 3, "kind")
    # ranked once an area's centre, however many steps pass it
    top = c.join(near, ["cx", "cy"])
    side = geo.side_of(F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy"), F.col("cx"), F.col("cy"), F.col("x"), F.col("y"))
    return top.select("center_id", F.col("rank").cast("long"), "poi_id", side.alias("side"))


@query("w10_dedup_routes", "SELECT data_source, lang, min(doc_id) AS doc_id FROM sft GROUP BY data_source, lang, text")
def dedup(t: Tables):
    return sequences.dedup_first(t.sft, ["text", "data_source", "lang"], "doc_id").select("data_source", "lang", "doc_id")


@query("w11_nearest_per_key", "SELECT road_name, direction, first(route_id ORDER BY road_length, route_id, no) AS route_id, min(road_length) AS road_length FROM step GROUP BY road_name, direction")
def nearest(t: Tables):
    m = F.min(F.struct("road_length", "route_id", "no")).alias("m")
    return t.step.groupBy("road_name", "direction").agg(m).select("road_name", "direction", "m.route_id", "m.road_length")


_TEXT = """phr AS (SELECT route_id, string_agg(concat('walk along ', road_name, ' for ', road_length, ' meters ', direction), ', ' ORDER BY no, road_id, aoi_id, road_length) AS text, count(*) AS n FROM step GROUP BY route_id)"""


@query("t15_t7_route_text", f"WITH {_TEXT} SELECT p.route_id, text, (SELECT sum(road_length) FROM step s WHERE s.route_id = p.route_id)::BIGINT AS total FROM phr p WHERE (n + 1)/2.0 <= 12 /* step */")
def route_texts(t: Tables):
    from ..functions.text import route_length

    r = t.route.where(routes.short_route(F.col("routes"))).select("route_id", routes.route_text(F.col("routes")).alias("text"))
    return r.withColumn("total", route_length(F.col("text")))


TOTALS = """tot AS (SELECT route_id, sum(CASE WHEN direction = 'north' THEN road_length WHEN direction LIKE 'north%' THEN road_length*0.7 ELSE 0 END)::DOUBLE AS north, sum(CASE WHEN direction = 'south' THEN road_length WHEN direction LIKE 'south%' THEN road_length*0.7 ELSE 0 END)::DOUBLE AS south,
 sum(CASE WHEN direction = 'east' THEN road_length WHEN direction LIKE '%east' THEN road_length*0.7 ELSE 0 END)::DOUBLE AS east, sum(CASE WHEN direction = 'west' THEN road_length WHEN direction LIKE '%west' THEN road_length*0.7 ELSE 0 END)::DOUBLE AS west FROM step GROUP BY route_id),
 net AS (SELECT route_id, round(east - west, 3) AS de, round(north - south, 3) AS dn FROM tot)"""


@query("t16_t17_direction_totals", f"WITH {TOTALS} SELECT route_id, de AS east_m, dn AS north_m, CASE WHEN abs(de) > abs(dn) THEN 'east-west' WHEN abs(dn) > abs(de) THEN 'south-north' END AS axis, CASE WHEN abs(de) > abs(dn) THEN CASE WHEN de > 0 THEN 'east' ELSE 'west' END WHEN abs(dn) > abs(de) THEN CASE WHEN dn > 0 THEN 'north' ELSE 'south' END END AS main FROM net /* step */")
def totals(t: Tables):
    return route_directions(t).select("route_id", "east_m", "north_m", "axis", "main")


def route_directions(t: Tables):
    d = t.route.select("route_id", "start_id", "dest_id", routes.direction_totals(F.col("routes")).alias("t"))
    d = d.withColumn("r", F.struct((F.round(F.col("t.east") - F.col("t.west"), 3)).alias("east"), F.lit(0.0).alias("west"), F.round(F.col("t.north") - F.col("t.south"), 3).alias("north"), F.lit(0.0).alias("south")))
    e, n, axis, main = routes.net_direction(F.col("r"))
    return d.select("route_id", "start_id", "dest_id", e.alias("east_m"), n.alias("north_m"), axis.alias("axis"), main.alias("main"))


@query("f6_route_size_filter", "SELECT route_id, count(*) AS n FROM step GROUP BY route_id HAVING count(*) BETWEEN 3 AND 12")
def sized(t: Tables):
    return t.route.select("route_id", F.size("routes").cast("long").alias("n")).where("n between 3 and 12")


@query("a20_visit_distribution", "WITH k AS (SELECT kind, loc_id, lag(loc_id) OVER (PARTITION BY traj_id ORDER BY seq) AS b FROM visit), n AS (SELECT kind, loc_id, count(*) AS n FROM k WHERE b IS NULL OR b <> loc_id GROUP BY 1, 2) SELECT kind, loc_id, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY kind), 8) AS share FROM n")
def distribution(t: Tables):
    return sequences.visit_distribution(t.visit).withColumn("share", F.round("share", 8))


@query("a16_user_sets", "SELECT user_id, count(DISTINCT traj_id) AS trajectories, count(DISTINCT loc_id) AS places, count(*) AS visits FROM visit GROUP BY user_id")
def user_sets(t: Tables):
    return t.visit.groupBy("user_id").agg(F.count_distinct("traj_id").alias("trajectories"), F.count_distinct("loc_id").alias("places"), F.count(F.lit(1)).alias("visits"))


@query("t20_drop_step", f"""WITH f AS (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY no, road_id, aoi_id, road_length) - 1 AS i, concat('walk along ', road_name, ' for ', road_length, ' meters ', direction) AS p, count(*) OVER (PARTITION BY route_id) AS n FROM step),
 d AS (SELECT *, {number_sql(1 << 30, 'route_id', seed=6)} % n AS gone FROM f WHERE n > 1)
SELECT route_id, string_agg(CASE WHEN i <> gone THEN p END, ', ' ORDER BY i) AS lacking, string_agg(p, ', ' ORDER BY md5(concat_ws('#', route_id, i))) AS scrambled, max(CASE WHEN i = gone THEN p END) AS missing FROM d GROUP BY route_id /* lane road */""")
def dropped(t: Tables):
    """Route text without one step, and in scrambled order, both drawn by hash."""
    from ..functions.text import keyed_number

    phrases = routes.route_phrases(F.col("routes"))
    r = t.route.where("size(routes) > 1").select("route_id", phrases.alias("p"))
    no = keyed_number(1 << 30, F.col("route_id"), seed=6) % F.size("p")
    mixed = F.array_sort(F.transform("p", lambda x, i: F.struct(F.md5(F.concat_ws("#", F.col("route_id").cast("string"), i.cast("string"))).alias("h"), x.alias("x"))))
    return r.select("route_id", F.array_join(F.filter("p", lambda x, i: i != no), ", ").alias("lacking"), F.array_join(F.transform(mixed, lambda s: s["x"]), ", ").alias("scrambled"), F.element_at("p", (no + 1).cast("int")).alias("missing"))
