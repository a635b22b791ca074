"""Queries over roads, lanes and junctions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spatial, topology
from .base import Tables, query


@query("j7_resolve_endpoints", "WITH k AS (SELECT concat(name, '(', category, ')') AS key, min(poi_id) AS poi_id FROM poi GROUP BY 1), e AS (SELECT e.route_id, concat(a.name, '(', a.category, ')') AS s, concat(b.name, '(', b.category, ')') AS d FROM ends e JOIN poi a ON a.poi_id = e.start_id JOIN poi b ON b.poi_id = e.dest_id) SELECT route_id, ks.poi_id AS start_poi, kd.poi_id AS dest_poi FROM e JOIN k ks ON ks.key = e.s JOIN k kd ON kd.key = e.d")
def endpoints(t: Tables):
    return resolve_endpoints(t)


def resolve_endpoints(t: Tables):
    """Routes name their ends by "name(category)"; the first point of a key is meant."""
    key = F.concat("name", F.lit("("), "category", F.lit(")"))
    first = t.poi.select(key.alias("key"), "poi_id").groupBy("key").agg(F.min("poi_id").alias("poi_id"))
    n = t.n_customers
    o = t.raw("orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("start_id"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % n).alias("dest_id"))
    named = t.poi.select("poi_id", key.alias("key"))
    e = o.join(named.select(F.col("poi_id").alias("start_id"), F.col("key").alias("s")), "start_id").join(named.select(F.col("poi_id").alias("dest_id"), F.col("key").alias("d")), "dest_id")
    return e.join(first.select(F.col("key").alias("s"), F.col("poi_id").alias("start_poi")), "s").join(first.select(F.col("key").alias("d"), F.col("poi_id").alias("dest_poi")), "d").select("route_id", "start_poi", "dest_poi")


@query("j8_a9_road_aois", "SELECT name, count(DISTINCT aoi_id) AS n, min(aoi_id) AS first, max(aoi_id) AS last FROM lane JOIN road USING (road_id) GROUP BY name")
def beside(t: Tables):
    return topology.road_aois(t.lane, t.road).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("aoi_id").alias("first"), F.max("aoi_id").alias("last"))


@query("j8_road_pois", "SELECT r.name, count(DISTINCT p.poi_id) AS n FROM (SELECT DISTINCT name, aoi_id FROM lane JOIN road USING (road_id)) r JOIN attached p USING (aoi_id) GROUP BY r.name")
def reachable(t: Tables):
    return topology.road_poi_counts(t.lane, t.road, spatial.attach_pois(t.poi, t.aoi).select("aoi_id", "poi_id"))


@query("j9_aoi_longest_road", "WITH s AS (SELECT road_id, sum(length) AS total FROM lane GROUP BY 1), b AS (SELECT DISTINCT aoi_id, road_id FROM lane), r AS (SELECT aoi_id, road_id, name, row_number() OVER (PARTITION BY aoi_id ORDER BY total DESC, name, road_id) AS k FROM b JOIN s USING (road_id) JOIN road USING (road_id)) SELECT aoi_id, count(*) AS n_roads, max(CASE WHEN k = 1 THEN name END) AS longest FROM r GROUP BY aoi_id")
def longest(t: Tables):
    return topology.aoi_longest_road(t.lane, t.road)


@query("j10_junction_of_lane", "WITH n AS (SELECT DISTINCT junction_id, road_id, name FROM lane JOIN road USING (road_id)) SELECT a.junction_id, a.road_id, string_agg(DISTINCT b.name, ' / ' ORDER BY b.name) AS others FROM n a JOIN n b ON b.junction_id = a.junction_id AND b.name <> a.name GROUP BY 1, 2")
def junctions(t: Tables):
    return topology.junction_of_lane(t.lane, t.road).select("junction_id", "road_id", F.array_join("others", " / ").alias("others"))


@query("j10_junction_sides", "SELECT lane_id, side, junction_id, array_to_string(names, ' / ') AS names, round(x, 4) AS x, round(y, 4) AS y FROM lane_side")
def sides(t: Tables):
    s = topology.lane_sides(t.edge, t.lanes, t.road)
    return s.select("lane_id", "side", "junction_id", F.array_join("names", " / ").alias("names"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("j13_aoi_pairs_by_road", "SELECT name, aoi_id, row_number() OVER (PARTITION BY name ORDER BY aoi_id) - 1 AS no, count(*) OVER (PARTITION BY name) AS n FROM (SELECT DISTINCT name, aoi_id FROM lane JOIN road USING (road_id))")
def members(t: Tables):
    """Who is on a road, and with how many: each two of them are a pair."""
    return topology.road_members(t.lane, t.road)


@query("j13_pair_counts", "WITH b AS (SELECT DISTINCT name, aoi_id FROM lane JOIN road USING (road_id)) SELECT x.name, count(*) AS pairs, min(x.aoi_id*100000 + y.aoi_id) AS first FROM b x JOIN b y ON x.name = y.name AND x.aoi_id <> y.aoi_id GROUP BY x.name")
def pairs(t: Tables):
    return topology.pair_counts_by_road(t.lane, t.road).select("name", "pairs", (F.col("a") * 100000 + F.col("b")).alias("first"))


@query("a8_junction_records", "WITH j AS (SELECT junction_id, (list_sort(list(DISTINCT name)))[1:3] AS names FROM lane JOIN road USING (road_id) GROUP BY 1 HAVING count(DISTINCT name) >= 2), l AS (SELECT junction_id, first(cx ORDER BY no DESC, road_id DESC, cx DESC, cy DESC) AS x, first(cy ORDER BY no DESC, road_id DESC, cx DESC, cy DESC) AS y FROM lane JOIN aoi USING (aoi_id) GROUP BY 1) SELECT junction_id, array_to_string(names, ' / ') AS name, x, y FROM j JOIN l USING (junction_id) /* road lane aoi */")
def records(t: Tables):
    lanes = t.lane.join(t.aoi.select("aoi_id", F.col("cx").alias("x"), F.col("cy").alias("y")), "aoi_id")
    return topology.junction_records(lanes, t.road).select("junction_id", F.array_join("names", " / ").alias("name"), "x", "y")


@query("a8_junction_names", "SELECT junction_id, string_agg(DISTINCT name, ' / ' ORDER BY name) AS name, count(DISTINCT name) AS n FROM lane JOIN road USING (road_id) GROUP BY junction_id")
def names(t: Tables):
    j = topology.junction_names(t.lane, t.road)
    return j.select("junction_id", F.array_join("names", " / ").alias("name"), F.size("names").cast("long").alias("n"))


@query("j14_road_links", "WITH n AS (SELECT DISTINCT junction_id, name FROM lane JOIN road USING (road_id)) SELECT a.name, count(DISTINCT b.name) AS n, min(b.name) AS first FROM n a JOIN n b ON a.junction_id = b.junction_id AND a.name <> b.name GROUP BY a.name")
def links(t: Tables):
    return topology.road_links(topology.junction_names(t.lane, t.road)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("first"))


def sided_lanes(t: Tables):
    """Lanes with ids and side lanes: a lane's side lanes are those of its road and
    junction that come after it."""
    order = Window.partitionBy("road_id").orderBy("junction_id", "no", "aoi_id", "length")
    lanes = t.lane.withColumn("k", F.row_number().over(order).cast("long"))
    lane_id = F.col("road_id") * 1000000 + F.col("k")
    beside = F.when(F.lead("junction_id").over(order) == F.col("junction_id"), F.array(lane_id + 1)).otherwise(F.array().cast("array<bigint>"))
    return lanes.select(lane_id.alias("lane_id"), "road_id", F.col("k").alias("no"), "length", beside.alias("side_ids"))


@query(
    "a6_road_length_estimate",
    """WITH RECURSIVE k AS (SELECT road_id, junction_id, length, row_number() OVER w AS i, coalesce(lead(junction_id) OVER w = junction_id, false) AS sided FROM lane WINDOW w AS (PARTITION BY road_id ORDER BY junction_id, no, aoi_id, length)),
 walk AS (SELECT road_id, i, length AS total, sided AS covers_next FROM k WHERE i = 1 UNION ALL SELECT k.road_id, k.i, w.total + CASE WHEN w.covers_next THEN 0 ELSE k.length END, NOT w.covers_next AND k.sided FROM walk w JOIN k ON k.road_id = w.road_id AND k.i = w.i + 1),
 last AS (SELECT road_id, total FROM (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY i DESC) AS r FROM walk) WHERE r = 1),
 f AS (SELECT road_id, CASE WHEN sided THEN 1 ELSE 0 END AS sides FROM k WHERE i = 1)
SELECT name, round(sum(total) / (1 + first(sides ORDER BY road_id)), 6) AS length FROM last JOIN f USING (road_id) JOIN road USING (road_id) GROUP BY name""",
)
def length_estimate(t: Tables):
    return topology.road_length_estimate(sided_lanes(t), t.road).withColumn("length", F.round("length", 6))


def junction_points(t: Tables):
    j = F.col("junction_id")
    return t.lane.join(t.road, "road_id").select("name", "junction_id").distinct().withColumns({"x": ((j * j * 13 + j * 6007) % 10007).cast("double"), "y": ((j * j * 7 + j * 3001) % 10009).cast("double")})


@query(
    "a7_road_endpoints",
    """WITH p AS (SELECT DISTINCT name, junction_id, (junction_id*junction_id*13 + junction_id*6007) % 10007 AS x, (junction_id*junction_id*7 + junction_id*3001) % 10009 AS y FROM lane JOIN road USING (road_id)),
 s AS (SELECT name, max(x) - min(x) >= max(y) - min(y) AS wide, first(junction_id ORDER BY x, junction_id) AS w, first(junction_id ORDER BY x DESC, junction_id DESC) AS e, first(junction_id ORDER BY y, junction_id) AS s, first(junction_id ORDER BY y DESC, junction_id DESC) AS n, count(*) AS c FROM p GROUP BY name)
SELECT name, CASE WHEN wide THEN w ELSE s END AS start_id, CASE WHEN wide THEN e ELSE n END AS end_id FROM s WHERE c >= 2""",
)
def road_ends(t: Tables):
    return topology.road_endpoints(junction_points(t))


@query("j18_landmark_for_road", "WITH f AS (SELECT road_id, first(aoi_id ORDER BY no, junction_id, aoi_id) AS aoi_id FROM lane JOIN attached_ids USING (aoi_id) GROUP BY road_id), x AS (SELECT 1) SELECT r.road_id, f.aoi_id FROM road r LEFT JOIN f USING (road_id) /* poi aoi */".replace("attached_ids", "(SELECT DISTINCT aoi_id FROM attached)"))
def landmarks(t: Tables):
    has = spatial.attach_pois(t.poi, t.aoi).select("aoi_id").distinct()
    first = t.lane.join(has, "aoi_id").groupBy("road_id").agg(F.min(F.struct("no", "junction_id", "aoi_id")).alias("m")).select("road_id", F.col("m.aoi_id").alias("aoi_id"))
    return t.road.select("road_id").join(first, "road_id", "left")
