"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, timefns
from ..operators import topology
from .base import Tables, coord_sql, query

_PAIR = """pair AS (SELECT a.poi_id, a.x AS x1, a.y AS y1, a.lng AS lng1, a.lat AS lat1, b.x AS x2, b.y AS y2, b.lng AS lng2, b.lat AS lat2
  FROM poi a JOIN poi b ON b.poi_id = (a.poi_id * 31 + 7) % (SELECT count(*) FROM customer))"""


def _pairs(t: Tables):
    n = t.raw("customer").count()
    a = t.poi.select("poi_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("lng").alias("lng1"), F.col("lat").alias("lat1"), ((F.col("poi_id") * 31 + 7) % n).alias("other"))
    b = t.poi.select(F.col("poi_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("lng").alias("lng2"), F.col("lat").alias("lat2"))
    return a.join(b, "other")


_AZ = "((((round(90 - degrees(atan2(y2 - y1, x2 - x1)), 2)) % 360) + 360) % 360)"
_BR = "((degrees(atan2(sin(radians(lng2-lng1))*cos(radians(lat2)), cos(radians(lat1))*sin(radians(lat2)) - sin(radians(lat1))*cos(radians(lat2))*cos(radians(lng2-lng1)))) % 360) + 360) % 360"
_D8 = "(['north','northeast','east','southeast','south','southwest','west','northwest'])[floor((({0} + 22.5) % 360)/45)::INT + 1]"
_D4 = "(['north','east','south','west'])[floor((({0} + 45) % 360)/90)::INT + 1]"


@query("g1_g4_distance_and_angle", f"WITH {_PAIR} SELECT poi_id, round(sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)), 6) AS planar, round(2*6371.0*asin(sqrt(pow(sin(radians(lat2-lat1)/2),2)+cos(radians(lat1))*cos(radians(lat2))*pow(sin(radians(lng2-lng1)/2),2))), 3) AS haversine, round({_AZ}, 2) AS azimuth, round({_BR}, 4) AS bearing FROM pair")
def distance_and_angle(t: Tables):
    c = F.col
    return _pairs(t).select(
        "poi_id",
        F.round(geo.dist_xy(c("x1"), c("y1"), c("x2"), c("y2")), 6).alias("planar"),
        geo.haversine_km(c("lng1"), c("lat1"), c("lng2"), c("lat2")).alias("haversine"),
        F.round(geo.azimuth_xy(c("x1"), c("y1"), c("x2"), c("y2")), 2).alias("azimuth"),
        F.round(geo.bearing(c("lat1"), c("lng1"), c("lat2"), c("lng2")), 4).alias("bearing"),
    )


@query(
    "g5_g8_directions",
    f"""WITH {_PAIR}, a AS (SELECT *, {_AZ} AS az FROM pair), d AS (SELECT *, {_D8.format('az')} AS d8, {_D4.format('az')} AS d4 FROM a)
SELECT poi_id, d8, d4, concat('from ', CASE d4 WHEN 'north' THEN 'south' WHEN 'south' THEN 'north' WHEN 'east' THEN 'west' ELSE 'east' END, ' to ', d4) AS phrase,
  CASE WHEN d4 IN ('east','west') THEN 'south-north' ELSE 'east-west' END AS axis,
  CASE WHEN x2 = x1 AND y2 = y1 THEN 'same point' WHEN x2 = x1 THEN CASE WHEN y2 > y1 THEN 'north' ELSE 'south' END WHEN y2 = y1 THEN CASE WHEN x2 > x1 THEN 'east' ELSE 'west' END
   WHEN y2 > y1 AND degrees(atan(abs((y2 - y1)/(x2 - x1)))) >= 45 THEN 'north' WHEN y2 < y1 AND degrees(atan(abs((y2 - y1)/(x2 - x1)))) <= 45 THEN CASE WHEN x2 > x1 THEN 'east' ELSE 'west' END
   ELSE concat(CASE WHEN y2 > y1 THEN 'north' ELSE 'south' END, CASE WHEN x2 > x1 THEN 'east' ELSE 'west' END) END AS quadrant FROM d""",
)
def directions(t: Tables):
    c = F.col
    az = geo.azimuth_xy(c("x1"), c("y1"), c("x2"), c("y2"))
    d = _pairs(t).withColumn("az", az)
    return d.select("poi_id", geo.dir8(c("az")).alias("d8"), geo.dir4(c("az")).alias("d4"), geo.dir_phrase(geo.dir4(c("az"))).alias("phrase"), geo.road_axis(geo.dir4(c("az"))).alias("axis"), geo.quadrant_dir(c("x2") - c("x1"), c("y2") - c("y1")).alias("quadrant"))


@query(
    "g9_g10_g17_g18_grids_and_rounding",
    f"""SELECT poi_id, trunc((x - 5000)/10)::BIGINT AS gx, (floor((x + 100)/250)*88 + floor((y + 100)/250))::BIGINT AS grid,
  CASE WHEN round_even(x/50, 0) = 0 THEN 'within 50m' ELSE concat((round_even(x/50, 0)::BIGINT*50)::VARCHAR, 'm') END AS near50, (floor(y/100)*100)::BIGINT AS down100, {coord_sql('lng', 'lat')} AS coord, concat_ws(' / ', {', '.join(coord_sql(f'lng {a} 0.01', f'lat {b} 0.01') for a in '-+' for b in '-+')}) AS around FROM poi""",
)
def grids(t: Tables):
    c = F.col
    gx, _ = geo.grid_lnglat(F.lit(5000.0), F.lit(0.0), c("x"), c("y"), 10.0)
    return t.poi.select("poi_id", gx.alias("gx"), geo.grid_xy(c("x"), c("y"), -100.0, -100.0).alias("grid"), geo.round50_text(c("x")).alias("near50"), geo.floor100(c("y")).alias("down100"), geo.coord_text(c("lng"), c("lat")).alias("coord"), F.array_join(geo.coord_distractors(c("lng"), c("lat")), " / ").alias("around"))


@query(
    "g12_g14_rings",
    """SELECT a.aoi_id, round(cx, 4) AS center_x, round(cy, 4) AS center_y, 4*half*half AS area, 8*half AS perimeter,
  (SELECT count(*) FROM poi p WHERE p.poi_id % 10 = a.aoi_id % 10 AND p.x > cx - half AND p.x < cx + half AND p.y > cy - half AND p.y < cy + half) AS points FROM aoi a""",
)
def rings(t: Tables):
    from ..operators.spatial import count_within

    x, y = geo.ring_centroid(F.col("ring"))
    shapes = t.aoi.select("aoi_id", "ring", F.round(x, 4).alias("center_x"), F.round(y, 4).alias("center_y"), geo.ring_area(F.col("ring")).alias("area"), geo.ring_length(F.col("ring")).alias("perimeter"))
    kind = lambda key: (F.col(key) % 10).alias("k")
    points = count_within(t.poi.select("x", "y", kind("poi_id")), t.aoi.select("aoi_id", "ring", kind("aoi_id")), "k")
    return shapes.drop("ring").join(points, "aoi_id", "left").fillna(0, ["points"])


@query("g11_projection_round_trip", "SELECT poi_id, round(lng, 7) AS lng, round(lat, 7) AS lat FROM poi")
def projection(t: Tables):
    x, y = geo.to_xy(F.col("lng"), F.col("lat"), 116.05, 39.95)
    there = t.poi.select("poi_id", x.alias("x"), y.alias("y"))
    lng, lat = geo.to_lnglat(F.col("x"), F.col("y"), 116.05, 39.95)
    return there.select("poi_id", F.round(lng, 7).alias("lng"), F.round(lat, 7).alias("lat"))


@query("g16_side_of_heading", f"WITH {_PAIR} SELECT poi_id, CASE WHEN 3*(y2-y1) - 4*(x2-x1) > 0 THEN 'left' WHEN 3*(y2-y1) - 4*(x2-x1) < 0 THEN 'right' ELSE 'on the line' END AS side FROM pair")
def sides(t: Tables):
    c = F.col
    return _pairs(t).select("poi_id", geo.side_of(F.lit(3.0), F.lit(4.0), c("x1"), c("y1"), c("x2"), c("y2")).alias("side"))


@query(
    "d1_d5_clock",
    """WITH e AS (SELECT event_id, floor(epoch(ts)/60)::BIGINT AS m, isodow(ts) AS dow, strftime(ts, '%H:%M') AS clock, value FROM events)
SELECT event_id, strftime(to_timestamp((m - m % 30 + CASE WHEN m % 30 >= 15 THEN 30 ELSE 0 END)*60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS half_hour, CASE WHEN dow < 6 THEN 'weekday' ELSE 'weekend' END AS day_type,
  round((split_part(clock, ':', 1)::DOUBLE*3600 + split_part(clock, ':', 2)::DOUBLE*60)/86400, 6) AS fraction,
  format('{:02d}:{:02d}', ((split_part(clock, ':', 1)::BIGINT*60 + split_part(clock, ':', 2)::BIGINT + 95) % 1440)//60, ((split_part(clock, ':', 1)::BIGINT*60 + split_part(clock, ':', 2)::BIGINT + 95) % 1440) % 60) AS later,
  split_part(clock, ':', 1)::BIGINT*60 + split_part(clock, ':', 2)::BIGINT + 95 >= 1440 AS next_day, trunc(value*100/70)::BIGINT AS travel FROM e""",
)
def clock(t: Tables):
    ts = F.col("ts")
    e = t.raw("events").select("event_id", "value", ts, F.date_format(ts, "HH:mm").alias("clock"))
    later, over = timefns.add_minutes(F.col("clock"), F.lit(95))
    return e.select("event_id", F.date_format(timefns.round_half_hour(ts.cast("timestamp")), "yyyy-MM-dd HH:mm").alias("half_hour"), timefns.day_type(ts).alias("day_type"), F.round(timefns.day_fraction(F.col("clock")), 6).alias("fraction"), later.alias("later"), over.alias("next_day"), timefns.travel_minutes(F.col("value") * 100).alias("travel"))


@query("t1_t3_categories", "SELECT a.aoi_id, a.land_use, CASE a.land_use WHEN 'E3' THEN 'OtherNon-construction' WHEN 'R' THEN 'Residential' WHEN 'S4' THEN 'TrafficStation&Park' WHEN 'A4' THEN 'Sports' WHEN 'B31' THEN 'Entertainment' WHEN 'B1' THEN 'CommercialFacilities' WHEN 'U9' THEN 'OtherPublicFacilities' WHEN 'A3' THEN 'Education' WHEN 'G1' THEN 'Park&GreenLand' WHEN 'B' THEN 'CommercialService&IndustryFacilities' WHEN 'B32' THEN 'Resort&Fitness' WHEN 'B13' THEN 'Restaurant&Bar' WHEN 'A9' THEN 'ReligiousFacilities' WHEN 'A5' THEN 'Hospital' END AS land_use_name, a.land_use <> 'B1' AS evaluated, string_agg(DISTINCT split_part(p.category, ' > ', 1), '|' ORDER BY split_part(p.category, ' > ', 1)) AS labels FROM aoi a JOIN attached p USING (aoi_id) GROUP BY a.aoi_id, a.land_use")
def categories(t: Tables):
    from ..operators.spatial import attach_pois

    inside = attach_pois(t.poi, t.aoi).groupBy("aoi_id").agg(F.array_sort(F.collect_set(text.top_category(F.col("category")))).alias("labels"))
    return t.aoi.join(inside, "aoi_id").select("aoi_id", "land_use", text.landuse_name(F.col("land_use")).alias("land_use_name"), text.landuse_name(F.col("land_use"), text.EVAL_LAND_USE).isNotNull().alias("evaluated"), text.join_labels(F.col("labels")).alias("labels"))


def address_rows(t: Tables):
    """(aoi_id, aoi_name, land_use, side, road, offset, toward, junction, address) of the
    areas that have an address."""
    rows = topology.aoi_addresses(t.position, t.edge, t.lanes, t.road, t.aoi).join(t.aoi.select("aoi_id", F.col("name").alias("aoi_name"), "land_use"), "aoi_id")
    rows = rows.select("aoi_id", "aoi_name", "land_use", "side", "road", geo.round50_text(F.col("metres")).alias("offset"), "toward", "junction", "lane_id", "from")
    return rows.withColumn("address", text.address_text(F.col("side"), F.col("road"), F.col("offset"), F.col("toward"), F.col("junction"), F.lit(None).cast("string")))


_AZ2 = "((((round(90 - degrees(atan2({3} - {1}, {2} - {0})), 2)) % 360) + 360) % 360)"
ADDR = f"""ps AS (SELECT l.aoi_id, l.lane_id, l.length, l.length*(l.no % 4 + 1)/5 AS s, l.x, l.y, r.name AS rd, z.side AS from_, z.names, z.x AS jx, z.y AS jy,
  row_number() OVER (PARTITION BY l.aoi_id ORDER BY l.junction_id, l.no, l.road_id, l.length, l.k, z.side, z.junction_id) AS rank FROM lanes l JOIN lane_side z USING (lane_id) JOIN road r USING (road_id)),
 addr1 AS (SELECT p.*, a.name AS aoi_name, a.land_use, CASE from_ WHEN 'predecessor' THEN s ELSE length - s END AS m, {_AZ2.format('jx', 'jy', 'cx', 'cy')} AS az8, {_AZ2.format('p.x', 'p.y', 'cx', 'cy')} AS az4 FROM ps p JOIN aoi a USING (aoi_id) WHERE rank = 1),
 addr0 AS (SELECT aoi_id, aoi_name, land_use, lane_id, from_, {_D4.format('az4')} AS side, rd AS road_, CASE WHEN round_even(m/50, 0) = 0 THEN 'within 50m' ELSE concat((round_even(m/50, 0)::BIGINT*50)::VARCHAR, 'm') END AS off_,
  {_D8.format('az8')} AS toward, coalesce(list_filter(names, lambda n: n <> rd)[1], rd) AS junction FROM addr1),
 addr AS (SELECT *, concat(side, ' side of ', road_, ', ', off_, ' to the ', toward, ' of the junction with ', junction) AS address FROM addr0) /* lanes lane_side */"""


@query("j11_t4_aoi_address", f"WITH {ADDR} SELECT aoi_id, aoi_name, lane_id, from_ AS side, address FROM addr /* lane road aoi */")
def aoi_addresses(t: Tables):
    return address_rows(t).select("aoi_id", "aoi_name", "lane_id", F.col("from").alias("side"), "address")


@query("j12_t4_poi_address", f"WITH {ADDR} SELECT p.poi_id, concat(address, ', inside ', aoi_name) AS address FROM attached p JOIN addr USING (aoi_id) /* lane road aoi */")
def poi_addresses(t: Tables):
    from ..operators.spatial import attach_pois

    a = address_rows(t)
    c = F.col
    full = text.address_text(c("side"), c("road"), c("offset"), c("toward"), c("junction"), c("aoi_name"))
    return attach_pois(t.poi, t.aoi).select("poi_id", "aoi_id").join(a, "aoi_id").select("poi_id", full.alias("address"))


@query("t5_parse_address", f"WITH {ADDR} SELECT aoi_id, side, road_ AS road, off_ AS distance, toward, junction FROM addr /* lane road aoi */")
def parsed_addresses(t: Tables):
    p = text.parse_address(F.col("address"), inside=False)
    return address_rows(t).select("aoi_id", p.alias("p")).select("aoi_id", "p.side", "p.road", F.col("p.offset").alias("distance"), "p.toward", "p.junction")


@query("t6_t12_json_and_numbers", """SELECT event_id, concat(loc_id, ', ', event_type) AS address, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id END AS first_number, CASE WHEN event_id >= 1000 THEN event_id ELSE 1000 + loc_id END AS longest_number, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 10)/2.0 END::DOUBLE AS score,
 split_part('task-' || event_type || '-' || event_id, '-', 2) AS task FROM visit""")
def json_and_numbers(t: Tables):
    e, k, kind = F.col("event_id"), F.col("loc_id"), F.col("event_type")
    js = F.to_json(F.struct(k.cast("string").alias("house"), kind.alias("road"), F.lit("100").alias("postcode"), F.lit("x").alias("country")))
    first = F.when(e % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("id "), e.cast("string"), F.lit(" of "), k.cast("string")))
    longest = F.concat_ws(" ", e.cast("string"), (1000 + k).cast("string"))
    score = F.when(e % 3 == 0, F.lit("Score: none")).otherwise(F.concat(F.lit("**Score:** "), ((e % 10) / 2).cast("string")))
    record = F.concat(F.lit("task-"), kind, F.lit("-"), e.cast("string"))
    return t.visit.select("event_id", text.address_from_json(js).alias("address"), text.first_int(first).alias("first_number"), text.longest_int(longest).alias("longest_number"), text.parse_score(F.replace(score, F.lit("**"), F.lit(""))).alias("score"), text.task_type(record).alias("task"))


@query("t9_extract_choice", "SELECT event_id, said AS choice FROM output")
def choices(t: Tables):
    return t.output.select("event_id", text.extract_choice(F.col("text")).alias("choice"))


@query("t10_reasoning_split", "SELECT event_id, event_type AS answer, concat('seen at ', loc_id) AS reasoning, event_type AS final FROM visit")
def reasoning_split(t: Tables):
    said = F.concat(F.lit("Answer: "), F.col("event_type"), F.lit("\nReasoning: seen at "), F.col("loc_id").cast("string"))
    a, r = text.split_reasoning(said)
    final = text.parse_final_answer(F.concat(F.lit("some steps\nFinal Answer: "), F.col("event_type"), F.lit("\n")))
    return t.visit.select("event_id", a.alias("answer"), r.alias("reasoning"), final.alias("final"))


@query(
    "t14_sum_chain",
    """WITH v AS (SELECT route_id, no, road_length, sum(road_length) OVER w AS s, row_number() OVER w AS i FROM step WINDOW w AS (PARTITION BY route_id ORDER BY no, road_id, aoi_id, road_length ROWS UNBOUNDED PRECEDING))
SELECT route_id, coalesce(string_agg(CASE WHEN i > 1 THEN concat(s - road_length, '+', road_length, '=', s) END, ', ' ORDER BY i), '') AS chain, sum(road_length)::BIGINT AS total FROM v GROUP BY route_id""",
)
def sum_chains(t: Tables):
    chain, total = text.sum_chain_text(F.transform("steps", lambda s: s["road_length"]))
    return t.route.select("route_id", chain.alias("chain"), total.alias("total"))


@query("t13_fill_template", "SELECT poi_id, CASE (('0x' || substr(md5(concat_ws('#', poi_id, '3')), 1, 8))::BIGINT % 3) WHEN 0 THEN concat('Where is ', name, '?') WHEN 1 THEN concat('What is the address of ', name, '?') ELSE concat('Tell me where ', name, ' lies.') END AS question FROM poi")
def templates(t: Tables):
    forms = ["Where is {name}?", "What is the address of {name}?", "Tell me where {name} lies."]
    return t.poi.select("poi_id", text.fill_template(F.col("poi_id"), forms, {"name": F.col("name")}, seed=3).alias("question"))
