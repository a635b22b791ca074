"""Question/answer and reasoning dialogues, and record conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import dialogues, spatial, topology
from .base import Tables, coord_sql, number_sql, query
from .scalar_jobs import ADDR, address_rows
from .sequence_jobs import NARRATED, merged_routes


def qa(df: DataFrame, task: str, key: str, question: Column, answer: Column) -> DataFrame:
    """(id, question, answer) with ids of the form name-task-number."""
    return df.select(F.concat(F.lit(f"city-{task}-"), F.col(key).cast("string")).alias("id"), question.alias("question"), answer.cast("string").alias("answer"))


def _lit(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


@query("q1_names_and_addresses", f"WITH {ADDR} SELECT concat('city-aoi_name2addr-', aoi_id) AS id, concat('What is the address of ', aoi_name, '?') AS question, address AS answer FROM addr UNION ALL SELECT concat('city-poi_name2addr-', poi_id), concat('What is the address of ', p.name, '?'), concat(address, ', inside ', aoi_name) FROM attached p JOIN addr USING (aoi_id) UNION ALL SELECT concat('city-category_addr2poi-', poi_id), concat('Which ', split_part(category, ' > ', 1), ' is at ', address, ', inside ', aoi_name, '?'), p.name FROM attached p JOIN addr USING (aoi_id) /* poi aoi lane road */")
def names(t: Tables):
    a = address_rows(t)
    out = qa(a, "aoi_name2addr", "aoi_id", _lit("What is the address of ", "$aoi_name", "?"), F.col("address"))
    p = spatial.attach_pois(t.poi, t.aoi).join(a, "aoi_id").withColumn("full", _lit("$address", ", inside ", "$aoi_name"))
    out = out.union(qa(p, "poi_name2addr", "poi_id", _lit("What is the address of ", "$name", "?"), F.col("full")))
    return out.union(qa(p, "category_addr2poi", "poi_id", _lit("Which ", text.top_category(F.col("category")), " is at ", "$full", "?"), F.col("name")))


@query("q1_landuse_addr2aoi", f"""WITH {ADDR}, lu(code, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in text.LAND_USE.items())}) SELECT concat('city-landuse_addr2aoi-', aoi_id) AS id, concat('Which ', label, ' area is at the ', address, '?') AS question, aoi_name AS answer FROM addr JOIN lu ON code = land_use /* aoi lane road */""")
def land_use(t: Tables):
    a = address_rows(t)
    return qa(a, "landuse_addr2aoi", "aoi_id", _lit("Which ", text.landuse_name(F.col("land_use")), " area is at the ", "$address", "?"), F.col("aoi_name"))


@query("q2_poi_address_elements", f"WITH {ADDR} SELECT concat('city-poi_addr_element-', poi_id) AS id, concat('Name the elements of: ', address, ', inside ', aoi_name) AS question, concat('{{\"side\":\"', side, '\",\"road\":\"', road_, '\",\"offset\":\"', off_, '\",\"toward\":\"', toward, '\",\"junction\":\"', junction, '\",\"inside\":\"', aoi_name, '\"}}') AS answer FROM attached p JOIN addr USING (aoi_id) /* aoi lane road */")
def poi_elements(t: Tables):
    p = spatial.attach_pois(t.poi, t.aoi).select("poi_id", "aoi_id").join(address_rows(t), "aoi_id").withColumn("full", _lit("$address", ", inside ", "$aoi_name"))
    return qa(p, "poi_addr_element", "poi_id", _lit("Name the elements of: ", "$full"), F.to_json(text.parse_address(F.col("full"))))


@query("q2_address_elements", f"WITH {ADDR} SELECT concat('city-aoi_addr_element-', aoi_id) AS id, concat('Name the elements of: ', address) AS question, concat('{{\"side\":\"', side, '\",\"road\":\"', road_, '\",\"offset\":\"', off_, '\",\"toward\":\"', toward, '\",\"junction\":\"', junction, '\"}}') AS answer FROM addr /* aoi lane road */")
def elements(t: Tables):
    a = address_rows(t)
    return qa(a, "aoi_addr_element", "aoi_id", _lit("Name the elements of: ", "$address"), F.to_json(text.parse_address(F.col("address"), inside=False)))


@query("q3_addresses_and_coordinates", f"WITH {ADDR} SELECT concat('city-aoi_addr2coords-', addr.aoi_id) AS id, concat('Where is ', address, '?') AS question, {coord_sql('116.0 + cx/100000', '39.9 + cy/100000')} AS answer FROM addr JOIN aoi a ON a.aoi_id = addr.aoi_id UNION ALL SELECT concat('city-aoi_coords2addr-', addr.aoi_id), concat('What is at ', {coord_sql('116.0 + cx/100000', '39.9 + cy/100000')}, '?'), address FROM addr JOIN aoi a ON a.aoi_id = addr.aoi_id /* lane road */")
def coordinates(t: Tables):
    c = geo.coord_text(116.0 + F.col("cx") / 100000, 39.9 + F.col("cy") / 100000)
    a = address_rows(t).join(t.aoi.select("aoi_id", "cx", "cy"), "aoi_id").withColumn("at", c)
    return qa(a, "aoi_addr2coords", "aoi_id", _lit("Where is ", "$address", "?"), F.col("at")).union(qa(a, "aoi_coords2addr", "aoi_id", _lit("What is at ", "$at", "?"), F.col("address")))


_JP = "jp AS (SELECT road_id, no, junction_id, (junction_id*junction_id*13 + junction_id*6007) % 10007 AS x, (junction_id*junction_id*7 + junction_id*3001) % 10009 AS y FROM lane), je AS (SELECT road_id, min(junction_id) AS a, max(junction_id) AS b FROM jp GROUP BY road_id HAVING min(junction_id) < max(junction_id)), jq AS (SELECT je.*, (a*a*13 + a*6007) % 10007 AS x1, (a*a*7 + a*3001) % 10009 AS y1, (b*b*13 + b*6007) % 10007 AS x2, (b*b*7 + b*3001) % 10009 AS y2 FROM je)"


_JC = coord_sql("116.0 + x/100000", "39.9 + y/100000")
_JN = "jn AS (SELECT junction_id, (junction_id*junction_id*13 + junction_id*6007) % 10007 AS x, (junction_id*junction_id*7 + junction_id*3001) % 10009 AS y, array_to_string((list_sort(list(DISTINCT name)))[1:3], ' and ') AS roads FROM lane JOIN road USING (road_id) GROUP BY junction_id HAVING count(DISTINCT name) >= 2)"


@query("q3_junction_coordinates", f"WITH {_JN} SELECT concat('city-junc_addr2coords-', junction_id) AS id, concat('Where is junction ', junction_id, ' of ', roads, '?') AS question, {_JC} AS answer FROM jn UNION ALL SELECT concat('city-junc_coords2addr-', junction_id), concat('Which junction is at ', {_JC}, '?'), concat('junction ', junction_id, ' of ', roads) FROM jn /* lane road */")
def junction_coordinates(t: Tables):
    """Junctions are named by two or three of their roads."""
    j = F.col("junction_id")
    x, y = ((j * j * 13 + j * 6007) % 10007).cast("double"), ((j * j * 7 + j * 3001) % 10009).cast("double")
    named = topology.junction_names(t.lane, t.road).where("size(names) >= 2")
    d = named.select("junction_id", F.array_join(F.slice("names", 1, 3), " and ").alias("roads"), geo.coord_text(116.0 + x / 100000, 39.9 + y / 100000).alias("at"))
    there = qa(d, "junc_addr2coords", "junction_id", _lit("Where is junction ", "$junction_id", " of ", "$roads", "?"), F.col("at"))
    return there.union(qa(d, "junc_coords2addr", "junction_id", _lit("Which junction is at ", "$at", "?"), _lit("junction ", "$junction_id", " of ", "$roads")))


@query("q4_junctions", f"WITH {_JP} SELECT concat('city-junc_distance-', road_id) AS id, concat('How far is junction ', b, ' from junction ', a, '?') AS question, CASE WHEN round_even(sqrt((x1-x2)**2 + (y1-y2)**2)/50, 0) = 0 THEN 'within 50m' ELSE concat(round_even(sqrt((x1-x2)**2 + (y1-y2)**2)/50, 0)::BIGINT*50, 'm') END AS answer FROM jq /* lane */")
def junctions(t: Tables):
    e = t.lane.groupBy("road_id").agg(F.min("junction_id").alias("a"), F.max("junction_id").alias("b")).where("a < b")
    at = lambda k: (((F.col(k) * F.col(k) * 13 + F.col(k) * 6007) % 10007).cast("double"), ((F.col(k) * F.col(k) * 7 + F.col(k) * 3001) % 10009).cast("double"))
    (x1, y1), (x2, y2) = at("a"), at("b")
    return qa(e, "junc_distance", "road_id", _lit("How far is junction ", "$b", " from junction ", "$a", "?"), geo.round50_text(geo.dist_xy(x1, y1, x2, y2)))


@query("q4_junction_direction", f"WITH {_JP}, az AS (SELECT *, ((((round(90 - degrees(atan2(y2 - y1, x2 - x1)), 2)) % 360) + 360) % 360) AS z FROM jq) SELECT concat('city-junc_direction-', road_id) AS id, concat('In which direction is junction ', b, ' from junction ', a, '?') AS question, (['north','northeast','east','southeast','south','southwest','west','northwest'])[floor(((z + 22.5) % 360)/45)::INT + 1] AS answer FROM az /* lane */")
def junction_direction(t: Tables):
    e = t.lane.groupBy("road_id").agg(F.min("junction_id").alias("a"), F.max("junction_id").alias("b")).where("a < b")
    at = lambda k: (((F.col(k) * F.col(k) * 13 + F.col(k) * 6007) % 10007).cast("double"), ((F.col(k) * F.col(k) * 7 + F.col(k) * 3001) % 10009).cast("double"))
    (x1, y1), (x2, y2) = at("a"), at("b")
    return qa(e, "junc_direction", "road_id", _lit("In which direction is junction ", "$b", " from junction ", "$a", "?"), geo.dir8(geo.azimuth_xy(x1, y1, x2, y2)))


@query("q5_categories", "WITH c AS (SELECT aoi_id, category, count(*) AS n, min(name) AS poi FROM attached GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY n DESC, category) AS k FROM c) SELECT concat('city-aoi_category2poi-', aoi_id) AS id, concat('Name a ', category, ' in ', a.name, '.') AS question, poi AS answer FROM r JOIN aoi a USING (aoi_id) WHERE k = 1 UNION ALL SELECT concat('city-aoi_landuse2poi_category-', aoi_id), concat('Which kind is most common in ', a.name, '?'), category FROM r JOIN aoi a USING (aoi_id) WHERE k = 1")
def category_qa(t: Tables):
    c = spatial.attach_pois(t.poi, t.aoi).groupBy("aoi_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("poi"))
    k = F.row_number().over(Window.partitionBy("aoi_id").orderBy(F.desc("n"), "category"))
    top = c.withColumn("k", k).where("k = 1").join(t.aoi.select("aoi_id", F.col("name").alias("aoi")), "aoi_id")
    return qa(top, "aoi_category2poi", "aoi_id", _lit("Name a ", "$category", " in ", "$aoi", "."), F.col("poi")).union(qa(top, "aoi_landuse2poi_category", "aoi_id", _lit("Which kind is most common in ", "$aoi", "?"), F.col("category")))


@query("q5_category_land_use", f"WITH lu(code, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in text.LAND_USE.items())}), c AS (SELECT p.category, land_use, count(*) AS n FROM attached p JOIN aoi USING (aoi_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, land_use) AS k FROM c) SELECT concat('city-poi_category2aoi_landuse-', md5(category)) AS id, concat('On what kind of land do most ', category, ' lie?') AS question, label AS answer FROM r JOIN lu ON code = land_use WHERE k = 1")
def category_land_use(t: Tables):
    c = spatial.attach_pois(t.poi, t.aoi).select("aoi_id", "category").join(t.aoi.select("aoi_id", "land_use"), "aoi_id").groupBy("category", "land_use").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "land_use"))
    top = c.withColumn("k", k).where("k = 1").withColumn("key", F.md5("category"))
    return qa(top, "poi_category2aoi_landuse", "key", _lit("On what kind of land do most ", "$category", " lie?"), text.landuse_name(F.col("land_use")))


@query("q6_adjacent_pois", "WITH f AS (SELECT aoi_id, min(poi_id) AS poi_id FROM attached GROUP BY 1 HAVING count(*) > 1) SELECT concat('city-poi2adjacency_pois-', f.poi_id) AS id, concat('What is near ', p.name, '?') AS question, string_agg(o.name, ', ' ORDER BY o.name) AS answer FROM f JOIN poi p ON p.poi_id = f.poi_id JOIN attached o ON o.aoi_id = f.aoi_id AND o.poi_id <> f.poi_id GROUP BY f.poi_id, p.name")
def adjacent(t: Tables):
    p = spatial.attach_pois(t.poi, t.aoi)
    first = p.groupBy("aoi_id").agg(F.min("poi_id").alias("first"), F.min_by("name", "poi_id").alias("first_name"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = p.join(first, "aoi_id").where("poi_id <> first").groupBy("first", "first_name").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("near"))
    return qa(near, "poi2adjacency_pois", "first", _lit("What is near ", "$first_name", "?"), F.col("near"))


@query("q7_largest_areas", "WITH c AS (SELECT aoi_id, count(*) AS n FROM attached GROUP BY 1) SELECT 'city-max_pois_aoi-0' AS id, 'Which area holds most places?' AS question, (SELECT name FROM aoi WHERE aoi_id = (SELECT aoi_id FROM c ORDER BY n DESC, aoi_id LIMIT 1)) AS answer UNION ALL SELECT 'city-max_aoi_area-0', 'Which area is largest?', (SELECT name FROM aoi ORDER BY half DESC, aoi_id LIMIT 1)")
def largest(t: Tables):
    c = spatial.attach_pois(t.poi, t.aoi).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n")).join(t.aoi.select("aoi_id", "name"), "aoi_id")
    first = lambda df, by: df.agg(F.min_by("name", F.struct((-F.col(by)).alias("v"), "aoi_id")).alias("name")).withColumn("no", F.lit(0))
    return qa(first(c, "n"), "max_pois_aoi", "no", F.lit("Which area holds most places?"), F.col("name")).union(qa(first(t.aoi, "half"), "max_aoi_area", "no", F.lit("Which area is largest?"), F.col("name")))


@query("q9_road2connected_aois", "WITH b AS (SELECT DISTINCT r.name, a.aoi_id, a.name AS aoi FROM lane l JOIN road r USING (road_id) JOIN aoi a USING (aoi_id)), p AS (SELECT x.name, x.aoi AS a, min(y.aoi) AS b FROM b x JOIN b y ON x.name = y.name AND y.aoi_id <> x.aoi_id GROUP BY 1, 2) SELECT concat('city-road2connected_2aois-', md5(concat(name, a))) AS id, concat('Which area is joined to ', a, ' by ', name, '?') AS question, b AS answer FROM p")
def connected(t: Tables):
    n = t.aoi.select("aoi_id", F.col("name").alias("aoi"))
    named = topology.road_aois(t.lane, t.road).join(n, "aoi_id")
    # the least neighbour of each area on a road: the least of the road, or the second least
    two = named.groupBy("name").agg(F.slice(F.array_sort(F.collect_set("aoi")), 1, 2).alias("two"))
    p = named.join(two, "name").withColumn("b", F.when(F.col("two")[0] != F.col("aoi"), F.col("two")[0]).otherwise(F.try_element_at("two", F.lit(2)))).where("b is not null")
    return qa(p.withColumn("k", F.md5(F.concat("name", "aoi"))), "road2connected_2aois", "k", _lit("Which area is joined to ", "$aoi", " by ", "$name", "?"), F.col("b"))


@query("q10_roads_of_areas", "WITH s AS (SELECT road_id, sum(length) AS total FROM lane GROUP BY 1), b AS (SELECT DISTINCT aoi_id, road_id FROM lane), r AS (SELECT aoi_id, name, row_number() OVER (PARTITION BY aoi_id ORDER BY total DESC, name, road_id) AS k FROM b JOIN s USING (road_id) JOIN road USING (road_id)) SELECT concat('city-aoi2longest_connected_road-', aoi_id) AS id, concat('Which is the longest road at ', a.name, '?') AS question, r.name AS answer FROM r JOIN aoi a USING (aoi_id) WHERE k = 1 UNION ALL SELECT concat('city-aoi_area-', aoi_id), concat('How large is ', name, '?'), (4*half*half)::BIGINT::VARCHAR FROM aoi")
def roads_of(t: Tables):
    a = topology.aoi_longest_road(t.lane, t.road).join(t.aoi.select("aoi_id", F.col("name").alias("aoi")), "aoi_id")
    area = t.aoi.withColumn("area", geo.ring_area(F.col("ring")).cast("long"))
    return qa(a, "aoi2longest_connected_road", "aoi_id", _lit("Which is the longest road at ", "$aoi", "?"), F.col("longest")).union(qa(area, "aoi_area", "aoi_id", _lit("How large is ", "$name", "?"), F.col("area")))


@query("q10_places_around_areas", """WITH b AS (SELECT aoi_id, string_agg(DISTINCT r.name, ', ' ORDER BY r.name) AS roads FROM lane JOIN road r USING (road_id) GROUP BY aoi_id),
 near AS (SELECT a.aoi_id, a.name AS aoi, p.poi_id, p.name, split_part(p.category, ' > ', 1) AS kind, sqrt((p.x - cx)*(p.x - cx) + (p.y - cy)*(p.y - cy)) AS d FROM aoi a JOIN poi p ON abs(p.x - cx) <= 800 AND abs(p.y - cy) <= 800), rk AS (SELECT *, row_number() OVER (PARTITION BY aoi_id, kind ORDER BY d, poi_id) AS k FROM near WHERE d <= 800)
SELECT concat('city-aoi2connected_road-', aoi_id) AS id, concat('Which roads meet ', a.name, '?') AS question, roads AS answer FROM b JOIN aoi a USING (aoi_id)
UNION ALL SELECT concat('city-aoi_range_category2poi-', aoi_id, '/', kind), concat('Which ', kind, ' lie within 800 m of ', aoi, '?'), string_agg(name, ', ' ORDER BY k) FROM rk WHERE k <= 10 GROUP BY aoi_id, aoi, kind
UNION ALL SELECT concat('city-aoi_category2nearest_poi-', aoi_id, '/', kind), concat('Which ', kind, ' is nearest to ', aoi, '?'), name FROM rk WHERE k = 1 /* lane road poi aoi */""")
def around_areas(t: Tables):
    from .mcq_jobs import KINDS

    named = t.aoi.select("aoi_id", F.col("name").alias("aoi"))
    roads = topology.road_aois(t.lane, t.road).groupBy("aoi_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("roads")).join(named, "aoi_id")
    out = qa(roads, "aoi2connected_road", "aoi_id", _lit("Which roads meet ", "$aoi", "?"), F.col("roads"))
    c = t.aoi.select(F.col("aoi_id").alias("center_id"), "cx", "cy")
    near = spatial.pois_near(c, t.poi, 800.0, list(KINDS), 10).join(t.poi.select("poi_id", "name"), "poi_id").join(named.withColumnRenamed("aoi_id", "center_id"), "center_id")
    near = near.withColumn("key", F.concat_ws("/", "center_id", "prefix"))
    listed = near.groupBy("key", "prefix", "aoi").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("names"))
    out = out.union(qa(listed, "aoi_range_category2poi", "key", _lit("Which ", "$prefix", " lie within 800 m of ", "$aoi", "?"), F.col("names")))
    return out.union(qa(near.where("rank = 1"), "aoi_category2nearest_poi", "key", _lit("Which ", "$prefix", " is nearest to ", "$aoi", "?"), F.col("name")))


@query("q8_route_repairs", f"""WITH RECURSIVE {NARRATED}, pt AS (SELECT *, len(parts) AS n, {number_sql(1 << 20, 'route_id', seed=8)} % len(parts) AS gone FROM told WHERE len(parts) BETWEEN 3 AND 12), ex AS (SELECT route_id, parts, gone, unnest(range(n)) AS i FROM pt)
SELECT concat('city-scrambled_task_route-', route_id) AS id, concat('Put in order: ', string_agg(parts[i + 1], '; ' ORDER BY md5(concat_ws('#', route_id, i)))) AS question, array_to_string(any_value(parts), '; ') AS answer FROM ex GROUP BY route_id
UNION ALL SELECT concat('city-lacking_task_route-', route_id), concat('What is missing: ', string_agg(CASE WHEN i <> gone THEN parts[i + 1] END, '; ' ORDER BY i)), any_value(parts[gone + 1]) FROM ex GROUP BY route_id /* step */""")
def repairs(t: Tables):
    """Merged routes in scrambled order, or lacking a stretch, with the repair as answer."""
    from ..operators.sequences import narrate

    r = merged_routes(t).where("size(merged) between 3 and 12").withColumn("whole", narrate(F.col("merged")))
    parts = F.split("whole", "; ")
    mixed = F.array_join(F.transform(F.array_sort(F.transform(parts, lambda p, i: F.struct(F.md5(F.concat_ws("#", F.col("route_id").cast("string"), i.cast("string"))).alias("h"), p.alias("p")))), lambda s: s["p"]), "; ")
    no = text.keyed_number(1 << 20, F.col("route_id"), seed=8) % F.size(parts)
    lacking = F.array_join(F.filter(parts, lambda p, i: i != no), "; ")
    return qa(r, "scrambled_task_route", "route_id", F.concat(F.lit("Put in order: "), mixed), F.col("whole")).union(qa(r, "lacking_task_route", "route_id", F.concat(F.lit("What is missing: "), lacking), F.element_at(parts, (no + 1).cast("int"))))


def conversation(t: Tables) -> DataFrame:
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content")))
    return t.dialogue.groupBy("conv_id").agg(m.alias("messages"))


@query("c4_f7_drop_bad_dialogues", "WITH f AS (SELECT conv_id, first(role ORDER BY turn) FILTER (WHERE role <> 'system') AS r, bool_or(lower(text) LIKE '%idiot%') AS bad FROM dialogue GROUP BY 1) SELECT conv_id FROM f WHERE r = 'user' AND NOT bad")
def good(t: Tables):
    return dialogues.drop_bad_dialogues(conversation(t), ["idiot"]).select("conv_id")


@query("c5_s11_alpaca", "WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM dialogue WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM dialogue WHERE role = 'assistant'), p AS (SELECT u.conv_id, u.k, u.text AS q, a.text AS r, max(u.k) OVER (PARTITION BY u.conv_id) AS n FROM u JOIN a USING (conv_id, k)) SELECT conv_id, max(CASE WHEN k = n THEN q END) AS instruction, max(CASE WHEN k = n THEN r END) AS output, (max(n) - 1)::BIGINT AS n_history, coalesce((SELECT first(text ORDER BY turn) FROM dialogue d WHERE d.conv_id = p.conv_id AND role = 'system'), '') AS system FROM p GROUP BY conv_id")
def alpaca(t: Tables):
    a = dialogues.to_alpaca(conversation(t))
    return a.select("conv_id", "instruction", "output", F.size("history").cast("long").alias("n_history"), "system")


@query("c5_s11_sharegpt", "SELECT conv_id, string_agg(concat(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, ':', md5(text)), '|' ORDER BY turn) AS turns FROM dialogue GROUP BY conv_id")
def sharegpt(t: Tables):
    s = dialogues.to_sharegpt(conversation(t))
    return s.select("conv_id", F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit(":"), F.md5(m["value"]))), "|").alias("turns"))


@query("c1_training_sessions", "SELECT conv_id, string_agg(concat(CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END, ':', length(text)), '|' ORDER BY turn) AS shape FROM (SELECT * FROM dialogue WHERE trim(text) <> '') GROUP BY conv_id")
def sessions(t: Tables):
    s = conversation(t).withColumn("session", dialogues.training_session(F.col("messages")))
    return s.select("conv_id", F.array_join(F.transform("session", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), "|").alias("shape"))


@query("c6_pretraining_text", "SELECT conv_id, md5(concat_ws(chr(10), 'task ' || conv_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn), ''))) AS digest FROM dialogue GROUP BY conv_id")
def pretraining(t: Tables):
    c = conversation(t)
    return c.select("conv_id", F.md5(dialogues.pretraining_text(F.col("messages"), F.concat(F.lit("task "), F.col("conv_id").cast("string")))).alias("digest"))


@query("c3_right_stories", "SELECT task, count(*) FILTER (WHERE said = answer) AS kept, round(avg(CASE WHEN said = answer THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM output GROUP BY task")
def stories(t: Tables):
    """Records whose model answer equals the label, and the accuracy by data set."""
    hit = text.extract_choice(F.col("text")) == F.col("answer")
    return t.output.groupBy("task").agg(F.count(F.when(hit, 1)).alias("kept"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 8).alias("accuracy"))


@query("t19_t21_prompts", "SELECT item_id, concat('Read: ', left(md5(text), 8), chr(10), 'A. ', item_id, chr(10), 'B. ', item_id + 1, chr(10), 'Answer:') AS prompt FROM benchmark")
def prompts(t: Tables):
    b = t.raw("benchmark")
    i = F.col("item_id")
    return b.select("item_id", text.mcq_prompt(F.concat(F.lit("Read: "), F.substring(F.md5("text"), 1, 8)), F.array(i.cast("string"), (i + 1).cast("string"))).alias("prompt"))


@query("f9_exact_pairs", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS twin FROM sft WHERE text IS NOT NULL QUALIFY doc_id <> twin")
def twins(t: Tables):
    """Each row whose text an earlier one has, with the first of them: rows, not pairs."""
    h = t.sft.where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("twin"))
    return h.join(first, "h").where("doc_id <> twin").select("doc_id", "twin")
