"""Hand-worked values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cityweave.functions import geo, routes, text, timefns


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_angles_and_directions(spark):
    assert one(spark, *(geo.azimuth_xy(*lit(0, 0, x, y)) for x, y in ((1, 0), (0, 1), (-1, 0), (0, -1)))) == (90, 0, 270, 180)
    assert one(spark, *(geo.dir8(F.lit(a)) for a in (22.5, 22.49, 337.5, 180.0))) == ("northeast", "north", "north", "south")
    assert one(spark, *(geo.dir4(F.lit(a)) for a in (45.0, 315.0, 135.0, 225.0))) == ("east", "north", "south", "west")
    assert one(spark, geo.dir_phrase(F.lit("north")), geo.road_axis(F.lit("east")), geo.quadrant_dir(*lit(1, -1)), geo.quadrant_dir(*lit(0, 0)), geo.quadrant_dir(*lit(3, 0))) == ("from south to north", "south-north", "east", "same point", "east")
    cut = {(1, 9): "north", (9, 1): "northeast", (-9, 1): "northwest", (1, -9): "southeast", (-1, -9): "southwest", (-9, -1): "west", (0, -1): "south"}
    assert one(spark, *(geo.quadrant_dir(*lit(*d)) for d in cut)) == tuple(cut.values())


def test_rounding_and_grids(spark):
    assert one(spark, *(geo.round50_text(F.lit(float(v))) for v in (25, 75, 0, 130))) == ("within 50m", "100m", "within 50m", "150m")
    assert one(spark, geo.grid_xy(*lit(435550, 4405900), 435300.0, 4405900.0), geo.floor100(F.lit(199.9))) == (88, 100)
    assert one(spark, geo.coord_text(*lit(116.00005, -39.9))) == ("116.0001, -39.9000",)
    assert one(spark, *geo.grid_lnglat(*lit(116, 39, 115.99985, 39.00025))) == (-1, 2)


def test_distances(spark):
    a, b = one(spark, geo.dist_xy(*lit(0, 0, 3, 4)), geo.haversine_km(*lit(0, 0, 1, 0)))
    assert a == 5 and abs(b - 111.195) < 0.001
    assert one(spark, geo.bearing(*lit(0, 0, 0, 1)))[0] == pytest.approx(90)


def square():
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])


def test_rings(spark):
    x, y = geo.ring_centroid(square())
    assert one(spark, geo.ring_area(square()), geo.ring_length(square()), x, y) == (8, 12, 2, 1)
    inside = [geo.contains(square(), *lit(*p)) for p in ((1, 1), (0, 1), (4, 2), (5, 1), (2, 0))]
    assert one(spark, *inside) == (True, False, False, False, False)


def test_projection_round_trip(spark):
    x, y = geo.to_xy(*lit(116.4, 39.95), 116.3, 39.9)
    df = spark.range(1).select(x.alias("x"), y.alias("y"))
    lng, lat = geo.to_lnglat(F.col("x"), F.col("y"), 116.3, 39.9)
    got = df.select("x", "y", lng, lat).first()
    assert abs(got[0] - 8547) < 20 and abs(got[1] - 5553) < 20
    assert got[2] == pytest.approx(116.4, abs=1e-8) and got[3] == pytest.approx(39.95, abs=1e-8)


def test_time(spark):
    half = [timefns.round_half_hour(F.lit(dt.datetime(2024, 5, 4, 10, m, 31))) for m in (14, 15, 44, 45)]
    assert [v.strftime("%H:%M:%S") for v in one(spark, *half)] == ["10:00:00", "10:30:00", "10:30:00", "11:00:00"]
    later, over = timefns.add_minutes(F.lit("23:50"), F.lit(15))
    assert one(spark, later, over, timefns.day_type(F.lit(dt.datetime(2024, 5, 4))), timefns.travel_minutes(F.lit(139.0))) == ("00:05", True, "weekend", 1)
    a, b = timefns.parse_span(F.lit("(06:00, 12:00:00)"))
    assert one(spark, a, b, timefns.day_fraction(F.lit("x"))) == (0.25, 0.5, None)


def test_addresses(spark):
    full = text.address_text(*map(F.lit, ("east", "Long Road", "150m", "north", "Short Lane", "Park")))
    assert one(spark, full) == ("east side of Long Road, 150m to the north of the junction with Short Lane, inside Park",)
    p, q, r = one(spark, text.parse_address(full), text.parse_address(F.lit("no address")), text.parse_address(F.lit("east side of A, 50m to the north of the junction with B")))
    assert p.road == "Long Road" and p.inside == "Park" and q is None and r is None
    assert one(spark, text.address_from_json(F.lit('{"road":"A","postcode":"1","house":"2"}')), text.address_from_json(F.lit("{broken"))) == ("A, 2", "invalid")


def test_answers(spark):
    said = {"The answer is B": "B", "Answer: C": "C", "The answer is a hotel, D": "D", "E is right": "E", "": "Z", "none of these": "Z", "A": "A", "x\n F": "F"}
    said |= {"The answer is not A": "Z", "A nice place near the river": "Z", "A is wrong. B is correct": "B", "A or B? I would choose B": "B", "B isn't right": "Z", "B, since it is near": "B"}
    assert one(spark, *(text.extract_choice(F.lit(s)) for s in said)) == tuple(said.values())
    assert one(spark, text.first_int(F.lit("no")), text.first_int(F.lit("a 12 b 345")), text.longest_int(F.lit("a 12 b 345")), text.route_length(F.lit("x for 10 meters, y for 32 meters")), text.task_type(F.lit("beijing-poi2addr-17"))) == (-1, 12, 345, 42, "poi2addr")
    assert one(spark, text.parse_score(F.lit("Score: 7.5")), text.parse_score(F.lit("Score: x"))) == (7.5, None)


def test_sum_chain_and_bio(spark):
    chain, total = text.sum_chain_text(F.array(*map(F.lit, (100, 200, 300))))
    assert one(spark, chain, total) == ("100+200=300, 300+300=600", 600)
    parts = text.bio_components(F.array(*map(F.lit, "abcdef")), F.array(*map(F.lit, ("B-x", "I-x", "E-x", "O", "B-y", "B-y"))))
    assert [(p.kind, p.text) for p in one(spark, parts)[0]] == [("x", "abc"), ("y", "e"), ("y", "f")]


def test_route_totals(spark):
    rows = '[{"type":"road","road_name":"A","road_length":100,"direction":"from southwest to northeast"},{"type":"junc","junc_name":"J"},{"type":"road","road_name":"B","road_length":50,"direction":"west"}]'
    t = one(spark, routes.direction_totals(routes.parse_route(F.lit(rows))))[0]
    assert (t.north, t.east, t.south, t.west) == (70, 70, 0, 50)
    assert one(spark, routes.route_text(routes.parse_route(F.lit(rows))))[0].startswith("walk along A for 100 meters")
