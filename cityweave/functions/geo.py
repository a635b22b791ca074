"""Planar and geographic column functions.  Null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# The eight and four compass directions, clockwise from north.
DIR8 = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
DIR4 = ("north", "east", "south", "west")
# Opposite directions, for phrases such as "from south to north".
OPPOSITE = {"north": "south", "south": "north", "east": "west", "west": "east", "northeast": "southwest", "southwest": "northeast", "northwest": "southeast", "southeast": "northwest"}


def dist_xy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance in kilometres, rounded to three places."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2.0)
    return F.round(2 * EARTH_KM * F.asin(F.sqrt(a)), 3)


def azimuth_xy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clockwise degrees from north of the way from point 1 to point 2, two places."""
    return F.pmod(F.round(90 - F.degrees(F.atan2(y2 - y1, x2 - x1)), 2), F.lit(360.0))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def dir8(angle: Column) -> Column:
    slot = F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*map(F.lit, DIR8)), slot + 1)


def dir4(angle: Column) -> Column:
    slot = F.floor(F.pmod(angle + 45, F.lit(360.0)) / 90).cast("int")
    return F.element_at(F.array(*map(F.lit, DIR4)), slot + 1)


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def dir_phrase(direction: Column) -> Column:
    """"from south to north" for a way that leads north."""
    return F.concat(F.lit("from "), _lookup(direction, OPPOSITE), F.lit(" to "), direction)


def road_axis(direction: Column) -> Column:
    """The road beside a side: east and west sides lie on a south-north road."""
    return F.when(direction.isin("east", "west"), F.lit("south-north")).when(direction.isin("north", "south"), F.lit("east-west"))


def quadrant_dir(dx: Column, dy: Column) -> Column:
    """Direction of a displacement, cut at 45 degrees: northward ones are diagonal when
    flatter than that, else north; southward ones are diagonal when steeper, else east
    or west.  On an axis the plain word; "same point" at 0, 0."""
    flat, steep = F.abs(dy) < F.abs(dx), F.abs(dy) > F.abs(dx)
    side = F.when(dx > 0, F.lit("east")).otherwise(F.lit("west"))
    return (
        F.when((dx == 0) & (dy == 0), F.lit("same point"))
        .when(dx == 0, F.when(dy > 0, F.lit("north")).otherwise(F.lit("south")))
        .when(dy == 0, side)
        .when(dy > 0, F.when(flat, F.concat(F.lit("north"), side)).otherwise(F.lit("north")))
        .otherwise(F.when(steep, F.concat(F.lit("south"), side)).otherwise(side))
    )


def grid_lnglat(lng0: Column, lat0: Column, lng: Column, lat: Column, cell: float = 0.0001) -> tuple[Column, Column]:
    """Signed cell numbers from a centre, cut towards it."""
    return ((lng - lng0) / cell).cast("long"), ((lat - lat0) / cell).cast("long")


def grid_xy(x: Column, y: Column, x0: float, y0: float, size: float = 250.0, across: int = 88) -> Column:
    return (F.floor((x - x0) / size) * across + F.floor((y - y0) / size)).cast("long")


_A, _E2, _K0 = 6378137.0, 0.00669437999014, 1.0


def _meridian(lat: Column) -> Column:
    e2, e4, e6 = _E2, _E2**2, _E2**3
    return _A * (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat
        - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * lat)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * lat)
        - (35 * e6 / 3072) * F.sin(6 * lat)
    )


def to_xy(lng: Column, lat: Column, lng0: float, lat0: float) -> tuple[Column, Column]:
    """Transverse Mercator metres on the WGS 84 ellipsoid around (lng0, lat0), by series."""
    p = F.radians(lat)
    ep2 = _E2 / (1 - _E2)
    n = _A / F.sqrt(1 - _E2 * F.pow(F.sin(p), 2.0))
    t, c = F.pow(F.tan(p), 2.0), ep2 * F.pow(F.cos(p), 2.0)
    a = F.cos(p) * F.radians(lng - lng0)
    x = n * (a + (1 - t + c) * F.pow(a, 3.0) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5.0) / 120)
    m0 = _meridian(F.radians(F.lit(float(lat0))))
    y = _meridian(p) - m0 + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4.0) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6.0) / 720)
    return x, y


def to_lnglat(x: Column, y: Column, lng0: float, lat0: float) -> tuple[Column, Column]:
    """The inverse of to_xy."""
    e2, e4, e6 = _E2, _E2**2, _E2**3
    ep2 = _E2 / (1 - _E2)
    mu = (_meridian(F.radians(F.lit(float(lat0)))) + y) / (_A * (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
    e1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    c, t = ep2 * F.pow(F.cos(p), 2.0), F.pow(F.tan(p), 2.0)
    s = 1 - _E2 * F.pow(F.sin(p), 2.0)
    n, r = _A / F.sqrt(s), _A * (1 - _E2) / F.pow(s, 1.5)
    d = x / n
    lat = p - (n * F.tan(p) / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4.0) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6.0) / 720)
    lng = (d - (1 + 2 * t + c) * F.pow(d, 3.0) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5.0) / 120) / F.cos(p)
    return F.degrees(lng) + lng0, F.degrees(lat)


def ring_edges(ring: Column) -> Column:
    """Edges (a, b) of a ring of (x, y), open or closed (the closing edge of a closed
    ring has no length and changes nothing)."""
    ahead = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e["a"], e["b"]))


def ring_area(ring: Column) -> Column:
    return F.abs(_sum(ring_edges(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def ring_length(ring: Column) -> Column:
    return _sum(ring_edges(ring), lambda a, b: dist_xy(a["x"], a["y"], b["x"], b["y"]))


def line_length(line: Column) -> Column:
    edges = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.element_at(line, i).alias("a"), F.element_at(line, i + 1).alias("b")))
    return F.when(F.size(line) >= 2, _sum(edges, lambda a, b: dist_xy(a["x"], a["y"], b["x"], b["y"]))).otherwise(0.0)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted centre of a polygon."""
    edges = ring_edges(ring)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    area = _sum(edges, cross)
    x = _sum(edges, lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / (3 * area)
    y = _sum(edges, lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / (3 * area)
    return x, y


def contains_edges(edges: Column, x: Column, y: Column) -> Column:
    """contains() for edges that were made once, before a join."""

    def on(e):
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    def crossed(e):
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    return ~F.exists(edges, on) & (F.size(F.filter(edges, crossed)) % 2 == 1)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside: a point on the boundary is outside."""
    return contains_edges(ring_edges(ring), x, y)


def side_of(hx: Column, hy: Column, cx: Column, cy: Column, px: Column, py: Column) -> Column:
    """Where a point lies from a walker at (cx, cy) who heads along (hx, hy)."""
    cross = hx * (py - cy) - hy * (px - cx)
    return F.when(cross > 0, F.lit("left")).when(cross < 0, F.lit("right")).otherwise(F.lit("on the line"))


def round50_text(metres: Column) -> Column:
    """Nearest 50 metres (halves to even) as text; "within 50m" for none."""
    steps = F.bround(metres / 50).cast("long")
    return F.when(steps == 0, F.lit("within 50m")).otherwise(F.concat((steps * 50).cast("string"), F.lit("m")))


def floor100(metres: Column) -> Column:
    return (F.floor(metres / 100) * 100).cast("long")


def coord_text(lng: Column, lat: Column) -> Column:
    return F.concat(fixed4(lng), F.lit(", "), fixed4(lat))


def fixed4(v: Column) -> Column:
    """Four decimals, halves away from zero."""
    n = F.floor(F.abs(v) * 10000 + 0.5).cast("long")
    return F.concat(F.when(v < 0, "-").otherwise(""), F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def coord_distractors(lng: Column, lat: Column, step: float = 0.01) -> Column:
    """The four diagonal neighbours."""
    return F.array(*[coord_text(lng + dx, lat + dy) for dx in (-step, step) for dy in (-step, step)])
