"""Geometry as a nested column, with array functions over it.

A geometry is ``STRUCT<kind STRING, parts ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>>``: polygons (or
lines, as parts of one ring) made of rings made of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
RINGS = f"array<{POINTS}>"
PARTS = f"array<{RINGS}>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
EARTH_M = 6_371_008.8


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once: inside array functions an expression is otherwise repeated per element."""
    return F.transform(F.array(value), fn)[0]


def _geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.cast(PARTS).alias("parts"))


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(p: Column) -> Column:
    return _geometry("Point", F.array(F.array(F.array(p))))


def line_string(coords: Column) -> Column:
    return _geometry("LineString", F.array(F.array(coords)))


def polygon(ring: Column) -> Column:
    return _geometry("Polygon", F.array(F.array(ring)))


def multi_polygon(parts: Column) -> Column:
    return _geometry("MultiPolygon", parts)


def all_points(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def vertex_count(geom: Column) -> Column:
    return F.size(all_points(geom))


def bbox(geom: Column) -> Column:
    pts = all_points(geom)
    pick = lambda f: F.transform(pts, lambda p: p[f])
    return F.struct(F.array_min(pick("x")).alias("minx"), F.array_min(pick("y")).alias("miny"),
                    F.array_max(pick("x")).alias("maxx"), F.array_max(pick("y")).alias("maxy"))


def is_box(parts: Column) -> Column:
    """Whether parts (of a polygon) are one closed ring over the four corners of its box, and nothing else."""
    def test(ring: Column) -> Column:
        level = F.forall(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: (ring[i]["x"] == ring[i - 1]["x"]) != (ring[i]["y"] == ring[i - 1]["y"]))
        sides = lambda f: F.size(F.array_distinct(F.transform(ring, lambda p: p[f])))
        return (ring[0] == ring[4]) & (F.size(F.array_distinct(ring)) == 4) & (sides("x") == 2) & (sides("y") == 2) & level

    one = (F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) == 1)
    ring = F.get(F.get(parts, F.lit(0)), F.lit(0))
    return F.coalesce(F.when(one & (F.size(ring) == 5), let(ring, test)), F.lit(False))


def is_closed(refs: Column) -> Column:
    return (F.size(refs) >= 4) & (F.get(refs, F.lit(0)) == F.element_at(refs, -1))


def dedupe(coords: Column) -> Column:
    """Drop points equal to the one before."""
    return F.filter(coords, lambda p, i: (i == 0) | (p != F.get(coords, i - 1)))


def close_ring(coords: Column) -> Column:
    """Repeated points once, and the first one again at the end."""
    return let(dedupe(coords), lambda c: F.when((F.size(c) == 0) | (F.get(c, F.lit(0)) == F.element_at(c, -1)), c).otherwise(
        F.concat(c, F.slice(c, 1, 1))))


def _segments(coords: Column) -> Column:
    """Indices of the points that a segment ends at."""
    return F.when(F.size(coords) >= 2, F.sequence(F.lit(1), F.size(coords) - 1)).otherwise(F.array().cast("array<int>"))


def ring_area(coords: Column) -> Column:
    """Signed planar area (counter-clockwise positive)."""
    return F.aggregate(_segments(coords), F.lit(0.0), lambda a, i: a + (
        coords[i - 1]["x"] * coords[i]["y"] - coords[i]["x"] * coords[i - 1]["y"]) / 2)


def line_length(coords: Column) -> Column:
    """Planar length."""
    return F.aggregate(_segments(coords), F.lit(0.0), lambda a, i: a + F.hypot(
        coords[i]["x"] - coords[i - 1]["x"], coords[i]["y"] - coords[i - 1]["y"]))


def line_length_m(coords: Column) -> Column:
    return F.aggregate(_segments(coords), F.lit(0.0), lambda a, i: a + distance_m(
        coords[i - 1]["x"], coords[i - 1]["y"], coords[i]["x"], coords[i]["y"]))


def longest_line(geom: Column) -> Column:
    """The first longest line of a (multi) line."""
    lines = F.flatten(geom["parts"])
    ranked = F.transform(lines, lambda c, i: F.struct(line_length(c).alias("n"), (-i).alias("i"), c.alias("c")))
    return F.array_max(ranked)["c"]


def longest_line_m(geom: Column) -> Column:
    """The first line of most metres of a (multi) line."""
    ranked = F.transform(F.flatten(geom["parts"]), lambda c, i: F.struct(line_length_m(c).alias("n"), (-i).alias("i"), c.alias("c")))
    return F.array_max(ranked)["c"]


def largest_polygon(geom: Column) -> Column:
    """Rings of the first polygon of largest outer area."""
    ranked = F.transform(geom["parts"], lambda r, i: F.struct(F.abs(ring_area(r[0])).alias("n"), (-i).alias("i"), r.alias("r")))
    return F.array_max(ranked)["r"]


def point_in_ring(x: Column, y: Column, coords: Column) -> Column:
    """Ray cast over a closed ring."""
    def cross(a: Column, i: Column) -> Column:
        p, q = coords[i], coords[i - 1]
        hit = ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
        return F.when(hit, ~a).otherwise(a)

    return F.aggregate(_segments(coords), F.lit(False), cross)


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in none of the others."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return point_in_ring(x, y, rings[0]) & ~F.exists(holes, lambda r: point_in_ring(x, y, r))


def line_midpoint(coords: Column) -> Column:
    """Point half-way along a line."""
    return let(line_length(coords) / 2, lambda half: _point_at(coords, half))


def _point_at(coords: Column, half: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(a: Column, i: Column) -> Column:
        p, q = coords[i - 1], coords[i]
        d = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        t = F.when(d > 0, (half - a["run"]) / d).otherwise(0.0)
        here = a["at"].isNull() & (a["run"] + d >= half)
        made = xy(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
        return F.struct((a["run"] + d).alias("run"), F.when(here, made).otherwise(a["at"]).alias("at"))

    return F.aggregate(_segments(coords), start, step, lambda a: F.coalesce(a["at"], F.get(coords, F.lit(0))))


def representative_point(geom: Column) -> Column:
    """Point for pois: a line's midpoint; a polygon's vertex mean if inside, else its first vertex; else the box centre."""
    def inside_or_first(ring: Column) -> Column:
        n = F.size(ring) - 1
        mean = lambda f: F.aggregate(F.slice(ring, 1, n), F.lit(0.0), lambda a, p: a + p[f]) / n
        return let(xy(mean("x"), mean("y")), lambda m: F.when(point_in_ring(m["x"], m["y"], ring), m).otherwise(ring[0]))

    b = bbox(geom)
    return (F.when(geom["kind"] == "Point", all_points(geom)[0])
            .when(geom["kind"].isin("LineString", "MultiLineString"), let(longest_line(geom), line_midpoint))
            .when(geom["kind"].isin("Polygon", "MultiPolygon"), let(largest_polygon(geom)[0], inside_or_first))
            .otherwise(xy((b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2)))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))
    return F.pmod(deg + 360.0, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def ecef(lon: Column, lat: Column, h: Column) -> Column:
    """WGS84 earth-centred position (x, y, z)."""
    a, e2 = 6378137.0, 6.69437999014e-3
    p, q = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    return F.struct(((n + h) * F.cos(p) * F.cos(q)).alias("x"), ((n + h) * F.cos(p) * F.sin(q)).alias("y"),
                    ((n * (1 - e2) + h) * F.sin(p)).alias("z"))


def normal(lon: Column, lat: Column) -> Column:
    p, q = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z"))


def region(minx: Column, miny: Column, maxx: Column, maxy: Column, low: Column, high: Column) -> Column:
    """Bounding region in radians and metres."""
    return F.struct(F.radians(minx).alias("west"), F.radians(miny).alias("south"), F.radians(maxx).alias("east"),
                    F.radians(maxy).alias("north"), low.alias("low"), high.alias("high"))

