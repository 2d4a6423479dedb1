"""Airports, runways, 3D partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..functions import tilemath as tm
from ..operators import catalog as cat
from ..operators import query as q
from ..operators import space
from ..views import view, with_views



def _dist(ax: str, ay: str, bx: str, by: str) -> str:
    return (f"(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({by} - {ay}) / 2), 2) + cos(radians({ay})) * cos(radians({by})) "
            f"* pow(sin(radians({bx} - {ax}) / 2), 2)))))")


def _bear(ax: str, ay: str, bx: str, by: str) -> str:
    return (f"fmod(degrees(atan2(sin(radians({bx} - {ax})) * cos(radians({by})), cos(radians({ay})) * sin(radians({by})) "
            f"- sin(radians({ay})) * cos(radians({by})) * cos(radians({bx} - {ax})))) + 360.0, 360.0)")


def _airports(spark, d):
    b = view(spark, d, "geo_boxes")
    corner = lambda x, y: g.xy(F.col(x), F.col(y))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    f = b.select(F.col("fid").alias("ord"), F.concat(F.lit("way/"), F.col("fid")).alias("id"),
                 F.when(F.col("fid") % 2 == 0, F.concat(F.lit("LE"), F.col("fid"))).alias("icao"), F.lit(None).cast("string").alias("ident"),
                 F.when(F.col("fid") % 3 == 0, F.concat(F.lit("I"), F.col("fid"))).alias("iata"), F.lit(" ").alias("ref"), F.lit("").alias("name"),
                 F.concat((F.col("fid") * 3).cast("string"), F.when(F.col("fid") % 2 == 0, " ft").otherwise(" m")).alias("ele"),
                 ((F.col("minx") + F.col("maxx")) / 2).alias("lon"), ((F.col("miny") + F.col("maxy")) / 2).alias("lat"), g.polygon(ring).alias("geom"))
    return cat.airports(f)


_AIR = """ap AS (SELECT fid AS ord, 'way/' || fid AS source_id, CASE WHEN fid % 2 = 0 THEN 'LE' || fid END AS icao, CASE WHEN fid % 3 = 0 THEN 'I' || fid END AS iata,
 round((minx + maxx) / 2, 8) AS lon, round((miny + maxy) / 2, 8) AS lat, round(CASE WHEN fid % 2 = 0 THEN fid * 3 * 0.3048::DOUBLE ELSE fid * 3 END, 2) AS elevation_m,
 minx, miny, maxx, maxy, coalesce(CASE WHEN fid % 2 = 0 THEN 'LE' || fid END, CASE WHEN fid % 3 = 0 THEN 'I' || fid END, 'way/' || fid) AS id FROM geo_boxes)"""


def airports(spark, d):
    return _airports(spark, d).select("ord", "id", "name", "icao", "iata", "lon", "lat", "elevation_m")


def airport_keys(spark, d):
    p = view(spark, d, "geo_points").select("fid", F.when(F.col("fid") % 2 == 0, F.concat(F.lit("LE"), F.col("fid") % 200)).otherwise(
        F.concat(F.lit("way/"), F.col("fid") % 200)).alias("airport_key"))
    return cat.lookup_key(p, _airports(spark, d)).select("fid", "by_key")


_KEYS = f"""{with_views("geo_points", "geo_boxes")}, {_AIR},
k AS (SELECT id AS k, ord FROM ap UNION SELECT source_id, ord FROM ap UNION SELECT icao, ord FROM ap UNION SELECT iata, ord FROM ap),
m AS (SELECT k, max(ord) AS by_key FROM k WHERE k IS NOT NULL GROUP BY k),
p AS (SELECT fid, CASE WHEN fid % 2 = 0 THEN 'LE' || (fid % 200) ELSE 'way/' || (fid % 200) END AS k FROM geo_points)
SELECT fid, by_key FROM p LEFT JOIN m USING (k)"""


def airports_containing(spark, d):
    return cat.containing(view(spark, d, "geo_points"), _airports(spark, d))


_CONTAIN = f"""{with_views("geo_points", "geo_boxes")}, {_AIR},
m AS (SELECT p.fid, a.ord, (a.maxx - a.minx) * (a.maxy - a.miny) AS area FROM geo_points p JOIN ap a
 ON p.lon >= a.minx AND p.lon < a.maxx AND p.lat >= a.miny AND p.lat < a.maxy)
SELECT fid, arg_min(ord, (area, ord)) AS by_area FROM m GROUP BY fid"""


def airports_nearest(spark, d):
    """Nearest airport centre within 300 km; distances equal to the millimetre are a tie, which the first airport wins."""
    return cat.nearest_within(view(spark, d, "geo_points"), _airports(spark, d), 300_000.0)


_NEAR = f"""{with_views("geo_points", "geo_boxes")}, {_AIR},
m AS (SELECT p.fid, a.ord, {_dist("p.lon", "p.lat", "a.lon", "a.lat")} AS m FROM geo_points p, ap a)
SELECT fid, arg_min(ord, (round(m, 3), ord)) AS by_distance FROM m WHERE m <= 300000 GROUP BY fid"""


def airport_assignment(spark, d):
    p = view(spark, d, "geo_points").select("fid", "lon", "lat", F.when(F.col("fid") % 20 == 0, F.concat(F.lit("LE"), F.col("fid") % 100)).alias("airport_key"))
    return cat.assign_airport(p, _airports(spark, d)).select("fid", "airport")


_ASSIGN = f"""{with_views("geo_points", "geo_boxes")}, {_AIR},
k AS (SELECT p.fid, max(a.ord) AS v FROM geo_points p JOIN ap a ON p.fid % 20 = 0 AND a.icao = 'LE' || (p.fid % 100) GROUP BY p.fid),
c AS (SELECT p.fid, arg_min(a.ord, ((a.maxx - a.minx) * (a.maxy - a.miny), a.ord)) AS v FROM geo_points p JOIN ap a
 ON p.lon >= a.minx AND p.lon < a.maxx AND p.lat >= a.miny AND p.lat < a.maxy GROUP BY p.fid),
n AS (SELECT fid, arg_min(ord, (round(m, 3), ord)) AS v FROM (SELECT p.fid, a.ord, {_dist("p.lon", "p.lat", "a.lon", "a.lat")} AS m FROM geo_points p, ap a) WHERE m <= 25000 GROUP BY fid)
SELECT p.fid, coalesce(k.v, c.v, n.v) AS airport FROM geo_points p LEFT JOIN k USING (fid) LEFT JOIN c USING (fid) LEFT JOIN n USING (fid)"""


def _runways(spark, d):
    """A runway line per footprint; its ends and ref follow from the key."""
    b = view(spark, d, "geo_boxes")
    n = (F.col("fid") % 18 + 1).cast("int")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    lines = b.select(F.col("fid").alias("airport"), F.col("fid").alias("ord"), F.concat(F.lit("r/"), F.col("fid")).alias("runway_id"),
                     F.concat(F.lit("RWY "), two(n), F.lit(" / "), two(n + 18)).alias("ref"), (F.col("minx") + 5).alias("ax"), (F.col("miny") + 5).alias("ay"),
                     (F.col("minx") + 5.02).alias("bx"), (F.col("miny") + 5 + (F.col("fid") % 7) / 200.0).alias("by"),
                     F.lit(None).cast("string").alias("ele"), (F.col("fid") * 3.0).alias("airport_elevation"))
    thr = b.where("fid % 3 = 0").select(F.col("fid").alias("airport"), two(n).alias("designator"), F.col("fid").alias("ord"),
                                        (F.col("minx") + 5.001).alias("lon"), (F.col("miny") + 5).alias("lat"), F.lit("101").alias("ele"))
    return lines, thr


def runway_directions(spark, d):
    lines, thr = _runways(spark, d)
    return cat.directions_from_lines(lines, thr).select("runway_id", "designator", F.round("heading", 1).alias("heading"), "elevation_m", "quality",
                                                        F.round("lon", 6).alias("lon"))


def _dir_sql() -> str:
    two = lambda e: f"lpad(({e})::VARCHAR, 2, '0')"
    diff = lambda a, b: f"least(fmod(abs({a} - {b}), 360.0), 360.0 - fmod(abs({a} - {b}), 360.0))"
    return f"""{with_views("geo_boxes")},
r AS (SELECT fid, minx + 5 AS ax, miny + 5 AS ay, minx + 5.02 AS bx, miny + 5 + (fid % 7) / 200.0::DOUBLE AS by_, fid % 18 + 1 AS n, fid % 3 = 0 AS t FROM geo_boxes),
e AS (SELECT *, {two('n')} AS designator, true AS low, n * 10.0 AS want FROM r UNION ALL SELECT *, {two('n + 18')}, false, CASE WHEN n = 18 THEN 0 ELSE (n + 18) * 10.0 END FROM r),
h AS (SELECT *, {diff(_bear("ax", "ay", "bx", "by_"), "want")} <= {diff(_bear("bx", "by_", "ax", "ay"), "want")} AS fwd FROM e),
s AS (SELECT *, CASE WHEN t AND low THEN ax + 0.001 WHEN fwd THEN ax ELSE bx END AS lon, CASE WHEN t AND low THEN ay WHEN fwd THEN ay ELSE by_ END AS lat FROM h),
o AS (SELECT *, {_dist("lon", "lat", "ax", "ay")} >= {_dist("lon", "lat", "bx", "by_")} AS far_a FROM s),
u AS (SELECT *, CASE WHEN t AND NOT low THEN ax + 0.001 WHEN far_a THEN ax ELSE bx END AS tx, CASE WHEN t AND NOT low THEN ay WHEN far_a THEN ay ELSE by_ END AS ty FROM o)
SELECT 'r/' || fid AS runway_id, designator, round(fmod(round({_bear("lon", "lat", "tx", "ty")}, 2), 360.0), 1) AS heading,
 CASE WHEN t AND low THEN 101.0 ELSE fid * 3.0 END::DOUBLE AS elevation_m, CASE WHEN t AND low THEN 'mapped-threshold' ELSE 'estimated' END AS quality, round(lon, 6) AS lon FROM u"""


def catalogue_summary(spark, d):
    lines, thr = _runways(spark, d)
    every = cat.directions_from_lines(lines, thr)
    points = lines.where("ord % 4 = 0").select("airport", "ord", F.concat("runway_id", F.lit("p")).alias("runway_id"), F.substring("ref", 5, 2).alias("ref"),
                                               F.lit(361.0).alias("heading"), F.col("ax").alias("lon"), F.col("ay").alias("lat"), "ele", "airport_elevation")
    given = cat.directions_from_points(points).withColumn("n", F.lit(0))
    best = cat.best_directions(every.unionByName(given))
    lost = lines.where("ord % 9 = 0").select("runway_id", F.lit(None).cast("long").alias("airport"))
    return cat.catalog_summary(best, lines.select("runway_id", "airport").unionByName(points.select("runway_id", "airport")).unionByName(lost))


_SUM = f"""{with_views("geo_boxes")} SELECT count(*) AS airports, 2 * count(*) AS directions, count(*) FILTER (fid % 3 = 0 OR fid % 4 = 0) AS mapped,
 2 * count(*) - count(*) FILTER (fid % 3 = 0 OR fid % 4 = 0) AS estimated, count(*) + count(*) FILTER (fid % 4 = 0) AS physical, count(*) FILTER (fid % 9 = 0) AS unresolved FROM geo_boxes"""


def catalogue(spark, d):
    """Airport documents: number of runways and their designators in natural order."""
    lines, thr = _runways(spark, d)
    doc = cat.build_catalog(_airports(spark, d), cat.best_directions(cat.directions_from_lines(lines, thr)))
    return doc.select("id", F.array_join(F.transform("runways", lambda r: r["designator"]), ",").alias("runways"))


_CAT = f"""{with_views("geo_boxes")}, {_AIR} SELECT id, lpad((ord % 18 + 1)::VARCHAR, 2, '0') || ',' || (ord % 18 + 19) AS runways FROM ap"""


def _aviation(spark, d):
    """One table of airports, runways and thresholds, told apart by layer and tags only."""
    b = view(spark, d, "geo_boxes")
    n = (F.col("fid") % 18 + 1).cast("int")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    at = lambda dx, dy: g.xy(F.col("minx") + dx, F.col("miny") + dy)
    tags = lambda **kw: F.map_filter(F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    lit = F.lit
    area = b.select((F.col("fid") * 10).alias("ord"), lit("aip").alias("layer"), g.polygon(F.array(at(0, 0), at(10, 0), at(10, 10), at(0, 10), at(0, 0))).alias("geom"),
                    tags(aeroway=lit("aerodrome"), id=F.concat(lit("way/"), "fid"), icao=F.when(F.col("fid") % 2 == 0, F.concat(lit("LE"), "fid")), ele=F.col("fid") * 3).alias("props"))
    strip = b.select((F.col("fid") * 10 + 1).alias("ord"), lit("aip").alias("layer"), g.line_string(F.array(at(5, 5), g.xy(F.col("minx") + 5.02, F.col("miny") + 5 + (F.col("fid") % 7) / 200.0))).alias("geom"),
                     tags(aeroway=lit("runway"), id=F.concat(lit("r/"), "fid"), ref=F.concat(lit("RWY "), two(n), lit(" / "), two(n + 18))).alias("props"))
    end = b.where("fid % 3 = 0").select((F.col("fid") * 10 + 2).alias("ord"), lit("aip").alias("layer"), g.point(at(5.001, 5)).alias("geom"),
                                        tags(aeroway=lit("threshold"), id=F.concat(lit("t/"), "fid"), ref=two(n), ele=lit("101")).alias("props"))
    given = b.where("fid % 4 = 0").select((F.col("fid") * 10 + 3).alias("ord"), lit("runways").alias("layer"), g.point(at(5, 5)).alias("geom"),
                                          tags(id=F.concat(lit("p/"), "fid"), airportId=F.concat(lit("way/"), "fid"), runwayDesignator=two(n), headingDeg=lit("361"), elevationM=lit("7")).alias("props"))
    lost = b.where("fid % 5 = 0").select((F.col("fid") * 10 + 4).alias("ord"), lit("aip").alias("layer"), F.lit(None).cast(g.GEOMETRY).alias("geom"),
                                         tags(aeroway=lit("runway"), id=F.concat(lit("x/"), "fid"), ref=lit("01/19")).alias("props"))
    plain = b.where("fid % 7 = 0").select((F.col("fid") * 10 + 5).alias("ord"), lit("aip").alias("layer"), g.line_string(F.array(at(1, 1), at(2, 2))).alias("geom"),
                                          tags(aeroway=lit("runway"), id=F.concat(lit("y/"), "fid"), ref=lit(" ; ")).alias("props"))
    return area.unionByName(strip).unionByName(end).unionByName(given).unionByName(lost).unionByName(plain)


def airport_documents(spark, d):
    """Airports of one raw feature table with their runways, natural order."""
    docs, _ = cat.airport_catalog(_aviation(spark, d))
    said = F.transform("runways", lambda r: F.concat_ws(":", r["designator"], F.round(r["heading"], 1).cast("string"), r["quality"], r["elevation_source"], F.round(r["elevation_m"], 1).cast("string")))
    return docs.select("id", "lon", "lat", F.array_join(said, ",").alias("runways"))


def airport_counts(spark, d):
    return cat.airport_catalog(_aviation(spark, d))[1]


def _aviation_sql() -> str:
    """Rule: a runway or threshold belongs to the airport that its key names, else to the smallest that holds its anchor (its own one holds it, so the
    nearest is never asked); a runway end takes the nearest threshold of its airport and designator, an airport the best direction of each designator."""
    two = lambda e: f"lpad(({e})::VARCHAR, 2, '0')"
    diff = lambda a, b: f"least(fmod(abs({a} - {b}), 360.0), 360.0 - fmod(abs({a} - {b}), 360.0))"
    return f"""{with_views("geo_boxes")},
ap AS (SELECT fid, fid * 10 AS ord, minx AS x0, miny AS y0, minx + 10 AS x1, miny + 10 AS y1, (minx + 10 - minx) * (miny + 10 - miny) AS area FROM geo_boxes),
ra AS (SELECT fid, fid * 10 + 1 AS ord, minx + 5 AS ax, miny + 5 AS ay, minx + 5.02 AS bx, miny + 5 + (fid % 7) / 200.0::DOUBLE AS by_, fid % 18 + 1 AS n FROM geo_boxes),
ta AS (SELECT fid, fid * 10 + 2 AS ord, minx + 5.001 AS tx, miny + 5 AS ty, {two('fid % 18 + 1')} AS designator FROM geo_boxes WHERE fid % 3 = 0),
asked AS (SELECT ord, ax + (bx - ax) * 0.5 AS lon, ay + (by_ - ay) * 0.5 AS lat FROM ra UNION ALL SELECT ord, tx, ty FROM ta),
held AS (SELECT q.ord, arg_min(ap.fid, (area, ap.ord)) AS airport FROM asked q JOIN ap ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY q.ord),
e AS (SELECT ra.*, airport, 0 AS k, {two('n')} AS designator, n * 10.0 AS want FROM ra JOIN held USING (ord)
 UNION ALL SELECT ra.*, airport, 1, {two('n + 18')}, CASE WHEN n = 18 THEN 0 ELSE (n + 18) * 10.0 END FROM ra JOIN held USING (ord)),
t AS (SELECT ta.*, airport FROM ta JOIN held USING (ord)),
f AS (SELECT e.ord, k, arg_min(struct_pack(tx := tx, ty := ty), (least({_dist("tx", "ty", "ax", "ay")}, {_dist("tx", "ty", "bx", "by_")}), t.ord)) AS t FROM e JOIN t USING (airport, designator) GROUP BY e.ord, k),
s AS (SELECT e.*, f.t AS own, o.t AS other, {diff(_bear("ax", "ay", "bx", "by_"), "want")} <= {diff(_bear("bx", "by_", "ax", "ay"), "want")} AS fwd
 FROM e LEFT JOIN f ON f.ord = e.ord AND f.k = e.k LEFT JOIN f o ON o.ord = e.ord AND o.k = 1 - e.k),
l AS (SELECT *, coalesce(own.tx, CASE WHEN fwd THEN ax ELSE bx END) AS lon, coalesce(own.ty, CASE WHEN fwd THEN ay ELSE by_ END) AS lat FROM s),
u AS (SELECT *, {_dist("lon", "lat", "ax", "ay")} >= {_dist("lon", "lat", "bx", "by_")} AS far_a FROM l),
w AS (SELECT *, coalesce(other.tx, CASE WHEN far_a THEN ax ELSE bx END) AS ux, coalesce(other.ty, CASE WHEN far_a THEN ay ELSE by_ END) AS uy FROM u),
x AS (SELECT airport, ord, k, designator, fmod(round({_bear("lon", "lat", "ux", "uy")}, 2), 360.0) AS heading, CASE WHEN own IS NULL THEN 'estimated' ELSE 'mapped-threshold' END AS quality,
  CASE WHEN own IS NULL THEN 1 ELSE 2 END AS good, CASE WHEN own IS NULL THEN 'airport' ELSE 'threshold' END AS src, CASE WHEN own IS NULL THEN airport * 3.0 ELSE 101.0 END::DOUBLE AS ele FROM w
 UNION ALL SELECT fid, fid * 10 + 3, 0, {two('fid % 18 + 1')}, 1.0, 'source', 3, 'source', 7.0 FROM geo_boxes WHERE fid % 4 = 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY airport, designator ORDER BY good DESC, ord, k) AS place FROM x) WHERE place = 1)"""


_ADOC = f"""{_aviation_sql()}
SELECT coalesce(CASE WHEN b.fid % 2 = 0 THEN 'LE' || b.fid END, 'way/' || b.fid) AS id, round(minx + 5, 8) AS lon, round(miny + 5, 8) AS lat,
 string_agg(designator || ':' || round(heading, 1)::DOUBLE || ':' || quality || ':' || src || ':' || ele, ',' ORDER BY designator) AS runways
FROM best JOIN geo_boxes b ON airport = b.fid GROUP BY b.fid, minx, miny"""
_ACNT = f"""{_aviation_sql()}
SELECT count(DISTINCT airport) AS airports, count(*) AS directions, count(*) FILTER (good > 1) AS mapped, count(*) FILTER (good = 1) AS estimated,
 (SELECT count(*) + count(*) FILTER (fid % 4 = 0) FROM geo_boxes) AS physical, (SELECT count(*) FILTER (fid % 5 = 0) FROM geo_boxes) AS unresolved FROM best"""


def quadtree_leaves(spark, d):
    leaves = space.quadtree(q.boxes_of_points(view(spark, d, "geo_points")), (-180.0, -85.0, 180.0, 85.0), 40, 6)
    return leaves.groupBy("depth", "i", "j").agg(F.count("*").alias("n"), (F.max("batch") + 1).alias("batches"))


def _quad_sql(limit: int = 40, deep: int = 6) -> str:
    return f"""{with_views("geo_points")},
a AS (SELECT fid, floor((lon + 180.0000001) / 360.0000002 * {1 << deep})::BIGINT AS ci, floor((lat + 85.0000001) / 170.0000002 * {1 << deep})::BIGINT AS cj FROM geo_points),
e AS (SELECT fid, depth::INTEGER AS depth, ci >> ({deep} - depth) AS i, cj >> ({deep} - depth) AS j FROM a, range(0, {deep + 1}) r(depth)),
t AS (SELECT depth, i, j, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT fid, min(e.depth) AS depth FROM e JOIN t USING (depth, i, j) WHERE n <= {limit} OR e.depth = {deep} GROUP BY fid)
SELECT depth, i, j, count(*) AS n, ((count(*) - 1) // {limit} + 1)::INTEGER AS batches FROM f JOIN e USING (fid, depth) GROUP BY depth, i, j"""


def quadtree_summary(spark, d):
    return space.partition_summary(space.quadtree(q.boxes_of_points(view(spark, d, "geo_points")), (-180.0, -85.0, 180.0, 85.0), 40, 6)).drop("largest_batch")


def tile_hierarchy(spark, d):
    """Ancestors of occupied z7 tiles up to z3, with rolled-up regions."""
    t = view(spark, d, "geo_points").select(F.lit(7).alias("z"), tm.tile_x(F.col("lon"), 7).alias("x"), tm.tile_y(F.col("lat"), 7).alias("y")).distinct()
    h = space.tile_hierarchy(space.tile_regions(t), 3, 7)
    return h.select("z", "x", "y", F.round("west", 6).alias("west"), F.round("north", 6).alias("north"), "content", F.round("geometric_error", 3).alias("geometric_error"))


def _hier_sql() -> str:
    from .planning import _tx, _ty

    return f"""{with_views("geo_points")}, t AS (SELECT DISTINCT {_tx(7)} AS x, {_ty(7)} AS y FROM geo_points),
r AS (SELECT x, y, radians(x / 128.0::DOUBLE * 360.0 - 180.0) AS west, atan(sinh(pi() * (1 - 2 * y / 128.0::DOUBLE))) AS north FROM t),
u AS (SELECT z::INTEGER AS z, x >> (7 - z) AS x, y >> (7 - z) AS y, west, north FROM r, range(3, 8) q(z))
SELECT z, x, y, round(min(west), 6) AS west, round(max(north), 6) AS north, z = 7 AS content,
 round(CASE WHEN z < 7 THEN 2 * pi() * 6378137 / 256 * 8 / pow(2, z) ELSE 0 END, 3) AS geometric_error FROM u GROUP BY z, x, y"""


def earth_positions(spark, d):
    """Tile-local origins of earth-centred positions."""
    p = view(spark, d, "geo_points").select(tm.tile_x(F.col("lon"), 2).alias("tx"), tm.tile_y(F.col("lat"), 2).alias("ty"),
                                            g.ecef(F.col("lon"), F.col("lat"), F.lit(10.0)).alias("e")).select("tx", "ty", "e.*")
    c = space.rtc_center(p, "tx", "ty")
    return c.select("tx", "ty", *[F.round(k, 2).alias(k) for k in "xyz"])


def _ecef_sql() -> str:
    from .planning import _tx, _ty

    return f"""{with_views("geo_points")}, p AS (SELECT {_tx(2)} AS tx, {_ty(2)} AS ty, radians(lon) AS q, radians(lat) AS p FROM geo_points),
n AS (SELECT *, 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(p), 2)) AS n FROM p),
e AS (SELECT tx, ty, (n + 10) * cos(p) * cos(q) AS x, (n + 10) * cos(p) * sin(q) AS y, (n * (1 - 6.69437999014e-3) + 10) * sin(p) AS z FROM n)
SELECT tx, ty, round((min(x) + max(x)) / 2, 2) AS x, round((min(y) + max(y)) / 2, 2) AS y, round((min(z) + max(z)) / 2, 2) AS z FROM e GROUP BY tx, ty"""


QUERIES = {f.__name__: f for f in (airports, airport_keys, airports_containing, airports_nearest, airport_assignment, runway_directions,
                                   catalogue_summary, catalogue, airport_documents, airport_counts, quadtree_leaves, quadtree_summary, tile_hierarchy, earth_positions)}
ORACLES = {
    "airport_documents": _ADOC, "airport_counts": _ACNT,
    "airports": f"{with_views('geo_boxes')}, {_AIR} SELECT ord, id, id AS name, icao, iata, lon, lat, elevation_m FROM ap",
    "airport_keys": _KEYS, "airports_containing": _CONTAIN, "airports_nearest": _NEAR, "airport_assignment": _ASSIGN,
    "runway_directions": _dir_sql(), "catalogue_summary": _SUM, "catalogue": _CAT, "quadtree_leaves": _quad_sql(),
    "quadtree_summary": f"SELECT sum(n)::BIGINT AS features, count(*) AS leaves, max(n) AS largest, max(depth) AS depth, sum(batches)::BIGINT AS batches FROM ({_quad_sql()})",
    "tile_hierarchy": _hier_sql(), "earth_positions": _ecef_sql(),
}
