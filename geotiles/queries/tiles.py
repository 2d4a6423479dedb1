"""Tile limits, pyramids, labels and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import policy as pol
from ..functions import tilemath as tm
from ..operators import coverage as cov
from ..operators import labels as lab
from ..operators import query as q
from ..plans import pyramid as pyr
from ..views import view, with_views
from .planning import _tx, _ty


def _features(spark, d):
    """World-wide points as a layered feature table."""
    p = view(spark, d, "geo_points")
    layer = F.when(F.col("fid") % 3 == 0, "observations").when(F.col("fid") % 3 == 1, "stations").otherwise("sights")
    df = p.select(layer.alias("layer"), (F.col("fid") % 3).cast("int").alias("layer_order"), "fid", "lon", "lat", "priority", "amenity", "name")
    return q.boxes_of_points(df).withColumns({"geom": g.point(g.xy(F.col("lon"), F.col("lat"))), "props": F.create_map(F.lit("amenity"), F.col("amenity"))})


def feature_tiles(spark, d):
    """Tiles whose buffered box each point touches, z6."""
    return pyr.assign_tiles(_features(spark, d).select("fid", *pyr.BOX), 6).groupBy("x", "y").agg(F.count("*").alias("n"))


def _buffered(z: int, box: tuple[float, float, float, float] | None = None) -> str:
    n = 1 << z
    xs, ys = f"range(0, {n})", f"range(0, {n})"
    if box:  # tiles about a box only: the others cannot touch what lies in it
        import math

        row = lambda lat: (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n
        xs = f"range({int((box[0] + 180) / 360 * n) - 2}, {int((box[2] + 180) / 360 * n) + 3})"
        ys = f"range({int(row(box[3])) - 2}, {int(row(box[1])) + 3})"
    return f"""bt AS (SELECT x, y, greatest(-180.0, x * 360.0 / {n} - 180.0 - 360.0 / {n} * 128 / 4096) AS bx0, least(180.0, (x + 1) * 360.0 / {n} - 180.0 + 360.0 / {n} * 128 / 4096) AS bx1,
 greatest(-85.05112878, s - (t - s) * 128 / 4096) AS by0, least(85.05112878, t + (t - s) * 128 / 4096) AS by1 FROM (
 SELECT x, y, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / {n}.0::DOUBLE)))) AS s, degrees(atan(sinh(pi() * (1 - 2 * y / {n}.0::DOUBLE)))) AS t FROM {xs} a(x), {ys} b(y)))"""


_TOUCH = "lon >= bx0 AND lon <= bx1 AND lat >= by0 AND lat <= by1"


def tile_top(spark, d):
    """Five best points per layer and tile, then eight per tile, z2."""
    at = pyr.assign_tiles(_features(spark, d).drop("geom", "props"), 2)
    cut = pyr.top_per_layer(at, F.lit(5))
    return pyr.top_per_tile(cut, F.lit(8)).select("x", "y", "layer", "fid")


_TILETOP = f"""{with_views("geo_points")}, {_buffered(2)},
f AS (SELECT *, CASE fid % 3 WHEN 0 THEN 'observations' WHEN 1 THEN 'stations' ELSE 'sights' END AS layer, fid % 3 AS o FROM geo_points),
a AS (SELECT x, y, layer, o, fid, priority, row_number() OVER (PARTITION BY x, y, layer ORDER BY priority DESC, fid) AS n FROM f JOIN bt ON {_TOUCH}),
b AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY priority DESC, o, fid) AS m FROM a WHERE n <= 5)
SELECT x, y, layer, fid FROM b WHERE m <= 8"""


def pyramid_stats(spark, d):
    """Tile statistics of a point pyramid, z0..z4, at most 50 features a tile."""
    tiles, stats = pyr.tile_pyramid(_features(spark, d).drop("priority"), 0, 4, max_features=50)
    return stats.select("z", "x", "y", "original", "encoded", "dropped", "dropped_small", "vertices", "empty_reason")


def _stats_sql() -> str:
    parts = []
    for z in range(5):
        n = 1 << z
        px = f"round(((lon + 180) / 360.0::DOUBLE * {n} - x) * 4096, 6)"
        py = f"round(((0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi()) * {n} - y) * 4096, 6)"
        parts.append(f"""SELECT {z}::INTEGER AS z, x, y, {px} BETWEEN -128 AND 4224 AND {py} BETWEEN -128 AND 4224 AS inside,
 row_number() OVER (PARTITION BY x, y ORDER BY fid % 3, fid) AS n FROM geo_points JOIN ({_buffered(z)[7:-1]}) ON {_TOUCH}""")
    return f"""{with_views("geo_points")}, s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT z, x, y, count(*) AS original, count(*) FILTER (n <= 50 AND inside) AS encoded, count(*) FILTER (n <= 50) AS kept FROM s GROUP BY z, x, y)
SELECT z, x, y, original, encoded, original - kept AS dropped, 0::BIGINT AS dropped_small, kept AS vertices,
 CASE WHEN encoded > 0 THEN 'none' WHEN original > kept THEN 'filtered' ELSE 'no_tile_geometry' END AS empty_reason FROM g"""


def _bent_lines(spark, d):
    """A line of three points per point: the middle one sticks out by 0.05 or 0.5 degrees; polygons for every fifth."""
    p = view(spark, d, "geo_points").select("fid", (F.col("lon") * 0.9).alias("lon"), (F.col("lat") * 0.9).alias("lat"))
    out = F.when(F.col("fid") % 2 == 0, 0.05).otherwise(0.5)
    at = lambda dx, dy: g.xy(F.col("lon") + dx, F.col("lat") + dy)
    line = g.line_string(F.array(at(0, 0.0), at(1, out), at(2, 0.0)))
    area = g.polygon(F.array(at(0, 0.0), at(1, -0.05), at(2, 0.0), at(2, 2.0), at(0, 2.0), at(0, 0.0)))
    f = p.withColumn("geom", F.when(F.col("fid") % 5 == 0, area).otherwise(line).cast(g.GEOMETRY)).withColumn("_b", g.bbox(F.col("geom")))
    return f.select(F.lit("shapes").alias("layer"), F.lit(0).alias("layer_order"), "fid", "geom", F.create_map(F.lit("n"), F.col("fid").cast("string")).alias("props"), "_b.*")


def shape_stats(spark, d):
    """Vertices before and after simplification, and the tolerance, of the lines and polygons that z3 tiles keep: 6 500 at most, in order of fid."""
    _, stats = pyr.tile_pyramid(_bent_lines(spark, d), 3, 3)
    return stats.select("x", "y", "original", "dropped", "vertices", "simplified", F.round("tolerance", 6).alias("tolerance"))


_SHAPES = f"""{with_views("geo_points")}, {_buffered(3)},
f AS (SELECT fid, lon * 0.9 AS x0, lat * 0.9 AS y0, fid % 5 = 0 AS area, fid % 2 = 0 AS flat FROM geo_points),
b AS (SELECT *, x0 + 2 AS x1, CASE WHEN area THEN y0 - 0.05 ELSE y0 END AS lo, CASE WHEN area THEN y0 + 2.0 WHEN flat THEN y0 + 0.05 ELSE y0 + 0.5 END AS hi FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY fid) <= 6500 AS kept FROM b JOIN bt ON x1 >= bx0 AND x0 <= bx1 AND hi >= by0 AND lo <= by1)
SELECT x, y, count(*) AS original, count(*) FILTER (NOT kept) AS dropped, sum(CASE WHEN area THEN 6 ELSE 3 END) FILTER (kept)::BIGINT AS vertices,
 sum(CASE WHEN area THEN 5 WHEN flat THEN 2 ELSE 3 END) FILTER (kept)::BIGINT AS simplified,
 round(max(CASE WHEN area THEN 11.55 ELSE 10.01 END::DOUBLE) FILTER (kept) * 45 / 4096, 6) AS tolerance FROM t GROUP BY x, y"""


def way_features(spark, d):
    """The ways as a layer of roads."""
    from ..operators.assemble import resolve_way_coords

    w = resolve_way_coords(view(spark, d, "geo_way_refs"), view(spark, d, "geo_nodes")).where(F.size("coords") >= 2)
    f = w.select(F.lit("roads").alias("layer"), F.lit(0).alias("layer_order"), F.col("way_id").alias("fid"), g.line_string(F.col("coords")).alias("geom"),
                 F.create_map(F.lit("highway"), F.when(F.col("way_id") % 2 == 0, "primary").otherwise("service")).alias("props"))
    return f.withColumn("_b", g.bbox(F.col("geom"))).select("*", "_b.*").drop("_b")


def pyramid_tiles(spark, d):
    """Encoded tiles of the ways' lines over the city by the built-in policy, z9 to z11 (payload sizes)."""
    tiles, _ = pyr.tile_pyramid(way_features(spark, d), 9, 11, pol.osm_policy())
    return tiles.select("z", "x", "y", F.length("payload").alias("bytes"))


def pyramid_counts(spark, d):
    """What the same job reads and keeps per tile: major roads only."""
    _, stats = pyr.tile_pyramid(way_features(spark, d), 9, 11, pol.osm_policy())
    return stats.select("z", "x", "y", "original", (F.col("original") - F.col("dropped") + F.col("dropped_small")).alias("kept"))


def _counts_sql() -> str:
    parts = [f"""SELECT {z}::INTEGER AS z, x, y, count(*) AS original FROM wb JOIN ({_buffered(z, (-3.9, 40.3, -3.5, 40.6))[7:-1]}) ON maxx >= bx0 AND minx <= bx1 AND maxy >= by0 AND miny <= by1
 WHERE fid % 2 = 0 AND n >= 2 GROUP BY x, y""" for z in (9, 10, 11)]
    return f"""{with_views("geo_way_refs", "geo_nodes")}, wb AS (SELECT way_id AS fid, count(*) AS n, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy
 FROM geo_way_refs JOIN geo_nodes ON ref = id GROUP BY way_id), t AS ({" UNION ALL ".join(parts)})
SELECT z, x, y, original, least(original, CASE WHEN z = 11 THEN 3500 ELSE 1800 END)::BIGINT AS kept FROM t"""


def _poi_features(spark, d):
    """Named points as pois, a tenth of them with a stored category."""
    p = view(spark, d, "geo_points")
    props = F.map_filter(F.create_map(F.lit("amenity"), "amenity", F.lit("name"), "name", F.lit("poi_category"), F.when(F.col("fid") % 10 == 0, "transport")), lambda k, v: v.isNotNull())
    return p.select(F.lit("pois").alias("layer"), F.lit(0).alias("layer_order"), "fid", g.point(g.xy(F.col("lon"), F.col("lat"))).alias("geom"),
                    F.col("lon").alias("minx"), F.col("lat").alias("miny"), F.col("lon").alias("maxx"), F.col("lat").alias("maxy"), props.alias("props"))


def poi_tiles(spark, d):
    """What tiles of z15 to z17 read and keep of pois and their labels: consumer pois are off, a style hides town halls and shows fuel as transport."""
    style = {"layers": {"pois": {"classes": {"amenity": ["hospital", "townhall", "fuel", "restaurant"]}, "byProperty": {"amenity": {"townhall": {"visible": False}}}}}}
    _, stats = pyr.tile_pyramid(_poi_features(spark, d), 15, 17, pol.osm_policy(style=style), labels=("poi_labels",))
    return stats.select("z", "x", "y", "original", (F.col("original") - F.col("dropped") + F.col("dropped_small")).alias("kept"))


def _poi_sql() -> str:
    parts = []
    for z in (16, 17):
        n = 1 << z
        parts.append(f"""SELECT {z}::INTEGER AS z, x, y, seen, shown FROM (
 SELECT *, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / {n}.0::DOUBLE)))) AS s, degrees(atan(sinh(pi() * (1 - 2 * y / {n}.0::DOUBLE)))) AS t FROM (
 SELECT lon, lat, seen, shown, floor((lon + 180) / 360 * {n})::BIGINT + dx AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * {n})::BIGINT + dy AS y FROM k, range(-1, 2) a(dx), range(-1, 2) b(dy)))
 WHERE lon >= x * 360.0 / {n} - 180.0 - 360.0 / {n} * 128 / 4096 AND lon <= (x + 1) * 360.0 / {n} - 180.0 + 360.0 / {n} * 128 / 4096
  AND lat >= s - (t - s) * 128 / 4096 AND lat <= t + (t - s) * 128 / 4096""")
    return f"""{with_views("geo_points")},
k AS (SELECT *, amenity IN ('hospital', 'fuel', 'restaurant') OR fid % 10 = 0 AS seen,
 amenity IN ('hospital', 'fuel', 'restaurant') AND (amenity <> 'restaurant' OR fid % 10 = 0) AS shown FROM geo_points WHERE amenity <> 'townhall'),
t AS ({" UNION ALL ".join(parts)})
SELECT z, x, y, (count(*) + CASE WHEN z = 17 THEN count(*) FILTER (shown) ELSE 0 END)::BIGINT AS original,
 (count(*) FILTER (shown) * CASE WHEN z = 17 THEN 2 ELSE 1 END)::BIGINT AS kept FROM t WHERE seen AND x >= 0 AND x < (1 << z) GROUP BY z, x, y"""


def _stored_points(spark, d) -> str:
    """Points and footprints as packed layers in a folder of the checkpoint directory."""
    from ..operators.query import boxes_of_points
    from ..sources import layers_io
    from ..sources.scratch import fresh_folder

    p = boxes_of_points(view(spark, d, "geo_points")).select(F.lit("points").alias("layer"), "fid", "minx", "miny", "maxx", "maxy")
    b = view(spark, d, "geo_boxes").select(F.lit("boxes").alias("layer"), "fid", "minx", "miny", "maxx", "maxy")
    path = fresh_folder(spark, "layers")
    layers_io.write_layers(p.unionByName(b), path, rows=100)
    return path


def stored_box(spark, d):
    """Features of two layers in a box, written by tiles and read back through the index."""
    from ..sources import layers_io

    path = _stored_points(spark, d)
    return layers_io.read_layer(spark, path, "points", (-60.0, -40.0, 60.0, 40.0)).select("layer", "fid").unionByName(
        layers_io.read_layer(spark, path, "boxes", (-60.0, -40.0, 60.0, 40.0)).select("layer", "fid"))


def stored_joins(spark, d):
    """Footprints with the stored points they hold: tiles meet the footprints first."""
    from ..sources import layers_io

    return layers_io.query_layer(spark, _stored_points(spark, d), "points", view(spark, d, "geo_boxes"))


_STORED = f"""{with_views("geo_points", "geo_boxes")} SELECT 'points' AS layer, fid FROM geo_points WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40
 UNION ALL SELECT 'boxes', fid FROM geo_boxes WHERE maxx >= -60 AND minx <= 60 AND maxy >= -40 AND miny <= 40"""
_STOREDJ = f"""{with_views("geo_points", "geo_boxes")} SELECT b.fid AS box_fid, p.fid FROM geo_boxes b JOIN geo_points p ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy"""


def layer_priorities(spark, d):
    """Priorities of the other layers from their properties, z14, and with the size of the box below z13."""
    p = view(spark, d, "geo_points")
    layers = ("boundaries", "aip", "landuse", "water", "coastline", "railways", "cliffs", "terrain", "pois", "other")
    rows = p.select("fid", F.explode(F.array(*map(F.lit, layers))).alias("layer"))
    pick = lambda k, *vs: F.get(F.array(*[F.lit(v) for v in vs]), (F.col("fid") % len(vs)).cast("int"))
    get = lambda k: {"admin_level": pick(k, "2", "8", "", "x", None), "aeroway": pick(k, "runway", "apron", "gate"), "landuse": pick(k, "forest", "retail", "farmland", "grass"),
                     "natural": pick(k, "wood", None, None), "leisure": pick(k, None, "park")}.get(k, F.lit(None).cast("string"))
    box = F.struct(F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(0.03).alias("maxx"), F.lit(0.04).alias("maxy"))
    at = lambda z: pol.priority(F.col("layer"), get, F.lit("LineString"), box, F.lit(z))
    return rows.select("fid", "layer", F.round(at(14), 6).alias("near"), F.round(at(11), 6).alias("far"))


_PRIO = f"""{with_views("geo_points")}, r AS (SELECT fid, unnest(['boundaries', 'aip', 'landuse', 'water', 'coastline', 'railways', 'cliffs', 'terrain', 'pois', 'other']) AS layer FROM geo_points),
g AS (SELECT *, CASE WHEN fid % 4 = 0 OR fid % 3 = 0 THEN 520 WHEN fid % 4 = 1 THEN 430 WHEN fid % 2 = 1 OR fid % 4 = 2 THEN 360 END AS ground FROM r),
b AS (SELECT *, CASE layer WHEN 'boundaries' THEN CASE fid % 5 WHEN 0 THEN 860 WHEN 1 THEN 440 WHEN 2 THEN 1000 WHEN 3 THEN 300 ELSE 1000 END WHEN 'aip' THEN CASE fid % 3 WHEN 0 THEN 870 WHEN 1 THEN 680 ELSE 240 END
 WHEN 'landuse' THEN ground WHEN 'water' THEN 860 WHEN 'coastline' THEN 830 WHEN 'railways' THEN 680 WHEN 'cliffs' THEN 620 WHEN 'terrain' THEN 540 WHEN 'pois' THEN 60 ELSE 100 END AS base FROM g)
SELECT fid, layer, coalesce(base, 220)::DOUBLE AS near, (coalesce(base, 100) + CASE WHEN layer = 'pois' THEN 0 ELSE 45 END)::DOUBLE AS far FROM b"""


def tile_directory(spark, d):
    """Offsets of tiles in id order, without a single-partition window."""
    from ..sources.tiles_io import with_offsets

    t = view(spark, d, "geo_points").select("fid", tm.tile_x(F.col("lon"), 7).alias("x"), tm.tile_y(F.col("lat"), 7).alias("y")).groupBy("x", "y").agg(
        F.sum("fid").alias("length"))
    t = t.select(F.lit(7).alias("z"), "x", "y", tm.tile_id(7, F.col("x"), F.col("y")).alias("tile_id"), "length")
    return with_offsets(t).select("tile_id", "offset", "length", "leaf")


def _dir_sql() -> str:
    from .planning import _IDS, VIEWS

    ids = _IDS.replace("{points}", VIEWS["geo_points"]).replace("5 AS k", "6 AS k").replace(_tx(6), _tx(7)).replace(_ty(6), _ty(7)).replace("1365 + d", "5461 + d")
    head, tail = ids.rsplit("SELECT fid", 1)
    return f"""{head}, i AS (SELECT fid{tail}), g AS (SELECT tile_id, sum(fid)::BIGINT AS length FROM i GROUP BY tile_id)
SELECT tile_id, coalesce(sum(length) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length,
 ((row_number() OVER (ORDER BY tile_id) - 1) // 512)::BIGINT AS leaf FROM g"""


def policy_table(spark, d):
    """Limits, tolerances and sizes of every layer and zoom in use."""
    z = view(spark, d, "geo_obs").select(F.coalesce("last_zoom", F.lit(7)).cast("int").alias("z"))
    rows = z.select("z", F.explode(F.array(*map(F.lit, ("roads", "buildings", "water", "landuse", "pois", "other")))).alias("layer"))
    kind = F.when(F.col("layer") == "roads", "LineString").otherwise("Polygon")
    return rows.select("z", "layer", pol.layer_limit(F.col("layer"), F.col("z")).alias("n"), pol.tile_budget(F.col("z")).cast("int").alias("budget"),
                       pol.min_size(F.col("layer"), kind, F.col("z")).alias("smallest"), tm.detail_for_zoom(F.col("z")).alias("detail")).distinct()


_POLICY = f"""{with_views("geo_obs")}, z AS (SELECT DISTINCT coalesce(last_zoom, 7)::INTEGER AS z FROM geo_obs),
r AS (SELECT z, unnest(['roads', 'buildings', 'water', 'landuse', 'pois', 'other']) AS layer FROM z)
SELECT z, layer, CASE WHEN z <= 10 THEN CASE layer WHEN 'roads' THEN 1800 WHEN 'landuse' THEN 1600 WHEN 'water' THEN 1200 WHEN 'other' THEN 500 ELSE 0 END
 WHEN z = 11 THEN CASE layer WHEN 'roads' THEN 3500 WHEN 'landuse' THEN 2200 WHEN 'water' THEN 1600 WHEN 'other' THEN 1000 ELSE 0 END
 WHEN z = 12 THEN CASE layer WHEN 'roads' THEN 5000 WHEN 'landuse' THEN 2600 WHEN 'water' THEN 1800 WHEN 'other' THEN 1500 WHEN 'buildings' THEN 300 ELSE 0 END
 WHEN z IN (13, 14) THEN CASE layer WHEN 'buildings' THEN CASE z WHEN 13 THEN 900 ELSE 4000 END WHEN 'pois' THEN 0 ELSE 1152921504606846976 END ELSE 1152921504606846976 END::BIGINT AS n,
 (CASE WHEN z <= 10 THEN 6500 WHEN z = 11 THEN 10000 ELSE 12000 END)::INTEGER AS budget,
 (CASE WHEN z >= 15 THEN 0 ELSE CASE layer WHEN 'buildings' THEN CASE WHEN z <= 12 THEN 18 WHEN z = 13 THEN 10 ELSE 5 END WHEN 'pois' THEN 4
  WHEN 'roads' THEN CASE WHEN z <= 10 THEN 3 WHEN z <= 12 THEN 2 ELSE 1 END WHEN 'water' THEN CASE WHEN z <= 10 THEN 5 WHEN z <= 12 THEN 3 ELSE 1.5 END
  WHEN 'landuse' THEN CASE WHEN z <= 10 THEN 6 WHEN z <= 12 THEN 4 ELSE 2 END ELSE CASE WHEN z <= 10 THEN 3 ELSE 1 END END END)::DOUBLE AS smallest,
 CASE WHEN z <= 11 THEN 'overview' WHEN z <= 14 THEN 'normal' ELSE 'full' END AS detail FROM r"""


def road_priorities(spark, d):
    w = view(spark, d, "geo_ways")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in pyr.BOX])
    get = lambda k: F.col("highway") if k == "highway" else F.lit(None).cast("string")
    return w.select("highway", pol.priority(F.lit("roads"), get, F.lit("LineString"), zero, F.lit(13)).alias("priority")).groupBy("highway", "priority").agg(F.count("*").alias("n"))


def poi_label_candidates(spark, d):
    """Best poi labels per z3 tile: as many as the layer may have at z17."""
    p = view(spark, d, "geo_points")
    get = lambda k: {"name": F.when(F.col("fid") % 4 == 0, "restaurant").otherwise(F.col("name")), "amenity": F.col("amenity")}.get(k, F.lit(None).cast("string"))
    c = lab.label_candidates(p, "poi_labels", 17, get)
    c = c.withColumns({"z": F.lit(3), "x": tm.tile_x(F.col("lon"), 3), "y": tm.tile_y(F.col("lat"), 3), "layer": F.lit("poi_labels")})
    return lab.top_labels(c, "poi_labels", 17).select("x", "y", "fid", "text", "class", "priority", "min_zoom")


_PL = f"""{with_views("geo_points")}, c AS (SELECT {_tx(3)} AS x, {_ty(3)} AS y, fid, name AS text, amenity AS class,
 CASE amenity WHEN 'hospital' THEN 920 WHEN 'townhall' THEN 820 ELSE 500 END::INTEGER AS priority, 16::INTEGER AS min_zoom FROM geo_points WHERE fid % 4 <> 0)
SELECT x, y, fid, text, class, priority, min_zoom FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY priority DESC, fid) AS n FROM c) WHERE n <= 50"""


def road_label_texts(spark, d):
    w = view(spark, d, "geo_ways").withColumn("ref", F.when(F.col("id") % 6 == 0, F.concat(F.lit(" A  "), F.col("id"))).when(F.col("id") % 6 == 1, "yes"))
    get = lambda k: {"highway": F.col("highway"), "ref": F.col("ref"), "name": F.concat(F.lit("Road "), F.col("name"))}.get(k, F.lit(None).cast("string"))
    return lab.label_candidates(w, "road_labels", 14, get).groupBy("highway", "min_zoom", "priority").agg(F.count("*").alias("n"), F.min("text").alias("first"))


_RL = f"""{with_views("geo_ways")}, c AS (SELECT highway, CASE highway WHEN 'tertiary' THEN 14 ELSE 13 END::INTEGER AS min_zoom,
 (CASE highway WHEN 'motorway' THEN 1000 WHEN 'primary' THEN 920 ELSE 740 END + CASE WHEN id % 6 IN (0, 1) THEN 80 ELSE 0 END)::INTEGER AS priority,
 CASE WHEN id % 6 = 0 THEN 'A ' || id ELSE 'Road ' || name END AS text FROM geo_ways WHERE highway IN ('motorway', 'primary', 'tertiary'))
SELECT highway, min_zoom, priority, count(*) AS n, min(text) AS "first" FROM c GROUP BY ALL"""


def decluttered(spark, d):
    """Labels left after overlaps go, z2, of the best that a tile may have at z17."""
    p = view(spark, d, "geo_points").select("fid", F.col("name").alias("key"), "priority", (F.col("lon") - 4).alias("minx"), (F.col("lat") - 1).alias("miny"), (F.col("lon") + 4).alias("maxx"),
                                            (F.col("lat") + 1).alias("maxy"), F.lit(2).alias("z"), tm.tile_x(F.col("lon"), 2).alias("x"), tm.tile_y(F.col("lat"), 2).alias("y"))
    return lab.declutter(lab.top_labels(p, "poi_labels", 17), ("x", "y"), 40).select("x", "y", "fid")


def crowded_labels(spark, d):
    """Labels left of all points of a z1 tile, however many."""
    p = view(spark, d, "geo_points").select("fid", F.col("name").alias("key"), "priority", (F.col("lon") - 6).alias("minx"), (F.col("lat") - 3).alias("miny"), (F.col("lon") + 6).alias("maxx"),
                                            (F.col("lat") + 3).alias("maxy"), tm.tile_x(F.col("lon"), 1).alias("x"), tm.tile_y(F.col("lat"), 1).alias("y"))
    return lab.declutter(p, ("x", "y"), 60).select("x", "y", "fid")


def _greedy_sql(z: int, wide: float, high: float, best: str, most: int) -> str:
    """Labels one by one, in order of rank, kept while they overlap none that is kept."""
    return f"""{with_views("geo_points").replace("WITH", "WITH RECURSIVE", 1)}, t AS (SELECT {_tx(z)} AS x, {_ty(z)} AS y, fid, name, priority, lon, lat FROM geo_points),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY priority DESC, fid) AS k FROM t) WHERE {best}),
c AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY priority DESC, name) AS n FROM b),
s AS (SELECT x, y, 0::BIGINT AS n, []::STRUCT(fid BIGINT, lon DOUBLE, lat DOUBLE)[] AS kept FROM c GROUP BY x, y
 UNION ALL SELECT s.x, s.y, c.n, CASE WHEN len(kept) < {most} AND len(list_filter(kept, lambda q: abs(q.lon - c.lon) < {wide} AND abs(q.lat - c.lat) < {high})) = 0
  THEN list_append(kept, {{'fid': c.fid::BIGINT, 'lon': c.lon, 'lat': c.lat}}) ELSE kept END FROM s JOIN c ON c.x = s.x AND c.y = s.y AND c.n = s.n + 1),
l AS (SELECT x, y, arg_max(kept, n) AS kept FROM s GROUP BY x, y)
SELECT x, y, unnest(kept).fid AS fid FROM l"""


def aviation_labels(spark, d):
    """Labels of runways and the like at z12 and z14."""
    w = view(spark, d, "geo_ways")
    kind = F.get(F.array(*map(F.lit, ("runway", "helipad", "hangar", "taxiway"))), (F.col("id") % 4).cast("int"))
    ref = F.when(F.col("id") % 5 == 0, F.concat(F.lit("R"), "id")).when(F.col("id") % 5 == 1, "no")
    get = lambda k: {"aeroway": kind, "ref": ref, "name": F.when(F.col("id") % 3 == 0, F.concat(F.lit("Field  "), "id"))}.get(k, F.lit(None).cast("string"))
    parts = [lab.label_candidates(w, "aip_labels", z, get).select(F.lit(z).alias("z"), "id", "text", "class", "priority", "min_zoom") for z in (12, 14)]
    return parts[0].unionByName(parts[1])


_AVI = f"""{with_views("geo_ways")}, c AS (SELECT id, ['runway', 'helipad', 'hangar', 'taxiway'][id % 4 + 1] AS class FROM geo_ways),
l AS (SELECT id, class, CASE WHEN id % 5 = 0 THEN 'R' || id WHEN id % 3 = 0 THEN 'Field ' || id WHEN class = 'runway' THEN 'RWY' WHEN class = 'helipad' THEN 'H' END AS text FROM c)
SELECT z::INTEGER AS z, id, text, class, CASE class WHEN 'runway' THEN 930 WHEN 'helipad' THEN 980 WHEN 'taxiway' THEN 760 ELSE 680 END::INTEGER AS priority,
 CASE WHEN class IN ('runway', 'taxiway') THEN 12 ELSE 14 END::INTEGER AS min_zoom FROM l, (VALUES (12), (14)) r(z) WHERE text IS NOT NULL AND (z = 14 OR class IN ('runway', 'taxiway'))"""


def coverage_selection(spark, d):
    """Extract chosen for a small box around each point."""
    p = view(spark, d, "geo_points")
    boxes = p.select(F.col("fid").alias("box"), F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 0.5).alias("maxx"), (F.col("lat") + 0.5).alias("maxy"))
    b = view(spark, d, "geo_boxes")
    c = lambda x, y: g.xy(F.col(x), F.col(y))
    ring = F.array(c("minx", "miny"), c("maxx", "miny"), c("maxx", "maxy"), c("minx", "maxy"), c("minx", "miny"))
    ex = b.select(F.col("fid").cast("string").alias("id"), F.lit("root").alias("parent"), F.array().cast("array<string>").alias("admin"), F.lit(False).alias("cached"),
                  (F.lit(100.0) + F.col("fid")).alias("area"), "minx", "miny", "maxx", "maxy", F.array(F.array(ring)).alias("rings"))
    return cov.select_coverage(boxes, ex).select("box", F.col("ids")[0].alias("id"), F.size("ids").alias("n"))


_COVSEL = f"""{with_views("geo_points", "geo_boxes")} SELECT p.fid AS box, arg_min(b.fid, b.fid)::VARCHAR AS id, 1::INTEGER AS n FROM geo_points p JOIN geo_boxes b
 ON p.lon >= b.minx AND p.lon + 0.5 <= b.maxx AND p.lat >= b.miny AND p.lat + 0.5 <= b.maxy GROUP BY p.fid"""


QUERIES = {f.__name__: f for f in (feature_tiles, tile_top, pyramid_stats, shape_stats, pyramid_tiles, pyramid_counts, poi_tiles, stored_box, stored_joins, layer_priorities, aviation_labels, tile_directory, policy_table, road_priorities,
                                   poi_label_candidates, road_label_texts, decluttered, crowded_labels, coverage_selection)}
ORACLES = {
    "feature_tiles": f"{with_views('geo_points')}, {_buffered(6)} SELECT x, y, count(*) AS n FROM geo_points JOIN bt ON {_TOUCH} GROUP BY x, y",
    "shape_stats": _SHAPES, "pyramid_counts": _counts_sql(), "layer_priorities": _PRIO, "aviation_labels": _AVI,
    "tile_top": _TILETOP, "poi_tiles": _poi_sql(), "stored_box": _STORED, "stored_joins": _STOREDJ, "pyramid_stats": _stats_sql(), "tile_directory": _dir_sql(), "policy_table": _POLICY,
    "road_priorities": f"{with_views('geo_ways')} SELECT highway, count(*) AS n, CASE highway WHEN 'motorway' THEN 1000 WHEN 'primary' THEN 920 WHEN 'tertiary' THEN 740 WHEN 'residential' THEN 460 ELSE 160 END::DOUBLE AS priority FROM geo_ways GROUP BY highway",
    "poi_label_candidates": _PL, "decluttered": _greedy_sql(2, 8, 2, "k <= 50", 40), "crowded_labels": _greedy_sql(1, 12, 6, "true", 60), "road_label_texts": _RL, "coverage_selection": _COVSEL,
}
