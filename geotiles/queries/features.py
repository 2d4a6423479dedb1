"""Classification and assembly of ways and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import assemble as a
from ..operators import classify as c
from ..plans import build
from ..views import table, view, with_views

CITY = (-3.8, 40.35, -3.6, 40.5)


def _tagged_ways(spark, d):
    w = view(spark, d, "geo_ways")
    tags = F.map_filter(F.create_map(*[x for k, v in (("highway", "highway"), ("building", "building"), ("natural", "natural_"),
                                                     ("landuse", "landuse"), ("aeroway", "aeroway")) for x in (F.lit(k), F.col(v))]),
                        lambda k, v: v.isNotNull())
    return w.withColumn("tags", tags)


_HIT = {"roads": "highway IS NOT NULL", "buildings": "building IS NOT NULL", "water": "natural_ = 'water'",
        "coastline": "natural_ = 'coastline'", "landuse": "landuse IS NOT NULL OR natural_ = 'wood'",
        "aip": "aeroway IS NOT NULL", "pois": "landuse = 'industrial'"}
_CLASSIFIED = "cl AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS layer FROM geo_ways WHERE {v}" for k, v in _HIT.items()) + ")"


def classify_ways(spark, d):
    return c.classify_ways(_tagged_ways(spark, d)).select("id", "layer")


def classify_relations(spark, d):
    """The same tags on relations: neither roads nor railways."""
    return c.classify_relations(_tagged_ways(spark, d)).groupBy("layer").agg(F.count("*").alias("n"))


def layer_properties(spark, d):
    ways = c.classify_ways(_tagged_ways(spark, d), ["landuse", "pois"])
    return c.properties_for(ways, ["id", "landuse", "natural", "poi_category", "layer_name"], F.lit("way"), F.col("id"))


def point_features(spark, d):
    n = view(spark, d, "geo_nodes").withColumn("tags", F.create_map(
        F.lit("aeroway"), F.when(F.col("id") % 3 == 0, "helipad"), F.lit("amenity"), F.when(F.col("id") % 4 == 0, "cafe").otherwise("")))
    return c.point_features(n, CITY).select("id", "layer")


def poi_categories(spark, d):
    t = c.Tags(lambda k: F.col("amenity") if k == "amenity" else F.when(F.col("fid") % 6 == 0, F.lit("museum")) if k == "tourism"
               else F.when(F.col("fid") % 10 == 0, F.lit("yes")) if k == "radar" else F.lit(None).cast("string"))
    p = view(spark, d, "geo_points")
    stored = F.when(F.col("fid") % 9 == 0, F.lit(" custom ")).when(F.col("fid") % 9 == 1, F.lit("  "))
    return p.select("fid", c.is_poi(t).alias("poi"), c.poi_category(t).alias("built"), c.poi_category_stored(stored, t).alias("read"))


_POI = f"""{with_views("geo_points")},
k AS (SELECT *, CASE WHEN fid % 6 = 0 THEN 1 ELSE 0 END AS tourism, fid % 10 = 0 AS radar FROM geo_points),
b AS (SELECT *, CASE WHEN amenity = 'hospital' THEN 'emergency' WHEN amenity = 'townhall' THEN 'government' END AS first,
 CASE WHEN amenity = 'warehouse' THEN 'industrial' WHEN tourism = 1 OR amenity = 'restaurant' THEN 'consumer' ELSE 'operational' END AS last FROM k)
SELECT fid, true AS poi, coalesce(first, CASE WHEN radar THEN 'communications' END, last) AS built,
 CASE WHEN fid % 9 = 0 THEN 'custom' ELSE coalesce(first, last) END AS read FROM b"""


def way_lines(spark, d):
    """Points of every way in ref order, with its length; a tenth of the nodes is missing."""
    nodes = view(spark, d, "geo_nodes").where("id % 10 <> 0")
    w = a.resolve_way_coords(view(spark, d, "geo_way_refs"), nodes).where(F.size("coords") > 0)
    return w.select("way_id", F.size("coords").alias("n"), F.round(g.line_length(F.col("coords")), 8).alias("length"),
                    F.round(F.abs(g.let(g.close_ring(F.col("coords")), g.ring_area)), 6).alias("area"))


_LINES = f"""{with_views("geo_nodes", "geo_way_refs")},
p AS (SELECT way_id, pos, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, first_value(lon) OVER w AS flon, first_value(lat) OVER w AS flat,
 row_number() OVER (PARTITION BY way_id ORDER BY pos DESC) AS back
 FROM geo_way_refs JOIN geo_nodes ON ref = id WHERE id % 10 <> 0 WINDOW w AS (PARTITION BY way_id ORDER BY pos))
SELECT way_id, count(*)::INTEGER AS n, round(coalesce(sum(sqrt((lon - plon) * (lon - plon) + (lat - plat) * (lat - plat)) ORDER BY pos), 0), 8) AS length,
 round(abs(coalesce(sum((plon * lat - lon * plat) / 2 ORDER BY pos), 0) + sum(CASE WHEN back = 1 THEN (lon * flat - flon * lat) / 2 ELSE 0 END)), 6) AS area
FROM p GROUP BY way_id"""


def _ref_rows(spark, d):
    """Refs of ways; those of closed ways end at their first node, and every fifth way repeats its second ref."""
    refs = view(spark, d, "geo_way_refs")
    closed = view(spark, d, "geo_ways").where("closed").select(F.col("id").alias("way_id"))
    last = refs.join(closed, "way_id", "left_semi").groupBy("way_id").agg(F.min_by("ref", "pos").alias("ref"), (F.max("pos") * 2 + 2).alias("pos"))
    twice = refs.where("way_id % 5 = 0 AND pos = 2").select("way_id", "ref", F.lit(5).alias("pos"))
    return refs.withColumn("pos", F.col("pos") * 2).unionByName(last.select("way_id", "ref", "pos")).unionByName(twice.select("way_id", "ref", "pos"))


def way_geometries(spark, d):
    """Kinds of geometry by layer, with vertices; a tenth of the nodes is missing."""
    coords = a.resolve_way_coords(_ref_rows(spark, d), view(spark, d, "geo_nodes").where("id % 10 <> 3"))
    ways = c.classify_ways(_tagged_ways(spark, d)).join(coords, F.col("id") == F.col("way_id"))
    made = ways.withColumn("geom", a.way_geometry(F.col("layer"), F.col("aeroway"), F.col("refs"), F.col("coords")))
    return made.groupBy("layer", F.col("geom.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("geom").isNotNull(), g.vertex_count(F.col("geom")))).alias("vertices"))


_REF_ROWS = """rr AS (SELECT way_id, ref, pos * 2 AS pos FROM geo_way_refs
 UNION ALL SELECT way_id, arg_min(ref, pos), max(pos) * 2 + 2 FROM geo_way_refs WHERE way_id % 4 = 0 GROUP BY way_id
 UNION ALL SELECT way_id, ref, 5 FROM geo_way_refs WHERE way_id % 5 = 0 AND pos = 2)"""
#: Rule: refs decide whether a way is closed, the points of known nodes make it, neighbours that are equal count once.
_WAY_SHAPES = f"""{_REF_ROWS},
wf AS (SELECT way_id, count(*) >= 4 AND arg_min(ref, pos) = arg_max(ref, pos) AS closed FROM rr GROUP BY way_id),
wp AS (SELECT way_id, pos, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM rr JOIN geo_nodes ON ref = id WHERE id % 10 <> 3
 WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
wd AS (SELECT way_id, count(*) AS line, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy,
 count(*) + ((arg_min(lon, pos), arg_min(lat, pos)) <> (arg_max(lon, pos), arg_max(lat, pos)))::INT AS ring
 FROM wp WHERE plon IS NULL OR plon <> lon OR plat <> lat GROUP BY way_id),
ws AS (SELECT way_id, closed, coalesce(line, 0) AS line, coalesce(ring, 0) AS ring, minx, miny, maxx, maxy FROM wf LEFT JOIN wd USING (way_id)),
wk AS (SELECT cl.id, layer, minx, miny, maxx, maxy, line, ring, CASE WHEN layer IN ('roads', 'coastline') THEN CASE WHEN line >= 2 THEN 'LineString' END
 WHEN ws.closed THEN CASE WHEN ring >= 4 THEN 'MultiPolygon' END WHEN layer IN ('pois', 'aip') AND line >= 2 THEN 'LineString' END AS kind
 FROM cl JOIN ws ON id = way_id)"""
_WAYGEO = f"""{with_views("geo_ways", "geo_way_refs", "geo_nodes")}, {_CLASSIFIED}, {_WAY_SHAPES}
SELECT layer, kind, count(*) AS n, sum(CASE kind WHEN 'LineString' THEN line WHEN 'MultiPolygon' THEN ring END)::BIGINT AS vertices FROM wk GROUP BY layer, kind"""


def built_layers(spark, d):
    """The whole layer build over an extract that lacks a tenth of its nodes: features, geometries and boxes by layer.

    Relations are made of closed ways, so that SQL can say their rings; pois made of ways are left to kept_features.
    """
    nodes = view(spark, d, "geo_nodes").where("id % 10 <> 3").withColumn("tags", F.create_map(F.lit("aeroway"), F.when(F.col("id") % 6 == 0, "helipad")))
    refs = _ref_rows(spark, d).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("r"))
    ways = _tagged_ways(spark, d).join(refs, F.col("id") == F.col("way_id")).select("id", F.col("r.ref").alias("refs"), "tags")
    member = F.struct(F.lit("way").alias("type"), "ref", F.lit("outer").alias("role"))
    loops = view(spark, d, "geo_relation_members").join(ways.where(g.is_closed(F.col("refs"))).select(F.col("id").alias("ref")), "ref", "left_semi")
    rels = loops.groupBy(F.col("rel_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", member.alias("m")))).alias("m")).select(
        "id", F.col("m.m").alias("members"), F.create_map(F.when(F.col("id") % 2 == 0, "natural").otherwise("boundary"), F.when(F.col("id") % 2 == 0, "coastline").otherwise("administrative")).alias("tags"))
    got = build.build_layers(nodes, ways, rels, CITY).where("NOT (layer = 'pois' AND id LIKE 'way/%')")
    return got.groupBy("layer", F.regexp_extract("id", "^[a-z]+", 0).alias("source"), F.col("geom.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.round(F.min("minx"), 6).alias("minx"), F.round(F.max("maxy"), 6).alias("maxy"))


_BUILT = f"""{with_views("geo_ways", "geo_way_refs", "geo_nodes", "geo_relation_members")}, {_CLASSIFIED}, {_WAY_SHAPES},
mr AS (SELECT rel_id, ws.* FROM geo_relation_members m JOIN ws ON m.ref = ws.way_id WHERE ws.closed),
ra AS (SELECT rel_id, 'MultiPolygon' AS kind, min(minx) AS minx, max(maxx) AS maxx, min(miny) AS miny, max(maxy) AS maxy FROM mr WHERE ring >= 4 GROUP BY rel_id),
rl AS (SELECT rel_id, CASE WHEN count(*) > 1 THEN 'MultiLineString' ELSE 'LineString' END AS kind, min(minx) AS minx, max(maxx) AS maxx, min(miny) AS miny, max(maxy) AS maxy
 FROM mr WHERE line >= 2 AND rel_id NOT IN (SELECT rel_id FROM ra) GROUP BY rel_id),
rg AS (SELECT * FROM ra UNION ALL SELECT * FROM rl),
ff AS (SELECT layer, 'way' AS source, kind, minx, maxx, miny, maxy FROM wk WHERE kind IS NOT NULL AND layer <> 'pois'
 UNION ALL SELECT CASE WHEN rel_id % 2 = 0 THEN 'coastline' ELSE 'boundaries' END, 'relation', kind, minx, maxx, miny, maxy FROM rg
 UNION ALL SELECT unnest(['aip', 'pois']), 'node', 'Point', lon, lon, lat, lat FROM geo_nodes WHERE id % 6 = 0 AND id % 10 <> 3)
SELECT layer, source, kind, count(*) AS n, round(min(minx), 6) AS minx, round(max(maxy), 6) AS maxy FROM ff
WHERE maxx >= -3.8 AND minx <= -3.6 AND maxy >= 40.35 AND miny <= 40.5 GROUP BY ALL"""


def relation_members(spark, d):
    """Members met with their ways; helper ways come first, missing ones drop."""
    ways = a.resolve_way_coords(view(spark, d, "geo_way_refs"), view(spark, d, "geo_nodes"))
    plain = ways.where("way_id % 3 <> 0")
    helpers = ways.where("way_id % 2 = 0").withColumn("refs", F.slice("refs", 1, 1))
    got = a.resolve_members(view(spark, d, "geo_relation_members"), plain, helpers)
    return got.groupBy("rel_id").agg(F.count("*").alias("members"), F.sum(F.size("refs")).alias("refs"))


_MEMBERS = f"""{with_views("geo_relation_members", "geo_way_refs", "geo_nodes")},
s AS (SELECT way_id, count(*) AS n FROM geo_way_refs JOIN geo_nodes ON ref = id GROUP BY way_id)
SELECT rel_id, count(*) AS members, sum(CASE WHEN way_id % 2 = 0 THEN 1 ELSE n END)::BIGINT AS refs
FROM geo_relation_members JOIN s ON ref = way_id WHERE way_id % 2 = 0 OR way_id % 3 <> 0 GROUP BY rel_id"""


def needed_nodes(spark, d):
    """Nodes that ways of one layer refer to."""
    chosen = c.classify_ways(_tagged_ways(spark, d), ["coastline"]).select(F.col("id").alias("way_id"))
    refs = view(spark, d, "geo_way_refs").join(chosen, "way_id", "left_semi")
    return a.needed_nodes(view(spark, d, "geo_nodes"), refs).select("id")


def helper_ways(spark, d):
    """Member ways that no area layer took."""
    ways = view(spark, d, "geo_ways")
    members = view(spark, d, "geo_relation_members")
    taken = c.classify_ways(_tagged_ways(spark, d), ["buildings", "water", "landuse"])
    return a.helper_ways(ways, members, taken).select("id")


def ring_assembly(spark, d):
    """Closed rings of relations whose members are the four sides of a square, half of them turned."""
    rel = view(spark, d, "geo_points")
    corner = lambda dx, dy: (dx, dy)
    square = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)]
    sides = []
    for k in range(4):
        (x0, y0), (x1, y1) = square[k], square[k + 1]
        ids = F.array((F.col("fid") * 10 + k), (F.col("fid") * 10 + (k + 1) % 4)).cast("array<bigint>")
        pts = F.array(g.xy(F.col("lon") + x0, F.col("lat") + y0), g.xy(F.col("lon") + x1, F.col("lat") + y1))
        turn = (F.col("fid") + k) % 3 == 0
        sides.append(F.struct(F.lit((k * 3) % 4).cast("long").alias("pos"), F.when(turn, F.reverse(ids)).otherwise(ids).alias("refs"),
                              F.when(turn, F.reverse(pts)).otherwise(pts).alias("points")))
    members = rel.select(F.col("fid").alias("rel_id"), F.lit("outer").alias("role"), F.explode(F.array(*sides)).alias("s")).select("rel_id", "role", "s.*")
    rings = a.assemble_rings(members.where("NOT (rel_id % 10 = 0 AND pos = 2)"))
    return rings.select("rel_id", "ring", F.size("refs").alias("n"), F.round(F.abs(g.ring_area(F.col("coords"))), 6).alias("area"))


_RINGS = f"""{with_views("geo_points")} SELECT fid AS rel_id, 0::INTEGER AS ring, 5::INTEGER AS n, 1.0::DOUBLE AS area FROM geo_points WHERE fid % 10 <> 0"""


def relation_shapes(spark, d):
    """Relations of four sides in two layers: closed ones become polygons, open ones lines where the layer may be lines; a small ring is a hole.

    In every fifth relation the node where the first two sides meet is missing: the ring closes all the same.
    """
    p = view(spark, d, "geo_points")
    parts = []
    for k, ((x0, y0), (x1, y1)) in enumerate(zip(((0, 0), (1, 0), (1, 1), (0, 1)), ((1, 0), (1, 1), (0, 1), (0, 0)))):
        for role, base, size in (("outer", 0, 1.0), ("inner", 100, 0.25)):
            ids = F.array(F.col("fid") * 1000 + base + k, F.col("fid") * 1000 + base + (k + 1) % 4)
            pts = F.array(g.xy(F.col("lon") + (x0 * size + (0.1 if base else 0)), F.col("lat") + (y0 * size + (0.6 if base else 0))),
                          g.xy(F.col("lon") + (x1 * size + (0.1 if base else 0)), F.col("lat") + (y1 * size + (0.6 if base else 0))))
            parts.append(F.struct(F.lit(base + k).cast("long").alias("pos"), F.lit(role).alias("role"), ids.cast("array<bigint>").alias("refs"),
                                  F.transform(pts, lambda q, i: F.when(~((F.col("fid") % 5 == 0) & (F.get(ids, i) % 100 == 1)), q)).alias("points")))
    met = p.select(F.col("fid").alias("rel_id"), F.explode(F.array(*parts)).alias("m")).select("rel_id", "m.*")
    met = met.where("NOT (rel_id % 4 = 0 AND pos = 3)").where("NOT (rel_id % 3 = 0 AND role = 'inner')")
    rels = p.select(F.col("fid").alias("id"), F.when(F.col("fid") % 8 < 4, "water").otherwise("boundaries").alias("layer"))
    got = a.relation_geometry(rels, met)
    return got.select("id", "layer", F.col("geom.kind").alias("kind"), F.size(F.flatten("geom.parts")).alias("rings"), F.when(F.col("geom").isNotNull(), g.vertex_count(F.col("geom"))).alias("vertices"))


_RELS = f"""{with_views("geo_points")}, r AS (SELECT fid, CASE WHEN fid % 8 < 4 THEN 'water' ELSE 'boundaries' END AS layer, fid % 4 = 0 AS open, fid % 3 <> 0 AS hole FROM geo_points)
SELECT fid AS id, layer, CASE WHEN NOT open THEN 'MultiPolygon' WHEN layer = 'boundaries' THEN CASE WHEN gap = 1 AND NOT hole THEN 'LineString' ELSE 'MultiLineString' END END AS kind,
 CASE WHEN NOT open THEN 1 + hole::INTEGER WHEN layer = 'boundaries' THEN 3 + 4 * hole::INTEGER - gap * (2 + 2 * hole::INTEGER) END::INTEGER AS rings,
 CASE WHEN NOT open THEN (5 - gap) * (1 + hole::INTEGER) WHEN layer = 'boundaries' THEN 6 + 8 * hole::INTEGER - gap * (4 + 4 * hole::INTEGER) END::INTEGER AS vertices
 FROM (SELECT *, (fid % 5 = 0)::INT AS gap FROM r)"""


def first_seen(spark, d):
    """First feature of every id; null and empty ids stay."""
    f = table(spark, d, "orders").select(F.lit("roads").alias("layer"), F.when(F.col("o_orderkey") % 7 == 0, None).when(
        F.col("o_orderkey") % 11 == 0, "").otherwise((F.col("o_custkey") % 500).cast("string")).alias("id"), F.col("o_orderkey").alias("ord"))
    return a.dedup_first(f).select("id", "ord")


_FIRST = """WITH f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE (o_custkey % 500)::VARCHAR END AS id, o_orderkey AS ord FROM orders)
SELECT id, ord FROM f WHERE coalesce(id, '') = '' UNION ALL SELECT id, min(ord) FROM f WHERE coalesce(id, '') <> '' GROUP BY id"""


def merged_sources(spark, d):
    """Two overlapping node extracts: the last one wins."""
    n = view(spark, d, "geo_nodes")
    both = a.union_sources([n.where("id % 3 <> 0"), n.where("id % 2 = 0").withColumn("lon", F.col("lon") + 1)])
    return a.dedup_last(both).select("id", F.round("lon", 6).alias("lon"))


def node_extent(spark, d):
    return a.infer_extent(view(spark, d, "geo_nodes"))


def kept_features(spark, d):
    """Ways in the request box; pois become points."""
    coords = a.resolve_way_coords(view(spark, d, "geo_way_refs"), view(spark, d, "geo_nodes"))
    f = coords.withColumn("layer", F.when(F.col("way_id") % 3 == 0, "pois").otherwise("roads")).withColumn(
        "geom", F.when(F.size("coords") >= 2, g.line_string(F.col("coords"))))
    return a.keep_inside(f, CITY).select("way_id", "layer", F.col("geom.kind").alias("kind"), F.round("minx", 6).alias("minx"))


_KEPT = f"""{with_views("geo_nodes", "geo_way_refs")},
p AS (SELECT way_id, pos, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM geo_way_refs JOIN geo_nodes ON ref = id WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
l AS (SELECT *, sqrt((lon - plon) * (lon - plon) + (lat - plat) * (lat - plat)) AS d FROM p),
r AS (SELECT *, sum(d) OVER (PARTITION BY way_id ORDER BY pos) AS run, sum(d) OVER (PARTITION BY way_id) AS total, count(*) OVER (PARTITION BY way_id) AS n FROM l),
mid AS (SELECT way_id, arg_min(plon + (lon - plon) * CASE WHEN d > 0 THEN (total / 2 - (run - d)) / d ELSE 0 END, pos) AS x,
 arg_min(plat + (lat - plat) * CASE WHEN d > 0 THEN (total / 2 - (run - d)) / d ELSE 0 END, pos) AS y FROM r WHERE n >= 2 AND d IS NOT NULL AND run >= total / 2 GROUP BY way_id),
b AS (SELECT way_id, min(lon) AS minx, max(lon) AS maxx, min(lat) AS miny, max(lat) AS maxy FROM p GROUP BY way_id HAVING count(*) >= 2),
f AS (SELECT b.way_id, CASE WHEN b.way_id % 3 = 0 THEN 'pois' ELSE 'roads' END AS layer, CASE WHEN b.way_id % 3 = 0 THEN x ELSE minx END AS minx,
 CASE WHEN b.way_id % 3 = 0 THEN x ELSE maxx END AS maxx, CASE WHEN b.way_id % 3 = 0 THEN y ELSE miny END AS miny, CASE WHEN b.way_id % 3 = 0 THEN y ELSE maxy END AS maxy
 FROM b JOIN mid USING (way_id))
SELECT way_id, layer, CASE WHEN layer = 'pois' THEN 'Point' ELSE 'LineString' END AS kind, round(minx, 6) AS minx FROM f
WHERE maxx >= -3.8 AND minx <= -3.6 AND maxy >= 40.35 AND miny <= 40.5"""


def label_texts(spark, d):
    """Cleaned texts, titles, heights and elevations."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("s"))
    raw = F.concat(F.lit("  "), F.replace("s", F.lit(" "), F.lit("  ")), F.lit("\t"))
    h = F.concat((F.col("fid") % 700 - 20).cast("string"), F.lit(",5 m"))
    return t.select("fid", tx.clean_text(raw).alias("clean"), tx.is_label(F.when(F.col("fid") % 5 == 0, "Yes").otherwise(F.col("s"))).alias("label"),
                    F.round(tx.building_height(F.when(F.col("fid") % 3 != 0, h), F.when(F.col("fid") % 2 == 0, (F.col("fid") % 300).cast("string"))), 3).alias("height"),
                    F.round(tx.elevation_m(F.when(F.col("fid") % 2 == 0, F.concat(F.col("fid").cast("string"), F.lit(" ft"))).otherwise(F.lit("high"))), 4).alias("elevation"))


_TEXTS = r"""SELECT p_partkey AS fid, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS clean,
 CASE WHEN p_partkey % 5 = 0 THEN false ELSE length(trim(p_name)) >= 2 END AS label,
 round(CASE WHEN p_partkey % 3 <> 0 AND h > 0 THEN least(h, 500) WHEN p_partkey % 2 = 0 AND p_partkey % 300 > 0 THEN least(p_partkey % 300 * 3, 500) ELSE 9 END, 3)::DOUBLE AS height,
 round(CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 0.3048::DOUBLE END, 4) AS elevation
 FROM (SELECT *, ((p_partkey % 700 - 20) || '.5')::DOUBLE AS h FROM part)"""


QUERIES = {f.__name__: f for f in (
    classify_ways, classify_relations, layer_properties, point_features, poi_categories, way_lines, way_geometries, built_layers, relation_members,
    needed_nodes, helper_ways, ring_assembly, relation_shapes, first_seen, merged_sources, node_extent, kept_features, label_texts)}

ORACLES = {
    "classify_ways": f"{with_views('geo_ways')}, {_CLASSIFIED} SELECT id, layer FROM cl",
    "classify_relations": f"{with_views('geo_ways')}, {_CLASSIFIED} SELECT layer, count(*) AS n FROM cl WHERE layer <> 'roads' GROUP BY layer",
    "layer_properties": f"{with_views('geo_ways')}, {_CLASSIFIED} SELECT 'way/' || id AS id, landuse, natural_ AS natural, CASE WHEN layer = 'pois' THEN 'industrial' END AS poi_category, NULL::VARCHAR AS layer_name FROM cl WHERE layer IN ('landuse', 'pois')",
    "point_features": f"""{with_views('geo_nodes')}, i AS (SELECT id FROM geo_nodes WHERE lon BETWEEN -3.8 AND -3.6 AND lat BETWEEN 40.35 AND 40.5)
SELECT id, 'aip' AS layer FROM i WHERE id % 3 = 0 UNION ALL SELECT id, 'pois' FROM i WHERE id % 4 = 0 OR id % 3 = 0""",
    "poi_categories": _POI, "way_lines": _LINES, "way_geometries": _WAYGEO, "built_layers": _BUILT, "relation_members": _MEMBERS,
    "relation_shapes": _RELS,
    "needed_nodes": f"{with_views('geo_nodes', 'geo_way_refs', 'geo_ways')} SELECT id FROM geo_nodes WHERE id IN (SELECT ref FROM geo_way_refs WHERE way_id IN (SELECT id FROM geo_ways WHERE natural_ = 'coastline'))",
    "helper_ways": f"{with_views('geo_ways', 'geo_relation_members')}, {_CLASSIFIED} SELECT id FROM geo_ways WHERE id IN (SELECT ref FROM geo_relation_members) AND id NOT IN (SELECT id FROM cl WHERE layer IN ('buildings', 'water', 'landuse'))",
    "ring_assembly": _RINGS, "first_seen": _FIRST,
    "merged_sources": f"{with_views('geo_nodes')} SELECT id, round(CASE WHEN id % 2 = 0 THEN lon + 1 ELSE lon END, 6) AS lon FROM geo_nodes WHERE id % 2 = 0 OR id % 3 <> 0",
    "node_extent": f"{with_views('geo_nodes')} SELECT min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM geo_nodes",
    "kept_features": _KEPT, "label_texts": _TEXTS,
}
