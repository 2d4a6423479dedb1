"""Layers, styles and labels that decide what is shown at a zoom."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import policy as pol
from ..functions import tilemath as tm
from ..functions.text import natural_key
from ..operators import coverage as cov
from ..operators import labels as lab
from ..operators import query as q
from ..operators import visibility as vis
from ..operators.classify import Tags
from ..plans import pyramid as pyr
from ..schema import LayerSpec, conform, resolve_layers
from ..sources import layers_io, tiles_io
from ..views import table, view, with_views


def _layers(spark, d):
    """A layer per customer, some of them the built-in ones: zoom windows and order follow from its key."""
    k = F.col("c_custkey").cast("int")
    name = F.when(k % 50 == 1, "roads").when(k % 50 == 2, "aip").when(k % 50 == 3, "pois").otherwise(F.concat(F.lit("layer"), k))
    return table(spark, d, "customer").select(name.alias("id"), F.when(k % 4 != 0, k % 9).alias("min_zoom"), F.when(k % 5 != 0, 10 + k % 7).alias("max_zoom"),
                                              k.alias("ord"), (k % 3).alias("rule_order"), F.array(F.lit("name"), F.col("c_name")).alias("fields"))


_LAY = """ly AS (SELECT CASE c_custkey % 50 WHEN 1 THEN 'roads' WHEN 2 THEN 'aip' WHEN 3 THEN 'pois' ELSE 'layer' || c_custkey END AS id, c_custkey::INTEGER AS k,
 CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 END AS lo, CASE WHEN c_custkey % 5 <> 0 THEN 10 + c_custkey % 7 END AS hi FROM customer)"""


def active_layers(spark, d):
    layers = _layers(spark, d).withColumn("id", F.concat(F.lit("layer"), "ord"))
    rules = layers.select(F.col("id").alias("layer"), F.when(F.col("ord") % 6 == 0, False).alias("visible"), F.when(F.col("ord") % 2 == 0, 3).alias("min_zoom"), F.lit(None).cast("int").alias("max_zoom"))
    return q.active_layers(layers, rules, 4).select("id")


def layer_order(spark, d):
    """Draw order: listed layers first."""
    got = vis.draw_order(_layers(spark, d), ["layer11", "roads", "layer7"])
    return got.select("id", "place", F.coalesce("rule_order", F.lit(0)).alias("rule_order"), "ord")


def tile_metadata(spark, d):
    return tiles_io.tile_metadata(_layers(spark, d), 5, 12).select("id", F.size("fields").alias("fields"), "min_zoom", "max_zoom")


def label_layers(spark, d):
    """Label layers open at z16 over all layers, and how many layers open them."""
    layers = _layers(spark, d).select("id", "min_zoom", (F.col("max_zoom") + 3).alias("max_zoom"))
    return lab.active_label_layers(layers, 17).groupBy("label").agg(F.count("*").alias("n"))


def effective_zooms(spark, d):
    o = view(spark, d, "geo_obs")
    return q.effective_zoom(o, (2, 15), (None, 14), (F.col("first_zoom"), F.col("last_zoom")), {"kind": {"click": (4, None), "view": (None, 9)}}).groupBy(
        "kind", "eff_min", "eff_max").agg(F.count("*").alias("n"))


def box_read(spark, d):
    """First 100 points of one box, by fid."""
    return q.read_box(q.boxes_of_points(view(spark, d, "geo_points")), (-60.0, -40.0, 60.0, 40.0), 100).select("fid")


def visible_pois(spark, d):
    t = Tags(lambda k: F.col("amenity") if k == "amenity" else F.when(F.col("fid") % 7 == 0, F.lit("plant")) if k == "power" else F.lit(None).cast("string"))
    return vis.visible_pois(view(spark, d, "geo_points"), t, {"energy": False, "consumer": True}).groupBy("amenity").agg(F.count("*").alias("n"))


_VIS = f"""{with_views("geo_points")} SELECT amenity, count(*) AS n FROM geo_points
WHERE amenity IN ('hospital', 'townhall') OR (amenity = 'warehouse' AND fid % 7 <> 0) GROUP BY amenity"""


def zoom_rules(spark, d):
    """Roads admitted by the built-in layer rules per zoom."""
    w = view(spark, d, "geo_ways")
    out = None
    for z in (10, 12, 14, 16):
        part = q.apply_filters(w, any_=pol.layer_rules("roads", z)).groupBy("highway").agg(F.count("*").alias("n")).withColumn("z", F.lit(z))
        out = part if out is None else out.unionByName(part)
    return out


_RULES = f"""{with_views("geo_ways")} SELECT highway, count(*) AS n, z::INTEGER AS z FROM geo_ways, (VALUES (10), (12), (14), (16)) r(z)
WHERE highway IN ('motorway', 'primary') AND highway <> CASE WHEN z < 12 THEN 'none' ELSE '' END OR (highway = 'tertiary' AND z >= 12) OR (highway = 'residential' AND z >= 14) OR (highway = 'footway' AND z >= 16) GROUP BY highway, z"""


THEME = {"roads": {"local": {"enabled": True}}, "pois": {"minZoom": 16, "categories": {"industrial": False}}}


def described_labels(spark, d):
    """Labels of points by a theme, z17."""
    get = lambda k: {"name": F.when(F.col("fid") % 6 == 0, "Yes").otherwise(F.col("name")), "amenity": F.col("amenity"),
                     "poi_category": F.when(F.col("fid") % 5 == 0, " government ")}.get(k, F.lit(None).cast("string"))
    return lab.describe_labels(view(spark, d, "geo_points"), "pois", 17, THEME, get).select("fid", "text", "priority", "priority_class")


_DESC = f"""{with_views("geo_points")} SELECT fid, CASE WHEN fid % 6 <> 0 THEN name WHEN amenity = 'hospital' THEN 'Hospital' WHEN amenity = 'townhall' THEN 'Town hall' ELSE 'Warehouse' END AS text,
 (CASE WHEN amenity = 'hospital' THEN 920 ELSE 620 END)::INTEGER AS priority, CASE WHEN amenity = 'hospital' THEN 'critical' ELSE 'normal' END AS priority_class
FROM geo_points WHERE amenity IN ('hospital', 'townhall') OR (amenity = 'warehouse' AND fid % 5 = 0)"""


def theme_roads(spark, d):
    """Road labels of a theme at z12, z16 and z17: refs of major roads, names of local ones."""
    w = view(spark, d, "geo_ways").withColumn("ref", F.when(F.col("id") % 6 == 0, F.concat(F.lit(" A  "), F.col("id"))).when(F.col("id") % 6 == 1, "yes"))
    get = lambda k: {"highway": F.col("highway"), "ref": F.col("ref"), "name": F.concat(F.lit("Road "), F.col("name"))}.get(k, F.lit(None).cast("string"))
    parts = [lab.describe_labels(w, "roads", z, THEME, get).select(F.lit(z).alias("z"), "id", "text", "priority", "priority_class") for z in (11, 12, 17)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TROADS = f"""{with_views("geo_ways")} SELECT z::INTEGER AS z, id, CASE WHEN highway = 'residential' THEN 'Road ' || name ELSE 'A ' || id END AS text,
 CASE WHEN highway = 'residential' THEN 400 ELSE 820 END::INTEGER AS priority, CASE WHEN highway = 'residential' THEN 'low' ELSE 'important' END AS priority_class
FROM geo_ways, (VALUES (11), (12), (17)) r(z) WHERE (highway IN ('motorway', 'primary') AND id % 6 = 0 AND z >= 12) OR (highway = 'residential' AND z >= 17)"""


def label_anchors(spark, d):
    """Anchors of footprints with a hole in the middle, and of bent lines."""
    b = view(spark, d, "geo_boxes")
    c = lambda dx, dy: g.xy(F.col("minx") + dx, F.col("miny") + dy)
    ring = lambda *ps: F.array(*[c(*p) for p in ps])
    hole = F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((1, 1), (6, 1), (6, 9), (1, 9), (1, 1)))).cast(g.PARTS).alias("parts"))
    line = g.line_string(ring((0, 0), (4, 0), (4, 6)))
    df = b.withColumn("geom", F.when(F.col("fid") % 2 == 0, hole).otherwise(line).cast(g.GEOMETRY))
    return lab.with_anchors(df).select("fid", F.round("anchor.x", 6).alias("x"), F.round("anchor.y", 6).alias("y"))


_ANCH = f"""{with_views("geo_boxes")} SELECT fid, round(minx + CASE WHEN fid % 2 = 0 THEN 8 ELSE 4 END, 6) AS x, round(miny + CASE WHEN fid % 2 = 0 THEN 5 ELSE 1 END, 6) AS y FROM geo_boxes"""


_ODD = "\u00a0\u2003"


def title_cases(spark, d):
    """Words of addresses raised after any sign, underscores and odd spaces as spaces."""
    from ..functions.text import admin_codes, clean_text, title_case

    p = view(spark, d, "geo_points")
    raw = F.concat(F.lit(_ODD + "bus-stop"), F.lit(_ODD), F.lit("o'neil "), F.col("amenity"), F.lit("_of "), F.lower(F.substring("name", 1, 8)), F.lit(" 3rd école" + _ODD))
    code = F.when(F.col("fid") % 3 == 0, F.lit('["ES-MD","ES-CL"]')).when(F.col("fid") % 3 == 1, F.lit("PT")).otherwise("")
    return p.select("fid", title_case(raw).alias("title"), clean_text(F.concat(F.lit(_ODD), "name", F.lit(_ODD), "amenity")).alias("clean"), F.array_join(admin_codes(code), "|").alias("codes"))


_TITLE = f"""{with_views("geo_points")} SELECT fid, 'Bus-Stop O''Neil ' || upper(amenity[1]) || amenity[2:] || ' Of Customer 3rd éCole' AS title, name || ' ' || amenity AS clean,
 CASE fid % 3 WHEN 0 THEN 'ES-MD|ES-CL' WHEN 1 THEN 'PT' ELSE '' END AS codes FROM geo_points"""


def coverage_list(spark, d):
    """Extracts that a moved footprint touches; children of a root only where there are any."""
    b = view(spark, d, "geo_boxes")
    c = lambda x, y: g.xy(F.col(x), F.col(y))
    ring = F.array(c("minx", "miny"), c("maxx", "miny"), c("maxx", "maxy"), c("minx", "maxy"), c("minx", "miny"))
    ex = b.select(F.col("fid").cast("string").alias("id"), F.when(F.col("fid") % 2 == 0, "1").alias("parent"), (F.lit(100.0) + F.col("fid")).alias("area"),
                  "minx", "miny", "maxx", "maxy", F.array(F.array(ring)).alias("rings"))
    boxes = b.select(F.col("fid").alias("box"), *[(F.col(x) + 5).alias(x) for x in pyr.BOX])
    return cov.list_coverage(boxes, ex)


_CLIST = f"""{with_views("geo_boxes")}, m AS (SELECT a.fid AS box, b.fid AS id, b.fid % 2 = 0 AS top FROM geo_boxes a JOIN geo_boxes b
 ON a.minx + 5 <= b.maxx AND a.maxx + 5 >= b.minx AND a.miny + 5 <= b.maxy AND a.maxy + 5 >= b.miny),
s AS (SELECT box, bool_or(top) AS has_top FROM m GROUP BY box)
SELECT box, id::VARCHAR AS id, 100.0::DOUBLE + id AS area FROM m JOIN s USING (box) WHERE top OR NOT has_top"""


def coverage_siblings(spark, d):
    """Boxes over the seam of two administrative halves get both; boxes inside one get it, or a cached container near its size."""
    b = view(spark, d, "geo_boxes")
    half = lambda k: b.select(F.concat(F.col("fid"), F.lit("ab"[k])).alias("id"), F.col("fid").cast("string").alias("parent"), F.array(F.lit("XX")).alias("admin"), F.lit(False).alias("cached"),
                              F.lit(50.0).alias("area"), (F.col("minx") + 5 * k).alias("minx"), "miny", (F.col("minx") + 5 * k + 5).alias("maxx"), "maxy")
    whole = b.select(F.col("fid").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("admin"), (F.col("fid") % 2 == 0).alias("cached"),
                     F.lit(100.0).alias("area"), *pyr.BOX)
    c = lambda x, y: g.xy(F.col(x), F.col(y))
    ring = F.array(c("minx", "miny"), c("maxx", "miny"), c("maxx", "maxy"), c("minx", "maxy"), c("minx", "miny"))
    ex = whole.unionByName(half(0)).unionByName(half(1)).withColumn("rings", F.array(F.array(ring)))
    at = F.when(F.col("fid") % 3 == 0, 4.0).otherwise(1.0)
    boxes = b.select(F.col("fid").alias("box"), (F.col("minx") + at).alias("minx"), (F.col("miny") + 4).alias("miny"), (F.col("minx") + at + 2).alias("maxx"), (F.col("miny") + 6).alias("maxy"))
    return cov.select_coverage(boxes, ex).select("box", F.array_join("ids", "+").alias("ids"))


def _siblings_sql() -> str:
    """Rule of ``select_coverage`` over extracts that are boxes: 25 samples a box, edges inside (to 1e-11 degrees)."""
    px = lambda i: f"(q.minx + (q.maxx - q.minx) * {i / 4})"
    py = lambda i: f"(q.miny + (q.maxy - q.miny) * {i / 4})"
    bits = lambda p, lo, hi, step: " + ".join(f"CASE WHEN {p(i)} >= {lo} - 1e-11 AND {p(i)} <= {hi} + 1e-11 THEN {1 << step * i} ELSE 0 END" for i in range(5))
    return f"""{with_views("geo_boxes")},
q AS (SELECT fid AS box, minx + dx AS minx, miny + 4 AS miny, minx + dx + 2 AS maxx, miny + 6 AS maxy FROM (SELECT *, CASE WHEN fid % 3 = 0 THEN 4.0 ELSE 1.0 END::DOUBLE AS dx FROM geo_boxes)),
ex AS (SELECT fid::VARCHAR AS id, NULL::VARCHAR AS parent, 0 AS codes, fid % 2 = 0 AS cached, 100.0::DOUBLE AS area, minx AS x0, miny AS y0, maxx AS x1, maxy AS y1 FROM geo_boxes
 UNION ALL SELECT fid || s, fid::VARCHAR, 1, false, 50.0, minx + 5 * k, miny, minx + 5 * k + 5, maxy FROM geo_boxes, (VALUES ('a', 0), ('b', 1)) r(s, k)),
h AS (SELECT *, bit_count(points) AS hits FROM (SELECT q.box, ex.*, q.minx >= x0 AND q.maxx <= x1 AND q.miny >= y0 AND q.maxy <= y1 AS within,
  (({bits(px, "x0", "x1", 5)}) * ({bits(py, "y0", "y1", 1)}))::BIGINT AS points FROM q JOIN ex ON q.minx <= x1 AND q.maxx >= x0 AND q.miny <= y1 AND q.maxy >= y0) WHERE points > 0),
best AS (SELECT box, arg_min(struct_pack(area := area, id := id, parent := parent, codes := codes), (area, id)) AS small, arg_min(struct_pack(area := area, id := id), (area, id)) FILTER (codes <= 0) AS plain
 FROM h WHERE hits = 25 AND within GROUP BY box),
sb AS (SELECT * FROM h WHERE parent IS NOT NULL AND codes > 0),
gr AS (SELECT box, parent, sum(area) AS total, string_agg(id, '+' ORDER BY area, id) AS ids, count(*) AS members FROM sb GROUP BY box, parent HAVING count(*) > 1 AND bit_count(bit_or(points)) = 25),
plan AS (SELECT box, arg_min(struct_pack(ids := ids, members := members), (total, parent)) AS plan FROM gr GROUP BY box),
beside AS (SELECT DISTINCT b.box FROM best b JOIN sb ON sb.box = b.box AND sb.parent = b.small.parent AND sb.id <> b.small.id),
safe AS (SELECT b.box, CASE WHEN b.small.codes > 0 AND b.small.parent IS NOT NULL AND e.box IS NOT NULL AND b.plain IS NOT NULL THEN b.plain ELSE struct_pack(area := b.small.area, id := b.small.id) END AS safe
 FROM best b LEFT JOIN beside e ON e.box = b.box),
ca AS (SELECT s.box, arg_min(h.id, (h.area, h.id)) AS id FROM safe s JOIN h ON h.box = s.box WHERE h.cached AND h.hits = 25 AND h.within AND h.area >= s.safe.area AND h.area <= s.safe.area * 6 GROUP BY s.box)
SELECT s.box, CASE WHEN plan.members BETWEEN 2 AND 4 THEN plan.ids ELSE coalesce(ca.id, s.safe.id) END AS ids FROM safe s LEFT JOIN plan ON plan.box = s.box LEFT JOIN ca ON ca.box = s.box"""


def tolerances(spark, d):
    """Simplification tolerance of every layer, geometry and zoom in use."""
    z = view(spark, d, "geo_obs").select(F.coalesce("last_zoom", F.lit(7)).cast("int").alias("z"))
    rows = z.select("z", F.explode(F.array(*map(F.lit, ("roads", "water", "landuse", "boundaries", "buildings", "other")))).alias("layer"))
    rows = rows.select("z", "layer", F.explode(F.array(F.lit("LineString"), F.lit("Polygon"))).alias("kind"))
    return rows.select("z", "layer", "kind", F.round(pol.tolerance(F.col("layer"), F.col("kind"), F.col("z"), tm.detail_for_zoom(F.col("z"))), 2).alias("tolerance")).distinct()


_TOL = f"""{with_views("geo_obs")}, z AS (SELECT DISTINCT coalesce(last_zoom, 7)::INTEGER AS z FROM geo_obs),
r AS (SELECT z, layer, unnest(['LineString', 'Polygon']) AS kind FROM (SELECT z, unnest(['roads', 'water', 'landuse', 'boundaries', 'buildings', 'other']) AS layer FROM z)),
b AS (SELECT *, CASE WHEN z <= 7 THEN 14 WHEN z <= 9 THEN 10 WHEN z = 10 THEN 8 WHEN z = 11 THEN 6 WHEN z = 12 THEN 4 WHEN z = 13 THEN 2.4 WHEN z = 14 THEN 1.2 WHEN z = 15 THEN 0.5 ELSE 0 END::DOUBLE AS base,
 CASE layer WHEN 'roads' THEN 0.45 WHEN 'water' THEN CASE kind WHEN 'Polygon' THEN 0.65 ELSE 0.55 END WHEN 'landuse' THEN CASE kind WHEN 'Polygon' THEN 0.7 ELSE 0.6 END
  WHEN 'boundaries' THEN CASE WHEN z <= 10 THEN 0.95 ELSE 0.75 END WHEN 'buildings' THEN CASE WHEN z <= 14 THEN 0.45 ELSE 0.25 END ELSE CASE kind WHEN 'Polygon' THEN 0.75 ELSE 0.65 END END::DOUBLE AS scale,
 CASE WHEN z <= 11 THEN 1.1 WHEN z <= 14 THEN 1 ELSE 0.3 END::DOUBLE AS detail FROM r)
SELECT z, layer, kind, round(base * scale * detail, 2) AS tolerance FROM b"""


def coverage_candidates(spark, d):
    """Footprints that a box around each supplier's neighbour touches."""
    b = view(spark, d, "geo_boxes")
    c = lambda x, y: g.xy(F.col(x), F.col(y))
    ring = F.array(c("minx", "miny"), c("maxx", "miny"), c("maxx", "maxy"), c("minx", "maxy"), c("minx", "miny"))
    ex = b.select(F.col("fid").cast("string").alias("id"), F.when(F.col("fid") % 3 != 0, "1").alias("parent"), F.lit(100.0).alias("area"), "minx", "miny", "maxx", "maxy", F.array(F.array(ring)).alias("rings"))
    boxes = b.select(F.col("fid").alias("box"), (F.col("minx") + 4).alias("minx"), (F.col("miny") + 4).alias("miny"), (F.col("maxx") + 4).alias("maxx"), (F.col("maxy") + 4).alias("maxy"))
    return cov.coverage_by_id(boxes, ex, ["1", "2", "none"])


_CAND = f"""{with_views("geo_boxes")} SELECT a.fid AS box, w.id, coalesce(b.fid IS NOT NULL, false) AS ok FROM geo_boxes a CROSS JOIN (VALUES ('1'), ('2'), ('none')) w(id)
LEFT JOIN geo_boxes b ON b.fid::VARCHAR = w.id AND a.minx + 4 <= b.maxx AND a.maxx + 4 >= b.minx AND a.miny + 4 <= b.maxy AND a.maxy + 4 >= b.miny"""


_LAYERS_3D = ("buildings", "roads", "water", "aviation", "signs", "landuse")


def _features_3d(spark, d):
    k = F.col("fid") % len(_LAYERS_3D)
    return q.boxes_of_points(view(spark, d, "geo_points")).withColumns({
        "layer": F.element_at(F.array(*map(F.lit, _LAYERS_3D)), (k + 1).cast("int")), "height": F.when(F.col("fid") % 3 == 0, F.concat(F.col("fid"), F.lit(" m"))),
        "levels": (F.col("fid") % 8).cast("string"), "first_zoom": (F.col("fid") % 5).cast("int"), "last_zoom": F.lit(None).cast("int"),
        "ref": F.when(F.col("fid") % 4 == 0, "").otherwise(F.when(F.col("fid") % 4 == 1, "A1")), "name": F.lit(None).cast("string"),
        "geom": g.point(g.xy(F.col("minx"), F.col("miny")))})


_SPECS_3D = ({"id": "signs", "tiles3d": {"strategy": "points", "width_m": 2}}, {"id": "landuse", "tiles3d": {"height": 4.5}})


def attributes_3d(spark, d):
    """Heights, strategies, widths, zooms and label anchors of six layers, two of them with overrides."""
    a = vis.attributes_3d(_features_3d(spark, d), (-180.0, -85.0, 180.0, 85.0), (1, 18), (3, None), 40, resolve_layers(_SPECS_3D))
    return a.select("fid", "layer", F.round("height_m", 2).alias("height_m"), "strategy", "width_m", "eff_min", "eff_max", F.round("label_lon", 4).alias("label_lon"))


_A3 = f"""{with_views("geo_points")}, v(layer, strategy, tall, wide) AS (VALUES ('buildings', 'extruded', 0.0, 6.0), ('roads', 'line', 10.0, 6.0), ('water', 'mixed', 5.0, 6.0),
 ('aviation', 'mixed', 9.0, 14.0), ('signs', 'points', 6.0, 2.0), ('landuse', 'surface', 4.5, 6.0)),
f AS (SELECT *, ({list(_LAYERS_3D)})[fid % 6 + 1] AS layer FROM geo_points)
SELECT fid, layer, CASE WHEN layer <> 'buildings' THEN tall WHEN fid % 3 = 0 AND fid > 0 THEN least(fid, 500) WHEN fid % 8 > 0 THEN fid % 8 * 3 ELSE 9 END::DOUBLE AS height_m,
 strategy, wide::DOUBLE AS width_m, greatest(3, fid % 5)::INTEGER AS eff_min, 18::INTEGER AS eff_max, CASE WHEN fid % 4 = 1 THEN round(lon, 4) END AS label_lon FROM f JOIN v USING (layer)"""


def delivery_summary(spark, d):
    """3D delivery of each layer: features, batches of leaves, depth and zooms, each layer in a tree over its own extent."""
    from ..operators import space

    f = _features_3d(spark, d).withColumn("last_zoom", F.when(F.col("layer") == "roads", F.lit(12)))
    return space.delivery_summary(f, vis.attributes_3d(f, None, (1, 18), (3, None), 40))


_DELIVERY = f"""{with_views("geo_points")},
f AS (SELECT fid, lon, lat, ({list(_LAYERS_3D)})[fid % 6 + 1] AS layer FROM geo_points),
r AS (SELECT layer, min(lon) - 1e-7::DOUBLE AS w, min(lat) - 1e-7::DOUBLE AS s, max(lon) + 1e-7::DOUBLE AS e, max(lat) + 1e-7::DOUBLE AS n FROM f GROUP BY layer),
a AS (SELECT fid, layer, floor((lon - w) / (e - w) * 256)::BIGINT AS ci, floor((lat - s) / (n - s) * 256)::BIGINT AS cj FROM f JOIN r USING (layer)),
x AS (SELECT fid, layer, depth::INTEGER AS depth, ci >> (8 - depth) AS i, cj >> (8 - depth) AS j FROM a, range(0, 9) q(depth)),
t AS (SELECT layer, depth, i, j, count(*) AS n FROM x GROUP BY ALL),
l AS (SELECT fid, layer, min(x.depth) AS depth FROM x JOIN t USING (layer, depth, i, j) WHERE n <= 40 OR x.depth = 8 GROUP BY fid, layer),
c AS (SELECT layer, depth, i, j, count(*) AS n FROM l JOIN x USING (fid, layer, depth) GROUP BY layer, depth, i, j)
SELECT layer, sum(n)::BIGINT AS source_features, sum(n)::BIGINT AS features, sum((n - 1) // 40 + 1)::BIGINT AS tiles, max(least(n, 40)) AS largest, max(depth)::INTEGER AS depth,
 (SELECT min(greatest(3, fid % 5))::INTEGER FROM f WHERE f.layer = c.layer) AS min_zoom, CASE WHEN layer = 'roads' THEN 12 ELSE 18 END::INTEGER AS max_zoom FROM c GROUP BY layer"""


def regions(spark, d):
    """Bounding regions and surface normals of footprints."""
    b = view(spark, d, "geo_boxes")
    r = g.region(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), F.lit(0.0), F.lit(9.0))
    n = g.normal(F.col("minx"), F.col("miny"))
    return b.select("fid", F.round(r["west"], 8).alias("west"), F.round(r["north"], 8).alias("north"), F.round(n["x"], 8).alias("nx"), F.round(n["z"], 8).alias("nz"))


_REG = f"""{with_views("geo_boxes")} SELECT fid, round(radians(minx), 8) AS west, round(radians(maxy), 8) AS north, round(cos(radians(miny)) * cos(radians(minx)), 8) AS nx, round(sin(radians(miny)), 8) AS nz FROM geo_boxes"""


def small_features(spark, d):
    """Way boxes too small for their tile at z10 and z13, as landuse."""
    from ..operators.assemble import way_boxes

    w = way_boxes(view(spark, d, "geo_way_refs"), view(spark, d, "geo_nodes"))
    out = None
    for z in (3, 6):
        t = tm.tile_bbox(z, tm.tile_x(F.col("minx"), z), tm.tile_y(F.col("miny"), z))
        s = pol.is_small(F.struct(*pyr.BOX), t, pol.min_size(F.lit("landuse"), F.lit("Polygon"), F.lit(z)))
        part = w.agg(F.count_if(s).alias("small"), F.count("*").alias("n")).withColumn("z", F.lit(z))
        out = part if out is None else out.unionByName(part)
    return out


def _small_sql() -> str:
    from .planning import _WB, _tx, _ty

    part = lambda z, n: f"""SELECT count(*) FILTER (greatest((maxx - minx) / (360.0 / {n}) * 4096, (maxy - miny) / (degrees(atan(sinh(pi() * (1 - 2 * y / {n}.0::DOUBLE)))) - degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / {n}.0::DOUBLE))))) * 4096) < 6) AS small,
 count(*) AS n, {z}::INTEGER AS z FROM (SELECT *, {_ty(z, 'miny')} AS y FROM wb)"""  # noqa: E731
    return f"{_WB} {part(3, 8)} UNION ALL {part(6, 64)}"


def ingested_features(spark, d):
    """Features read from JSON texts: declared columns only."""
    p = view(spark, d, "geo_points")
    js = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                            F.struct(F.col("amenity").alias("kind"), F.col("fid").alias("rank"), F.lit("x").alias("extra")).alias("properties")))
    spec = LayerSpec("points", columns={"kind": "TEXT", "rank": "INTEGER", "missing": "REAL"})
    return layers_io.ingest_features(p.select(js.alias("feature")), spec).select("rank", "kind", "missing", F.round("minx", 6).alias("minx"))


def conformed_columns(spark, d):
    """Caller columns cast to a declared layer."""
    spec = LayerSpec("events", columns={"kind": "TEXT", "value": "REAL", "first_zoom": "INTEGER", "note": "TEXT"})
    return conform(view(spark, d, "geo_obs"), spec).groupBy("kind").agg(F.count("note").alias("notes"), F.round(F.sum("value"), 3).alias("value"), F.count("first_zoom").alias("zooms"))


def natural_order(spark, d):
    """Rank of designators in natural order."""
    from pyspark.sql.window import Window

    s = table(spark, d, "supplier").select(F.concat((F.col("s_suppkey") % 37).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "L").otherwise("")).alias("d"))
    keyed = s.select("d", natural_key(F.col("d")).alias("key")).distinct()
    return keyed.select("d", F.row_number().over(Window.partitionBy(F.substring("d", -1, 1) == "L").orderBy("key")).alias("rank"))


_NAT = """WITH s AS (SELECT DISTINCT (s_suppkey % 37) || CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE '' END AS d FROM supplier)
SELECT d, row_number() OVER (PARTITION BY d LIKE '%L' ORDER BY regexp_extract(d, '^[0-9]+')::INTEGER) AS rank FROM s"""

QUERIES = {f.__name__: f for f in (active_layers, layer_order, tile_metadata, label_layers, effective_zooms, box_read, visible_pois, zoom_rules, described_labels, theme_roads, label_anchors,
                                   title_cases, coverage_list, coverage_siblings, tolerances,
                                   coverage_candidates, attributes_3d, delivery_summary, regions, small_features, ingested_features, conformed_columns, natural_order)}
ORACLES = {
    "theme_roads": _TROADS, "label_anchors": _ANCH, "title_cases": _TITLE, "coverage_list": _CLIST, "coverage_siblings": _siblings_sql(), "tolerances": _TOL,
    "active_layers": f"WITH {_LAY} SELECT 'layer' || k AS id FROM ly WHERE coalesce(lo, 0) <= 4 AND coalesce(hi, 24) >= 4 AND k % 6 <> 0",
    "layer_order": f"WITH {_LAY} SELECT id, CASE id WHEN 'layer11' THEN 0 WHEN 'roads' THEN 1 WHEN 'layer7' THEN 2 ELSE 999 END::BIGINT AS place, (k % 3)::INTEGER AS rule_order, k AS ord FROM ly",
    "tile_metadata": f"WITH {_LAY} SELECT id, 2::INTEGER AS fields, greatest(5, coalesce(lo, 5))::INTEGER AS min_zoom, least(12, coalesce(hi, 12))::INTEGER AS max_zoom FROM ly WHERE greatest(5, coalesce(lo, 5)) <= least(12, coalesce(hi, 12))",
    "label_layers": f"WITH {_LAY} SELECT CASE id WHEN 'roads' THEN 'road_labels' WHEN 'aip' THEN 'aip_labels' ELSE 'poi_labels' END AS label, count(*) AS n FROM ly WHERE id IN ('roads', 'aip', 'pois') AND coalesce(lo, 0) <= 17 AND coalesce(hi + 3, 24) >= 17 GROUP BY id",
    "effective_zooms": f"{with_views('geo_obs')} SELECT kind, greatest(2, CASE WHEN kind = 'click' THEN 4 ELSE 0 END, coalesce(first_zoom, 0))::BIGINT AS eff_min, least(CASE WHEN kind = 'view' THEN 9 ELSE 14 END, coalesce(last_zoom, 24))::BIGINT AS eff_max, count(*) AS n FROM geo_obs GROUP BY 1, 2, 3",
    "box_read": f"{with_views('geo_points')} SELECT fid FROM geo_points WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40 ORDER BY fid LIMIT 100",
    "visible_pois": _VIS, "zoom_rules": _RULES, "described_labels": _DESC, "coverage_candidates": _CAND, "attributes_3d": _A3, "delivery_summary": _DELIVERY, "regions": _REG, "small_features": _small_sql(),
    "ingested_features": f"{with_views('geo_points')} SELECT fid AS rank, amenity AS kind, NULL::DOUBLE AS missing, round(lon, 6) AS minx FROM geo_points",
    "conformed_columns": f"{with_views('geo_obs')} SELECT kind, 0::BIGINT AS notes, round(sum(value), 3) AS value, count(first_zoom) AS zooms FROM geo_obs GROUP BY kind",
    "natural_order": _NAT,
}
