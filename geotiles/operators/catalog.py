"""Airport and runway catalogue."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.text import clean_text, designators, elevation_m, expected_heading, natural_key
from ..sources.scratch import settled
from .labels import with_anchors

NEAREST_M = 25_000.0
QUALITY = {"source": 3, "mapped-threshold": 2, "estimated": 1}


def _text(name: str) -> Column:
    c = F.trim(F.col(name).cast("string"))
    return F.when(c != "", c)


def airports(features: DataFrame) -> DataFrame:
    """(ord, id, name, icao, iata, source_id, lon, lat, elevation_m, geom) of features
    (ord, id, icao, ident, iata, ref, name, ele, lon, lat, geom)."""
    ident = F.coalesce(_text("icao"), _text("ident"), _text("iata"), _text("ref"), F.col("id").cast("string"))
    return features.select(
        "ord", ident.alias("id"), F.coalesce(_text("name"), ident).alias("name"), _text("icao").alias("icao"),
        _text("iata").alias("iata"), F.col("id").cast("string").alias("source_id"), F.round("lon", 8).alias("lon"),
        F.round("lat", 8).alias("lat"), F.round(elevation_m(F.col("ele")), 2).alias("elevation_m"), "geom")


def lookup_key(features: DataFrame, found: DataFrame, key: str = "airport_key") -> DataFrame:
    """Adds ``by_key``: the airport ord that a key names by id, source id, icao or iata; later airports win."""
    keys = found.select("ord", F.explode(F.array_distinct(F.array("id", "source_id", "icao", "iata"))).alias("k")).where(
        "k IS NOT NULL AND k <> ''").groupBy("k").agg(F.max("ord").alias("by_key"))
    return features.join(keys.withColumnRenamed("k", key), key, "left")


def _cells_of_box(df: DataFrame, cell: float) -> DataFrame:
    line = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return df.withColumn("_cx", F.explode(line("minx", "maxx"))).withColumn("_cy", F.explode(line("miny", "maxy")))


#: Edges of a polygon's band, about.
BAND_EDGES = 64


def _banded_edges(polygons: DataFrame) -> DataFrame:
    """(ord, band, edges): the edges of polygons (ord, geom, miny, maxy, bands) by the bands of latitude they reach into."""
    rings = polygons.select("ord", "miny", "maxy", "bands", F.posexplode("geom.parts").alias("part", "rings")).select(
        "ord", "miny", "maxy", "bands", "part", F.posexplode("rings").alias("ring", "c"))
    pairs = F.when(F.size("c") >= 2, F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(
        F.get("c", i)["x"].alias("px"), F.get("c", i)["y"].alias("py"), F.get("c", i - 1)["x"].alias("qx"), F.get("c", i - 1)["y"].alias("qy"))))
    edges = rings.select("ord", "miny", "maxy", "bands", "part", "ring", F.explode(pairs).alias("e")).where("e.py <> e.qy")  # a level edge is never crossed
    at = lambda y: _band(y, F.col("miny"), F.col("maxy"), F.col("bands"))
    dealt = edges.select("ord", "part", "ring", "e.*", F.explode(F.sequence(at(F.least("e.py", "e.qy")), at(F.greatest("e.py", "e.qy")))).alias("band"))
    return dealt.groupBy("ord", "band").agg(F.collect_list(F.struct("part", "ring", "px", "py", "qx", "qy")).alias("edges"))


def _band(y: Column, low: Column, high: Column, bands: Column) -> Column:
    share = F.when(high > low, (y - low) / (high - low)).otherwise(0.0)
    return F.least(F.floor(share * bands), bands - 1)


def containing(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """(fid, by_area): for points (fid, lon, lat) the polygon ord (ord, geom) of smallest box that holds them.

    Polygons are never copied to where points are: boxes meet points in grid cells; the edges of a polygon are dealt once to bands of
    latitude of some ``BAND_EDGES`` each, and a point casts its ray over the edges of its own band, ring by ring.

    Of the polygons that are boxes themselves, the smallest that covers a whole cell bounds what the cell's points can be given: only
    polygons before it in order of (area, ord) meet them.  So points meet a few polygons, however many lie over one another.
    """
    boxed = polygons.where(F.col("geom.kind").isin("Polygon", "MultiPolygon")).withColumn("_b", g.bbox(F.col("geom"))).select(
        "ord", "geom", "_b.*", F.greatest(F.lit(1), F.ceil(g.vertex_count(F.col("geom")) / BAND_EDGES)).alias("bands"), g.is_box(F.col("geom")["parts"]).alias("_whole"))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    tiles = _cells_of_box(boxed.select("ord", area.alias("area"), "minx", "miny", "maxx", "maxy", "bands", "_whole"), cell)
    x0, y0 = F.col("_cx") * cell, F.col("_cy") * cell
    covers = F.col("_whole") & (F.col("minx") <= x0) & (F.col("miny") <= y0) & (F.col("maxx") >= x0 + cell) & (F.col("maxy") >= y0 + cell)
    bound = tiles.where(covers).groupBy("_cx", "_cy").agg(F.min(F.struct("area", "ord")).alias("_best"))
    tiles = tiles.join(bound, ["_cx", "_cy"], "left").where(F.col("_best").isNull() | (F.struct("area", "ord") <= F.col("_best"))).drop("_whole", "_best")
    at = points.select("fid", "lon", "lat").withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    near = at.join(tiles, ["_cx", "_cy"]).where((F.col("lon") >= F.col("minx")) & (F.col("lon") <= F.col("maxx")) & (F.col("lat") >= F.col("miny")) & (F.col("lat") <= F.col("maxy")))
    near = near.select("fid", "lon", "lat", "ord", "area", _band(F.col("lat"), F.col("miny"), F.col("maxy"), F.col("bands")).alias("band"))
    met = near.join(_banded_edges(boxed), ["ord", "band"])
    x, y = F.col("lon"), F.col("lat")
    crossed = F.transform(F.filter("edges", lambda e: ((e["py"] > y) != (e["qy"] > y)) & (x < (e["qx"] - e["px"]) * (y - e["py"]) / (e["qy"] - e["py"]) + e["px"])),
                          lambda e: F.struct(e["part"].alias("part"), e["ring"].alias("ring")))
    odd = F.filter(F.array_distinct("crossed"), lambda r: F.size(F.filter("crossed", lambda c: c == r)) % 2 == 1)
    inside = F.exists("odd", lambda r: (r["ring"] == 0) & ~F.exists("odd", lambda h: (h["part"] == r["part"]) & (h["ring"] > 0)))
    held = met.withColumn("crossed", crossed).withColumn("odd", odd).where(inside)
    return held.groupBy("fid").agg(F.min(F.struct("area", "ord")).alias("m")).select("fid", F.col("m.ord").alias("by_area"))


def nearest_within(points: DataFrame, targets: DataFrame, metres: float = NEAREST_M) -> DataFrame:
    """(fid, by_distance): nearest target ord (ord, lon, lat) within ``metres``; distances equal to the millimetre are a tie, the first ord wins.

    Where targets are dense the search starts at a reach that holds a few of them and is doubled for the points that found none, so
    that a point meets a few targets, however many are within ``metres``.
    """
    even = math.sqrt(4 * 4 * math.pi * g.EARTH_M ** 2 / (math.pi * max(1, targets.count())))  # a circle of four targets, if they were spread evenly
    reach = metres / (1 << max(0, int(math.log2(max(1.0, metres / even)))))
    left, found = points.select("fid", "lon", "lat"), []
    while reach < metres:
        # a tie of the farthest might lie just beyond the reach, so those are left to the next one
        hit = settled(_nearest(left, targets, reach).where(F.col("n.m") < reach - 0.002), "nearest")
        found.append(hit)
        left = left.join(hit.select("fid"), "fid", "left_anti")
        reach *= 2
    every = reduce(DataFrame.unionByName, [*found, _nearest(left, targets, metres)])
    return every.select("fid", F.col("n.ord").alias("by_distance"))


def _nearest(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """(fid, n): the nearest target within ``metres`` as a struct (m in whole millimetres, ord).

    Points and targets meet in latitude bands as high as the reach; inside a band, in whole numbers of longitude cells as wide as the reach is
    at most at its latitudes, so only neighbours, also over the antimeridian, are compared.
    """
    turn = metres / g.EARTH_M
    lat_step = math.degrees(turn) * 1.000001
    band = lambda lat: F.floor((lat + 90.0) / lat_step)

    def cells(b: Column) -> Column:
        edge = F.greatest(F.abs(b * lat_step - 90.0), F.abs((b + 1) * lat_step - 90.0))
        share = F.lit(math.sin(min(turn, math.pi / 2)) * 1.000001) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
        return F.when((edge >= 90.0) | (share >= 1.0), F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1), F.floor(360.0 / F.degrees(F.asin(share)))).cast("long"))

    def column(lon: Column, b: Column) -> Column:
        return F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * cells(b))

    around = F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]))
    near = targets.select("ord", F.col("lon").alias("tlon"), F.col("lat").alias("tlat")).withColumn("_d", around).withColumn(
        "_b", band(F.col("tlat")) + F.col("_d")).withColumn("_e", around)
    near = near.withColumn("_c", F.pmod(column(F.col("tlon"), F.col("_b")) + F.col("_e"), cells(F.col("_b")))).select("ord", "tlon", "tlat", "_b", "_c").distinct()
    at = points.select("fid", "lon", "lat").withColumn("_b", band(F.col("lat")))
    at = at.withColumn("_c", F.pmod(column(F.col("lon"), F.col("_b")), cells(F.col("_b"))))
    met = at.join(near, ["_b", "_c"]).withColumn("m", g.distance_m(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat")))
    return met.where(F.col("m") <= metres).groupBy("fid").agg(F.min(F.struct(F.round("m", 3).alias("m"), "ord")).alias("n"))


def assign_airport(features: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``airport`` (ord): by key, else containing, else nearest, of features (fid, airport_key, lon, lat)."""
    df = lookup_key(features, found)
    df = df.join(containing(features, found), "fid", "left").join(nearest_within(features, found), "fid", "left")
    return df.withColumn("airport", F.coalesce("by_key", "by_area", "by_distance")).drop("by_key", "by_area", "by_distance")


def directions_from_points(runways: DataFrame) -> DataFrame:
    """(airport, ord, runway_id, designator, physical, heading, lon, lat, elevation_m, quality) of rows with a heading."""
    d = F.get(designators(F.col("ref")), F.lit(0))
    return runways.where(d.isNotNull() & F.col("heading").isNotNull()).select(
        "airport", "ord", "runway_id", d.alias("designator"), d.alias("physical"),
        F.round(F.pmod(F.col("heading"), F.lit(360.0)), 2).alias("heading"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"),
        F.round(elevation_m(F.coalesce(F.col("ele").cast("string"), F.col("airport_elevation").cast("string"))), 2).alias("elevation_m"), F.lit("source").alias("quality"),
        F.when(elevation_m(F.coalesce(F.col("ele").cast("string"), F.col("airport_elevation").cast("string"))).isNotNull(), "source").alias("elevation_source"))


def match_thresholds(ends: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(runway_id, designator, t): threshold (airport, designator, ord, lon, lat, ele) nearest to either end."""
    met = ends.join(thresholds.select("airport", "designator", F.col("ord").alias("tord"), F.col("lon").alias("tlon"),
                                      F.col("lat").alias("tlat"), F.col("ele").alias("tele")), ["airport", "designator"])
    near = F.least(g.distance_m(F.col("tlon"), F.col("tlat"), F.col("ax"), F.col("ay")),
                   g.distance_m(F.col("tlon"), F.col("tlat"), F.col("bx"), F.col("by")))
    return met.groupBy("runway_id", "designator").agg(
        F.min(F.struct(near.alias("m"), "tord", "tlon", "tlat", "tele")).alias("t"))


def directions_from_lines(runways: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Directions of runway lines (airport, airport_elevation, ord, runway_id, ref, ax, ay, bx, by, ele)."""
    ds = designators(F.col("ref"))
    each = runways.withColumn("all_", ds).select("*", F.posexplode("all_").alias("n", "designator"))
    found = match_thresholds(each.select("runway_id", "airport", "designator", "ax", "ay", "bx", "by"), thresholds)
    own = each.join(found, ["runway_id", "designator"], "left")
    other = F.filter(F.col("all_"), lambda d: d != F.col("designator"))
    opposite = found.select("runway_id", F.col("designator").alias("other"), F.col("t").alias("ot"))
    df = own.withColumn("other", F.get(other, F.lit(0))).join(opposite, ["runway_id", "other"], "left")
    want, fwd = expected_heading(F.col("designator")), g.bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    back = g.bearing(F.col("bx"), F.col("by"), F.col("ax"), F.col("ay"))
    start_a = want.isNull() | (g.angle_diff(fwd, want) <= g.angle_diff(back, want))
    lon = F.coalesce(F.col("t.tlon"), F.when(start_a, F.col("ax")).otherwise(F.col("bx")))
    lat = F.coalesce(F.col("t.tlat"), F.when(start_a, F.col("ay")).otherwise(F.col("by")))
    df = df.withColumns({"lon": lon, "lat": lat})
    far_a = g.distance_m(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay")) >= g.distance_m(F.col("lon"), F.col("lat"), F.col("bx"), F.col("by"))
    to_lon = F.coalesce(F.col("ot.tlon"), F.when(far_a, F.col("ax")).otherwise(F.col("bx")))
    to_lat = F.coalesce(F.col("ot.tlat"), F.when(far_a, F.col("ay")).otherwise(F.col("by")))
    ele = F.coalesce(F.col("t.tele").cast("string"), F.col("ele").cast("string"), F.col("airport_elevation").cast("string"))
    return df.select("airport", "ord", "n", "runway_id", "designator", F.col("ref").alias("physical"),
                     F.pmod(F.round(g.bearing(F.col("lon"), F.col("lat"), to_lon, to_lat), 2), F.lit(360.0)).alias("heading"),
                     F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round(elevation_m(ele), 2).alias("elevation_m"),
                     F.when(F.col("t").isNotNull(), "mapped-threshold").otherwise("estimated").alias("quality"),
                     F.when(elevation_m(ele).isNotNull(), F.when(F.col("t.tele").isNotNull(), "threshold").when(F.col("ele").isNotNull(), "runway").otherwise(
                         "airport")).alias("elevation_source"))


def best_directions(df: DataFrame) -> DataFrame:
    """One direction per (airport, designator): best quality, then first."""
    rank = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])[F.col("quality")]
    order = [rank.desc(), F.col("ord")] + ([F.col("n")] if "n" in df.columns else [])
    place = F.row_number().over(Window.partitionBy("airport", "designator").orderBy(*order))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def catalog_summary(best: DataFrame, runways: DataFrame) -> DataFrame:
    """One row of counts; ``runways`` has (runway_id, airport) with a null airport if unresolved."""
    a = best.agg(F.count_distinct("airport").alias("airports"), F.count("*").alias("directions"),
                 F.count_if(F.col("quality") != "estimated").alias("mapped"), F.count_if(F.col("quality") == "estimated").alias("estimated"))
    b = runways.agg(F.count_distinct(F.when(F.col("airport").isNotNull(), F.col("runway_id"))).alias("physical"),
                    F.count_if(F.col("airport").isNull()).alias("unresolved"))
    return a.crossJoin(b)  # one row each


def build_catalog(found: DataFrame, best: DataFrame) -> DataFrame:
    """One row per airport with directions: its runways in natural order."""
    runway = F.struct(natural_key(F.col("designator")).alias("k"), F.struct("designator", "physical", "heading", "lon", "lat", "elevation_m", "elevation_source", "quality").alias("r"))
    per = best.groupBy(F.col("airport").alias("ord")).agg(F.array_sort(F.collect_list(runway)).alias("rs"))
    return found.drop("geom").join(per, "ord").withColumn("runways", F.transform("rs", lambda x: x["r"])).drop("rs")


def airport_catalog(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(airport documents, one row of counts) of features (ord, layer, geom, props MAP<STRING,STRING>).

    Airports, runways and thresholds are told by layer or aeroway.  Runways and thresholds go to the airport that their key
    names, else the smallest that holds them, else the nearest within reach; a runway without designators is none,
    one without an airport or without directions counts as unresolved.
    """
    get = lambda k: F.col("props")[k]
    is_ = lambda *names: F.coalesce(get("aeroway").isin(*names), F.lit(False))
    # airports are read by every lookup, assigned features by every kind of direction: both are settled
    placed = with_anchors(features).withColumns({"lon": F.col("anchor.x"), "lat": F.col("anchor.y")})
    raw = placed.where(((F.col("layer") == "airports") | is_("aerodrome", "airport")) & F.col("anchor").isNotNull())
    found = airports(raw.select("ord", *[get(k).alias(k) for k in ("id", "icao", "ident", "iata", "ref", "name")],
                                F.coalesce(get("elevationM"), get("ele")).alias("ele"), "lon", "lat", "geom"))
    found = settled(found, "airports")
    # a feature without a place can still name its airport
    point = F.col("geom.kind") == "Point"
    known = found.select(F.col("ord").alias("airport"), F.col("elevation_m").alias("airport_elevation"), F.col("id").alias("airport_id"))
    asked = placed.where(is_("threshold", "runway") | (F.col("layer") == "runways"))
    met = assign_airport(asked.select(F.col("ord").alias("fid"), "layer", "geom", "props", "lon", "lat", F.trim(F.coalesce(
        get("airportId"), get("airport_id"))).alias("airport_key")), found).withColumnRenamed("fid", "ord").join(known, "airport", "left")
    met = settled(met, "assigned")
    own = F.get(designators(get("ref")), F.lit(0))
    thresholds = met.where(is_("threshold") & point & F.col("airport").isNotNull()).select(
        "airport", own.alias("designator"), "ord", "lon", "lat", get("ele").alias("ele"))
    runways = met.where((F.col("layer") == "runways") | is_("runway")).where(
        (F.col("layer") == "runways") | (F.size(designators(get("ref"))) > 0))
    at = runways.where(F.col("airport").isNotNull()).withColumn("runway_id", F.col("ord").cast("string"))
    given = (F.col("layer") == "runways") & point
    number = lambda *ks: F.coalesce(*[get(k).cast("double") for k in ks])
    spot = at.where(given).select("airport", "airport_elevation", "ord", "runway_id", F.coalesce(get("runwayDesignator"), get("designator"), get("ref")).alias("ref"),
                                  number("headingTrueDeg", "headingDeg").alias("heading"), "lon", "lat", F.coalesce(get("elevationM"), get("ele")).alias("ele"))
    lines = at.where(~given & F.col("geom.kind").isin("LineString", "MultiLineString")).withColumn("line", g.longest_line_m(F.col("geom")))
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    strips = lines.where(F.size("line") > 0).select("airport", "airport_elevation", "ord", "runway_id", F.trim(get("ref")).alias("ref"), first["x"].alias("ax"), first["y"].alias("ay"),
                                                    last["x"].alias("bx"), last["y"].alias("by"), get("ele").alias("ele"))
    every = directions_from_lines(strips, thresholds).unionByName(directions_from_points(spot).withColumn("n", F.lit(0)))
    every = settled(every, "directions")
    used = every.select(F.col("ord").alias("used")).distinct()
    told = runways.join(used, F.col("ord") == F.col("used"), "left").select(
        F.coalesce(get("id"), F.concat_ws(":", "airport_id", get("ref"))).alias("runway_id"), F.when(F.col("used").isNotNull(), F.col("airport")).alias("airport"))
    best = best_directions(every)
    return build_catalog(found, best), catalog_summary(best, told)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
