"""Label candidates, limits and decluttering."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.arrays import Parts, geometries
from ..functions.policy import LABEL_LIMITS, ROAD_PRIORITY, ROADS
from ..functions.text import clean_text, filled, first_label, first_text, is_label, title_case
from ..plans.pyramid import top_per_layer
from ..schema import BOX
from ..sources.scratch import settled
from .classify import Tags, poi_category_stored

# What names a feature, and the classes that are labelled at a zoom.
NAME_FIELDS = ("name", "ref", "iata", "icao", "operator", "official_name", "short_name")
CLASS_FIELDS = ("amenity", "railway", "public_transport", "aeroway", "power", "man_made", "military", "emergency", "industrial", "poi_category")
UNNAMED_WAYS = ("path", "footway", "cycleway", "steps", "corridor", "platform")
EARLY_AVIATION = ("runway", "taxiway", "apron", "terminal")
LATE_AVIATION = EARLY_AVIATION + ("helipad", "hangar", "aerodrome", "heliport")
AVIATION_LABEL = {"helipad": 980, "heliport": 980, "runway": 930, "terminal": 880, "apron": 820, "taxiway": 760}
LAYER_START = {"road_labels": 13, "aip_labels": 12, "poi_labels": 17}
LABEL_SOURCE = {"road_labels": "roads", "aip_labels": "aip", "poi_labels": "pois"}
OTHER_LIMIT = 80
# What a theme labels.
THEME_ROADS = {
    "major": ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"),
    "secondary": ("secondary", "secondary_link"),
    "local": ("residential", "living_street", "unclassified"),
}
THEME_SOURCES = ("roads", "aip", "aviation", "pois")
THEME_POI_FIELDS = ("amenity", "tourism", "shop", "leisure", "railway", "public_transport", "station", "aeroway", "power", "man_made", "tower:type", "military",
                    "emergency", "office", "government", "boundary", "protect_class", "landuse", "industrial")
THEME_POI_CLASSES = {
    "amenity": ("hospital", "police", "fire_station", "bus_station", "ferry_terminal", "shelter", "townhall", "courthouse", "prison", "ranger_station",
                "research_institute", "airport", "railway_station", "train_station", "subway_station", "communications_tower", "bunker", "checkpoint", "depot", "warehouse"),
    "tourism": ("information",), "leisure": ("nature_reserve",), "railway": ("station",), "public_transport": ("station",), "station": ("subway",),
    "aeroway": ("aerodrome", "airport"), "power": ("plant", "substation", "generator", "tower", "transformer", "line"),
    "man_made": ("communications_tower", "mast", "antenna"), "tower:type": ("communication",),
    "military": ("barracks", "bunker", "checkpoint", "airbase", "naval_base", "range", "training_area", "base", "airfield", "danger_area", "ammunition_dump"),
    "emergency": ("ambulance_station", "siren", "assembly_point", "disaster_response"), "office": ("government",),
    "government": ("yes", "public_safety", "border_control", "customs", "ministry", "aerospace"), "boundary": ("protected_area",),
    "industrial": ("refinery", "depot", "storage", "logistics"), "landuse": ("industrial",),
}
THEME_POI_WORDS = {
    "military": {"airbase": "Airbase", "airfield": "Airfield", "barracks": "Barracks", "bunker": "Bunker", "checkpoint": "Checkpoint", "naval_base": "Naval base",
                 "range": "Range", "training_area": "Training area", "danger_area": "Danger area", "ammunition_dump": "Ammunition dump", "base": "Base"},
    "emergency": {"ambulance_station": "Ambulance station", "siren": "Siren", "assembly_point": "Assembly point", "disaster_response": "Disaster response"},
    "amenity": {"hospital": "Hospital", "police": "Police", "fire_station": "Fire station", "shelter": "Shelter", "bunker": "Bunker", "checkpoint": "Checkpoint",
                "depot": "Depot", "warehouse": "Warehouse", "prison": "Prison", "courthouse": "Courthouse", "townhall": "Town hall", "bus_station": "Bus station",
                "ferry_terminal": "Ferry terminal"},
    "power": {"plant": "Power plant", "substation": "Substation", "generator": "Generator", "tower": "Power tower", "transformer": "Transformer", "line": "Power line"},
    "man_made": {"communications_tower": "Comms tower", "mast": "Mast", "antenna": "Antenna"},
    "boundary": {"protected_area": "Protected area"}, "landuse": {"industrial": "Industrial"},
    "industrial": {"refinery": "Refinery", "depot": "Depot", "storage": "Storage", "logistics": "Logistics"},
}
THEME_AVIATION_WORDS = {"aerodrome": "Aerodrome", "heliport": "Heliport", "terminal": "Terminal", "apron": "Apron"}

Get = Callable[[str], Column]


def _map(table: dict, key: Column, other: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.coalesce(key, F.lit(""))], F.lit(other))


def road_labels(get: Get, z: Column) -> dict[str, Column]:
    """text, class, priority, min_zoom and whether a road is labelled at z."""
    c = F.coalesce(get("highway"), F.lit(""))
    known = lambda *names: c.isin(*[v for n in names for v in ROADS[n]])
    shown = ((c != "") & (z >= 13) & F.when(z <= 14, known("major", "mid")).when(z <= 16, known("major", "mid", "city")).otherwise(~c.isin(*UNNAMED_WAYS)))
    start = F.when(known("major"), 13).when(c.isin(*[v for v in ROADS["mid"] if v != "busway"]), 14).otherwise(16)
    prio = _map(ROAD_PRIORITY, c, 200) + F.when(filled(F.trim(get("ref"))), 80).otherwise(0) + F.when(z >= 15, 20).otherwise(0)
    return {"text": first_label(get("ref"), get("name")), "class": c, "priority": prio, "min_zoom": start, "shown": shown}


def aviation_labels(get: Get, z: Column) -> dict[str, Column]:
    c = F.coalesce(get("aeroway"), F.lit(""))
    shown = (z >= 12) & F.when(z < 14, c.isin(*EARLY_AVIATION)).otherwise(c.isin(*LATE_AVIATION))
    ref = clean_text(get("ref"))
    own = F.when((ref != "") & ~ref.rlike(r"(?i)^(yes|no|true|false|0|1)$"), ref)
    text = F.coalesce(own, first_label(*[get(k) for k in ("ref", "name", "iata", "icao", "operator")]),
                      F.when(c == "runway", "RWY").when(c.isin("helipad", "heliport"), "H"))
    return {"text": text, "class": c, "priority": _map(AVIATION_LABEL, c, 680),
            "min_zoom": F.when(c.isin(*EARLY_AVIATION), 12).otherwise(14), "shown": shown}


def poi_labels(get: Get, z: Column) -> dict[str, Column]:
    cat = poi_category_stored(get("poi_category"), Tags(get))
    prio = (F.when(cat.isin("emergency", "military"), 920).when(cat.isin("transport", "energy", "communications", "government"), 820)
            .when(F.coalesce(get("amenity").isin("hospital", "university"), F.lit(False)), 650).otherwise(500))
    kind = F.coalesce(first_text(*[get(k) for k in CLASS_FIELDS]), F.lit("poi"))
    return {"text": first_label(*[get(k) for k in NAME_FIELDS]), "class": kind, "priority": prio, "min_zoom": F.lit(16), "shown": F.lit(True)}


KINDS = {"road_labels": road_labels, "aip_labels": aviation_labels, "poi_labels": poi_labels}


def label_candidates(df: DataFrame, layer: str, z: int | Column, get: Get | None = None) -> DataFrame:
    """Adds text, class, priority, min_zoom to the features of a label layer that have a label at z."""
    get = get or (lambda k: F.col("props")[k])
    made = KINDS[layer](get, F.lit(z) if isinstance(z, int) else z)
    df = df.where(made["shown"]).withColumns({k: v for k, v in made.items() if k != "shown"})
    return df.where(filled(F.col("text")))


def label_limit(layer: str, z: int | Column) -> Column:
    """Most labels of a layer in a tile; layers without a table of their own have ``OTHER_LIMIT``."""
    zc = F.lit(z) if isinstance(z, int) else z
    out = F.lit(OTHER_LIMIT)
    for top, n in reversed(LABEL_LIMITS.get(layer, ())):
        out = F.when(zc <= top, F.lit(n)).otherwise(out)
    return out


def top_labels(cands: DataFrame, layer: str, z: int | Column, order: str = "fid") -> DataFrame:
    """Best candidates per tile (z, x, y) of a label layer; a literal bound cuts before the shuffle."""
    most = max((n for _, n in LABEL_LIMITS.get(layer, ())), default=OTHER_LIMIT)
    return top_per_layer(cands.withColumn("layer", F.lit(layer)), label_limit(layer, z), order=order, most=most)


def active_label_layers(layers: DataFrame, z: int) -> DataFrame:
    """Label layers whose source layer (id, min_zoom, max_zoom) and own start are open at z."""
    rows = [(k, LABEL_SOURCE[k], v) for k, v in LAYER_START.items()]
    known = layers.sparkSession.createDataFrame(rows, "label string, id string, start int")
    return (layers.join(F.broadcast(known), "id")  # three rows, fixed
            .where((F.coalesce("min_zoom", F.lit(0)) <= z) & (F.coalesce("max_zoom", F.lit(24)) >= z) & (F.col("start") <= z)).select("label"))


def priority_class(number: Column) -> Column:
    return F.when(number >= 900, "critical").when(number >= 760, "important").when(number >= 500, "normal").otherwise("low")


def _theme_rule(theme: Mapping, layer: str) -> Mapping | None:
    """A layer's rule, also under the other name of the aviation layer; none if it or all labels are off."""
    other = {"aip": "aviation", "aviation": "aip"}.get(layer, layer)
    rule = theme.get(layer, theme.get(other))
    if theme.get("enabled") is False or not isinstance(rule, Mapping) or rule.get("enabled") is False:
        return None
    return rule


def _open_at(rule: Mapping, z: int) -> bool:
    lo, hi = rule.get("minZoom"), rule.get("maxZoom")
    return (0 if lo is None else lo) <= z <= (22 if hi is None else hi)


def _nothing() -> dict[str, Column]:
    return {"text": F.lit(None).cast("string"), "priority": F.lit(None).cast("int"), "priority_class": F.lit(None).cast("string")}


def _choose(*cases: tuple[Column, Column, int, str]) -> dict[str, Column]:
    """text, priority and its class of the first case whose condition holds."""
    out = _nothing()
    for when, text, number, name in reversed(cases):
        hit = F.coalesce(when, F.lit(False))
        for k, v in (("text", text), ("priority", F.lit(number)), ("priority_class", F.lit(name))):
            out[k] = F.when(hit, v).otherwise(out[k])
    return out


def _theme_road(get: Get, z: int, rule: Mapping) -> dict[str, Column]:
    c, ref, name = F.coalesce(get("highway"), F.lit("")), clean_text(get("ref")), clean_text(get("name"))
    local = rule.get("local") if isinstance(rule.get("local"), Mapping) else {}
    start = {"major": rule.get("majorMinZoom", 12), "secondary": rule.get("secondaryMinZoom", 16), "local": local.get("minZoom", 17)}
    on = lambda k: c.isin(*THEME_ROADS[k]) & F.lit(z >= start[k] and (k != "local" or local.get("enabled") is True))
    return _choose((on("major") & is_label(ref), ref, 820, "important"), (on("secondary") & is_label(ref), ref, 700, "normal"),
                   (on("local") & is_label(name), name, 400, "low"))


def _theme_aviation(get: Get, z: int, rule: Mapping) -> dict[str, Column]:
    c, ref, name = F.coalesce(get("aeroway"), F.lit("")), clean_text(get("ref")), clean_text(get("name"))
    said = lambda t: F.when(F.coalesce(t, F.lit("")) != "", t)
    own = F.when((ref != "") & ~ref.rlike(r"(?i)^(yes|no|true|false|0|1)$"), ref)
    word = F.create_map(*[F.lit(x) for kv in THEME_AVIATION_WORDS.items() for x in kv])[c]
    field = F.coalesce(said(name), own, word)
    pad, strip, stand = F.coalesce(own, said(name), F.lit("H")), F.coalesce(own, said(name), F.lit("RWY")), F.coalesce(said(name), said(ref), word)

    def fit(t: Column) -> Column:
        """A meaningful text, or one of the short ones that pads and runways may carry."""
        short = t.rlike("^[A-Z]$") & c.isin("helipad", "heliport", "runway")
        return is_label(t) | ((t == "H") & c.isin("helipad", "heliport")) | ((t == "RWY") & (c == "runway")) | short

    at = lambda least: F.lit(z >= least)
    return _choose((c.isin("aerodrome", "heliport") & fit(field) & at(9), field, 980, "critical"), ((c == "runway") & fit(strip) & at(11), strip, 900, "important"),
                   (c.isin("terminal", "apron") & is_label(stand) & at(14), stand, 720, "normal"), ((c == "helipad") & fit(pad) & at(12), pad, 980, "critical"))


def _theme_poi(get: Get, z: int, rule: Mapping) -> dict[str, Column]:
    tags = Tags(get)
    cat = poi_category_stored(get("poi_category"), tags)
    off = [k for k, v in (rule.get("categories") or {}).items() if v is False]
    classes = rule["classes"] if isinstance(rule.get("classes"), Mapping) else THEME_POI_CLASSES
    picked = F.lit(False)
    for field in THEME_POI_FIELDS:
        if classes.get(field):
            picked = picked | F.coalesce(get(field).isin(*map(str, classes[field])), F.lit(False))
    word = F.coalesce(*[F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[clean_text(get(k))] for k, words in THEME_POI_WORDS.items()],
                      F.when(cat != "consumer", title_case(cat)))
    text = F.coalesce(first_label(*[get(k) for k in NAME_FIELDS]), word)
    stored, amenity = F.coalesce(get("poi_category"), F.lit("")), F.coalesce(get("amenity"), F.lit(""))
    high = stored.isin("emergency", "military")
    mid = ~high & stored.isin("transport", "energy", "communications", "government")
    late = ~high & ~mid & amenity.isin("hospital", "police", "fire_station")
    shown = picked & ~cat.isin(*off) if off else picked
    return _choose((shown & filled(text) & (high | late), text, 920, "critical"), (shown & filled(text) & mid, text, 820, "important"),
                   (shown & filled(text), text, 620, "normal"))


def describe_labels(df: DataFrame, layer: str, z: int, theme: Mapping, get: Get | None = None) -> DataFrame:
    """Features of a layer that a theme labels at z: adds text, priority and priority_class.

    ``theme`` maps ``enabled`` and the layers to rules: enabled, minZoom, maxZoom (22 where open); roads also
    majorMinZoom, secondaryMinZoom, local {enabled, minZoom}; pois also categories and classes.
    """
    get = get or (lambda k: F.col("props")[k])
    rule = _theme_rule(theme, layer)
    kinds = {"roads": _theme_road, "aip": _theme_aviation, "aviation": _theme_aviation, "pois": _theme_poi}
    made = kinds[layer](get, z, rule) if rule is not None and _open_at(rule, z) and layer in kinds else _nothing()
    return df.withColumns(made).where(filled(F.col("text")))


def line_anchor(geom: Column) -> Column:
    return g.let(g.longest_line(geom), g.line_midpoint)


def _scan_anchor(flat: Parts) -> tuple[float, float] | None:
    """Middle of the widest stretch inside the largest polygon (by its outer ring, the first on ties); holes are left out.

    Scan lines: the middle of the box, then half-way between neighbouring vertex heights; of more than 32, every
    k-th.
    """
    flat = [rings for rings in flat if rings]
    if not flat:
        return None
    twice = [abs(float((r[0][:-1, 0] * r[0][1:, 1] - r[0][1:, 0] * r[0][:-1, 1]).sum())) for r in flat]
    rings = flat[int(np.argmax(twice))]
    if not len(rings[0]):
        return None
    heights = np.unique(rings[0][:, 1])
    if len(heights) < 2:
        return tuple(rings[0][0])
    scans = np.concatenate(([(heights[0] + heights[-1]) / 2], (heights[:-1] + heights[1:]) / 2))
    a = np.concatenate([np.roll(r, 1, axis=0) for r in rings])
    b = np.concatenate(rings)
    width, best = -1.0, None
    for y in scans[::max(1, -(-len(scans) // 32))]:
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        p, q = a[hit], b[hit]
        xs = np.sort(p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
        gaps = xs[1::2] - xs[:len(xs) // 2 * 2:2]
        if len(gaps) and gaps.max() > width:
            k = int(gaps.argmax())
            width, best = float(gaps[k]), (float((xs[2 * k] + xs[2 * k + 1]) / 2), float(y))
    return best


def with_anchors(df: DataFrame) -> DataFrame:
    """Adds ``anchor`` (x, y): a point itself, the midpoint of the longest line, the widest interior stretch of the largest polygon; null if empty."""
    @F.arrow_udf("x double, y double")
    def widest(geom: pa.Array) -> pa.Array:
        got = [_scan_anchor(parts) if kind in ("Polygon", "MultiPolygon") else None for kind, parts in geometries(geom)]
        ends = [pa.array([None if p is None else float(p[i]) for p in got], pa.float64()) for i in (0, 1)]
        return pa.StructArray.from_arrays(ends, ["x", "y"])

    kind = F.col("geom.kind")
    df = df.withColumn("_area", widest(F.col("geom")))
    own = (F.when(kind == "Point", g.all_points(F.col("geom"))[0]).when(kind.isin("LineString", "MultiLineString"), line_anchor(F.col("geom")))
           .when(F.col("_area.x").isNotNull(), F.col("_area")))
    return df.withColumn("anchor", F.when(F.size(g.all_points(F.col("geom"))) > 0, own)).drop("_area")


def declutter(df: DataFrame, keys: tuple[str, ...], max_labels: int) -> DataFrame:
    """Per tile: priority, then key; each key once; labels that overlap a chosen one go; at most max_labels.

    Rows (keys, key, priority, minx, miny, maxx, maxy), any number a tile.  The result is that of taking labels one by one, found in rounds: labels lie in
    the cells of a grid of their mean size, and one that no undecided label of any of its cells outranks is kept; what overlaps it goes.  A
    cell's best is a minimum combined on the map side, kept labels do not overlap, so a cell holds few of them, and no tile or crowd is gathered.
    Every round decides the best of each tile at least, and about as many as there are crowds apart from each other.
    """
    rank = [F.desc("priority"), "key", *[F.col(c) for c in BOX]]
    alone = F.row_number().over(Window.partitionBy(*keys, "key").orderBy(*rank))
    labels = settled(df.withColumn("_n", alone).where("_n = 1").drop("_n").withColumn("_id", F.monotonically_increasing_id()), "labels")
    mean = labels.agg(F.avg(F.col("maxx") - F.col("minx")), F.avg(F.col("maxy") - F.col("miny"))).first()
    cell = lambda c, size: F.floor(F.col(c) / (size or 1.0))
    place = ["_tile", "_cx", "_cy"]
    best = F.struct((-F.col("priority")).alias("p"), "key", "_id")
    undecided = settled(labels.select("_id", F.to_json(F.struct(*keys)).alias("_tile"), best.alias("_rank"), *BOX,
                                      F.explode(F.sequence(cell("minx", mean[0]), cell("maxx", mean[0]))).alias("_cx")).withColumn(
                        "_cy", F.explode(F.sequence(cell("miny", mean[1]), cell("maxy", mean[1])))), "undecided")
    kept: list[DataFrame] = []
    while undecided.limit(1).count():
        first = undecided.groupBy(*place).agg(F.min("_rank").alias("_first"))
        wins = settled(undecided.join(first, place).groupBy("_id").agg(F.bool_and(F.col("_rank._id") == F.col("_first._id")).alias("wins")).where("wins").select("_id"), "kept-labels")
        kept.append(wins)
        held = undecided.join(wins, "_id", "left_semi").select(*place, *[F.col(c).alias(f"_{c}") for c in BOX])
        over = (F.col("minx") < F.col("_maxx")) & (F.col("maxx") > F.col("_minx")) & (F.col("miny") < F.col("_maxy")) & (F.col("maxy") > F.col("_miny"))
        gone = undecided.join(held, place).where(over).select("_id").unionByName(wins)
        undecided = settled(undecided.join(gone, "_id", "left_anti"), "undecided")
    if not kept:
        return df.limit(0)
    chosen = labels.join(reduce(DataFrame.unionByName, kept), "_id", "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))
    return chosen.withColumn("_n", place).where(F.col("_n") <= max_labels).select(*df.columns)
