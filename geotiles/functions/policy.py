"""Per-layer tile policies: limits, tolerances, sizes and priorities as Columns over (layer, kind, z).

A ``LayerPolicy`` holds functions that return Columns (or DataFrames for ``read`` and
``prepare``), never per-row callbacks, so a custom policy stays inside the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sqlite_real
from .tilemath import EXTENT

NO_LIMIT = 1 << 60

# Tables by zoom, layer and class.
BASE_TOLERANCE = ((7, 14.0), (9, 10.0), (10, 8.0), (11, 6.0), (12, 4.0), (13, 2.4), (14, 1.2), (15, 0.5))
DETAIL = {"overview": 1.1, "normal": 1.0, "full": 0.3}
BUDGET = ((10, 6500), (11, 10000), (12, 12500), (13, 12000))
DEFAULT_FEATURES, MAX_BUDGET = 12_000, 30_000
LIMITS = {
    10: {"roads": 1800, "landuse": 1600, "water": 1200, "aip": 500, "railways": 500, "boundaries": 500, "buildings": 0, "pois": 0, "": 500},
    11: {"roads": 3500, "landuse": 2200, "water": 1600, "aip": 800, "railways": 800, "boundaries": 700, "buildings": 0, "pois": 0, "": 1000},
    12: {"roads": 5000, "landuse": 2600, "water": 1800, "aip": 1000, "railways": 1000, "boundaries": 900, "buildings": 300, "pois": 0, "": 1500},
    13: {"buildings": 900, "pois": 0}, 14: {"buildings": 4000, "pois": 0},
}
LABEL_LIMITS = {"road_labels": ((13, 48), (15, 96), (99, 160)), "aip_labels": ((13, 40), (99, 80)), "poi_labels": ((17, 50), (99, 120))}
ROAD_PRIORITY = {"motorway": 1000, "trunk": 960, "primary": 920, "secondary": 880, "motorway_link": 850, "trunk_link": 830, "primary_link": 780,
                 "tertiary": 740, "secondary_link": 700, "busway": 650, "residential": 460, "unclassified": 440, "living_street": 420, "service": 230,
                 "track": 210, "cycleway": 190, "path": 170, "footway": 160, "steps": 150}
AVIATION_PRIORITY = {"runway": 870, "heliport": 820, "helipad": 800, "taxiway": 720, "apron": 680, "stopway": 620, "taxilane": 580, "terminal": 520}
FLAT_PRIORITY = {"water": 860, "coastline": 830, "railways": 680, "cliffs": 620, "terrain": 540, "pois": 60}
ROADS = {"major": ("motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link"),
         "mid": ("tertiary", "tertiary_link", "primary_link", "secondary_link", "busway"),
         "city": ("residential", "unclassified", "living_street"),
         "minor": ("service", "track", "path", "footway", "cycleway", "steps", "pedestrian", "corridor", "platform", "construction", "proposed", "road")}
OVERVIEW_LANDUSE = {"landuse": ("residential", "industrial", "commercial", "retail", "forest", "farmland", "military", "reservoir"),
                    "leisure": ("park", "golf_course", "recreation_ground"), "natural": ("wood", "water", "scrub", "heath")}
AVIATION = (("runway", "taxiway", "apron", "stopway", "taxilane"), ("terminal", "helipad", "hangar", "aerodrome", "heliport"))
NATURAL = {"terrain": ("beach", "sand"), "coastline": ("coastline",), "cliffs": ("cliff",)}
LAYERS_READ = ("roads", "landuse", "terrain", "coastline", "cliffs", "boundaries")
GATES = {"buildings": 12, "pois": 16, "aip": 10}
BUILDING_SPAN = ((12, 60), (13, 34), (14, 12))


def _steps(z: Column, table, last) -> Column:
    out = None
    for top, value in table:
        out = F.when(z <= top, F.lit(value)) if out is None else out.when(z <= top, F.lit(value))
    return out.otherwise(F.lit(last))


def tile_budget(z: Column, requested: int | None = None) -> Column:
    asked = requested if isinstance(requested, int) and requested > 0 else DEFAULT_FEATURES
    return F.least(F.lit(asked), _steps(z, BUDGET, MAX_BUDGET))


def greatest_budget(zooms: Sequence[int], requested: int | None = None) -> int:
    """The greatest ``tile_budget`` of some zooms."""
    asked = requested if isinstance(requested, int) and requested > 0 else DEFAULT_FEATURES
    return min(asked, max(next((n for top, n in BUDGET if z <= top), MAX_BUDGET) for z in zooms))


def greatest_limit(zooms: Sequence[int]) -> int:
    """The greatest ``layer_limit`` of some zooms, over all layers."""
    return max(max(LIMITS[max(10, z)].values()) if z <= 12 else NO_LIMIT for z in zooms)


def layer_limit(layer: Column, z: Column) -> Column:
    """Most features of a layer in a tile."""
    def of(table: dict) -> Column:
        out = None
        for name, n in table.items():
            if name:
                out = F.when(layer == name, F.lit(n)) if out is None else out.when(layer == name, F.lit(n))
        return out.otherwise(F.lit(table.get("", NO_LIMIT))).cast("long")

    return (F.when(z <= 10, of(LIMITS[10])).when(z == 11, of(LIMITS[11])).when(z == 12, of(LIMITS[12]))
            .when(z == 13, of(LIMITS[13])).when(z == 14, of(LIMITS[14])).otherwise(F.lit(NO_LIMIT).cast("long")))


def is_area(kind: Column) -> Column:
    return kind.isin("Polygon", "MultiPolygon")


def tolerance_scale(layer: Column, kind: Column, z: Column) -> Column:
    area = is_area(kind)
    pick = lambda a, b: F.when(area, F.lit(a)).otherwise(F.lit(b))
    return (F.when(layer == "roads", 0.45).when(layer == "railways", 0.55).when(layer == "aip", 0.35)
            .when(layer == "water", pick(0.65, 0.55)).when(layer == "landuse", pick(0.7, 0.6))
            .when(layer == "boundaries", F.when(z <= 10, 0.95).otherwise(0.75))
            .when(layer == "buildings", F.when(z <= 14, 0.45).otherwise(0.25)).otherwise(pick(0.75, 0.65)))


def plain_scale(layer: Column, kind: Column, z: Column) -> Column:
    return F.when(is_area(kind), 0.75).otherwise(0.65)


def tolerance(layer: Column, kind: Column, z: Column, detail: Column, scale: Callable[[Column, Column, Column], Column] | None = None) -> Column:
    """Tolerance in tile units, two places: by zoom, times the layer's scale, times the detail's."""
    factor = F.when(detail == "overview", DETAIL["overview"]).when(detail == "full", DETAIL["full"]).otherwise(DETAIL["normal"])
    return F.greatest(F.lit(0.0), F.round(_steps(z, BASE_TOLERANCE, 0.0) * (scale or tolerance_scale)(layer, kind, z) * factor, 2))


def min_size(layer: Column, kind: Column, z: Column) -> Column:
    """Smallest feature kept, in tile units; 0 keeps all."""
    at = lambda *table: _steps(z, table[:-1], table[-1])
    return F.when((z >= 15) | (kind == "Point"), 0.0).otherwise(
        F.when(layer == "buildings", at((12, 18.0), (13, 10.0), 5.0)).when(layer == "pois", 4.0).when(layer == "boundaries", 0.0)
        .when(layer == "roads", at((10, 3.0), (12, 2.0), 1.0))
        .when(layer.isin("railways", "aip", "coastline", "cliffs"), at((10, 2.0), (12, 1.2), 0.8))
        .when(layer == "water", at((10, 5.0), (12, 3.0), 1.5)).when(layer.isin("landuse", "terrain"), at((10, 6.0), (12, 4.0), 2.0))
        .otherwise(at((10, 3.0), 1.0)))


def is_small(box: Column, tile: Column, smallest: Column) -> Column:
    """Both sides of the box below the smallest size, measured in the plain tile."""
    w = (box["maxx"] - box["minx"]) / (tile["maxx"] - tile["minx"]) * EXTENT
    h = (box["maxy"] - box["miny"]) / (tile["maxy"] - tile["miny"]) * EXTENT
    return (smallest > 0) & (F.greatest(w, h) < smallest)


def _of(table: dict, key: Column, other: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.coalesce(key, F.lit(""))], F.lit(other)).cast("double")


def importance(kind: Column, box: Column) -> Column:
    """Extra priority of large geometries below z13."""
    w, h = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    return F.least(F.lit(180.0), F.when(is_area(kind), F.sqrt(w * h) * 15000).otherwise(F.hypot(w, h) * 900))


def priority(layer: Column, get: Callable[[str], Column], kind: Column, box: Column, z: Column) -> Column:
    """Feature priority; ``get`` names where a property is found."""
    w, h = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    level = get("admin_level")
    number = F.when(level.isNull() | (F.trim(level) == ""), F.lit(0.0)).otherwise(F.expr("NULL").cast("double"))
    number = F.coalesce(number, F.when(level.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), level.cast("double")))
    border = F.when(number.isNull(), 300.0).otherwise(F.greatest(F.lit(100.0), 1000 - 70 * number))
    use, wild = get("landuse"), get("natural")
    ground = (F.when(use.isin("forest", "reservoir") | F.coalesce(wild.isin("wood", "water"), F.lit(False)), 520.0)
              .when(use.isin("residential", "industrial", "commercial", "retail", "military"), 430.0)
              .when((get("leisure") == "park") | (use == "farmland"), 360.0).otherwise(F.when(z < 12, 100.0).otherwise(220.0)))
    house = F.when(z >= 15, 90.0).otherwise(90 + F.least(F.lit(260.0), F.sqrt(w * h) * 30000))
    base = (F.when(layer == "roads", _of(ROAD_PRIORITY, get("highway"), 200)).when(layer == "boundaries", border)
            .when(layer == "aip", _of(AVIATION_PRIORITY, get("aeroway"), 240)).when(layer == "landuse", ground)
            .when(layer == "buildings", house).otherwise(_of(FLAT_PRIORITY, layer, 100)))
    return base + F.when((z < 13) & ~layer.isin("pois", "buildings"), importance(kind, box)).otherwise(0.0)


def road_classes(z: int) -> tuple[str, ...]:
    names = ("major",) if z <= 11 else ("major", "mid") if z <= 13 else ("major", "mid", "city") if z == 14 else ("major", "mid", "city", "minor")
    return tuple(v for n in names for v in ROADS[n])


def layer_rules(layer: str, z: int) -> list[dict] | None:
    """Property filters of a layer at z, any of which admits a feature; None if the layer is shut there."""
    if z < GATES.get(layer, 0):
        return None
    if layer == "roads":
        return [{"column": "highway", "include": road_classes(z)}]
    if layer == "landuse" and z < 12:
        return [{"column": c, "include": v} for c, v in OVERVIEW_LANDUSE.items()]
    if layer in NATURAL:
        return [{"column": "natural", "include": NATURAL[layer]}]
    if layer == "boundaries" and z < 12:
        return [{"column": "admin_level", "maxNumber": 7}]
    if layer == "aip":
        return [{"column": "aeroway", "include": AVIATION[0] + (AVIATION[1] if z >= 13 else ())}]
    return []


def admitted(layer: Column, get: Callable[[str], Column], z: Column, zooms: Sequence[int]) -> Column:
    """``layer_rules`` of the built-in layers as one predicate over rows of several zooms; other layers are open."""
    out = F.lit(True)
    for name in (*LAYERS_READ, *GATES):
        by_rule: dict[str, tuple[list[int], list[dict] | None]] = {}
        for at in zooms:
            rules = layer_rules(name, at)
            by_rule.setdefault(repr(rules), ([], rules))[0].append(at)
        ok = F.lit(True)
        for ats, rules in by_rule.values():
            if rules is None:
                some = F.lit(False)
            elif not rules:
                continue
            else:
                some = F.lit(False)
                for rule in rules:
                    value = get(rule["column"])
                    hit = value.isin(*rule["include"]) if "include" in rule else sqlite_real(value) <= rule["maxNumber"]
                    some = some | F.coalesce(hit, F.lit(False))
            ok = F.when(z.isin(*ats), some).otherwise(ok)
        out = F.when(layer == name, ok).otherwise(out)
    return out


def wide_enough(layer: Column, box: Column, queried: Column, z: Column) -> Column:
    """Buildings below z15 must span a share of the buffered box that is queried."""
    span = F.greatest(queried["maxx"] - queried["minx"], queried["maxy"] - queried["miny"]) / EXTENT
    least = span * _steps(z, BUILDING_SPAN, 0)
    big = (box["maxx"] - box["minx"] >= least) | (box["maxy"] - box["miny"] >= least)
    return F.when((layer == "buildings") & (z < 15), big).otherwise(F.lit(True))


@dataclass(frozen=True)
class LayerPolicy:
    """Hooks of a tile job; the defaults are the generic policy: priority 100, no quota, no smallest size.

    ``aliases`` names the layer whose rules another name follows; ``source_layers`` the layer whose features a
    derived one reads; ``read`` may replace the features of a zoom; ``shown`` and ``wide`` are predicates
    over rows of all zooms, before and after tiles are known; ``visible`` drops rows of a tile that it has read and
    counted, from features and label sources alike, and ``enrich`` changes the properties of the others.
    """

    aliases: Mapping[str, str] = field(default_factory=dict)
    source_layers: Mapping[str, str] = field(default_factory=dict)
    read: Callable[[DataFrame, int], DataFrame] | None = None  # features of a zoom; none: all
    shown: Callable[[Column, Column, Sequence[int]], Column] = lambda layer, z, zooms: F.lit(True)
    wide: Callable[[Column, Column, Column, Column], Column] = lambda layer, box, queried, z: F.lit(True)
    visible: Callable[[Column], Column] | None = None
    enrich: Callable[[DataFrame], DataFrame] = lambda df: df
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    limit: Callable[[Column, Column], Column] = lambda layer, z: F.lit(NO_LIMIT).cast("long")
    most: Callable[[Sequence[int]], int] = lambda zooms: NO_LIMIT  # no limit of these zooms is greater
    priority: Callable[[Column, Column, Column, Column], Column] = lambda layer, kind, box, z: F.lit(100.0)
    min_size: Callable[[Column, Column, Column], Column] = lambda layer, kind, z: F.lit(0.0)
    tolerance_scale: Callable[[Column, Column, Column], Column] = plain_scale

    def named(self, layer: Column) -> Column:
        """The layer whose rules apply."""
        if not self.aliases:
            return layer
        return F.coalesce(F.create_map(*[F.lit(x) for kv in self.aliases.items() for x in kv])[layer], layer)


def osm_policy(get: Callable[[str], Column] | None = None, style: Mapping | None = None) -> LayerPolicy:
    """The built-in policy of the named layers; properties are looked up in a ``props`` map of texts unless ``get`` says otherwise.

    ``style`` decides which pois are shown (consumer pois are not, unless it says so) and which property values are hidden.
    """
    from ..operators.classify import Tags, poi_category_stored
    from ..operators.pois import PoiRules, hidden_values
    from ..schema import typed

    get = get or (lambda k: F.col("props")[k])
    tags, pois = Tags(get), PoiRules(style)
    hidden = hidden_values(style)

    def shown(layer: Column, z: Column, zooms: Sequence[int]) -> Column:
        out = admitted(layer, get, z, zooms) & ((layer != "pois") | pois.read(tags))
        for name, columns in hidden.items():
            own = F.col("layer") == name
            for column, values in columns.items():
                out = out & ~(own & tags.is_(column, *values))
        return out

    def enrich(df: DataFrame) -> DataFrame:
        category = poi_category_stored(get("poi_category"), tags)
        value = category if dict(df.dtypes)["props"] == "map<string,string>" else typed(text=category)
        other = F.map_filter("props", lambda k, v: k != "poi_category")
        return df.withColumn("props", F.when(F.col("layer") == "pois", F.map_concat(other, F.create_map(F.lit("poi_category"), value))).otherwise(F.col("props")))

    return LayerPolicy(aliases={"aviation": "aip"}, source_layers={"road_labels": "roads", "aip_labels": "aip", "poi_labels": "pois"},
                       shown=shown, wide=wide_enough, limit=layer_limit, most=greatest_limit, min_size=min_size, visible=lambda layer: (layer != "pois") | pois.visible(tags), enrich=enrich,
                       priority=lambda layer, kind, box, z: priority(layer, get, kind, box, z), tolerance_scale=tolerance_scale)
