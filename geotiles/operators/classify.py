"""Which layers an entity belongs to, from its tags (MAP<STRING,STRING>)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

# Layer names in their order, and the tag values that decide a layer or category.
LAYERS = ("roads", "buildings", "water", "terrain", "coastline", "cliffs", "landuse", "railways", "boundaries", "aip", "pois")
RAILWAY_STOPS = ("station", "halt", "tram_stop", "subway_entrance", "stop")
TRANSPORT_STOPS = ("station", "stop_area")
AIRFIELDS = ("aerodrome", "airport", "heliport", "helipad", "terminal")
POI_KEYS = ("amenity", "tourism", "shop", "leisure", "power", "man_made", "military", "emergency", "office", "government",
            "protect_class", "industrial")
STATIONS = ("railway_station", "train_station", "subway_station", "bus_station", "ferry_terminal")
RESCUE = ("hospital", "police", "fire_station", "shelter")
ALARMS = ("ambulance_station", "siren", "assembly_point", "disaster_response")
OFFICES = ("townhall", "courthouse", "prison", "embassy")
EATING = ("restaurant", "cafe", "bar", "fast_food", "pub")


class Tags:
    """Null-safe tag tests; ``get`` names where a tag is found."""

    def __init__(self, get):
        self.get = get

    def has(self, *keys: str) -> Column:
        out = F.lit(False)
        for k in keys:
            out = out | filled(self.get(k))
        return out

    def is_(self, key: str, *values: str) -> Column:
        return F.coalesce(self.get(key).isin(*values), F.lit(False))


def of_map(tags: str = "tags") -> Tags:
    return Tags(lambda k: F.col(tags)[k])


def is_water(t: Tags) -> Column:
    return t.is_("natural", "water") | t.is_("waterway", "riverbank") | t.is_("landuse", "reservoir")


def is_terrain(t: Tags) -> Column:
    return t.is_("natural", "beach", "sand")


def is_landuse(t: Tags) -> Column:
    return t.has("landuse") | t.is_("leisure", "park") | t.is_("natural", "wood")


def is_poi(t: Tags) -> Column:
    return (t.has(*POI_KEYS) | t.is_("railway", *RAILWAY_STOPS) | t.is_("public_transport", *TRANSPORT_STOPS)
            | t.is_("aeroway", *AIRFIELDS) | t.is_("boundary", "protected_area") | t.is_("landuse", "industrial"))


def _tests(t: Tags) -> dict[str, Column]:
    return {
        "roads": t.has("highway"), "buildings": t.has("building"), "water": is_water(t), "terrain": is_terrain(t),
        "coastline": t.is_("natural", "coastline"), "cliffs": t.is_("natural", "cliff"), "landuse": is_landuse(t),
        "railways": t.has("railway"), "boundaries": t.is_("boundary", "administrative"), "aip": t.has("aeroway"),
        "pois": is_poi(t),
    }


def _classified(df: DataFrame, layers: Iterable[str], tags: str) -> DataFrame:
    tests = _tests(of_map(tags))
    hits = F.array(*[F.when(tests[name], F.lit(name)) for name in layers])
    return df.withColumn("layer", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def classify_ways(ways: DataFrame, selected: Iterable[str] = LAYERS, tags: str = "tags") -> DataFrame:
    """One row per layer of a way."""
    return _classified(ways, [n for n in LAYERS if n in set(selected)], tags)


def classify_relations(rels: DataFrame, selected: Iterable[str] = LAYERS, tags: str = "tags") -> DataFrame:
    """One row per layer of a relation: never roads or railways."""
    return _classified(rels, [n for n in LAYERS if n in set(selected) - {"roads", "railways"}], tags)


def point_features(nodes: DataFrame, box: tuple[float, float, float, float], selected: Iterable[str] = LAYERS,
                   tags: str = "tags") -> DataFrame:
    """Nodes in the box as pois and aip features."""
    t = of_map(tags)
    tests = {"pois": is_poi(t), "aip": t.has("aeroway")}
    hits = F.array(*[F.when(tests[n], F.lit(n)) for n in ("pois", "aip") if n in set(selected)])
    inside = (F.col("lon") >= box[0]) & (F.col("lon") <= box[2]) & (F.col("lat") >= box[1]) & (F.col("lat") <= box[3])
    return nodes.where(inside).withColumn("layer", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def poi_category(t: Tags, radar: bool = True) -> Column:
    """First category of the ladder that applies, else operational."""
    comms = (t.is_("amenity", "communications_tower") | t.is_("man_made", "communications_tower", "mast", "antenna")
             | t.is_("tower:type", "communication"))
    if radar:
        comms = comms | t.has("radar")
    return (F.when(t.is_("amenity", *STATIONS, "airport") | t.is_("railway", "station") | t.is_("public_transport", "station")
                   | t.is_("station", "subway") | t.is_("aeroway", "aerodrome", "airport"), "transport")
            .when(t.is_("amenity", *RESCUE) | t.is_("emergency", *ALARMS), "emergency")
            .when(t.is_("amenity", *OFFICES) | t.is_("office", "government") | t.has("government"), "government")
            .when(t.has("power"), "energy")
            .when(comms, "communications")
            .when(t.is_("boundary", "protected_area") | t.is_("leisure", "nature_reserve") | t.is_("tourism", "national_park")
                  | t.has("protect_class"), "protected")
            .when(t.is_("landuse", "industrial") | t.has("industrial") | t.is_("amenity", "depot", "warehouse"), "industrial")
            .when(t.has("military") | t.is_("amenity", "bunker", "checkpoint"), "military")
            .when(t.has("shop", "tourism", "leisure") | t.is_("amenity", *EATING), "consumer")
            .otherwise("operational"))


def poi_category_stored(stored: Column, t: Tags) -> Column:
    """A non-blank stored category, else the ladder without radar."""
    kept = F.trim(stored)
    return F.when(kept != "", kept).otherwise(poi_category(t, radar=False))


def properties_for(df: DataFrame, columns: Iterable[str], kind: Column, id_col: Column, tags: str = "tags") -> DataFrame:
    """Declared columns only: id as type/id, poi_category by the ladder, others from tags or null."""
    t = of_map(tags)
    made = []
    for c in columns:
        if c == "id":
            made.append(F.concat_ws("/", kind, id_col.cast("string")).alias("id"))
        elif c == "poi_category":
            made.append(F.when(F.col("layer") == "pois", poi_category(t)).alias(c))
        else:
            made.append(F.col(tags)[c].alias(c))
    return df.select(*made)
