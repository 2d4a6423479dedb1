"""Which pois a style shows, as predicates over their tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import Tags, poi_category_stored

# Categories shown unless a style says otherwise, and the classes each admits by default.
SHOWN = ("transport", "emergency", "government", "energy", "communications", "protected", "industrial", "military", "operational")
CLASSES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "transport": (("amenity", ("bus_station", "ferry_terminal", "airport", "railway_station", "train_station", "subway_station")),
                  ("railway", ("station",)), ("public_transport", ("station",)), ("station", ("subway",)), ("aeroway", ("aerodrome", "airport"))),
    "emergency": (("amenity", ("hospital", "police", "fire_station", "shelter")),
                  ("emergency", ("ambulance_station", "siren", "assembly_point", "disaster_response"))),
    "government": (("amenity", ("townhall", "courthouse", "prison", "embassy", "research_institute")), ("office", ("government",)),
                   ("government", ("yes", "public_safety", "border_control", "customs", "ministry", "aerospace"))),
    "energy": (("power", ("plant", "substation", "generator", "tower", "transformer", "line")),),
    "communications": (("amenity", ("communications_tower",)), ("man_made", ("communications_tower", "mast", "antenna")), ("tower:type", ("communication",))),
    "protected": (("boundary", ("protected_area",)), ("leisure", ("nature_reserve",)), ("tourism", ("national_park",))),
    "industrial": (("landuse", ("industrial",)), ("industrial", ("refinery", "depot", "storage", "logistics")), ("amenity", ("depot", "warehouse"))),
    "military": (("amenity", ("bunker", "checkpoint")), ("military", ("barracks", "bunker", "checkpoint", "airbase", "naval_base", "range", "training_area",
                                                                     "base", "airfield", "danger_area", "ammunition_dump"))),
}


def category_visibility(*rules: Mapping[str, bool] | None) -> dict[str, bool]:
    """Category -> shown; later rules win, consumer is off by default."""
    seen = {c: True for c in SHOWN} | {"consumer": False}
    for rule in rules:
        seen |= {k: v is True for k, v in (rule or {}).items()}
    return seen


class PoiRules:
    """Shown categories and admitted classes of a style (``layers.pois`` and ``labels.pois``), or as given."""

    def __init__(self, style: Mapping | None = None, visibility: Mapping[str, bool] | None = None, classes: Mapping[str, Sequence[str]] | None = None):
        rules = [((style or {}).get(part) or {}).get("pois") or {} for part in ("layers", "labels")]
        self.seen = category_visibility(*[r.get("categories") for r in rules], visibility)
        own = classes if classes is not None else next((r["classes"] for r in rules if isinstance(r.get("classes"), Mapping)), None)
        if own is not None:
            self.pairs = [(c, tuple(str(v) for v in vs if str(v))) for c, vs in own.items() if c != "poi_category" and isinstance(vs, (list, tuple))]
        else:
            self.pairs = [p for c, on in self.seen.items() if on for p in CLASSES.get(c, ())]

    def _classed(self, tags: Tags) -> Column:
        out = F.lit(False)
        for column, values in self.pairs:
            out = out | tags.is_(column, *values) if values else out
        return out

    def read(self, tags: Tags) -> Column:
        """What a tile reads and counts: a stored category that is shown by itself, or an admitted class; all if consumer pois are shown."""
        if self.seen["consumer"]:
            return F.lit(True)
        direct = [c for c, on in self.seen.items() if on and c not in ("operational", "consumer")]
        return (tags.is_("poi_category", *direct) if direct else F.lit(False)) | self._classed(tags)

    def visible(self, tags: Tags) -> Column:
        """What of that is shown: category and class."""
        on = [c for c, v in self.seen.items() if v]
        return poi_category_stored(tags.get("poi_category"), tags).isin(*on) & self._classed(tags) if on else F.lit(False)


def hidden_values(style: Mapping | None) -> dict[str, dict[str, list[str]]]:
    """Layer -> column -> values that a style's ``byProperty`` hides; the rules of aip and aviation stand for each other."""
    out: dict[str, dict[str, list[str]]] = {}
    for layer, rule in ((style or {}).get("layers") or {}).items():
        for column, values in ((rule or {}).get("byProperty") or {}).items():
            for value, how in (values or {}).items() if isinstance(values, Mapping) else ():
                if isinstance(how, Mapping):
                    shown = (how.get("visibility") or {}).get("visible") if isinstance(how.get("visibility"), Mapping) else None
                    if (how.get("visible") if shown is None else shown) is False:
                        out.setdefault(layer, {}).setdefault(column, []).append(str(value))
    layers = (style or {}).get("layers") or {}
    for one, other in (("aip", "aviation"), ("aviation", "aip")):
        if one in out and other not in layers:
            out[other] = out[one]
    return out
