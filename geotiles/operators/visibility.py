"""What a style shows: poi categories and classes, draw order, attributes of 3D content."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import building_height, filled
from ..schema import LayerSpec
from .classify import Tags
from .labels import with_anchors
from .pois import PoiRules
from .query import effective_zoom
from .space import mesh_policy, quadtree

def visible_pois(df: DataFrame, tags: Tags, visibility: Mapping[str, bool] | None = None, classes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Pois of a shown category that one of the admitted classes names (the style's classes, else the defaults)."""
    return df.where(PoiRules(visibility=visibility, classes=classes).visible(tags))


def draw_order(layers: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Adds ``place``: position in the style's list (999 if missing); order by it, then by the rule's order, then by position."""
    at = F.array_position(F.array(*map(F.lit, listed)).cast("array<string>"), F.col("id"))
    return layers.withColumn("place", F.when(at > 0, at - 1).otherwise(999)).orderBy("place", F.coalesce("rule_order", F.lit(0)), "ord")


# Properties that give a feature a label in 3D.
NAMES = ("name", "ref", "iata", "icao", "operator", "official_name", "short_name")


def attributes_3d(features: DataFrame, bounds: tuple[float, float, float, float] | None, layer: tuple, rule: tuple, max_features: int = 1500,
                  specs: Iterable[LayerSpec] = ()) -> DataFrame:
    """Attribute rows of 3D content: height, strategy, width, zoom window, label anchor and leaf of features
    (fid, layer, box, height, levels, first_zoom, last_zoom, geom and names if there are any).

    Each layer has a quadtree of its own (over its extent if no bounds are given); a feature without any name has no label anchor.
    """
    specs = list(specs)
    df = effective_zoom(features, layer, rule, (F.col("first_zoom"), F.col("last_zoom")))
    extruded = mesh_policy(F.col("layer"), "strategy", specs) == "extruded"
    tall = F.when(extruded, building_height(F.col("height"), F.col("levels"))).otherwise(mesh_policy(F.col("layer"), "height", specs))
    df = df.withColumns({"height_m": tall, "strategy": mesh_policy(F.col("layer"), "strategy", specs), "width_m": mesh_policy(F.col("layer"), "width_m", specs)})
    extra = []
    if "geom" in features.columns:
        named = reduce(lambda a, b: a | b, [filled(F.col(c).cast("string")) for c in NAMES if c in features.columns], F.lit(False))
        df = with_anchors(df).withColumns({"label_lon": F.when(named, F.col("anchor.x")), "label_lat": F.when(named, F.col("anchor.y"))})
        extra = ["label_lon", "label_lat"]
    leaves = quadtree(features, bounds, max_features, by=("layer",))
    return df.join(leaves, ["layer", "fid"]).select(
        "fid", "layer", "height_m", "strategy", "width_m", "eff_min", "eff_max", *extra, "depth", "i", "j", "batch")
