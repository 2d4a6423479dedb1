"""Layer specifications: validated, then used as Spark schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.geometry import GEOMETRY

_TYPES = {"TEXT": T.StringType(), "INTEGER": T.LongType(), "REAL": T.DoubleType(), "BOOLEAN": T.BooleanType()}
KINDS = ("GEOMETRY", "POINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON")
BOX = ("minx", "miny", "maxx", "maxy")


@dataclass(frozen=True)
class LayerSpec:
    """A declared layer: columns by name and type, zoom window, optional zoom columns of its features."""

    id: str
    table: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    min_zoom: int | None = None
    max_zoom: int | None = None
    geometry: str = "GEOMETRY"
    source: str | None = None
    feature_zoom: tuple[str | None, str | None] = (None, None)
    tile_properties: tuple[str, ...] | None = None
    #: Overrides of how the layer becomes 3D content: strategy, height, width_m.
    tiles3d: Mapping[str, str | float] | None = None

    def schema(self) -> T.StructType:
        geometry = T.StructType.fromDDL(f"geom {GEOMETRY}").fields
        return T.StructType([T.StructField("fid", T.LongType()), *geometry,
                             *[T.StructField(c, T.DoubleType()) for c in BOX],
                             *[T.StructField(c, _TYPES[k]) for c, k in self.columns.items()]])


#: Strategies of 3D content, and those of the known layers with heights and widths in metres; others are mixed.
STRATEGIES = ("extruded", "surface", "line", "points", "mixed")
MESH_DEFAULT = {"strategy": "mixed", "height": 6.0, "width_m": 6.0}
MESH = {
    "buildings": {"strategy": "extruded", "height": 0.0},
    "landuse": {"strategy": "surface", "height": 3.0},
    "water": {"strategy": "mixed", "height": 5.0},
    "roads": {"strategy": "line", "height": 10.0, "width_m": 6.0},
    "railways": {"strategy": "line", "height": 11.0, "width_m": 3.0},
    "boundaries": {"strategy": "line", "height": 12.0, "width_m": 20.0},
    "terrain": {"strategy": "line", "height": 6.0, "width_m": 3.0},
    "coastline": {"strategy": "line", "height": 7.0, "width_m": 3.0},
    "cliffs": {"strategy": "line", "height": 8.0, "width_m": 3.0},
    "pois": {"strategy": "points", "height": 12.0},
    "aip": {"strategy": "mixed", "height": 9.0, "width_m": 14.0},
}


def mesh_rule(layer: str, override: Mapping[str, str | float] | None = None) -> dict[str, str | float]:
    """strategy, height and width_m of a layer's 3D content; ``aviation`` is ``aip``, an override goes before both."""
    if unknown := set(override or ()) - set(MESH_DEFAULT):
        raise ValueError(f"layer {layer}: unknown 3D settings {sorted(unknown)}")
    rule = MESH_DEFAULT | MESH.get("aip" if layer == "aviation" else layer, {}) | dict(override or {})
    if rule["strategy"] not in STRATEGIES:
        raise ValueError(f"layer {layer}: unknown 3D strategy {rule['strategy']}")
    for key in ("height", "width_m"):
        value = rule[key]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
            raise ValueError(f"layer {layer}: 3D {key} must be a number of zero or more")
    return rule


def resolve_layers(specs: Iterable[str | Mapping | LayerSpec]) -> list[LayerSpec]:
    """Specs from names or mappings; ids unique, table defaults to the id, zooms ordered, zoom columns declared integers."""
    out: list[LayerSpec] = []
    for s in specs:
        spec = s if isinstance(s, LayerSpec) else LayerSpec(id=s) if isinstance(s, str) else LayerSpec(**s)
        if not isinstance(spec.id, str) or not spec.id.strip():
            raise ValueError("a layer needs an id")
        if any(o.id == spec.id for o in out):
            raise ValueError(f"layer {spec.id} is declared twice")
        spec = LayerSpec(**{**spec.__dict__, "table": spec.table or spec.id})
        if spec.geometry.upper() not in KINDS:
            raise ValueError(f"layer {spec.id}: unknown geometry type {spec.geometry}")
        if unknown := [k for k in spec.columns.values() if k not in _TYPES]:
            raise ValueError(f"layer {spec.id}: unknown column types {unknown}")
        lo, hi = spec.min_zoom, spec.max_zoom
        if lo is not None and hi is not None and lo > hi:
            raise ValueError(f"layer {spec.id}: min_zoom is above max_zoom")
        for c in spec.feature_zoom:
            if c is not None and spec.columns.get(c) != "INTEGER":
                raise ValueError(f"layer {spec.id}: zoom column {c} must be a declared INTEGER")
        mesh_rule(spec.id, spec.tiles3d)
        out.append(spec)
    return out


def resolve_source(layers: Iterable[LayerSpec], wanted: str, aliases: Mapping[str, str] | None = None,
                   sources: Mapping[str, str] | None = None, z: int | None = None) -> LayerSpec | None:
    """The layer that answers for an id: its policy's source layer or itself, else an alias of that.

    At a zoom, both the layer asked for (if declared) and the one that answers must be open.
    """
    by_id = {s.id: s for s in layers}
    asked = by_id.get(wanted)
    name = (sources or {}).get(wanted) or (asked.source if asked and asked.source else wanted)
    found = by_id.get(name) or by_id.get((aliases or {}).get(name, ""))
    shut = lambda s: z is not None and not (s.min_zoom if s.min_zoom is not None else 0) <= z <= (s.max_zoom if s.max_zoom is not None else 24)
    if found is None or shut(found) or asked is not None and shut(asked):
        return None
    return found


def conform(df: DataFrame, spec: LayerSpec) -> DataFrame:
    """Declared columns only, cast; missing ones null; undeclared ones dropped."""
    have = set(df.columns)
    cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in spec.schema().fields]
    return df.select(*cols)


#: A property value of a tile: one of these is set.
VALUE = {"text": "string", "whole": "bigint", "real": "double", "flag": "boolean"}


def typed(**value: Column) -> Column:
    """A typed value from one of text, whole, real, flag; null if that is null."""
    (name, col), = value.items()
    made = F.struct(*[(col if k == name else F.lit(None)).cast(t).alias(k) for k, t in VALUE.items()])
    return F.when(col.isNotNull(), made)


def project_tile_props(df: DataFrame, spec: LayerSpec) -> DataFrame:
    """Properties of a tile feature as typed values: the chosen keys, id, geometry type and zoom columns; nulls are left out."""
    chosen = spec.tile_properties if spec.tile_properties is not None else tuple(spec.columns)
    kinds = dict(df.dtypes)
    keys = [k for k in dict.fromkeys([*chosen, "id", *[c for c in spec.feature_zoom if c]]) if k in kinds]
    of = {"boolean": "flag", "double": "real", "float": "real", "bigint": "whole", "int": "whole", "smallint": "whole", "tinyint": "whole"}
    pairs = [x for k in keys for x in (F.lit(k), typed(**{of.get(kinds[k], "text"): F.col(f"`{k}`")}))]
    props = F.map_filter(F.create_map(*pairs, F.lit("geometry_type"), typed(text=F.col("geom.kind"))), lambda k, v: v.isNotNull())
    return df.withColumn("props", props)
