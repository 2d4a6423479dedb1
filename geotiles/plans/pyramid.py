"""Tile pyramids: features to encoded tiles in one grouped job per zoom range.

Order of work: keys first (tiles of every feature box), then limits on slim rows
without geometry, then geometry joined back for the survivors only, simplified,
clipped and quantised in Arrow batches, and encoded per tile.
"""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import policy as pol
from ..functions import tilemath as tm
from ..functions.arrays import to_arrow
from ..schema import typed
from ..sources.scratch import settled
from . import shaping

#: Layers whose features carry their label anchor.
ANCHORED = ("roads", "pois", "aip")
#: Tasks that share the ranking of one layer in one tile.
SALTS = 16
BOX = ("minx", "miny", "maxx", "maxy")


def assign_tiles(features: DataFrame, z: int | Column) -> DataFrame:
    """One row per feature and tile whose buffered box it touches: adds z, x, y, tile, qbox."""
    zc = F.lit(z) if isinstance(z, int) else z
    r = tm.buffered_range(*[F.col(c) for c in BOX], zc)
    df = features.withColumn("z", zc.cast("int")).withColumn("_r", r)
    # rows of tiles first: their edges take trigonometry, those of columns do not
    rows = df.withColumn("y", F.explode(F.sequence("_r.min_y", "_r.max_y"))).withColumn("_q", tm.tile_bbox(F.col("z"), F.lit(0), F.col("y"), tm.BUFFER))
    rows = rows.withColumns({"_y0": F.col("_q.miny"), "_y1": F.col("_q.maxy")}).drop("_q").where("maxy >= _y0 AND miny <= _y1")
    df = rows.withColumn("x", F.explode(F.sequence("_r.min_x", "_r.max_x"))).withColumn("_q", tm.tile_bbox(F.col("z"), F.col("x"), F.lit(0), tm.BUFFER))
    qbox = F.struct(F.col("_q.minx").alias("minx"), F.col("_y0").alias("miny"), F.col("_q.maxx").alias("maxx"), F.col("_y1").alias("maxy"))
    df = df.withColumn("qbox", qbox).drop("_r", "_q", "_y0", "_y1")
    return df.where((F.col("maxx") >= F.col("qbox.minx")) & (F.col("minx") <= F.col("qbox.maxx")))


def top_per_layer(df: DataFrame, limit: Column, priority: str = "priority", order: str = "fid", most: int | None = None) -> DataFrame:
    """Best features of each (tile, layer) by priority, ties by order.

    ``most`` is a literal upper bound of the limit.  With it rows are cut twice, first inside (tile, layer, salt): a tile that
    holds a planet of features is ranked by ``SALTS`` tasks, of which at most ``most`` rows each go on.  The salt is the task that made the
    rows, so that Spark's cut before the shuffle leaves ``most`` rows of a tile and layer in each.
    """
    tile = ["z", "x", "y", "layer"]
    best = [F.desc(priority), order]
    if most:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        first = F.row_number().over(Window.partitionBy(*tile, "_salt").orderBy(*best))
        df = salted.withColumn("_n", first).where(F.col("_n") <= most).drop("_n", "_salt")
    place = F.row_number().over(Window.partitionBy(*tile).orderBy(*best))
    return df.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


def top_per_tile(df: DataFrame, budget: Column, priority: str = "priority", layer_order: str = "layer_order", order: str = "fid",
                 most: int | None = None) -> DataFrame:
    """Best features of each tile over all layers: priority, then layer order, then order.

    Rows come from ``top_per_layer``, so a tile has a bounded number; ``most`` is a literal upper bound of the budget.
    """
    place = F.row_number().over(Window.partitionBy("z", "x", "y").orderBy(F.desc(priority), layer_order, order))
    ranked = df.withColumn("_n", place)
    return ranked.where((F.col("_n") <= most) & (F.col("_n") <= budget) if most else F.col("_n") <= budget).drop("_n")


def simplify_line(p: np.ndarray, tol: float, closed: bool) -> np.ndarray:
    """One line or ring, simplified as ``shaping.simplified`` does it."""
    rings = shaping.Rings(p, np.array([0, len(p)]), np.zeros(1, np.int64), np.zeros(1, np.int64))
    return shaping.simplified(rings, np.array([shaping.AREA if closed else shaping.LINE]), np.array([tol])).xy


def to_tile(p: np.ndarray, z, x, y) -> np.ndarray:
    """Degrees to tile units (not rounded); the tile may be one for all points, or one for each."""
    n = np.exp2(np.asarray(z, float))
    s = np.sin(np.radians(np.minimum(89.9999, np.maximum(-89.9999, p[:, 1]))))
    out = np.empty_like(p)
    out[:, 0] = ((p[:, 0] + 180) / 360 * n - x) * tm.EXTENT
    out[:, 1] = (np.minimum(1.0, np.maximum(0.0, 0.5 - 0.25 * np.log((1 + s) / (1 - s)) / np.pi)) * n - y) * tm.EXTENT
    return out


def clip_to_tile(kind: str, parts: list[list[np.ndarray]], z: int, x: int, y: int) -> list[list[np.ndarray]]:
    """Parts in whole tile units inside the buffered tile; empty if nothing is left."""
    rings, kinds = shaping.read(to_arrow([(kind, [[to_tile(r, z, x, y) for r in rings] for rings in parts])]))
    left = shaping.clipped(rings, kinds, *SQUARE)
    return [[left.xy[left.at[r]:left.at[r + 1]] for r in np.flatnonzero(left.part == part)] for part in np.unique(left.part)]


#: The buffered tile, and the points that make a shape of each kind.
SQUARE = (-float(tm.BUFFER), float(tm.EXTENT + tm.BUFFER))
LEAST = np.array([1, 2, 4])
_SHAPE = "tile_shape binary, plain_shape binary, vertices int, simplified int, unusable boolean"


def shape_features(df: DataFrame) -> DataFrame:
    """Adds the simplified and the plain shape, as tile geometry commands, to rows (geom, small, tol, z, x, y, ...); empty if nothing is left."""
    names = [f.name for f in df.schema.fields if f.name != "geom"]
    schema = df.select(*names).schema
    from pyspark.sql.types import StructType

    for f in StructType.fromDDL(_SHAPE).fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            n = b.num_rows
            small = cols["small"].to_numpy(zero_copy_only=False)
            tol, z, x, y = (cols[c].to_numpy(zero_copy_only=False) for c in ("tol", "z", "x", "y"))
            rings, kinds = shaping.read(cols["geom"])
            of_point = np.repeat(rings.geom, rings.size)
            total = lambda some: np.bincount(some.geom, weights=some.size, minlength=n).astype(np.int32)
            units = dataclasses.replace(rings, xy=to_tile(rings.xy, z[of_point], x[of_point], y[of_point]))
            large = ~small[rings.geom]
            kept = shaping.simplified(rings.only(large), kinds, tol, units.only(large))
            usable = np.zeros(n, bool)
            usable[kept.geom[kept.size >= LEAST[kinds[kept.geom]]]] = True
            kept = kept.only(usable[kept.geom])
            made = shaping.commands(shaping.clipped(kept, kinds, *SQUARE), kinds)
            # only a layer without any shape in the tile falls back, so only lost features need their plain one
            lost = np.array([not m for m in made], bool)
            plain = shaping.commands(shaping.clipped(units.only(lost[units.geom]), kinds, *SQUARE), kinds)
            yield pa.RecordBatch.from_arrays(
                [*(cols[c] for c in names), pa.array(made, pa.binary()), pa.array(plain, pa.binary()), pa.array(total(rings)),
                 pa.array(total(kept)), pa.array(~small & ~usable)], [*names, "tile_shape", "plain_shape", "vertices", "simplified", "unusable"])

    return df.mapInArrow(run, schema)


def with_fallback(df: DataFrame) -> DataFrame:
    """A layer whose features all vanished in a tile gets their plain shapes back; still counted as dropped."""
    some = F.max(F.length("tile_shape") > 0).over(Window.partitionBy("z", "x", "y", "layer"))
    return df.withColumn("shape", F.when(some, F.col("tile_shape")).otherwise(F.col("plain_shape")))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _value(v) -> bytes:
    """A tile value: text, double, whole number (unsigned, or signed if negative) or flag, as its type says."""
    if isinstance(v, dict):
        v = next((v[k] for k in ("flag", "whole", "real", "text") if v.get(k) is not None), "")
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(5 << 3) + _varint(v) if v >= 0 else _varint(6 << 3) + _varint((v << 1 ^ v >> 63) & (1 << 64) - 1)
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def encode_layer(name: str, features: list[tuple[int, str, bytes, dict]]) -> bytes:
    """One layer of (fid, kind, commands, props), vector tile version 2; a negative fid has no id in the tile."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = [_varint(15 << 3) + _varint(2), _field(1, name.encode())]
    for fid, kind, made, props in features:
        shape = 1 if kind == "Point" else 2 if kind in ("LineString", "MultiLineString") else 3
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault(_value(v), len(values)))
                        for k, v in sorted((props or {}).items()) if v is not None)
        own = _varint(1 << 3) + _varint(fid) if fid >= 0 else b""
        body.append(_field(2, own + _field(2, tags) + _varint(3 << 3) + _varint(shape) + _field(4, made)))
    body += [_field(3, k.encode()) for k in keys]
    body += [_field(4, v) for v in values]
    body.append(_varint(5 << 3) + _varint(tm.EXTENT))
    return b"".join(body)


def encode_tiles(df: DataFrame) -> DataFrame:
    """(z, x, y, payload): gzip vector tiles of rows (z, x, y, layer, layer_order, fid, kind, shape, props).

    A tile's features are bounded by the tile budget, so one group is one tile.
    """
    import gzip

    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["layer_order", "fid"], kind="stable")
        layers = []
        for name, rows in pdf.groupby("layer", sort=False):
            feats = [(int(f), k, made, dict(pr) if pr is not None else {})
                     for f, k, made, pr in zip(rows["fid"], rows["kind"], rows["shape"], rows["props"])]
            layers.append(_field(3, encode_layer(str(name), feats)))
        first = pdf.iloc[0]
        return pd.DataFrame({"z": [first["z"]], "x": [first["x"]], "y": [first["y"]], "payload": [gzip.compress(b"".join(layers), 1, mtime=0)]})

    full = df.where(F.length("shape") > 0).select("z", "x", "y", "layer", "layer_order", "fid", "kind", "shape", "props")
    return full.groupBy("z", "x", "y").applyInPandas(run, "z int, x long, y long, payload binary")


def cut_early(spark: SparkSession, most: int) -> None:
    """Lets Spark cut rankings of up to ``most`` rows a group before their shuffle (it does so up to 1 000), so that a task sends a bounded number of rows a tile."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, str(max(most, int(spark.conf.get(key)))))


def limited(keys: DataFrame, policy: pol.LayerPolicy, zooms: Sequence[int], max_features: int | None = None) -> DataFrame:
    """Tile rows (z, x, y, layer, layer_order, fid, kind, box columns, props, priority) cut to layer limits, then to the tile budget.

    A feature with as many of its own layer before it as a tile may hold never survives, so the budget also bounds a layer.
    """
    most = pol.greatest_budget(zooms, max_features)
    first = min(most, policy.most(zooms))
    cut_early(keys.sparkSession, most)
    name = policy.named(F.col("layer"))
    cut = top_per_layer(keys, policy.limit(name, F.col("z")), most=first)
    return top_per_tile(cut, pol.tile_budget(F.col("z"), max_features), most=most)


def label_rows(keys: DataFrame, policy: pol.LayerPolicy, labels: Sequence[str], get: Callable[[str], Column]) -> DataFrame | None:
    """Candidates of label layers in the tiles that their source features touch, with their texts as props and their limit."""
    from ..operators import labels as lab

    made = []
    for at, label in enumerate(labels):
        source = policy.source_layers[label]
        from_ = keys.where((policy.named(F.col("layer")) == source) & (F.col("z") >= lab.LAYER_START.get(label, 0)))
        c = lab.label_candidates(from_.withColumn("source", F.col("layer")), label, F.col("z"), get)
        texts = {"text": F.col("text"), "class": F.col("class"), "sourceLayer": F.col("source"), "sourceId": F.col("fid").cast("string")}
        numbers = {"priority": F.col("priority"), "minZoom": F.col("min_zoom")}
        pairs = [x for k, v in texts.items() for x in (F.lit(k), typed(text=v))] + [x for k, v in numbers.items() for x in (F.lit(k), typed(whole=v))]
        c = c.withColumns({"props": F.create_map(*pairs), "kind": F.lit("Point"), "layer_order": F.lit(1000 + at), "priority": F.col("priority").cast("double")})
        made.append(c.withColumn("layer", F.lit(label)).withColumn("label_limit", lab.label_limit(label, F.col("z"))).select(
            "z", "x", "y", "layer", "layer_order", "fid", "kind", *BOX, "props", "source", "priority", "label_limit"))
    return reduce(DataFrame.unionByName, made) if made else None


def _typed_props(props: Column, dtype: str) -> Column:
    return F.transform_values(props, lambda k, v: typed(text=v)) if dtype == "map<string,string>" else props


def tile_rows(features: DataFrame, zooms: Sequence[int], policy: pol.LayerPolicy) -> DataFrame:
    """(z, x, y, layer, layer_order, fid, kind, box, props, priority, seen) of every feature a tile reads: zoom windows, layer rules, buffered box.

    What a policy says of a feature at a zoom (properties, priority, visibility) is asked once, before its tiles are known.
    """
    have = features.columns
    windows = [c for c in ("first_zoom", "last_zoom") if c in have]
    slim = features.select("layer", "layer_order", "fid", *BOX, F.col("geom.kind").alias("kind"), "props", *windows)
    # a feature is many rows from here on: dealt out evenly, however few files hold the features
    slim = slim.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("layer", "fid"))
    name = policy.named(F.col("layer"))

    def tiles(df: DataFrame) -> DataFrame:
        df = policy.enrich(df.withColumn("seen", F.lit(True) if policy.visible is None else policy.visible(name)))
        return assign_tiles(df.withColumn("priority", policy.priority(name, F.col("kind"), F.struct(*BOX), F.col("z"))), F.col("z"))

    if policy.read is None:  # one pass over the features for all zooms
        every = slim.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).where(policy.shown(name, F.col("z"), zooms))
        if "first_zoom" in windows:
            every = every.where(F.col("first_zoom").isNull() | (F.col("first_zoom") <= F.col("z")))
        if "last_zoom" in windows:
            every = every.where(F.col("last_zoom").isNull() | (F.col("last_zoom") >= F.col("z")))
        keys = tiles(every)
    else:
        keys = reduce(DataFrame.unionByName, [tiles(policy.read(slim, z).withColumn("z", F.lit(z))) for z in zooms])
    return keys.where(policy.wide(name, F.struct(*BOX), F.col("qbox"), F.col("z"))).drop("qbox", *windows)


def tile_pyramid(features: DataFrame, zmin: int, zmax: int, policy: pol.LayerPolicy | None = None, max_features: int | None = None,
                 detail: str | None = None, labels: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(tiles, stats) of features (layer, layer_order, fid, geom, minx..maxy, props), optionally with first_zoom, last_zoom.

    ``tiles`` has (z, x, y, payload); ``stats`` one row per touched tile.  ``labels`` names derived
    label layers; their points are the anchors of the features they read.  The features are settled once:
    keys are planned from their narrow columns, geometry is read for survivors.
    """
    policy = policy or pol.LayerPolicy()
    features = policy.prepare(features)
    if labels and "anchor" not in features.columns:
        from ..operators.labels import with_anchors

        features = with_anchors(features)
    if not getattr(features, "settled", False):
        features = settled(features, "tile-features")
    zooms = range(zmin, zmax + 1)
    keys = tile_rows(features, zooms, policy)
    dtype = dict(features.dtypes)["props"]
    # a tile counts what it has read, and goes on with what is visible of it
    read = keys
    keys = keys.where("seen").drop("seen")
    kept = limited(keys, policy, zooms, max_features).withColumns({"source": F.col("layer"), "props": _typed_props(F.col("props"), dtype)})
    counted = read.select("z", "x", "y")
    text_of = (lambda k: F.col("props")[k]) if dtype == "map<string,string>" else (lambda k: F.col("props")[k]["text"])
    said = label_rows(keys, policy, labels, text_of)
    if said is not None:
        counted = counted.unionByName(said.select("z", "x", "y"))
        most = max(n for t in pol.LABEL_LIMITS.values() for _, n in t)
        best = top_per_layer(said, F.col("label_limit"), most=most).drop("label_limit")
        # the tile budget holds over all layers, label layers last
        kept = top_per_tile(kept.unionByName(best), pol.tile_budget(F.col("z"), max_features), most=pol.greatest_budget(zooms, max_features))
    original = counted.groupBy("z", "x", "y").agg(F.count("*").alias("original"))
    tile = tm.tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    kept = kept.withColumn("_t", tile)
    name = policy.named(F.col("layer"))
    small = pol.is_small(F.struct(*BOX), F.col("_t"), policy.min_size(name, F.col("kind"), F.col("z")))
    span = F.greatest(F.abs(F.col("_t.maxx") - F.col("_t.minx")), F.abs(F.col("_t.maxy") - F.col("_t.miny")))
    how = F.lit(detail) if detail else tm.detail_for_zoom(F.col("z"))
    tol = span / tm.EXTENT * pol.tolerance(name, F.col("kind"), F.col("z"), how, policy.tolerance_scale)
    # written, so that Spark knows how few they are: then they go to the geometry, not all geometry to them
    ready = settled(kept.withColumns({"small": small, "tol": tol}).drop("_t", *BOX, "priority"), "tile-survivors")
    shapes = features.select(F.col("layer").alias("source"), "fid", "geom", *(["anchor"] if "anchor" in features.columns else []))
    met = ready.join(shapes, ["source", "fid"])
    if "anchor" in features.columns:
        at = F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array("anchor"))).cast(g.PARTS).alias("parts"))
        is_label = F.col("layer") != F.col("source")
        met = met.where(~is_label | F.col("anchor").isNotNull()).withColumn("geom", F.when(is_label, at).otherwise(F.col("geom")))
        # anchors lie on the unclipped feature, so they are the same in every tile and zoom
        place = F.map_from_entries(F.array(*[F.struct(F.lit(k), typed(real=F.col(f"anchor.{v}"))) for k, v in (("label_lon", "x"), ("label_lat", "y"))]))
        anchored = ~is_label & policy.named(F.col("layer")).isin(*ANCHORED) & F.col("anchor").isNotNull()
        met = met.withColumn("props", F.when(anchored, F.map_concat("props", place)).otherwise(F.col("props"))).drop("anchor")
    # shaping is the costly part: deal features out evenly, whatever the size of their bytes
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shaped = with_fallback(shape_features(met.drop("source").repartition(tasks, "layer", "fid", "z", "x", "y")))
    return encode_tiles(shaped), tile_stats(original, shaped)


def tile_stats(original: DataFrame, shaped: DataFrame) -> DataFrame:
    """(z, x, y, original, encoded, dropped, dropped_small, vertices, simplified, tolerance, empty_reason)."""
    per = shaped.groupBy("z", "x", "y").agg(
        F.count("*").alias("kept"), F.count_if(F.length("shape") > 0).alias("encoded"), F.count_if(F.col("small") | F.col("unusable")).alias("dropped_small"),
        F.sum("vertices").alias("vertices"), F.sum("simplified").alias("simplified"), F.max(F.when(~F.col("small"), F.col("tol"))).alias("tolerance"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = original.join(per, ["z", "x", "y"], "left")
    dropped = F.col("original") - zero("kept") + zero("dropped_small")
    df = df.select("z", "x", "y", "original", zero("encoded").alias("encoded"), dropped.alias("dropped"), zero("dropped_small").alias("dropped_small"),
                   zero("vertices").alias("vertices"), zero("simplified").alias("simplified"), F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"))
    return df.withColumn("empty_reason", empty_reason())


def empty_reason() -> Column:
    return (F.when(F.col("encoded") > 0, "none").when(F.col("original") == 0, "no_features").when(F.col("dropped") > 0, "filtered").otherwise("no_tile_geometry"))


