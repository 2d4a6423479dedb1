"""Layer tables on Parquet, GeoJSON-shaped ingest and GeoPackage geometry blobs."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.arrays import Parts, geometries, to_arrow
from ..schema import BOX, LayerSpec, conform

#: Features of a file, and the folder of the index of tiles inside a layer folder (readers of the folder pass over it).
FILE_ROWS = 500_000
INDEX = "_tiles"
#: Folders of a layer: at most 1 << FOLDER_SIDE squared, so that their number does not grow with the features.
FOLDER_SIDE = 4


def ingest_features(df: DataFrame, spec: LayerSpec, column: str = "feature") -> DataFrame:
    """Features of JSON texts (GeoJSON Feature objects): declared properties, geometry and box.

    Coordinates are read by geometry type; an unknown or missing geometry is null and its row dropped.
    """
    kinds = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
    nested = lambda n: "array<" * n + "double" + ">" * n
    c = F.col(column)
    props = ",".join(f"`{k}`:string" for k in spec.columns)
    base = df.select(F.get_json_object(c, "$.geometry.type").alias("kind"), F.get_json_object(c, "$.geometry.coordinates").alias("xy"),
                     F.get_json_object(c, "$.properties").alias("p"))
    read = {n: F.from_json("xy", nested(n)) for n in (1, 2, 3, 4)}
    pt = lambda a: g.xy(a[0], a[1])
    ring = lambda r: F.transform(r, pt)
    made = F.lit(None).cast(g.GEOMETRY)
    parts = {
        1: lambda: F.array(F.array(F.array(pt(read[1])))), 2: lambda: F.array(F.array(ring(read[2]))),
        3: lambda: F.transform(read[3], lambda line: F.array(ring(line))), 4: lambda: F.transform(read[4], lambda p: F.transform(p, ring)),
    }
    for kind, depth in kinds.items():
        p = F.array(F.transform(read[3], ring)) if kind == "Polygon" else parts[depth]()
        made = F.when(F.col("kind") == kind, F.struct(F.lit(kind).alias("kind"), p.cast(g.PARTS).alias("parts"))).otherwise(made)
    out = base.select(made.alias("geom"), F.from_json("p", f"struct<{props}>").alias("p") if props else F.lit(None).alias("p"))
    out = out.where("geom IS NOT NULL").select("geom", *( [F.col(f"p.`{k}`").alias(k) for k in spec.columns] ))
    out = out.withColumn("_b", g.bbox(F.col("geom"))).select("*", "_b.*").drop("_b")
    return conform(out.withColumn("fid", F.xxhash64("geom", *[F.col(f"`{k}`") for k in spec.columns])), spec)


def _packed(features: DataFrame, rows: int) -> DataFrame:
    """Adds ``tile`` and its ``block``, tiles that are neighbours in both directions: sort-tile-recursive packing of box centres, some ``rows`` features a tile.

    A layer is cut at quantiles of x into as many slices as each slice then is at quantiles of y.  Quantiles are approximate and combined on the map
    side over narrow columns; the cuts of a layer are a few numbers that join back.
    """
    df = features.withColumns({"_cx": (F.col("minx") + F.col("maxx")) / 2, "_cy": (F.col("miny") + F.col("maxy")) / 2})
    sides = F.greatest(F.lit(0), F.ceil(F.log2(F.ceil(F.col("n") / rows)) / 2)).cast("int")
    counts = features.groupBy("layer").agg(F.count("*").alias("n")).select("layer", F.least(F.lit(9), sides).alias("_side")).collect()  # a row a layer
    known = features.sparkSession.createDataFrame([(r[0], r["_side"]) for r in counts], "layer string, _side int")
    cuts = lambda c: F.coalesce(*[F.when(F.first("_side") == k, F.percentile_approx(c, [i / (1 << k) for i in range(1, 1 << k)], 10000)) for k in sorted({r["_side"] for r in counts if r["_side"]})],
                                F.array().cast("array<double>"))
    number = lambda bounds, c: F.size(F.filter(bounds, lambda b: b < F.col(c)))
    df = df.join(known, "layer")
    df = df.join(df.groupBy("layer").agg(cuts("_cx").alias("_xs")), "layer").withColumn("_slice", number("_xs", "_cx")).drop("_xs")
    df = df.join(df.groupBy("layer", "_slice").agg(cuts("_cy").alias("_ys")), ["layer", "_slice"])
    df = df.withColumn("_row", number("_ys", "_cy")).withColumn("_wide", F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.col("_side") - FOLDER_SIDE)))
    block = F.floor(F.col("_slice") / F.col("_wide")) * 512 + F.floor(F.col("_row") / F.col("_wide"))
    return df.withColumns({"tile": F.col("_slice") * 512 + F.col("_row"), "block": block.cast("int")}).drop("_cx", "_cy", "_side", "_slice", "_ys", "_row", "_wide")


def write_layers(features: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """Rows (layer, ..., minx..maxy) as a Parquet folder per layer and block of near tiles, with an index of the tiles' boxes beside them.

    Few tiles are a folder each; of many, neighbours share one, in the order of their numbers, so that Parquet tells them apart by its minima and maxima.

    Rows are dealt by ranges of layer, tile and box, so a crowded place is written by as many tasks as it needs.
    """
    df = _packed(features, rows)
    order = ("layer", "block", "tile", "minx", "miny")
    dealt = df.withColumn("_salt", F.xxhash64(*BOX, *(["fid"] if "fid" in df.columns else []))).repartitionByRange("layer", "block", "tile", "_salt").drop("_salt")
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", max(rows, FILE_ROWS)).partitionBy("layer", "block").parquet(path)
    box = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)]
    index = features.sparkSession.read.parquet(path).groupBy("layer", "block", "tile").agg(F.count("*").alias("features"), *box)
    index.write.mode("overwrite").parquet(f"{path}/{INDEX}")


def layer_index(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(block, tile, features, minx..maxy) of a layer's tiles."""
    return spark.read.parquet(f"{path}/{INDEX}").where(F.col("layer") == layer).drop("layer")


def read_layer(spark: SparkSession, path: str, layer: str, box: Sequence[float] | None = None, most_tiles: int = 10_000) -> DataFrame:
    """A layer's features; with a box only those that overlap it.

    The index names the tiles that the box touches, and only the files of their blocks are opened; where they are more than ``most_tiles``, their
    names are not listed and the box columns' minima and maxima alone let Parquet skip row groups.
    """
    df = spark.read.parquet(path).where(F.col("layer") == layer)
    if box is not None:
        touch = lambda d: d.where((F.col("maxx") >= box[0]) & (F.col("minx") <= box[2]) & (F.col("maxy") >= box[1]) & (F.col("miny") <= box[3]))
        tiles = touch(layer_index(spark, path, layer)).select("block", "tile").limit(most_tiles + 1).collect()
        named = F.col("block").isin(sorted({r["block"] for r in tiles})) & F.col("tile").isin([r["tile"] for r in tiles])
        df = touch(df.where(named) if len(tiles) <= most_tiles else df)
    return df.drop("block", "tile")


def query_layer(spark: SparkSession, path: str, layer: str, boxes: DataFrame) -> DataFrame:
    """(box_fid, fid): every box (fid, minx..maxy) with the layer's features that it overlaps.

    Boxes meet the tiles' boxes first, in the grid; a feature lies in one tile, so features meet the boxes of their tile by an equi join
    and no pair twice.
    """
    from ..operators.query import bbox_overlaps, query_boxes

    tiles = layer_index(spark, path, layer).withColumnRenamed("tile", "fid")
    near = query_boxes(tiles, boxes).withColumnRenamed("fid", "tile").join(
        boxes.select(F.col("fid").alias("box_fid"), *[F.col(c).alias(f"b{c}") for c in BOX]), "box_fid")
    features = spark.read.parquet(path).where(F.col("layer") == layer).select("tile", "fid", *BOX)
    return features.join(near, "tile").where(bbox_overlaps([F.col(c) for c in BOX], [F.col(f"b{c}") for c in BOX])).select("box_fid", "fid")


def describe_layers(spark: SparkSession, path: str, specs: Iterable[LayerSpec]) -> DataFrame:
    """(layer, present, features, srs, geometry kinds, extent) of the declared layers."""
    found = spark.read.parquet(path).groupBy("layer").agg(
        F.count("*").alias("features"), F.array_sort(F.collect_set("geom.kind")).alias("kinds"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    want = spark.createDataFrame([(s.id,) for s in specs], "layer string")
    return want.join(found, "layer", "left").select("layer", F.col("features").isNotNull().alias("present"),
                                                    F.coalesce("features", F.lit(0)).alias("features"), F.lit(4326).alias("srs"), "kinds", *BOX)


# Geometry type codes of well-known binary.
WKB = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
_NAMES = {v: k for k, v in WKB.items()}


def _ring_bytes(pts: np.ndarray) -> bytes:
    return struct.pack("<I", len(pts)) + pts.astype("<f8").tobytes()


def encode_wkb(kind: str, parts: Parts) -> bytes:
    head = struct.pack("<BI", 1, WKB[kind])
    if kind == "Point":
        return head + parts[0][0][:1].astype("<f8").tobytes()
    if kind == "LineString":
        return head + _ring_bytes(parts[0][0])
    if kind == "Polygon":
        return head + struct.pack("<I", len(parts[0])) + b"".join(map(_ring_bytes, parts[0]))
    if kind == "MultiPolygon":
        return head + struct.pack("<I", len(parts)) + b"".join(encode_wkb("Polygon", [p]) for p in parts)
    single = "LineString" if kind == "MultiLineString" else "Point"
    each = [[[r]] for rings in parts for r in rings] if single == "LineString" else [[[r[k:k + 1]]] for rings in parts for r in rings for k in range(len(r))]
    return head + struct.pack("<I", len(each)) + b"".join(encode_wkb(single, e) for e in each)


def decode_wkb(raw: bytes, at: int = 0) -> tuple[str, Parts, int]:
    end = "<" if raw[at] == 1 else ">"
    kind = _NAMES.get(struct.unpack_from(f"{end}I", raw, at + 1)[0])
    if kind is None:
        raise ValueError("unknown geometry type")
    at += 5

    def points(n: int, at: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(raw, f"{end}f8", 2 * n, at).astype(float).reshape(-1, 2), at + 16 * n

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(f"{end}I", raw, at)[0], at + 4

    if kind == "Point":
        pts, at = points(1, at)
        return kind, [[pts]], at
    n, at = count(at)
    if kind == "LineString":
        pts, at = points(n, at)
        return kind, [[pts]], at
    if kind == "Polygon":
        rings = []
        for _ in range(n):
            m, at = count(at)
            pts, at = points(m, at)
            rings.append(pts)
        return kind, [rings], at
    parts: Parts = []
    for _ in range(n):
        _, inner, at = decode_wkb(raw, at)
        parts += inner
    return kind, parts, at


def encode_gpkg(kind: str, parts: Parts, srs: int = 4326) -> bytes:
    """GeoPackage blob: magic, version, flags (little endian, box of four), srs, then well-known binary."""
    pts = np.concatenate([r for rings in parts for r in rings])
    (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
    return b"GP" + struct.pack("<BBi4d", 0, 3, srs, x0, x1, y0, y1) + encode_wkb(kind, parts)


def decode_gpkg(raw: bytes | None) -> tuple[str, Parts] | None:
    """Geometry of a blob; empty is null; a bad magic or envelope code is an error."""
    if raw is None:
        return None
    if raw[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = raw[3]
    size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(flags >> 1 & 7)
    if size is None:
        raise ValueError("bad envelope code")
    if flags & 16:
        return None
    return decode_wkb(raw, 8 + size)[:2]


def geom_to_gpkg(geom: Column) -> Column:
    @F.arrow_udf("binary")
    def run(geom: pa.Array) -> pa.Array:
        return pa.array([encode_gpkg(k, p) if k is not None and any(len(r) for rings in p for r in rings) else None for k, p in geometries(geom)], pa.binary())

    return run(geom)


def geom_from_gpkg(blob: Column) -> Column:
    @F.arrow_udf(g.GEOMETRY)
    def run(raw: pa.Array) -> pa.Array:
        return to_arrow(decode_gpkg(r.as_py()) for r in raw)

    return run(blob)
