"""Quadtree partitions, tile hierarchies and regions for 3D delivery."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tilemath import tile_bbox
from ..schema import MESH, MESH_DEFAULT, LayerSpec, mesh_rule
from ..sources.scratch import running_totals, settled

COARSE_ERROR = 2 * math.pi * 6378137 / 256


def mesh_policy(layer: Column, what: str, specs: Iterable[LayerSpec] = ()) -> Column:
    """strategy, height or width_m of a layer, as its spec, the known layers or the default say."""
    rules = {k: mesh_rule(k) for k in (*MESH, "aviation")} | {s.id: mesh_rule(s.id, s.tiles3d) for s in specs}
    kinds = F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k, v[what] if what == "strategy" else float(v[what]))])
    return F.coalesce(kinds[layer], F.lit(MESH_DEFAULT[what]))


def quadtree(features: DataFrame, bounds: tuple[float, float, float, float] | None, max_features: int = 1500, max_depth: int = 8,
             by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, fid, depth, i, j, batch): the leaf of each feature by its box centre, half-open, and its batch there.

    Counts of all depths come from one combined aggregate over exploded prefixes; a leaf is the shallowest
    cell of at most ``max_features`` or the deepest.  A leaf that fits is one batch; only the rows of fuller (deepest) ones are ranked, in
    fid order and by running totals, so that a crowd is dealt to many tasks.  Every ``by`` has a tree of its own; without bounds
    its root is its extent.
    """
    cells = 1 << max_depth
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    if bounds is None and not by:
        bounds = tuple(features.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first())
    if bounds is None:
        pick = [f(c).alias(n) for f, c, n in ((F.min, "minx", "_w"), (F.min, "miny", "_s"), (F.max, "maxx", "_e"), (F.max, "maxy", "_n"))]
        roots = features.groupBy(*by).agg(*pick)
        rooted = features.join(roots, list(by))
        w, s, e, n = F.col("_w") - 1e-7, F.col("_s") - 1e-7, F.col("_e") + 1e-7, F.col("_n") + 1e-7
    else:
        rooted, (w, s, e, n) = features, (bounds[0] - 1e-7, bounds[1] - 1e-7, bounds[2] + 1e-7, bounds[3] + 1e-7)
    inside = (cx >= w) & (cx < e) & (cy >= s) & (cy < n)
    at = rooted.where(inside).select(
        *by, "fid", F.floor((cx - w) / (e - w) * cells).alias("ci"), F.floor((cy - s) / (n - s) * cells).alias("cj"))
    depth = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    cut = lambda c: F.call_function("shiftright", F.col(c), F.lit(max_depth) - F.col("depth"))
    counts = (at.groupBy(*by, "ci", "cj").agg(F.count("*").alias("n")).select(*by, "ci", "cj", "n", depth)
              .withColumns({"i": cut("ci"), "j": cut("cj")}))
    total = counts.groupBy(*by, "depth", "i", "j").agg(F.sum("n").alias("total"))
    fits = (F.col("total") <= max_features) | (F.col("depth") == max_depth)
    leaf = (counts.join(total.where(fits), [*by, "depth", "i", "j"]).groupBy(*by, "ci", "cj")
            .agg(F.min(F.struct("depth", "i", "j", "total")).alias("leaf")).select(*by, "ci", "cj", "leaf.*"))
    placed = settled(at.join(leaf, [*by, "ci", "cj"]).select(*by, "fid", "depth", "i", "j", (F.col("total") > max_features).alias("full")), "leaves")
    ranked = running_totals(placed.where("full"), (*by, "depth", "i", "j"), ("fid",), place=F.lit(1).cast("long"))
    return placed.where("NOT full").withColumn("batch", F.lit(0)).unionByName(
        ranked.withColumn("batch", F.floor(F.col("place") / max_features).cast("int")).drop("place")).drop("full")


def partition_summary(leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each ``by``): features, leaves, largest leaf, deepest depth, emitted batches and the largest of them."""
    per = leaves.groupBy(*by, "depth", "i", "j", "batch").agg(F.count("*").alias("n"))
    cells = per.groupBy(*by, "depth", "i", "j").agg(F.sum("n").alias("n"), F.count("*").alias("batches"), F.max("n").alias("largest_batch"))
    return cells.groupBy(*by).agg(F.sum("n").alias("features"), F.count("*").alias("leaves"), F.max("n").alias("largest"),
                                  F.max("depth").alias("depth"), F.sum("batches").alias("batches"), F.max("largest_batch").alias("largest_batch"))


def delivery_summary(features: DataFrame, attributes: DataFrame) -> DataFrame:
    """(layer, source_features, features, tiles, largest, depth, min_zoom, max_zoom) of features and their 3D attributes."""
    parts = partition_summary(attributes, ("layer",))
    zooms = attributes.groupBy("layer").agg(F.least(F.lit(24), F.min("eff_min")).alias("min_zoom"), F.greatest(F.lit(0), F.max("eff_max")).alias("max_zoom"))
    source = features.groupBy("layer").agg(F.count("*").alias("source_features"))
    return source.join(parts, "layer").join(zooms, "layer").select(
        "layer", "source_features", "features", F.col("batches").alias("tiles"), F.col("largest_batch").alias("largest"), "depth", "min_zoom", "max_zoom")


def tile_hierarchy(tiles: DataFrame, zmin: int, zmax: int, scale: float = 8.0) -> DataFrame:
    """Occupied tiles (z, x, y, west, south, east, north) with their ancestors up to zmin and rolled-up regions.

    Each tile states its ancestors, and one combined aggregate per (z, x, y) unites their regions.
    """
    up = tiles.select("*", F.explode(F.sequence(F.lit(zmin), F.col("z"))).alias("az"))
    cut = lambda c: F.call_function("shiftright", F.col(c), F.col("z") - F.col("az"))
    rolled = up.select(F.col("az").alias("z"), cut("x").alias("x"), cut("y").alias("y"), "west", "south", "east", "north",
                       (F.col("az") == F.col("z")).alias("own"), (F.col("az") < F.col("z")).alias("parent"))
    return rolled.groupBy("z", "x", "y").agg(
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
        F.max("own").alias("content"), F.max("parent").alias("inner")).withColumn(
        "geometric_error", F.when(F.col("inner") & (F.col("z") < zmax), COARSE_ERROR * scale / F.pow(F.lit(2.0), F.col("z"))).otherwise(F.lit(0.0)))


def rtc_center(df: DataFrame, *keys: str) -> DataFrame:
    """Tile-local origin: middle of min and max of (x, y, z) per key."""
    mid = lambda c: ((F.min(c) + F.max(c)) / 2).alias(c)
    return df.groupBy(*keys).agg(mid("x"), mid("y"), mid("z"))


def tile_regions(tiles: DataFrame) -> DataFrame:
    b = tile_bbox(F.col("z"), F.col("x"), F.col("y"))
    return tiles.withColumns({"west": F.radians(b["minx"]), "south": F.radians(b["miny"]), "east": F.radians(b["maxx"]), "north": F.radians(b["maxy"])})
