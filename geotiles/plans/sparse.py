"""Tile planning: which tiles can be non-empty, and how many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tilemath import clip_range, range_count, tile_bbox, tile_range

MAX_INTERVALS = 50_000
HIGH, VERY_HIGH = 100_000, 500_000


def feature_ranges(features: DataFrame, z: int, coverage: Column | None = None) -> DataFrame:
    """Adds ``r``, the clipped tile range of each feature's box; features outside drop."""
    r = tile_range(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), z)
    df = features.withColumn("r", r if coverage is None else clip_range(r, coverage))
    return df.where(F.col("r").isNotNull())


def merge_intervals(columns: DataFrame, keys: list[str], lo: str = "min_y", hi: str = "max_y") -> DataFrame:
    """Union of closed integer intervals per key, touching ones joined: gaps and islands."""
    line = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = columns.select(*keys, lo, hi).distinct().withColumn(
        "_new", F.when(before.isNull() | (F.col(lo) > before + 1), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def sparse_plan(features: DataFrame, z: int, coverage: Column | None = None) -> DataFrame:
    """(z, x, min_y, max_y): merged tile columns of all features, never enumerated tile by tile."""
    columns = feature_ranges(features, z, coverage).select(
        F.explode(F.sequence("r.min_x", "r.max_x")).alias("x"),
        F.col("r.min_y").alias("min_y"), F.col("r.max_y").alias("max_y"))
    return merge_intervals(columns, ["x"]).select(F.lit(z).alias("z"), "x", "min_y", "max_y")


def plan_tiles(plan: DataFrame) -> DataFrame:
    return plan.select("z", "x", F.explode(F.sequence("min_y", "max_y")).alias("y"))


def plan_or_fallback(features: DataFrame, z: int, coverage: Column, max_intervals: int = MAX_INTERVALS,
                     mode: str = "sparse") -> tuple[DataFrame, str]:
    """The sparse plan, or the whole coverage with the reason: requested, invalid-extent, interval-budget."""
    spark = features.sparkSession
    whole = spark.range(1).select(coverage.alias("c")).select(
        F.lit(z).alias("z"), F.explode(F.sequence("c.min_x", "c.max_x")).alias("x"),
        F.col("c.min_y").alias("min_y"), F.col("c.max_y").alias("max_y"))
    if mode == "bbox":
        return whole, "requested"
    box = ["minx", "miny", "maxx", "maxy"]
    sound = (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))
    for c in box:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    r = clip_range(tile_range(*[F.col(c) for c in box], z), coverage)
    row = features.agg(F.count_if(~F.coalesce(sound, F.lit(False))).alias("bad"),
                       F.sum(F.when(sound, r["max_x"] - r["min_x"] + 1)).alias("n")).first()
    if row["bad"]:
        return whole, "invalid-extent"
    if (row["n"] or 0) > max_intervals:
        return whole, "interval-budget"
    return sparse_plan(features, z, coverage), "sparse"


def occupied(tiles: DataFrame, features: DataFrame) -> DataFrame:
    """Tiles whose box, one tile wider on each side, touches a feature box.

    Tile columns of the feature ranges are merged to intervals; a tile meets those of its own column, so no range is
    ever spelled out tile by tile.
    """
    zooms = sorted(r.z for r in tiles.select("z").distinct().collect())  # as many as there are zoom levels
    if not zooms:
        return tiles
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    columns = (features.select(*box, F.explode(F.array(*map(F.lit, zooms))).alias("z")).withColumn("r", tile_range(*box, F.col("z")))
               .select("z", F.explode(F.sequence("r.min_x", "r.max_x")).alias("x"), F.col("r.min_y").alias("min_y"), F.col("r.max_y").alias("max_y")))
    spans = merge_intervals(columns, ["z", "x"]).select(F.col("z").alias("sz"), F.col("x").alias("sx"), "min_y", "max_y")
    return tiles.join(spans, (F.col("z") == F.col("sz")) & (F.col("x") == F.col("sx")) & F.col("y").between(F.col("min_y"), F.col("max_y")), "left_semi")


def estimate_tiles(boxes: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """(fid, z, tiles, high, very_high): per zoom, and in total where z is null."""
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    per = boxes.select("fid", *box, F.explode(F.sequence(F.lit(zmin), F.lit(zmax))).alias("z")).select(
        "fid", "z", range_count(tile_range(*box, F.col("z"))).alias("n"))
    return (per.rollup("fid", "z").agg(F.sum("n").alias("tiles"), F.grouping_id().alias("g"))
            .where("g < 3").select("fid", "z", "tiles", (F.col("tiles") > HIGH).alias("high"),
                                   (F.col("tiles") > VERY_HIGH).alias("very_high")))


def coverage_advice(boxes: DataFrame) -> DataFrame:
    """(fid, area_km2, regional): approximate area of a box and whether it is regional."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    mid = F.radians((F.col("miny") + F.col("maxy")) / 2)
    area = (F.greatest(F.lit(0.0), w) * 111.32 * F.greatest(F.lit(0.01), F.cos(mid))
            * F.greatest(F.lit(0.0), h) * 110.57)
    return boxes.select("fid", F.round(area, 3).alias("area_km2"), ((area >= 2500) | (w >= 1.5) | (h >= 1.5)).alias("regional"))


#: Advice in its order, by name.
ADVICE = {
    "overview": "Regional extents work best up to z12-z13.",
    "city": "City extents work best at z14-z16.",
    "split_cities": "Export cities separately for z14 and above.",
    "many": "Many tiles: lower the maximum zoom, narrow the box or split the export.",
    "very_many": "Very many tiles: this takes long even with empty tiles left out.",
    "overview_first": "Export overview tiles first, then detailed cities.",
    "keep_low": "Keep z8-z10 for overview navigation.",
}


def export_advice(boxes: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """(fid, tiles, area_km2, advice): the tiles of each box in all zooms, its area, and what to do about them (texts of ``ADVICE``)."""
    totals = estimate_tiles(boxes, zmin, zmax).where("z IS NULL").select("fid", "tiles", "high", "very_high")
    large, regional = F.col("area_km2") > 2500, F.col("regional")
    when = {"overview": regional, "city": ~regional, "split_cities": regional & F.lit(zmax > 13), "many": F.col("high"), "very_many": F.col("very_high"),
            "overview_first": large & F.lit(zmax >= 15), "keep_low": F.lit(zmin > 8)}
    said = F.filter(F.array(*[F.when(c, F.lit(ADVICE[k])) for k, c in when.items()]), lambda x: x.isNotNull())
    return totals.join(coverage_advice(boxes), "fid").select("fid", "tiles", "area_km2", said.alias("advice"))


def cumulative_candidates(per_zoom: DataFrame, limit: int = HIGH) -> DataFrame:
    """Adds the running number of candidates by zoom, and whether it is within the limit; at most one row per zoom level."""
    line = Window.partitionBy(F.lit(0)).orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    df = per_zoom.withColumn("running", F.sum("tiles").over(line))
    return df.withColumn("ok", F.col("running") <= limit)


def guard_cumulative(per_zoom: DataFrame, limit: int = HIGH, force: bool = False) -> DataFrame:
    """``cumulative_candidates``; reading a zoom beyond the limit is an error unless forced."""
    df = cumulative_candidates(per_zoom, limit)
    if force:
        return df.withColumn("ok", F.lit(True))
    said = F.concat(F.lit("too many candidate tiles up to zoom "), F.col("z"), F.lit(": "), F.col("running"), F.lit(f" of {limit}"))
    return df.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def tile_report(tiles: DataFrame) -> DataFrame:
    """Accounting per zoom and in total (z null) over (z, planned, visited, written):
    estimated = excluded + candidates; candidates = pruned + visited; estimated = skipped + written."""
    n = lambda c: F.count_if(c)
    done = F.coalesce(F.col("written"), F.lit(False))
    return (tiles.rollup("z").agg(
        F.count("*").alias("estimated"), n(~F.col("planned")).alias("excluded"), n(F.col("planned")).alias("candidates"),
        n(F.col("planned") & ~F.col("visited")).alias("pruned"), n(F.col("visited")).alias("visited"),
        n(~done).alias("skipped"), n(done).alias("written")))
