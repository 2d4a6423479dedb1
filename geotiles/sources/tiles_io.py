"""Tile sink and directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tilemath import tile_id
from .scratch import running_totals

LEAF_ENTRIES = 512


def write_tiles(tiles: DataFrame, path: str, partitions: int | None = None) -> None:
    """Payload rows in tile-id order: ranges of ids per file, sorted inside."""
    df = tiles.withColumn("tile_id", tile_id(F.col("z"), F.col("x"), F.col("y"))).where(F.length("payload") > 0)
    df = df.repartitionByRange(partitions, "tile_id") if partitions else df.repartitionByRange("tile_id")
    df.sortWithinPartitions("tile_id").write.mode("overwrite").parquet(path)


def order_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("tile_id")


def with_offsets(tiles: DataFrame) -> DataFrame:
    """Adds offset (bytes before, in tile-id order), position and leaf to (tile_id, length); a dense area is as many stretches as it has rows for."""
    df = running_totals(tiles, (), ("tile_id",), offset=F.col("length").cast("long"), position=F.lit(1).cast("long"))
    return df.withColumn("leaf", F.floor(F.col("position") / LEAF_ENTRIES))


def tile_directory(tiles: DataFrame) -> DataFrame:
    """(tile_id, offset, length, run_length, leaf) of payload rows."""
    sized = tiles.select(tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), F.length("payload").alias("length")).where("length > 0")
    return with_offsets(sized).select("tile_id", "offset", "length", F.lit(1).alias("run_length"), "leaf")


def tile_metadata(layers: DataFrame, zmin: int, zmax: int) -> DataFrame:
    """(id, fields, min_zoom, max_zoom) of the vector layers, zooms cut to the tile set's."""
    return layers.select("id", "fields", F.greatest(F.coalesce("min_zoom", F.lit(zmin)), F.lit(zmin)).alias("min_zoom"),
                         F.least(F.coalesce("max_zoom", F.lit(zmax)), F.lit(zmax)).alias("max_zoom")).where("min_zoom <= max_zoom")
