"""Web-map tile arithmetic as Columns (extent 4096, buffer 128)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENT, BUFFER = 4096, 128
MAX_LAT = 85.05112878


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(_lit(low), F.least(_lit(high), v))


def tiles_across(z) -> Column:
    """2^z as LONG."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _lit(z).cast("int"))


def tile_x(lon: Column, z) -> Column:
    n = tiles_across(z)
    return clamp(F.floor((lon + 180.0) / 360.0 * n), F.lit(0).cast("long"), n - 1)


def tile_y(lat: Column, z) -> Column:
    n = tiles_across(z)
    rad = F.radians(clamp(lat, -MAX_LAT, MAX_LAT))
    y = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n
    return clamp(F.floor(y), F.lit(0).cast("long"), n - 1)


def tile_range(minx: Column, miny: Column, maxx: Column, maxy: Column, z, margin: int = 1) -> Column:
    """Struct (min_x, max_x, min_y, max_y) of the tiles a box touches, one tile wider on each side."""
    top = tiles_across(z) - 1
    zero = F.lit(0).cast("long")
    return F.struct(
        clamp(tile_x(minx, z) - margin, zero, top).alias("min_x"),
        clamp(tile_x(maxx, z) + margin, zero, top).alias("max_x"),
        clamp(tile_y(maxy, z) - margin, zero, top).alias("min_y"),
        clamp(tile_y(miny, z) + margin, zero, top).alias("max_y"))


def buffered_range(minx: Column, miny: Column, maxx: Column, maxy: Column, z) -> Column:
    """Struct like ``tile_range``'s that holds every tile whose buffered box the box may touch, and few others.

    A buffer is 1/32 of a tile in degrees.  Eastwards that is 1/32 of a column; northwards a degree is a share of a row that grows
    towards the poles, so that a quarter of a row bounds it at every zoom.
    """
    n = tiles_across(z)
    zero, top = F.lit(0).cast("long"), n - 1
    column = lambda lon: (lon + 180.0) / 360.0 * n

    def row(lat: Column) -> Column:
        rad = F.radians(clamp(lat, -MAX_LAT, MAX_LAT))
        return (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n

    whole = lambda v: clamp(F.floor(v), zero, top)
    return F.struct(whole(column(minx) - 0.04).alias("min_x"), whole(column(maxx) + 0.04).alias("max_x"),
                    whole(row(maxy) - 0.25).alias("min_y"), whole(row(miny) + 0.25).alias("max_y"))


def clip_range(r: Column, coverage: Column) -> Column:
    """Intersection of two ranges, null if empty."""
    lo = lambda f: F.greatest(r[f], coverage[f])
    hi = lambda f: F.least(r[f], coverage[f])
    made = F.struct(lo("min_x").alias("min_x"), hi("max_x").alias("max_x"),
                    lo("min_y").alias("min_y"), hi("max_y").alias("max_y"))
    return F.when((lo("min_x") <= hi("max_x")) & (lo("min_y") <= hi("max_y")), made)


def range_count(r: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.greatest(zero, r["max_x"] - r["min_x"] + 1) * F.greatest(zero, r["max_y"] - r["min_y"] + 1)


def _edge_lat(y: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def tile_bbox(z, x: Column, y: Column, buffer: int = 0) -> Column:
    """Struct (minx, miny, maxx, maxy) in degrees; with a buffer in 1/4096, clamped to the world."""
    n = tiles_across(z)
    minx, maxx = x / n * 360.0 - 180.0, (x + 1) / n * 360.0 - 180.0
    maxy, miny = _edge_lat(y, n), _edge_lat(y + 1, n)
    if buffer:
        mx, my = (maxx - minx) * buffer / EXTENT, (maxy - miny) * buffer / EXTENT
        minx, maxx = F.greatest(F.lit(-180.0), minx - mx), F.least(F.lit(180.0), maxx + mx)
        miny, maxy = F.greatest(F.lit(-MAX_LAT), miny - my), F.least(F.lit(MAX_LAT), maxy + my)
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def tile_id(z, x: Column, y: Column) -> Column:
    """Tile number along the Hilbert curve, after all tiles of lower zooms."""
    zc = _lit(z).cast("int")
    one = F.lit(1).cast("long")
    shift = lambda c, k: F.call_function("shiftleft", c, k)
    base = ((shift(one, 2 * zc) - 1) / 3).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(a: Column, k: Column) -> Column:
        s = shift(one, k)
        rx = (a["x"].bitwiseAND(s) > 0).cast("long")
        ry = (a["y"].bitwiseAND(s) > 0).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, s - 1 - a["x"].bitwiseAND(s - 1)).otherwise(a["x"].bitwiseAND(s - 1))
        fy = F.when(flip, s - 1 - a["y"].bitwiseAND(s - 1)).otherwise(a["y"].bitwiseAND(s - 1))
        return F.struct(d.alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"),
                        F.when(ry == 0, fx).otherwise(fy).alias("y"))

    bits = F.when(zc > 0, F.sequence(zc - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return base + F.aggregate(bits, start, step, lambda a: a["d"])


def detail_for_zoom(z) -> Column:
    z = _lit(z)
    return F.when(z <= 11, "overview").when(z <= 14, "normal").otherwise("full")
