"""Box, zoom and property queries over feature tables (minx, miny, maxx, maxy)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sqlite_real

BOX = ("minx", "miny", "maxx", "maxy")


def bbox_overlaps(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed overlap of two boxes."""
    return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])


def point_in_bbox(lon: Column, lat: Column, box: Sequence) -> Column:
    return (lon >= box[0]) & (lon <= box[2]) & (lat >= box[1]) & (lat <= box[3])


def boxes_of_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.withColumns({"minx": F.col(lon), "miny": F.col(lat), "maxx": F.col(lon), "maxy": F.col(lat)})


def _one_filter(df: DataFrame, rule: Mapping) -> Column | None:
    """Null if the column is unknown; an empty include matches nothing; exclude keeps nulls."""
    if rule["column"] not in df.columns:
        return None
    col, made = F.col(f"`{rule['column']}`"), []
    if "include" in rule:
        made.append(col.cast("string").isin(*map(str, rule["include"])) if rule["include"] else F.lit(False))
    if rule.get("exclude"):
        made.append(col.isNull() | ~col.cast("string").isin(*map(str, rule["exclude"])))
    if "minNumber" in rule:
        made.append(sqlite_real(col) >= float(rule["minNumber"]))
    if "maxNumber" in rule:
        made.append(sqlite_real(col) <= float(rule["maxNumber"]))
    return reduce(lambda a, b: a & b, made) if made else None


def apply_filters(df: DataFrame, all_: Sequence[Mapping] = (), any_: Sequence[Mapping] = ()) -> DataFrame:
    """Rows that meet every rule of ``all_`` and one of ``any_`` (if it has a known column)."""
    for rule in all_:
        if (c := _one_filter(df, rule)) is not None:
            df = df.where(c)
    some = [c for rule in any_ if (c := _one_filter(df, rule)) is not None]
    return df.where(reduce(lambda a, b: a | b, some)) if some else df


def hide_values(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop rows whose column holds a hidden value; null stays."""
    for column, values in rules.items():
        if column in df.columns and values:
            df = df.where(F.col(f"`{column}`").isNull() | ~F.col(f"`{column}`").cast("string").isin(*values))
    return df


def visible_at(df: DataFrame, z: int | Column, min_column: str | None = None, max_column: str | None = None) -> DataFrame:
    """Rows whose zoom window holds z; null ends are open."""
    for c in (min_column, max_column):
        if c and dict(df.dtypes).get(c) not in ("int", "bigint", "smallint", "tinyint"):
            raise ValueError(f"zoom column {c} must be an integer column of the layer")
    if min_column:
        df = df.where(F.col(f"`{min_column}`").isNull() | (F.col(f"`{min_column}`") <= z))
    if max_column:
        df = df.where(F.col(f"`{max_column}`").isNull() | (F.col(f"`{max_column}`") >= z))
    return df


def active_layers(layers: DataFrame, rules: DataFrame, z: int) -> DataFrame:
    """Layers (id, min_zoom, max_zoom) shown at z by their own window and their rule's (layer, visible, min_zoom, max_zoom)."""
    r = rules.select(F.col("layer").alias("id"), F.col("visible").alias("_v"), F.col("min_zoom").alias("_lo"),
                     F.col("max_zoom").alias("_hi"))
    inside = lambda lo, hi: (F.coalesce(lo, F.lit(0)) <= z) & (F.coalesce(hi, F.lit(24)) >= z)
    return layers.join(r, "id", "left").where(
        inside(F.col("min_zoom"), F.col("max_zoom")) & inside(F.col("_lo"), F.col("_hi"))
        & F.coalesce("_v", F.lit(True))).select(*layers.columns)


def min_span(df: DataFrame, threshold: float | Column) -> DataFrame:
    """Features as wide or as high as the threshold."""
    return df.where((F.col("maxx") - F.col("minx") >= threshold) | (F.col("maxy") - F.col("miny") >= threshold))


def effective_zoom(df: DataFrame, layer: Sequence, rule: Sequence, feature: Sequence[Column],
                   by_property: Mapping[str, Mapping[str, Sequence]] | None = None) -> DataFrame:
    """Adds eff_min, eff_max: the narrowest of layer, rule and feature windows (0 and 24 where open).

    ``by_property`` maps property -> value -> (min, max): what it sets replaces the rule's ends, later properties last.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    ends = [as_col(rule[0]), as_col(rule[1])]
    for name, values in (by_property or {}).items():
        for value, window in values.items():
            hit = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) == value
            ends = [e if w is None else F.when(hit, F.lit(w)).otherwise(e) for e, w in zip(ends, window)]
    lo = [F.coalesce(as_col(v), F.lit(0)) for v in (layer[0], ends[0], feature[0])]
    hi = [F.coalesce(as_col(v), F.lit(24)) for v in (layer[1], ends[1], feature[1])]
    return df.withColumns({"eff_min": F.greatest(*lo), "eff_max": F.least(*hi)})


def _cells(df: DataFrame, cell: float) -> DataFrame:
    line = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return df.withColumn("_cx", F.explode(line("minx", "maxx"))).withColumn("_cy", F.explode(line("miny", "maxy")))


def query_boxes(features: DataFrame, boxes: DataFrame, cell: float = 5.0) -> DataFrame:
    """(box_fid, fid): every box with the features it overlaps.

    Both sides go to the grid cells they touch and meet in an equi join, which skew
    handling may split; a pair is kept only in the cell of its lower-left common corner, so
    nothing has to be made distinct.
    """
    f = _cells(features.select("fid", *BOX), cell)
    b = _cells(boxes.select(F.col("fid").alias("box_fid"), *[F.col(c).alias("b" + c) for c in BOX],
                            *BOX), cell).drop(*BOX)
    # dealt by a number of their own: both sides are small beside their pairs, and would be put together into few tasks
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f, b = (df.repartition(n, "_cx", "_cy") for df in (f, b))
    met = f.join(b, ["_cx", "_cy"]).where(bbox_overlaps([F.col(c) for c in BOX], [F.col("b" + c) for c in BOX]))
    own = ((F.col("_cx") == F.floor(F.greatest("minx", "bminx") / cell))
           & (F.col("_cy") == F.floor(F.greatest("miny", "bminy") / cell)))
    return met.where(own).select("box_fid", "fid")


def read_box(df: DataFrame, box: Sequence[float], limit: int | None = None) -> DataFrame:
    """Distinct features of one box by fid; at most ``limit`` of them."""
    got = df.where(bbox_overlaps([F.col(c) for c in BOX], [F.lit(v) for v in box])).dropDuplicates(["fid"])
    return got.orderBy("fid").limit(limit) if limit is not None else got


def audit_index(features: DataFrame, index: DataFrame) -> DataFrame:
    """One row: features, entries, missing, orphans, inverted, verified, of features (fid) and index (fid, box)."""
    side = features.select("fid", F.lit(1).alias("f"), F.lit(0).alias("i"), F.lit(0).alias("bad")).unionByName(
        index.select("fid", F.lit(0).alias("f"), F.lit(1).alias("i"),
                     ((F.col("minx") > F.col("maxx")) | (F.col("miny") > F.col("maxy"))).cast("int").alias("bad")))
    per = side.groupBy("fid").agg(F.sum("f").alias("f"), F.sum("i").alias("i"), F.sum("bad").alias("bad"))
    return per.agg(F.sum("f").alias("features"), F.sum("i").alias("entries"),
                   F.count_if((F.col("f") > 0) & (F.col("i") == 0)).alias("missing"),
                   F.count_if((F.col("f") == 0) & (F.col("i") > 0)).alias("orphans"),
                   F.coalesce(F.sum("bad"), F.lit(0)).alias("inverted")).withColumn(
        "verified", (F.col("missing") == 0) & (F.col("orphans") == 0) & (F.col("inverted") == 0)
        & (F.coalesce("features", F.lit(0)) == F.coalesce("entries", F.lit(0))))


def layer_counts(features: DataFrame, layers: DataFrame) -> DataFrame:
    """(layer, n), zero for layers without features."""
    n = features.groupBy("layer").agg(F.count("*").alias("n"))
    return layers.select("layer").join(n, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"))


def extent(features: DataFrame, *keys: str) -> DataFrame:
    return features.groupBy(*keys).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                                       F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
