"""Layer build: entities to typed layer features in one lazy plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assemble as a
from ..operators import classify as c


def build_layers(nodes: DataFrame, ways: DataFrame, relations: DataFrame, box: tuple[float, float, float, float],
                 layers: Iterable[str] = c.LAYERS) -> DataFrame:
    """(layer, id, ord, tags, geom, minx..maxy): points, ways and relations that touch the box, first of each id.

    nodes (id, lon, lat, tags), ways (id, refs, tags), relations (id, members, tags).
    """
    layers = list(layers)
    points = c.point_features(nodes, box, layers).select(
        "layer", F.concat(F.lit("node/"), F.col("id")).alias("id"), F.lit(0).alias("ord"), "tags", g.point(g.xy(F.col("lon"), F.col("lat"))).alias("geom"))
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "ref"))
    lines = a.resolve_way_coords(refs, nodes)
    by_way = c.classify_ways(ways.select("id", "tags"), layers).join(lines, F.col("id") == F.col("way_id")).select(
        "layer", F.concat(F.lit("way/"), F.col("id")).alias("id"), F.lit(1).alias("ord"), "tags",
        a.way_geometry(F.col("layer"), F.col("tags")["aeroway"], F.col("refs"), F.col("coords")).alias("geom"))
    rels = c.classify_relations(relations, layers)
    members = rels.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m")).select(
        "rel_id", "pos", F.col("m.ref").alias("ref"), F.col("m.role").alias("role"), F.col("m.type").alias("type")).where("type = 'way'").drop("type").distinct()
    met = a.resolve_members(members, lines)
    by_rel = a.relation_geometry(rels, met).select("layer", F.concat(F.lit("relation/"), F.col("id")).alias("id"), F.lit(2).alias("ord"), "tags", "geom")
    every = a.union_features(points, by_way, by_rel)
    return a.dedup_first(a.keep_inside(every, box))
