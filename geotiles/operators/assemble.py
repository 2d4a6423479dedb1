"""OSM-style assembly: ways and relations from nodes, refs and members."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..sources.scratch import plain_unions, settled


def finite(*cols: str) -> Column:
    """All columns hold a number that is neither missing nor infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def needed_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    return nodes.join(refs.select(F.col("ref").alias("id")), "id", "left_semi")


def resolve_way_coords(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, refs, points, coords): all refs in order, a point or null for each, and the points that are there.

    Closedness and the joints of rings are questions to the refs; only geometry skips a missing node.
    """
    met = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref", "left")
    return collect_coords(met, "way_id")


def collect_coords(df: DataFrame, key: str) -> DataFrame:
    """(key, refs, points, coords) of rows (key, pos, ref, lon, lat); a row without lon or lat is a missing node."""
    point = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("p")
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", point))).alias("_l")).select(
        key, F.col("_l.ref").alias("refs"), F.col("_l.p").alias("points"), present(F.col("_l.p")).alias("coords"))


def present(points: Column) -> Column:
    return F.filter(points, lambda p: p.isNotNull())


def way_boxes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fid, minx, miny, maxx, maxy) of every way with a node: combined on the map side, no point lists."""
    met = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    return met.groupBy(F.col("way_id").alias("fid")).agg(
        F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))


def resolve_members(members: DataFrame, ways: DataFrame, helpers: DataFrame | None = None) -> DataFrame:
    """Members (rel_id, ref, role, pos) with their way's refs and points; helper ways come first, missing ones drop."""
    if helpers is None:
        return members.join(ways.withColumnRenamed("way_id", "ref"), "ref")
    both = helpers.withColumn("_o", F.lit(0)).unionByName(ways.withColumn("_o", F.lit(1)))
    best = both.groupBy("way_id").agg(F.min_by(F.struct("refs", "points"), "_o").alias("w")).select(
        F.col("way_id").alias("ref"), "w.*")
    return members.join(best, "ref")


def helper_ways(ways: DataFrame, members: DataFrame, classified: DataFrame) -> DataFrame:
    """Member ways that no layer has taken."""
    return ways.join(members.select(F.col("ref").alias("id")), "id", "left_semi").join(
        classified.select("id"), "id", "left_anti")


def dedup_first(features: DataFrame, keys: tuple[str, ...] = ("layer", "id"), order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """First feature of each (layer, id); null and empty ids are all kept, 0 is an id.

    A feature without id is a group of its own by a row number, so the input is read once and no group is large.
    """
    bare = F.col(keys[-1]).isNull() | (F.col(keys[-1]).cast("string") == "")
    alone = features.withColumn("_alone", F.when(bare, F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy(*keys, "_alone").orderBy(*order))
    return alone.withColumn("_n", place).where("_n = 1").drop("_n", "_alone")


def dedup_last(nodes: DataFrame, key: str = "id", order: str = "src") -> DataFrame:
    """Last source's row of each key."""
    rest = [c for c in nodes.columns if c != key]
    return nodes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Several extracts as one, with their order in ``src``."""
    out = frames[0].withColumn("src", F.lit(0))
    for k, df in enumerate(frames[1:], 1):
        out = out.unionByName(df.withColumn("src", F.lit(k)), allowMissingColumns=True)
    return out


def infer_extent(nodes: DataFrame, header: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row (minx, miny, maxx, maxy): a valid header box, else that of the nodes; a flat one is an error."""
    if header and all(map(math.isfinite, header)) and header[0] < header[2] and header[1] < header[3]:
        return nodes.sparkSession.range(1).select(*[F.lit(v).alias(c) for v, c in zip(header, ("minx", "miny", "maxx", "maxy"))])
    box = nodes.where(finite("lon", "lat")).agg(
        F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))
    flat = ~((F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")))
    return box.withColumn("minx", F.when(F.coalesce(flat, F.lit(True)), F.raise_error(F.lit("degenerate extent")).cast("double")).otherwise(F.col("minx")))


def way_geometry(layer: Column, aeroway: Column, refs: Column, coords: Column) -> Column:
    """Geometry of a way by layer: lines, polygons if its refs close, or null; repeated points count once."""
    line = g.let(g.dedupe(coords), lambda c: F.when(F.size(c) >= 2, g.line_string(c)))
    area = g.let(g.close_ring(coords), lambda c: F.when(F.size(c) >= 4, g.multi_polygon(F.array(F.array(c)))))
    closed = F.coalesce(g.is_closed(refs), F.lit(False))
    return (F.when(layer.isin("roads", "railways", "coastline", "cliffs"), line)
            .when(closed, area)
            .when(layer.isin("boundaries", "pois"), line)
            .when((layer == "aip") & ~F.coalesce(aeroway, F.lit("")).isin("apron", "terminal", "helipad"), line))


_RING = "rel_id long, role string, ring int, first_pos long, refs array<long>, xs array<double>, ys array<double>"
#: Points of a batch of rings, about.
_BATCH_POINTS = 200_000


def _join_ends(pdf: pd.DataFrame) -> Iterator[tuple[int, list[int], list[tuple[float, float]]]]:
    """``_joined`` of one relation's member ways (pos, refs, xs, ys) in order of pos."""
    pdf = pdf.sort_values("pos", kind="stable")
    yield from _joined([(int(p), list(r), list(zip(x, y))) for p, r, x, y in zip(pdf["pos"], pdf["refs"], pdf["xs"], pdf["ys"])])


def _joined(members: list[tuple[int, list[int], list[tuple[float, float]]]]) -> Iterator[tuple[int, list[int], list[tuple[float, float]]]]:
    """Greedy end-to-end joining of one relation's member ways (pos, refs, points) by their refs, first match in member order.

    A ring has four refs at least; points of missing nodes (NaN) and repeated ones are left out, and what is left of a ring
    counts if four points, with the closing one, remain.  Ways are found by the nodes at their ends, so the work grows with the ways.
    """
    ways = [m for m in members if len(m[1]) >= 2]
    used = [False] * len(ways)
    ends: dict[int, deque[int]] = {}
    for k, (_, r, _) in enumerate(ways):
        for node in {r[0], r[-1]}:
            ends.setdefault(node, deque()).append(k)

    def first(node: int) -> int:
        waiting = ends.get(node, ())
        while waiting and used[waiting[0]]:
            waiting.popleft()
        return waiting[0] if waiting else len(ways)

    for k, (pos, r, c) in enumerate(ways):
        if used[k]:
            continue
        used[k] = True
        refs, pts = deque(r), deque(c)
        while len(refs) < 4 or refs[0] != refs[-1]:
            best = min(first(refs[-1]), first(refs[0]))
            if best == len(ways):
                break
            used[best] = True
            _, r, c = ways[best]
            if r[0] == refs[-1]:
                refs.extend(r[1:])
                pts.extend(c[1:])
            elif r[-1] == refs[-1]:
                refs.extend(r[-2::-1])
                pts.extend(c[-2::-1])
            elif r[-1] == refs[0]:
                refs.extendleft(r[-2::-1])
                pts.extendleft(c[-2::-1])
            else:
                refs.extendleft(r[1:])
                pts.extendleft(c[1:])
        if len(refs) >= 4 and refs[0] == refs[-1]:
            ring = [p for p, _ in groupby(p for p in pts if p[0] == p[0])]
            if ring and ring[0] != ring[-1]:
                ring.append(ring[0])
            if len(ring) >= 4:
                yield pos, list(refs), ring


def assemble_rings(members: DataFrame) -> DataFrame:
    """(rel_id, role, ring, first_pos, refs, coords) of members (rel_id, role, pos, refs, points): closed rings of every relation and role.

    Order matters inside a relation, so one relation's member ways of a role stand one after another in a task, which streams
    them; it holds one relation at a time.
    """
    flat = members.select("rel_id", F.when(F.col("role") == "inner", "inner").otherwise("outer").alias("role"), "pos", "refs",
                          *[F.transform("points", lambda p: F.coalesce(p[c], F.lit(float("nan")))).alias(f"{c}s") for c in ("x", "y")])
    schema = pa.schema([("rel_id", pa.int64()), ("role", pa.string()), ("ring", pa.int32()), ("first_pos", pa.int64()), ("refs", pa.list_(pa.int64())),
                        ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, points = [], 0
        for (rel, role), ways in groupby(rows(batches), lambda w: (w[0], w[1])):
            for k, (pos, refs, pts) in enumerate(_joined([(p, r, list(zip(x, y))) for _, _, p, r, x, y in ways])):
                made.append((rel, role, k, pos, refs, [p[0] for p in pts], [p[1] for p in pts]))
                points += len(pts)
            if points > _BATCH_POINTS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)
                made, points = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)

    dealt = flat.select(F.col("rel_id").cast("long").alias("rel_id"), "role", F.col("pos").cast("long").alias("pos"), "refs", "xs", "ys")
    return dealt.repartition("rel_id", "role").sortWithinPartitions("rel_id", "role", "pos").mapInArrow(run, _RING).select(
        "rel_id", "role", "ring", "first_pos", "refs", F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).alias("coords"))


def nest_holes(rings: DataFrame) -> DataFrame:
    """(rel_id, ring, inner): every inner ring with the first outer ring that holds its first point."""
    outer = rings.where("role = 'outer'").select("rel_id", F.col("ring").alias("outer_ring"), F.col("coords").alias("outer"))
    inner = rings.where("role = 'inner'").select("rel_id", F.col("ring").alias("inner_ring"), "coords")
    met = inner.join(outer, "rel_id").where(g.point_in_ring(F.col("coords")[0]["x"], F.col("coords")[0]["y"], F.col("outer")))
    return met.groupBy("rel_id", "inner_ring").agg(F.min("outer_ring").alias("ring"), F.first("coords").alias("inner"))


def relation_polygons(rings: DataFrame) -> DataFrame:
    """(rel_id, geom): MultiPolygon of the outer rings with their holes."""
    holes = nest_holes(rings).groupBy("rel_id", "ring").agg(
        F.array_sort(F.collect_list(F.struct("inner_ring", "inner"))).alias("h"))
    outer = rings.where("role = 'outer'").join(holes, ["rel_id", "ring"], "left")
    per = outer.select("rel_id", "ring", F.concat(F.array("coords"), F.coalesce(
        F.transform("h", lambda x: x["inner"]), F.array().cast(g.RINGS))).alias("rings"))
    return per.groupBy("rel_id").agg(F.array_sort(F.collect_list(F.struct("ring", "rings"))).alias("p")).select(
        "rel_id", g.multi_polygon(F.transform("p", lambda x: x["rings"])).alias("geom"))


def relation_lines(met: DataFrame) -> DataFrame:
    """(rel_id, line): the member ways of a relation as a line, or several, in member order."""
    met = met.select("rel_id", "pos", g.dedupe(present(F.col("points"))).alias("coords")).where(F.size("coords") >= 2)
    per = met.groupBy("rel_id").agg(F.array_sort(F.collect_list(F.struct("pos", "coords"))).alias("l"))
    kind = F.when(F.size("l") > 1, "MultiLineString").otherwise("LineString").alias("kind")
    return per.select("rel_id", F.struct(kind, F.transform("l", lambda x: F.array(x["coords"])).alias("parts")).cast(g.GEOMETRY).alias("line"))


def relation_geometry(rels: DataFrame, met: DataFrame) -> DataFrame:
    """Adds ``geom`` to rows (layer, id, ...): the polygons its members close, else, for layers that may be lines, their lines.

    ``met`` holds the member ways (rel_id, pos, role, refs, points).
    """
    rings = settled(assemble_rings(met), "rings")  # outer and inner rings are read apart
    areas = relation_polygons(rings).select(F.col("rel_id").alias("area_of"), F.col("geom").alias("area"))
    lines = relation_lines(met).withColumnRenamed("rel_id", "line_of")
    lined = F.col("layer").isin("coastline", "cliffs", "boundaries", "pois")
    return (rels.join(areas, F.col("id") == F.col("area_of"), "left").join(lines, F.col("id") == F.col("line_of"), "left")
            .withColumn("geom", F.coalesce("area", F.when(lined, F.col("line")))).drop("area_of", "area", "line_of", "line"))


def union_features(*frames: DataFrame) -> DataFrame:
    """Features of several kinds or extracts as one table; columns missing on one side are null."""
    plain_unions(frames[0].sparkSession)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_inside(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features with a geometry whose box overlaps the request; pois become points; nothing is clipped."""
    df = features.where(F.col("geom").isNotNull()).withColumn(
        "geom", F.when(F.col("layer") == "pois", g.point(g.representative_point(F.col("geom")))).otherwise(F.col("geom")))
    df = df.withColumn("_b", g.bbox(F.col("geom"))).select("*", "_b.*").drop("_b")
    return df.where((F.col("maxx") >= box[0]) & (F.col("minx") <= box[2]) & (F.col("maxy") >= box[1]) & (F.col("miny") <= box[3]))
