"""Box queries, zoom windows and tile planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tilemath as tm
from ..functions.text import sqlite_real
from ..operators import query as q
from ..plans import sparse
from ..views import VIEWS, table, view, with_views

BOX = ("minx", "miny", "maxx", "maxy")
CITY = (-3.9, 40.3, -3.5, 40.6)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return q.boxes_of_points(view(spark, d, "geo_points"))


def pyramid_top_features(spark: SparkSession, d: str) -> DataFrame:
    """Three best points per z4 tile, by priority."""
    p = view(spark, d, "geo_points").withColumns({"x": tm.tile_x(F.col("lon"), 4), "y": tm.tile_y(F.col("lat"), 4)})
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("priority"), "fid"))
    return p.withColumn("rank", rank).where("rank <= 3").select("x", "y", "rank", "fid")


_TX = "greatest(0, least(floor((lon + 180.0) / 360.0 * {n}), {n} - 1))::BIGINT"
_TY = ("greatest(0, least(floor((1 - ln(tan(radians(greatest(-85.05112878, least(85.05112878, {lat})))) "
       "+ 1 / cos(radians(greatest(-85.05112878, least(85.05112878, {lat}))))) / pi()) / 2 * {n}), {n} - 1))::BIGINT")


def _tx(z: int, lon: str = "lon") -> str:
    return _TX.format(n=1 << z).replace("lon", lon, 1)


def _ty(z: int, lat: str = "lat") -> str:
    return _TY.format(n=1 << z, lat=lat)


_TOP = f"""{with_views("geo_points")},
t AS (SELECT *, {_tx(4)} AS x, {_ty(4)} AS y FROM geo_points)
SELECT * FROM (SELECT x, y, row_number() OVER (PARTITION BY x, y ORDER BY priority DESC, fid) AS rank, fid FROM t) WHERE rank <= 3"""


def tile_counts_z8(spark, d):
    p = view(spark, d, "geo_points")
    return p.groupBy(tm.tile_x(F.col("lon"), 8).alias("x"), tm.tile_y(F.col("lat"), 8).alias("y")).agg(F.count("*").alias("n"))


def tile_ids(spark, d):
    """Hilbert tile ids of all points at z6, in order of id."""
    p = view(spark, d, "geo_points")
    return p.select("fid", tm.tile_id(6, tm.tile_x(F.col("lon"), 6), tm.tile_y(F.col("lat"), 6)).alias("tile_id"))


_IDS = f"""WITH RECURSIVE geo_points AS ({{points}}), s AS (
 SELECT fid, 5 AS k, 0::BIGINT AS d, {_tx(6)} AS x, {_ty(6)} AS y FROM geo_points
 UNION ALL
 SELECT fid, k - 1, d + (1::BIGINT << (2*k)) * xor(3 * rx, ry),
   CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN (1::BIGINT << k) - 1 - yl ELSE yl END ELSE xl END,
   CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN (1::BIGINT << k) - 1 - xl ELSE xl END ELSE yl END
 FROM (SELECT *, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry, x & ((1::BIGINT << k) - 1) AS xl, y & ((1::BIGINT << k) - 1) AS yl
       FROM s WHERE k >= 0))
SELECT fid, 1365 + d AS tile_id FROM s WHERE k = -1"""


def tile_boxes(spark, d):
    """Corner of each occupied z5 tile, buffered."""
    t = view(spark, d, "geo_points").select(tm.tile_x(F.col("lon"), 5).alias("x"), tm.tile_y(F.col("lat"), 5).alias("y")).distinct()
    b = tm.tile_bbox(5, F.col("x"), F.col("y"), tm.BUFFER)
    return t.select("x", "y", *[F.round(b[c], 6).alias(c) for c in BOX])


_BOXES = f"""{with_views("geo_points")}, t AS (SELECT DISTINCT {_tx(5)} AS x, {_ty(5)} AS y FROM geo_points),
b AS (SELECT x, y, x / 32.0::DOUBLE * 360.0 - 180.0 AS minx, (x + 1) / 32.0::DOUBLE * 360.0 - 180.0 AS maxx,
 degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 32.0::DOUBLE)))) AS miny, degrees(atan(sinh(pi() * (1 - 2 * y / 32.0::DOUBLE)))) AS maxy FROM t)
SELECT x, y, round(greatest(-180.0, minx - (maxx - minx) * 128 / 4096), 6) AS minx,
 round(greatest(-85.05112878, miny - (maxy - miny) * 128 / 4096), 6) AS miny,
 round(least(180.0, maxx + (maxx - minx) * 128 / 4096), 6) AS maxx,
 round(least(85.05112878, maxy + (maxy - miny) * 128 / 4096), 6) AS maxy FROM b"""


def box_query(spark, d):
    """Every footprint with the points inside it."""
    return q.query_boxes(_points(spark, d), view(spark, d, "geo_boxes"))


_BOX_Q = f"""{with_views("geo_points", "geo_boxes")}
SELECT b.fid AS box_fid, p.fid AS fid FROM geo_boxes b JOIN geo_points p
 ON p.lon >= b.minx AND p.lon <= b.maxx AND p.lat >= b.miny AND p.lat <= b.maxy"""


def box_overlaps(spark, d):
    """Footprints with the boxes, moved by half their size, that they overlap."""
    b = view(spark, d, "geo_boxes")
    moved = b.select("fid", *[(F.col(c) + 5).alias(c) for c in BOX])
    return q.query_boxes(b, moved)


_OVER = f"""{with_views("geo_boxes")} SELECT a.fid AS box_fid, b.fid AS fid FROM geo_boxes a JOIN geo_boxes b
 ON a.minx + 5 <= b.maxx AND a.maxx + 5 >= b.minx AND a.miny + 5 <= b.maxy AND a.maxy + 5 >= b.miny"""


def zoom_windows(spark, d):
    """Observations visible per zoom 0..16."""
    o = view(spark, d, "geo_obs").withColumns({"first_zoom": F.col("first_zoom").cast("int"), "last_zoom": F.col("last_zoom").cast("int")})
    per = o.select("first_zoom", "last_zoom", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("z"))
    return q.visible_at(per, F.col("z"), "first_zoom", "last_zoom").groupBy("z").agg(F.count("*").alias("n"))


_ZOOM = f"""{with_views("geo_obs")} SELECT z::INTEGER AS z, count(*) AS n FROM geo_obs, range(0, 17) r(z)
 WHERE (first_zoom IS NULL OR first_zoom <= z) AND (last_zoom IS NULL OR last_zoom >= z) GROUP BY z"""


def property_filters(spark, d):
    """Include, exclude and number filters, all and any."""
    o = view(spark, d, "geo_obs")
    got = q.apply_filters(o, [{"column": "kind", "exclude": ["click"]}, {"column": "unknown", "include": []}],
                          [{"column": "value", "minNumber": 50}, {"column": "first_zoom", "include": [3]}])
    return q.hide_values(got, {"kind": ["view"]}).select("fid", "kind")


_FILTERS = f"""{with_views("geo_obs")} SELECT fid, kind FROM geo_obs WHERE (kind IS NULL OR kind <> 'click')
 AND (value >= 50 OR first_zoom = 3) AND (kind IS NULL OR kind <> 'view')"""


def span_filter(spark, d):
    """Way boxes at least 0.25 degrees wide or high."""
    return q.min_span(_way_boxes(spark, d), 0.25).select("fid")


def _way_boxes(spark, d):
    from ..operators.assemble import way_boxes

    return way_boxes(view(spark, d, "geo_way_refs"), view(spark, d, "geo_nodes"))


_WB = f"""{with_views("geo_nodes", "geo_way_refs")},
wb AS (SELECT way_id AS fid, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy
 FROM geo_way_refs JOIN geo_nodes ON ref = id GROUP BY way_id)"""


def layer_extents(spark, d):
    """Extent and number of points per amenity."""
    p = _points(spark, d)
    e = q.extent(p, "amenity")
    n = q.layer_counts(p.withColumn("layer", F.col("amenity")), p.select(F.col("amenity").alias("layer")).distinct())
    return e.join(n.withColumnRenamed("layer", "amenity"), "amenity")


_EXT = f"""{with_views("geo_points")} SELECT amenity, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy,
 count(*) AS n FROM geo_points GROUP BY amenity"""


def index_audit(spark, d):
    """Features against an index with holes, strangers and turned boxes."""
    p = _points(spark, d)
    index = p.where("fid % 10 <> 0").select("fid", F.col("minx"), "miny", F.when(F.col("fid") % 25 == 1, F.col("minx") - 1).otherwise(F.col("maxx")).alias("maxx"), "maxy")
    strangers = p.where("fid % 50 = 3").select((F.col("fid") + 100000000).alias("fid"), *BOX)
    return q.audit_index(p, index.unionByName(strangers))


_AUDIT = f"""{with_views("geo_points")}, i AS (SELECT fid, lon AS minx, CASE WHEN fid % 25 = 1 THEN lon - 1 ELSE lon END AS maxx FROM geo_points WHERE fid % 10 <> 0
 UNION ALL SELECT fid + 100000000, lon, lon FROM geo_points WHERE fid % 50 = 3)
SELECT (SELECT count(*) FROM geo_points) AS features, (SELECT count(*) FROM i) AS entries,
 (SELECT count(*) FROM geo_points p ANTI JOIN i USING (fid)) AS missing, (SELECT count(*) FROM i ANTI JOIN geo_points USING (fid)) AS orphans,
 (SELECT count(*) FROM i WHERE minx > maxx) AS inverted, false AS verified"""


def sparse_tiles(spark, d):
    """Merged tile columns of all footprints at z6."""
    return sparse.sparse_plan(view(spark, d, "geo_boxes"), 6)


def _range_sql(z: int) -> str:
    return (f"greatest(0, {_tx(z, 'minx')} - 1) AS x0, least({(1 << z) - 1}, {_tx(z, 'maxx')} + 1) AS x1, "
            f"greatest(0, {_ty(z, 'maxy')} - 1) AS y0, least({(1 << z) - 1}, {_ty(z, 'miny')} + 1) AS y1")


_SPARSE = f"""{with_views("geo_boxes")}, r AS (SELECT {_range_sql(6)} FROM geo_boxes),
c AS (SELECT DISTINCT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r),
t AS (SELECT DISTINCT x, unnest(range(y0, y1 + 1)) AS y FROM c),
g AS (SELECT x, y, y - row_number() OVER (PARTITION BY x ORDER BY y) AS g FROM t)
SELECT 6::INTEGER AS z, x, min(y) AS min_y, max(y) AS max_y FROM g GROUP BY x, g"""


def occupied_tiles(spark, d):
    """z5 tiles near a footprint."""
    every = spark.range(1 << 5).select(F.lit(5).alias("z"), F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("y"))
    return sparse.occupied(every, view(spark, d, "geo_boxes"))


_OCC = f"""{with_views("geo_boxes")}, r AS (SELECT {_range_sql(5)} FROM geo_boxes),
c AS (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r)
SELECT DISTINCT 5::INTEGER AS z, x, unnest(range(y0, y1 + 1)) AS y FROM c"""


def tile_estimate(spark, d):
    """Tiles of each footprint for z4..z12, with totals."""
    return sparse.estimate_tiles(view(spark, d, "geo_boxes"), 4, 12)


def _est_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT fid, {z}::INTEGER AS z, (x1 - x0 + 1) * (y1 - y0 + 1) AS n FROM (SELECT fid, {_range_sql(z)} FROM geo_boxes)" for z in range(4, 13))
    return f"""{with_views("geo_boxes")}, p AS ({rows}), s AS (SELECT fid, z, n::BIGINT AS tiles FROM p
 UNION ALL SELECT fid, NULL, sum(n)::BIGINT FROM p GROUP BY fid)
SELECT fid, z, tiles, tiles > 100000 AS high, tiles > 500000 AS very_high FROM s"""


def export_advice(spark, d):
    """What to do about exports of footprints, every third of them shrunk to a city, z9 to z15."""
    b = view(spark, d, "geo_boxes").withColumns({"maxx": F.when(F.col("fid") % 3 == 0, F.col("minx") + 0.05).otherwise(F.col("maxx")),
                                                 "maxy": F.when(F.col("fid") % 3 == 0, F.col("miny") + 0.05).otherwise(F.col("maxy"))})
    return sparse.export_advice(b, 9, 15).select("fid", "tiles", F.array_join("advice", "|").alias("advice"))


def _advice_sql() -> str:
    say = sparse.ADVICE
    rows = " UNION ALL ".join(f"SELECT fid, (x1 - x0 + 1) * (y1 - y0 + 1) AS n FROM (SELECT fid, {_range_sql(z)} FROM bb)" for z in range(9, 16))
    return f"""{with_views("geo_boxes")}, bb AS (SELECT fid, minx, miny, CASE WHEN fid % 3 = 0 THEN minx + 0.05 ELSE maxx END AS maxx, CASE WHEN fid % 3 = 0 THEN miny + 0.05 ELSE maxy END AS maxy FROM geo_boxes),
p AS ({rows}), s AS (SELECT fid, sum(n)::BIGINT AS tiles FROM p GROUP BY fid)
SELECT fid, tiles, CASE WHEN fid % 3 = 0 THEN '{say["city"]}' ELSE '{say["overview"]}|{say["split_cities"]}' END || CASE WHEN tiles > 100000 THEN '|{say["many"]}' ELSE '' END
 || CASE WHEN tiles > 500000 THEN '|{say["very_many"]}' ELSE '' END || CASE WHEN fid % 3 <> 0 THEN '|{say["overview_first"]}' ELSE '' END || '|{say["keep_low"]}' AS advice FROM s"""


def coverage_estimate(spark, d):
    return sparse.coverage_advice(view(spark, d, "geo_boxes"))


_COV = f"""{with_views("geo_boxes")}, a AS (SELECT fid, maxx - minx AS w, maxy - miny AS h,
 (maxx - minx) * 111.32 * greatest(0.01, cos(radians((miny + maxy) / 2))) * (maxy - miny) * 110.57 AS a FROM geo_boxes)
SELECT fid, round(a, 3) AS area_km2, a >= 2500 OR w >= 1.5 OR h >= 1.5 AS regional FROM a"""


def tile_accounting(spark, d):
    """z5 and z6: estimated, excluded, pruned, visited, skipped, written."""
    boxes, points = view(spark, d, "geo_boxes"), _points(spark, d)
    out = None
    for z in (5, 6):
        n = 1 << z
        every = spark.range(n).select(F.lit(z).alias("z"), F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("y"))
        planned = sparse.plan_tiles(sparse.sparse_plan(boxes, z)).withColumn("planned", F.lit(True))
        visited = sparse.occupied(every, points).withColumn("visited", F.lit(True))
        full = points.select(F.lit(z).alias("z"), tm.tile_x(F.col("lon"), z).alias("x"), tm.tile_y(F.col("lat"), z).alias("y")).distinct().withColumn("written", F.lit(True))
        rows = every.join(planned, ["z", "x", "y"], "left").join(visited, ["z", "x", "y"], "left").join(full, ["z", "x", "y"], "left")
        p = F.coalesce("planned", F.lit(False))
        v = p & F.coalesce("visited", F.lit(False))
        rows = rows.select("z", "x", "y", p.alias("planned"), v.alias("visited"), (v & F.coalesce("written", F.lit(False))).alias("written"))
        out = rows if out is None else out.unionByName(rows)
    return sparse.tile_report(out)


def _acc_sql() -> str:
    parts = []
    for z in (5, 6):
        n = 1 << z
        pr = _range_sql(z).replace("minx", "lon").replace("maxx", "lon").replace("maxy", "lat").replace("miny", "lat")
        parts.append(f"""SELECT {z}::INTEGER AS z, x, y, (x, y) IN (SELECT (x, y) FROM (SELECT x, unnest(range(y0, y1 + 1)) AS y FROM
 (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT {_range_sql(z)} FROM geo_boxes)))) AS p,
 (x, y) IN (SELECT (x, y) FROM (SELECT x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT {pr} FROM geo_points)))) AS v,
 (x, y) IN (SELECT ({_tx(z)}, {_ty(z)}) FROM geo_points) AS w FROM range(0, {n}) a(x), range(0, {n}) b(y)""")
    return f"""{with_views("geo_boxes", "geo_points")}, t AS ({" UNION ALL ".join(parts)}),
u AS (SELECT z, p, p AND v AS v, p AND v AND w AS w FROM t)
SELECT z, count(*) AS estimated, count(*) FILTER (NOT p) AS excluded, count(*) FILTER (p) AS candidates,
 count(*) FILTER (p AND NOT v) AS pruned, count(*) FILTER (v) AS visited, count(*) FILTER (NOT w) AS skipped, count(*) FILTER (w) AS written
FROM u GROUP BY ROLLUP (z)"""


def cumulative_guard(spark, d):
    b = view(spark, d, "geo_boxes")
    per = sparse.estimate_tiles(b, 2, 10).where("z is not null").groupBy("z").agg(F.sum("tiles").alias("tiles"))
    return sparse.cumulative_candidates(per)


def _guard_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {z}::INTEGER AS z, sum((x1 - x0 + 1) * (y1 - y0 + 1))::BIGINT AS tiles FROM (SELECT {_range_sql(z)} FROM geo_boxes)" for z in range(2, 11))
    return f"""{with_views("geo_boxes")}, p AS ({rows}), r AS (SELECT z, tiles, sum(tiles) OVER (ORDER BY z)::BIGINT AS running FROM p)
SELECT z, tiles, running, running <= 100000 AS ok FROM r"""


def number_prefix(spark, d):
    """Numbers read from text the lenient way."""
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN concat(c_acctbal, ' m') WHEN 1 THEN concat('x', c_acctbal) WHEN 2 THEN concat('-', c_custkey) WHEN 3 THEN NULL ELSE concat('  ', c_custkey, '.5e1z') END").alias("s"))
    return t.select("fid", F.round(sqlite_real(F.col("s")), 4).alias("number"))


_NUM = r"""SELECT c_custkey AS fid, round(CASE c_custkey % 5 WHEN 0 THEN c_acctbal::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN -c_custkey::DOUBLE WHEN 3 THEN NULL
 ELSE (c_custkey || '.5')::DOUBLE * 10 END, 4) AS number FROM customer"""


def plan_fallback(spark, d):
    """How each z is planned within a small interval budget."""
    boxes = view(spark, d, "geo_boxes")
    out = None
    for z in (3, 6, 9):
        n = (1 << z) - 1
        coverage = F.struct(F.lit(0).cast("long").alias("min_x"), F.lit(n).cast("long").alias("max_x"),
                            F.lit(0).cast("long").alias("min_y"), F.lit(n).cast("long").alias("max_y"))
        plan, reason = sparse.plan_or_fallback(boxes, z, coverage, max_intervals=900)
        row = plan.agg(F.sum(F.col("max_y") - F.col("min_y") + 1).alias("tiles")).select(F.lit(z).alias("z"), "tiles", F.lit(reason).alias("reason"))
        out = row if out is None else out.unionByName(row)
    return out


def _fallback_sql() -> str:
    rows = []
    for z in (3, 6, 9):
        rows.append(f"""SELECT {z}::INTEGER AS z, CASE WHEN n > 900 THEN {1 << (2 * z)} ELSE t END::BIGINT AS tiles,
 CASE WHEN n > 900 THEN 'interval-budget' ELSE 'sparse' END AS reason FROM (
 SELECT (SELECT sum(x1 - x0 + 1) FROM (SELECT {_range_sql(z)} FROM geo_boxes)) AS n,
 (SELECT count(*) FROM (SELECT DISTINCT x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT {_range_sql(z)} FROM geo_boxes)))) AS t)""")
    return with_views("geo_boxes") + " " + " UNION ALL ".join(rows)


QUERIES = {f.__name__: f for f in (
    pyramid_top_features, tile_counts_z8, tile_ids, tile_boxes, box_query, box_overlaps, zoom_windows, property_filters,
    span_filter, layer_extents, index_audit, sparse_tiles, occupied_tiles, tile_estimate, export_advice, coverage_estimate,
    tile_accounting, cumulative_guard, number_prefix, plan_fallback)}

ORACLES = {
    "pyramid_top_features": _TOP,
    "tile_counts_z8": f"{with_views('geo_points')} SELECT {_tx(8)} AS x, {_ty(8)} AS y, count(*) AS n FROM geo_points GROUP BY 1, 2",
    "tile_ids": _IDS.replace("{points}", VIEWS["geo_points"]),
    "tile_boxes": _BOXES, "box_query": _BOX_Q, "box_overlaps": _OVER, "zoom_windows": _ZOOM, "property_filters": _FILTERS,
    "span_filter": _WB + " SELECT fid FROM wb WHERE maxx - minx >= 0.25 OR maxy - miny >= 0.25",
    "layer_extents": _EXT, "index_audit": _AUDIT, "sparse_tiles": _SPARSE, "occupied_tiles": _OCC,
    "tile_estimate": _est_sql(), "export_advice": _advice_sql(), "coverage_estimate": _COV, "tile_accounting": _acc_sql(), "cumulative_guard": _guard_sql(),
    "number_prefix": _NUM, "plan_fallback": _fallback_sql(),
}
