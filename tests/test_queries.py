"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
from functools import reduce

import duckdb
import pytest

from geotiles.queries import ORACLES, QUERIES


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        got = db.execute(ORACLES[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_decluttered_against_plain_greedy(spark, db):
    """The best fifty labels of every z2 tile, greedily kept while their boxes do not overlap."""
    from geotiles.queries.planning import _tx, _ty
    from geotiles.views import with_views

    rows = db.execute(f"{with_views('geo_points')} SELECT {_tx(2)} AS x, {_ty(2)} AS y, fid, name, priority, lon, lat FROM geo_points").fetchall()
    tiles = {}
    for x, y, *rest in rows:
        tiles.setdefault((x, y), []).append(rest)
    want = set()
    for tile, labels in tiles.items():
        best = sorted(labels, key=lambda r: (-r[2], r[0]))[:50]
        kept = []
        for fid, name, _, lon, lat in sorted(best, key=lambda r: (-r[2], r[1])):
            if len(kept) < 40 and not any(abs(lon - a) < 8 and abs(lat - b) < 2 for _, a, b in kept):
                kept.append((fid, lon, lat))
        want |= {(*tile, fid) for fid, _, _ in kept}
    assert {tuple(r) for r in QUERIES["decluttered"](spark, "/root/testdata/sf0.001").select("x", "y", "fid").collect()} == want


def test_limits_are_cut_twice(spark, sf):
    """Salted ranking keeps what one ranking keeps; small limits are also cut before the shuffle."""
    from pyspark.sql import functions as F

    from geotiles.functions.policy import osm_policy
    from geotiles.plans import pyramid
    from geotiles.queries.tiles import way_features

    keys = pyramid.tile_rows(way_features(spark, sf), range(9, 11), osm_policy()).withColumn("priority", F.col("fid") % 7)
    one, two = (pyramid.top_per_layer(keys, F.lit(20), most=m).select("z", "x", "y", "fid") for m in (None, 20))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert "WindowGroupLimit" in two._jdf.queryExecution().executedPlan().toString()


def test_shape_stats_of_tiles_beyond_their_budget(spark, tmp_path):
    """7 000 shapes in one place: the SQL drops what the tile budget of z3 drops."""
    spark.range(1, 7001).selectExpr("id * 61200000 AS c_custkey", "'C' AS c_name", "CAST(1.0 AS DECIMAL(15, 2)) AS c_acctbal", "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = sorted(tuple(map(text, r)) for r in QUERIES["shape_stats"](spark, str(tmp_path)).select("x", "y", "original", "dropped", "vertices", "simplified", "tolerance").collect())
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert rows == sorted(tuple(map(text, r)) for r in con.execute(f"SELECT x, y, original, dropped, vertices, simplified, tolerance FROM ({ORACLES['shape_stats']})").fetchall())
    assert sum(int(r[3]) for r in rows) >= 500


def test_features_go_to_the_tiles_whose_buffer_they_touch(spark):
    """Narrow ranges of tiles, narrower than a tile on each side, lose none at any zoom; a ranking of thousands is cut before its shuffle."""
    import random

    from pyspark.sql import functions as F

    from geotiles.functions import tilemath as tm
    from geotiles.functions.policy import osm_policy
    from geotiles.plans import pyramid

    rng = random.Random(5)
    boxes = [(i, lon, lat, lon + rng.choice([0, 3]), lat + rng.choice([0, 2])) for i, (lon, lat) in enumerate((rng.uniform(-180, 177), rng.uniform(-85, 83)) for _ in range(60))]
    boxes += [(100 + i, -180 + 45 * i - 45 / 32, 84.9, -180 + 45 * i - 45 / 32, 85.0) for i in range(1, 8)]
    df = spark.createDataFrame(boxes, "fid long, minx double, miny double, maxx double, maxy double")
    got = pyramid.assign_tiles(df.crossJoin(spark.createDataFrame([(z,) for z in range(6)], "_z int")), F.col("_z")).select("fid", "z", "x", "y")
    every = reduce(lambda a, b: a.union(b), [spark.range(1 << 2 * z).selectExpr(f"{z} AS z", f"id div {1 << z} AS x", f"id % {1 << z} AS y") for z in range(6)])
    q = tm.tile_bbox(F.col("z"), F.col("x"), F.col("y"), tm.BUFFER)
    want = every.withColumn("q", q).join(df, F.expr("maxx >= q.minx AND minx <= q.maxx AND maxy >= q.miny AND miny <= q.maxy")).select("fid", "z", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    f = df.withColumns({"layer": F.lit("roads"), "layer_order": F.lit(0), "props": F.create_map(F.lit("highway"), F.lit("primary")), "geom": F.struct(F.lit("LineString").alias("kind"))})
    keys = pyramid.tile_rows(f, range(9, 12), osm_policy())
    plan = pyramid.limited(keys, osm_policy(), range(9, 12))._jdf.queryExecution().executedPlan().toString()
    assert "3500, Partial" in plan and "REPARTITION_BY_NUM" in plan
