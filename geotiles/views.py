"""Geospatial views over star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.scratch import plain_unions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    # city-sized box
    "geo_nodes": """SELECT p_partkey AS id,
  -3.9 + CAST((p_partkey*7919) % 4000 AS DOUBLE)/10000.0 AS lon,
  40.3 + CAST((p_partkey*104729) % 3000 AS DOUBLE)/10000.0 AS lat FROM part""",
    "geo_way_refs": """SELECT way_id, ref, row_number() OVER (PARTITION BY way_id ORDER BY ln, ref, src) AS pos
  FROM (SELECT l_orderkey AS way_id, l_partkey AS ref, l_linenumber AS ln,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey
                       ORDER BY l_suppkey, l_quantity, l_extendedprice) AS src FROM lineitem) t""",
    "geo_ways": """SELECT o_orderkey AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary'
    WHEN '3-MEDIUM' THEN 'tertiary' WHEN '4-NOT SPECIFIED' THEN 'residential' ELSE 'footway' END AS highway,
  CASE WHEN o_orderkey % 4 = 0 THEN 'yes' END AS building, o_orderkey % 4 = 0 AS closed,
  CASE WHEN o_orderkey % 7 = 0 THEN 'water' WHEN o_orderkey % 11 = 0 THEN 'coastline' WHEN o_orderkey % 13 = 0 THEN 'wood' END AS natural_,
  CASE WHEN o_orderkey % 9 = 0 THEN 'industrial' END AS landuse,
  CASE WHEN o_orderkey % 17 = 0 THEN 'runway' END AS aeroway,
  o_orderstatus AS name FROM orders""",
    "geo_relation_members": """SELECT c_custkey AS rel_id, o_orderkey AS ref,
  CASE WHEN o_orderkey % 5 = 0 THEN 'inner' ELSE 'outer' END AS role,
  row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS pos
  FROM customer JOIN orders ON o_custkey = c_custkey""",
    # world-wide points
    "geo_points": """SELECT c_custkey AS fid,
  CAST((c_custkey*7919) % 3600000 AS DOUBLE)/10000.0 - 180.0 AS lon,
  CAST((c_custkey*104729) % 1700000 AS DOUBLE)/10000.0 - 85.0 AS lat,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'townhall' WHEN 'AUTOMOBILE' THEN 'fuel'
    WHEN 'MACHINERY' THEN 'warehouse' WHEN 'HOUSEHOLD' THEN 'restaurant' ELSE 'hospital' END AS amenity,
  CAST(c_acctbal AS DOUBLE) AS priority, c_name AS name FROM customer""",
    # dense observations with zoom windows
    "geo_obs": """SELECT event_id AS fid,
  -3.9 + CAST((event_id*7919) % 4000 AS DOUBLE)/10000.0 AS lon,
  40.3 + CAST((user_id*104729) % 3000 AS DOUBLE)/10000.0 AS lat,
  event_type AS kind, CAST(value AS DOUBLE) AS value,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 8 END AS first_zoom,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE 8 + user_id % 8 END AS last_zoom FROM events""",
    # footprints, 10 degrees square
    "geo_boxes": """SELECT s_suppkey AS fid, lon-5.0 AS minx, lat-5.0 AS miny, lon+5.0 AS maxx, lat+5.0 AS maxy
  FROM (SELECT s_suppkey, CAST((s_suppkey*360007) % 3500000 AS DOUBLE)/10000.0 - 175.0 AS lon,
    CAST((s_suppkey*104729) % 1600000 AS DOUBLE)/10000.0 - 80.0 AS lat FROM supplier) t""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the tables its SQL names are read."""
    import re

    sql, used = VIEWS[name], {}
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
            used[t] = table(spark, sf_dir, t)
    return spark.sql(sql, **used)


def with_views(*names: str) -> str:
    """The same views as a WITH clause for other engines."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
