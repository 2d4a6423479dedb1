"""Durable cut points of long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which every executor and the driver reach; a temporary one only where all run on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        top = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def plain_unions(spark: SparkSession) -> None:
    """Switches zipped unions off for the session.

    Spark 4.1 may zip the partitions of a union's branches; where branches share a reused exchange that is coalesced in one of
    them only, that loses rows or fails with "Can't zip RDDs with unequal numbers of partitions".  It is read when a plan is
    executed, so it must be off before the first cut of a plan, not only where the last union is made.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh folder and read back; lost executors cost nothing that is written."""
    plain_unions(df.sparkSession)
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled = True
    return out


def running_totals(df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], **amounts: Column) -> DataFrame:
    """Adds for each name the sum of its amount over the rows of the group that come before in the order.

    Two levels: rows are dealt to tasks by ranges of (group, order), which are balanced by rows whatever the values; totals of
    these stretches are summed first, and a window runs inside a stretch only.  No group meets in one task.  The order must be unique in a group.
    """
    dealt = settled(df.withColumns({f"_{k}": v for k, v in amounts.items()}).repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "stretches")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy(*group, "_p").agg(*[F.sum(f"_{k}").alias(f"_{k}_all") for k in amounts])
    # one row a stretch and group
    ahead = Window.partitionBy(*group).orderBy("_p") if group else Window.orderBy("_p")
    starts = totals.select(*group, "_p", *[before(f"_{k}_all", ahead).alias(f"_{k}_start") for k in amounts])
    inside = Window.partitionBy(*group, "_p").orderBy(*order)
    met = dealt.withColumns({k: before(f"_{k}", inside) for k in amounts}).join(starts, [*group, "_p"])
    return met.withColumns({k: F.col(k) + F.col(f"_{k}_start") for k in amounts}).drop("_p", *[x for k in amounts for x in (f"_{k}", f"_{k}_start")])
