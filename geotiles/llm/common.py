"""Column helpers and durable cut points shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside these six; null text has none.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: str | Column = "text") -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(text_or_empty(col), GAP), lambda w: w != "")


def word_count(col: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The quarter of documents that no model may learn from (null id: never held out)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content, never null; equal rows share it."""
    return F.xxhash64(*cols)


def content_key(*cols: str) -> Column:
    """128-bit key of a row's content, never null; equal rows share it, and no two others do in practice."""
    parts = []
    for c in cols:
        said = F.col(f"`{c}`").cast("string")
        parts.append(F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.length(said).cast("string"), F.lit(":"), said)))
    return F.unhex(F.md5(F.concat_ws(";", *parts).cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach; a temporary one only where all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
