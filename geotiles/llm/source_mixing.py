"""Mixing sources to target weights by Sainte-Lague apportionment of equal word blocks.

1. Sizes: words per document, counted once and written without the texts, summed per source (map-side combined).
2. Targets: the wanted total is shared by weight; a source stops at ``max_epochs``
   times its size and its excess is reshared by weight until none is above.
   Each round is one aggregate row over the sources table; it ends when no further source is full.
3. Quotas: the mix is cut into shards of equal numbers of blocks.  Seats go to
   the highest quotients target / (2k + 1); since the method is house-monotone,
   a shard's integer quotas are the seats up to its end less those up to its
   start.  Seats are found by rounding and a window over the few seats around the
   rounded share, so no seat list is ever built.
4. Selection: a source's documents stand in seeded order (md5 of seed and id, then size, then content), cut
   into blocks of ``block`` words.  Shard after shard takes the source's next
   blocks, starting over when they end.

Ranks of sources and positions of documents are counted over range partitions: rows are sorted into
stretches of equal size, written with their stretch, and what stands before a stretch is summed
over stretches.  No source, leading character or id gathers in one task.

Defined results: null text has no words and is never taken; a null source is a
source of its own, last; ids may repeat or be null (rows equal in id and text are interchangeable, others never tie); very
long texts only count; an empty table gives an empty mix; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_count, written


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources by code point, repeating
    share: float = 1.5  # of all words
    max_epochs: int = 2
    block: int = 32  # words
    shards: int = 16
    seed: str = "mix-1"


def sized(docs: DataFrame, spec: MixSpec, text: str = "text", id_col: str = "doc_id",
          source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, source, size, key, tie): what the mix needs of a document, without its text; written."""
    return written(docs.select(
        F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("source"),
        word_count(text).alias("size"),
        F.md5(F.concat(F.lit(spec.seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
              .cast("binary")).alias("key"), F.xxhash64(f"`{id_col}`", f"`{text}`").alias("tie")), "sized")


def _stretched(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with the number of the stretch of the given order that holds them; written, as the bounds are drawn at random."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("stretch", F.spark_partition_id()), "stretched")


def _ranked(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """Weight by position in code-point order, null last."""
    part = _stretched(sources.withColumn("last", F.col("source").isNull()), "last", "source")
    counts = part.groupBy("stretch").agg(F.count("*").alias("n"))
    before = counts.select("stretch", F.coalesce(F.sum("n").over(
        Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("stretch").orderBy("last", "source")) - 1
    weight = F.array(*[F.lit(w).cast("long") for w in spec.weights])
    return (part.withColumn("place", place).join(before, "stretch")
            .withColumn("rank", F.col("before") + F.col("place"))
            .withColumn("weight", F.get(weight, (F.col("rank") % len(spec.weights)).cast("int")))
            .select("source", "source_size", "rank", "weight"))


def targets(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size)."""
    ranked = written(_ranked(sources, spec), "sources")
    cap = F.col("source_size") * spec.max_epochs
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, full, n = spec.share * total, None, F.lit(False), -1
    while True:
        row = ranked.agg(
            F.sum(F.when(full, cap).otherwise(F.lit(0))).alias("caps"),
            F.sum(F.when(full, F.lit(0)).otherwise(F.col("weight"))).alias("weights"),
            F.sum(full.cast("long")).alias("n")).first()
        if not row["weights"] or row["n"] == n:
            break
        n, level = row["n"], (wanted - row["caps"]) / row["weights"]
        full = cap < F.lit(level) * F.col("weight")
    share = F.lit(0.0) if level is None else F.lit(float(level)) * F.col("weight")
    return ranked.withColumn("target", F.when(full, cap.cast("double")).otherwise(share))


def shard_quotas(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, shard, quota, taken_before): integer blocks of every source in every shard."""
    row = sources.agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    total, n = row["t"] or 0.0, row["n"]
    seats = int(total / spec.block + 0.5)
    ends = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(seats * (s + 1) // spec.shards).cast("long").alias("house"))
                     for s in range(spec.shards)])
    near = sources.where("target > 0").select("source", "rank", "target", F.explode(ends).alias("e")).select(
        "source", "rank", "target", "e.*")
    # rounding the ideal share seats all but a few; only the seats around it need ranking
    ideal = F.col("target") * F.col("house") / F.lit(total or 1.0)
    slack = (F.ceil(F.col("target") * F.lit(float(n)) / F.lit(total or 1.0)) + 1).cast("long")
    near = near.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.floor(ideal).cast("long") - slack)).withColumn(
        "hi", F.floor(ideal).cast("long") + slack)
    seat = near.select("source", "rank", "target", "shard", "house", "lo",
                       F.explode(F.sequence("lo", "hi")).alias("k"))
    sure = near.groupBy("shard").agg(F.sum("lo").alias("sure"))
    order = Window.partitionBy("shard").orderBy((2 * F.col("k") + 1) / F.col("target"), "rank")
    won = (seat.withColumn("place", F.row_number().over(order)).join(sure, "shard")
           .where(F.col("place") <= F.col("house") - F.col("sure"))
           .groupBy("rank", "shard").agg(F.count("*").alias("more")))
    upto = near.select("source", "rank", "shard", "lo").join(won, ["rank", "shard"], "left").select(
        "source", "rank", "shard", (F.col("lo") + F.coalesce("more", F.lit(0))).alias("upto"))
    line = Window.partitionBy("rank").orderBy("shard")
    before = F.coalesce(F.lag("upto").over(line), F.lit(0))
    return upto.select("source", "rank", "shard", (F.col("upto") - before).alias("quota"), before.alias("taken_before"))


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``start``: words of the source that stand before the document in seeded order."""
    part = _stretched(rows, "source", "key", "size", "tie")
    total = part.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    # a stretch holds few sources and a source stands in neighbouring stretches: this table has at most sources + stretches rows
    before = total.select(F.col("source").alias("src"), F.col("stretch").alias("at"), F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source", "stretch").orderBy("key", "size", "tie").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return (part.withColumn("within", within)
            .join(before, part["source"].eqNullSafe(before["src"]) & (F.col("stretch") == F.col("at")))
            .withColumn("start", F.col("within") + F.col("before")).drop("stretch", "at", "src", "within", "before", "tie"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), text: str = "text", id_col: str = "doc_id",
        source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, source, size, source_size, target, blocks, taken): one row per document.

    ``blocks`` is the source's quota over all shards; the words taken are those of
    the source's first ``blocks`` blocks in seeded order, counted again from the
    start when the source ends.
    """
    rows = sized(docs, spec, text, id_col, source, keep)
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), spec)
    goal = written(goal, "targets")
    quota = shard_quotas(goal, spec).groupBy("rank").agg(F.sum("quota").alias("blocks"))
    goal = goal.join(quota, "rank", "left").select(
        F.col("source").alias("_source"), "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    placed = _positions(rows)
    joined = placed.join(goal, placed["source"].eqNullSafe(goal["_source"])).drop("_source")
    block = F.lit(spec.block).cast("long")
    per_epoch = F.ceil(F.col("source_size") / block).cast("long")
    taken = F.lit(0).cast("long")
    for epoch in range(spec.max_epochs):
        words = F.greatest(F.lit(0).cast("long"), F.col("blocks") - per_epoch * epoch) * block
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - F.col("start")))
    return joined.select(id_col, *keep, "source", "size", "source_size", "target", "blocks", taken.alias("taken"))


def block_plan(docs: DataFrame, spec: MixSpec = MixSpec(), text: str = "text", id_col: str = "doc_id",
               source: str = "source") -> DataFrame:
    """(shard, source, first_block, n_blocks): the stretch of a source's block sequence that a shard takes."""
    rows = sized(docs, spec, text, id_col, source)
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), spec)
    return shard_quotas(written(goal, "targets"), spec).select(
        "shard", "source", F.col("taken_before").alias("first_block"), F.col("quota").alias("n_blocks"))
