"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``.  Nulls, repeated rows and empty tables are handled as
the operators' docstrings say; rows that are equal in all columns are one document
from the near-duplicate stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotiles.llm import line_dedup, quality_rules, sentencepiece_codec, simhash_dedup, source_mixing
from geotiles.llm.common import content_key, text_or_empty, word_count, written
from geotiles.llm.queries import model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word that pass every rule of strict.v3 (shortness alone rejects none)."""
    ledger = quality_rules.rule_ledger(docs.select(*COLUMNS))
    return ledger.where(quality_rules.passes("strict.v3") & (F.col("n_words") > 0)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur elsewhere before them; those left without a word go."""
    kept = line_dedup.drop_recurring_lines(docs.select(*COLUMNS))
    return kept.where((F.col("n_dropped") == 0) | text_or_empty("text").rlike(r"[^\x20\x09-\x0D]")).select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (five-word shingle sets, Jaccard >= 0.8)."""
    keyed = docs.select(*COLUMNS, content_key(*COLUMNS).alias("key"))
    groups = simhash_dedup.similar_groups(keyed, "key", keep=("doc_id",))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("key"))).alias("b")
    winners = written(groups.groupBy("group").agg(best).select(F.col("b.key").alias("key")), "winners")
    return keyed.join(winners, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (nearest whole number of passes).

    Rounding moves a source from its target by less than one of its documents.
    """
    keyed = docs.select(*COLUMNS, content_key(*COLUMNS).alias("key"))
    mixed = source_mixing.mix(keyed.withColumnRenamed("key", "content"), keep=("content",))
    times = mixed.groupBy(F.col("content").alias("key")).agg(F.sum(F.when(
        F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).cast("int").alias("times"))
    chosen = keyed.dropDuplicates(["key"]).join(written(times.where("times > 0"), "times"), "key")
    return chosen.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_words, n_tokens, ids_sha256, decoded_sha256) of every document of the mix."""
    counted = docs.select("doc_id", "lang", "source", word_count("text").alias("n_words"), "text")
    return sentencepiece_codec.round_trip_digests(counted, model_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("source_mixing", mixing),
    ("sentencepiece", tokens),
]

#: No SQL: it cannot express the merges of the last stage.  tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
