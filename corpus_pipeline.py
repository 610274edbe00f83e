"""The corpus pipeline: five stages, each written as Parquet and read by the next.

Stages get (spark, docs, sf_dir) and decide about every row of ``docs``; all but
the last return its columns, whatever further columns there are and however they
are named.  In every stage a null text is an empty one, texts of any length are
read whole, a null doc_id is an id like others except where a stage says so, and
an empty table gives an empty one with the same columns.  Rows that repeat both
doc_id and text count as one document in the near-dedup stage and are kept as
they are in the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm import decontaminate, mixing, near_dedup, quality, sharding
from marketframe.llm.store import saved
from marketframe.session import ship

SHARDS = 16


def _same(docs: str, other: str) -> Column:
    """Whether a document is the one that a decision is about."""
    return F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & F.xxhash64(F.col(f"{docs}.text")).eqNullSafe(F.col(f"{other}.text_key"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (a score of 0.5 or more).  Rows with equal texts have equal scores and
    stay or go together; null and empty texts get the score of a text without lines; without labels all stay."""
    model = quality.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(model, F.col("text")) >= 0.5)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id (a null one is the last).
    Documents without words are in no group and stay; those without an id, too, since nothing says that two are one.
    Where the least doc_id of a group has several texts, the one with the least hash stays."""
    ship(spark)
    groups = near_dedup.near_groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    one = groups.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.text_key")
    stays = one.union(groups.where("root is null and doc_id is not null").select("doc_id", "text_key")).distinct()
    nameless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    marked = docs.where(~nameless).alias("d").join(stays.alias("s"), _same("d", "s"), "left_semi").select(F.struct("d.*").alias("doc"))
    nth = F.row_number().over(Window.partitionBy("doc.doc_id", F.xxhash64("doc.text")).orderBy(F.lit(1)))
    return marked.withColumn("nth", nth).where("nth = 1").select("doc.*").union(docs.where(nameless))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null and empty texts never are.  Without a benchmark all stay."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return docs.alias("d").join(found.select("doc_id", "text_key").distinct().alias("c"), _same("d", "c"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix sends them, in order of their finish times: a document comes once for each copy, a cut copy
    with its first words.  Null and word-less texts are never sent; repeated rows share what they take together."""
    return mixing.emit(docs, mixing.mix(docs))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot, and the shard with one more of them; rows with equal doc_id go to one shard."""
    return sharding.shard(docs, [1.0] * SHARDS)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup_filter", near_dedup_filter),
    ("decontamination_filter", decontamination_filter),
    ("mix_sources", mix_sources),
    ("shard_documents", shard_documents),
]

#: SQL can't express the trained classifier; tests/llm/test_pipeline.py checks each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
