"""From raw documents to packed training bins, stage by stage; every stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmart.llm import langid, near, packing, quality, substring
from sparkmart.llm.common import Scratch, swept
from sparkmart.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what the model rejects goes."""
    ship(spark)
    return langid.kept(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own and their host's rules."""
    ship(spark)
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows of the group that repeat its id stay with it.

    Links are the SimHash operator's, decided by the whole sets, and those that an exact way adds (`near`).

    Rows are told apart by id and text, so a row stays or goes with its own text's group, whatever other texts its
    id has. A row without an id goes if its group has an id; of a group without any, the row with the least text
    stays (of equal ones the least in the other columns, in their order), and it alone.
    """
    swept(ship(spark))
    scratch = Scratch(spark)
    groups = scratch.write(near.groups(docs), "groups")
    losers = scratch.write(groups.where("least < id").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct(), "losers")
    bare = scratch.write(groups.where("id is null and least is null").select(F.col("h").alias("__h"), F.col("component").alias("__component")).distinct(), "bare")
    with_id = docs.where("doc_id is not null")
    # only rows that may be losers are dealt out; the others stay where they were read
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    may, others = near.sifted(with_id, key, losers.select(F.xxhash64("__id", "__h").alias("key")))
    kept = others.unionByName(may.join(losers, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left_anti"))
    # each task passes on one row of a group only (a window's group limit), so a large group is no large partition
    first = F.row_number().over(Window.partitionBy("__component").orderBy("text", *(f"`{c}`" for c in docs.columns)))
    without = docs.where("doc_id is null").join(bare, F.xxhash64("text") == F.col("__h")).withColumn("__first", first).where("__first = 1")
    return kept.unionByName(without.select(*(f"`{c}`" for c in docs.columns)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has too."""
    swept(ship(spark))
    return substring.dedup(docs)


def packing_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins."""
    swept(ship(spark))
    return packing.packed(docs)


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing_bins)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    scratch = Scratch(ship(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
