"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage calls one operator of ``ledgerline.llm`` on everything its
predecessor kept, and returns the columns of ``documents``, whatever others
there are and however they are named; the last adds the place of each row.

Defined results, for every stage: an empty table gives no rows; rows with a
null or empty text pass the quality stage if the labelled rows' share of
label 1 does, become one row at near-duplicates, hold no benchmark item, and
are of size 0 to the mix, which takes each as often as its source's rate says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontam, mixing, quality_knn, sharding, similar_texts
from ledgerline.llm.queries import map_path
from ledgerline.llm.storage import drop_path, released, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of their latent-semantic vector don't reject.

    Repeated rows are judged alike; neighbours that tie count in the order of
    their ids; without labels every score is 0.5 and all stay.
    """
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_knn.accepted(docs, quality_knn.fit(documents, labels, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of similar texts.

    Repeated rows are a group; of rows with the least id those whose text has
    the least hash tie, and one of them stays; null ids come last.
    """
    return similar_texts.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; repeated rows share their fate, without items all stay."""
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: every document as often as it is taken.

    Rows alike in id, source and text share their copies in the order of a
    hash of all columns; a null source is a source of its own.
    """
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of every row, and its size, text_crc32, vslot, shard, place and map_version.

    The map of slots is stored in the shared folder and edited by later runs;
    repeated rows get places of their own; names that clash get underscores.
    """
    return sharding.assign_shards(docs, 16, map_path=map_path(spark, f"pipeline {sf_dir}"), keep=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]
#: Votes of a fitted model and MinHashes are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before kept; what a stage leaves behind goes when it is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
