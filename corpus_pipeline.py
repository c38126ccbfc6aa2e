"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again. ``run`` applies them to the documents of sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import near_dup, packing, pii, quality, repeats
from linkloom.llm._run import Scratch
from linkloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go."""
    return quality.kept_rows(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the least id stays."""
    return near_dup.kept_rows(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 400 bytes that repeat, and passages of over 50 words that do, are cut out of the texts."""
    return repeats.kept_rows(docs, words=51).withColumn("n_chars", F.length("text").cast("long"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences of at most 2048 tokens."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("repeats", repeats_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: The stages (robust estimates, similarity classes, token ids) can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as own:
        before = None
        for name, stage in STAGES[:-1]:
            docs = own.settle(stage(spark, docs, sf_dir), name)
            if before is not None:
                own.drop(before)
            before = docs
        return STAGES[-1][1](spark, docs, sf_dir)
