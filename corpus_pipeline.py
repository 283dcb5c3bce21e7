"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm.common import Scratch
from sylvan.llm.decontaminate import drop_contaminated
from sylvan.llm.exact_dedup import drop_exact_copies
from sylvan.llm.near_dedup import drop_near_copies
from sylvan.llm.packing import best_fit_packing
from sylvan.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document, encoded, lies in which sequence."""
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: A fitted classifier and packing in shards: SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the rows of the last, one for each piece of each document kept.

    Null texts are empty in every stage; empty texts are equal, so one of them
    is kept. Repeated rows count as copies. Stages keep all columns, clashing
    names too, until the last. An empty table gives no rows; without labels
    nothing is toxic, without benchmark items nothing contaminated. A stage's table goes when the next one's is whole.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        new = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if hasattr(docs, "scratch_path"):
            scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
