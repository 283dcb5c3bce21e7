"""The queries of this subpackage and, where DuckDB can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, warc
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .near_dedup import near_dedup
from .packing import best_fit_packing
from .quality import quality
from .secrets import secret_scan
from .tokens import token_counts
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key", "n_chunks")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_extra(table(spark, sf_dir, "conversations"))))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_toxicity,
        op3_exact_dedup,
        op4_quality_classifier,
        op5_benchmark_decontamination,
        op6_secret_scan,
        op7_best_fit_packing,
        op8_chat_formatting,
        op9_warc,
        op10_token_counts,
    )
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op8_chat_formatting": chat.SQL, "op9_warc": warc.SQL}
