"""Streams into a forest. The engine's logs are ordered streams with positions; these are additions of our own.

A log grows by micro-batches, each numbered after what is there; sum and count
trees follow a stream of elements by an aggregation in update mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import binary, path_literal, tree_id
from ..operators.logs import append
from ..sources.store import LOG_SCHEMA


def log_writer(values: DataFrame, path: Sequence[bytes], folder: str, checkpoint: str, order: Sequence[str]) -> StreamingQuery:
    """Appends a stream of rows (value and the columns of ``order``) to the log at ``path`` in ``folder``.

    Each micro-batch is written to a folder of its own number: one run again
    after a failure overwrites itself and takes the same positions, because it
    counts only the batches before it.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        log = read_log(spark, folder).where(F.col("batch") < number).drop("batch") if number else spark.createDataFrame([], LOG_SCHEMA)
        append(log, path, batch, [F.asc(c) for c in order]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return values.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark, folder: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA + ", batch bigint").parquet(folder)


def live_sums(elements: DataFrame, watermark: str | None = None, window: str | None = None, time: str = "ts") -> DataFrame:
    """Sums and counts of a stream of elements (path, sum_value) by tree, kept up to date; by time windows if given."""
    keys: list[Column] = [F.col("path")]
    if watermark:
        elements = elements.withWatermark(time, watermark)
    if window:
        keys.append(F.window(time, window).alias("window"))
    return elements.groupBy(*keys).agg(F.sum("sum_value").alias("sum_value"), F.count("*").alias("count_value"))


def as_elements(rows: DataFrame, path: Sequence[bytes], key: Column, value: Column) -> DataFrame:
    """A stream of elements of one level of trees: path, a tree by ``key``, and the value."""
    p = F.concat(path_literal(tuple(path)), F.array(key))
    return rows.select("*", tree_id(p).alias("tree_id"), p.alias("path"), value.cast("bigint").alias("sum_value"))


def tree_key(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), binary(b""))
