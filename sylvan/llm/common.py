"""Shared-folder tables, whole-row filters and connected components used by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, and the master local, one temporary folder a session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="sylvan-")
    return _fallback[app]


class Scratch:
    """Tables written once to the shared folder and read back: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        self.paths.discard(df.scratch_path)
        remove(self.spark, df.scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        for path in self.paths - {t.scratch_path for t in tables}:
            self.paths.discard(path)
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm, p = spark.sparkContext._jvm, None
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With the id, what names a row: ids may repeat with other texts."""
    return F.xxhash64(text_of(column))


SIEVE_WORDS = 1 << 18  # rows of the bit table of a sieve, of 64 bits each: what is broadcast, at any size


def sieve(wanted: DataFrame, column: str) -> DataFrame:
    """(sieve_word__, sieve_bits__): a bit table of a hash of a column, of at most SIEVE_WORDS rows.

    It tells rows that may have one of the wanted values from rows that have
    none, so that only the former are shuffled. The more values there are the
    fuller it gets; full, it lets all rows through.
    """
    h = F.xxhash64(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    return wanted.select((h.bitwiseAND(F.lit(SIEVE_WORDS - 1))).cast("int").alias("sieve_word__"), bit.alias("b")).groupBy("sieve_word__").agg(F.bit_or("b").alias("sieve_bits__"))


def sieved(rows: DataFrame, value: Column, bits: DataFrame, column: str) -> DataFrame:
    """rows and, in ``column``, whether the value may be one that the sieve was made of."""
    h = F.xxhash64(value)
    marked = rows.withColumn("sieve_hash__", h).withColumn("sieve_at__", F.col("sieve_hash__").bitwiseAND(F.lit(SIEVE_WORDS - 1)).cast("int"))
    # At most SIEVE_WORDS rows of two numbers: a proven bound.
    x = marked.join(F.broadcast(bits), F.col("sieve_at__") == F.col("sieve_word__"), "left")
    hit = F.call_function("shiftrightunsigned", F.coalesce("sieve_bits__", F.lit(0).cast("long")), F.shiftrightunsigned("sieve_hash__", 58).cast("int")).bitwiseAND(F.lit(1)) == 1
    return x.select(*rows.columns, hit.alias(column))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_key) is not in ``dropped``, a written table.

    Rows that a sieve of the dropped keys clears go straight out; the others
    are decided by a shuffle join, at every size the same. A row is named by
    its id and a 64-bit hash of its text: rows of one id whose unlike texts
    agree in it would go together.
    """
    bits = sieve(dropped, "text_key")
    x = sieved(docs.withColumn("text_key__", text_key()), F.col("text_key__"), bits, "maybe__")
    d = dropped.select(F.col("doc_id").alias("dropped_doc_id__"), F.col("text_key").alias("dropped_text_key__")).hint("merge")
    asked = x.where("maybe__")
    on = asked["doc_id"].eqNullSafe(d["dropped_doc_id__"]) & (asked["text_key__"] == d["dropped_text_key__"])
    return x.where("not maybe__").select(docs.columns).unionByName(asked.join(d, on, "left_anti").select(docs.columns))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reached.

    Alternating large-star and small-star steps, each a written table. Per
    node only a minimum is aggregated, so a node with very many edges is
    combined on the map side and its join can be split. Ends when a round
    leaves the edge set unchanged.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = scratch.table(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = scratch.table(small, "small")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(large)
        scratch.drop(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
