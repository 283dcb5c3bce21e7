"""Exact deduplication over content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so. A chunk is
named by a 64-bit digest; the chunk table then verifies every digest against
the SHA-256 of the chunks that bear it and gives those that clash ranks, so an
identifier (digest, rank) stands for one content. Texts are equal when their
ordered identifier lists are. Only digests travel; no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_key, text_of, without_rows

GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW_STEPS = 5  # the rolling hash covers 2**5 bytes


def cut_points(data: bytes, least: int = 512, mean_bits: int = 11, most: int = 8192) -> list[int]:
    """Ends of the chunks of ``data``; where they lie depends on the 32 bytes before each only, within the limits."""
    n = len(data)
    if n <= least:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in range(WINDOW_STEPS):
        s = 1 << k
        h[s:] += h[:-s] << np.uint32(s)
    marks = np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1
    ends, last, i = [], 0, 0
    while n - last > least:
        i = int(np.searchsorted(marks, last + least))
        end = min(int(marks[i]) if i < len(marks) else n, last + most, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch], digest_bits: int) -> Iterator[pa.RecordBatch]:
    drop = 64 - digest_bits
    for batch in batches:
        sha, digests, checks = [], [], []
        for text in batch.column("t").to_pylist():
            data = text.encode("utf-8", "surrogatepass")
            sha.append(hashlib.sha256(data).hexdigest())
            ds, cs, last = [], [], 0
            for end in cut_points(data):
                part = data[last:end]
                ds.append((xxhash.xxh64_intdigest(part) >> drop) - (1 << 63 if drop == 0 else 0))
                cs.append(hashlib.sha256(part).digest())
                last = end
            digests.append(ds)
            checks.append(cs)
        keep = [batch.column(c) for c in ("uid", "doc_id", "text_key")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(sha, pa.string()), pa.array(digests, pa.list_(pa.int64())), pa.array(checks, pa.list_(pa.binary()))],
            ["uid", "doc_id", "text_key", "text_sha256", "digests", "checks"],
        )


def exact_dedup(docs: DataFrame, digest_bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """Groups of equal texts: one row per row of docs, dropped ones too.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, n_chunks,
    text_key. Texts are compared as they are, in UTF-8; null counts as empty,
    and empty texts are equal. Of a group the row with the largest doc_id is
    kept; a null doc_id counts as smallest, and of rows that repeat the
    largest doc_id one is kept. Other columns of docs are ignored; an empty
    table gives no rows. ``digest_bits`` is for tests of clashing digests.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact_dedup")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("t"))
    recipes = scratch.table(
        rows.mapInArrow(
            lambda it: _recipes(it, digest_bits),
            "uid long, doc_id long, text_key long, text_sha256 string, digests array<long>, checks array<binary>",
        ),
        "recipes",
    )
    parts = recipes.select("uid", F.posexplode(F.arrays_zip("digests", "checks")).alias("pos", "c")).select("uid", "pos", F.col("c.digests").alias("digest"), F.col("c.checks").alias("check"))
    store = parts.select("digest", "check").distinct()
    clashing = store.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    ranks = scratch.table(
        store.join(clashing, "digest").select("digest", "check", F.row_number().over(W.partitionBy("digest").orderBy("check")).alias("rank")), "clashes"
    )
    named = parts.join(ranks, ["digest", "check"], "left").select("uid", "pos", "digest", F.coalesce("rank", F.lit(0)).alias("rank"))
    lists = named.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "rank"))).alias("l"))
    lists = lists.select("uid", F.transform("l", lambda x: F.struct(x["digest"].alias("digest"), x["rank"].alias("rank"))).alias("recipe"))
    told = scratch.table(recipes.drop("digests", "checks").join(lists, "uid"), "lists")
    groups = told.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", (-F.col("uid")).alias("u"))).alias("keep"))
    # Written, so that both sides of the join are plain shuffles, which Spark splits where a recipe is frequent.
    groups = scratch.table(groups, "groups")
    scratch.keep(told, groups)
    return told.join(groups, "recipe").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == -F.col("keep.u")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
        "text_key",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    found = scratch.table(exact_dedup(docs, scratch=scratch).select("doc_id", "keep_id", "kept", "text_key"), "found")
    again = scratch.table(found.where("not kept and doc_id <=> keep_id").select("doc_id", "text_key").distinct(), "again")
    gone = scratch.table(found.where("not kept and not doc_id <=> keep_id").select("doc_id", "text_key").distinct(), "gone")
    scratch.keep(again, gone)
    out = without_rows(docs, gone)
    if again.isEmpty():
        return out
    # Rows that repeat both id and text: nothing but their place tells them apart, so one of each is taken.
    key = [F.col("doc_id"), text_key()]
    alike = docs.join(again.select(F.col("doc_id").alias("again_doc_id__"), F.col("text_key").alias("again_text_key__")), F.col("doc_id").eqNullSafe(F.col("again_doc_id__")) & (text_key() == F.col("again_text_key__")), "left_semi")
    one = alike.withColumn("row__", F.row_number().over(W.partitionBy(*key).orderBy(*key))).where("row__ = 1").drop("row__")
    return without_rows(out, again).unionByName(one)
