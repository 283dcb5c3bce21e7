"""References between elements, followed by joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorruptedReferencePathKeyNotFound, CyclicReference, InvalidInput, ReferenceLimit
from ..functions.hashing import value_hashes
from ..functions.serde import of_row
from ..model import ABSOLUTE, COUSIN, ELEMENT_COLUMNS, REFERENCE, REMOVED_COUSIN, SIBLING, UPSTREAM_ELEMENT, UPSTREAM_ROOT, UPSTREAM_ROOT_WITH_PARENT, target, tree_id
from ..sources.store import written

MAX_HOPS = 10  # raw reads in one chain
STATES = {1: InvalidInput, 2: CyclicReference, 3: CorruptedReferencePathKeyNotFound, 4: ReferenceLimit}


def follow(rows: DataFrame, nodes: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """rows (with path, key and element columns) and where their references lead.

    Adds at_path, at_key (of the element found), hops, ref_state (0: found;
    1: the kind cannot be satisfied; 2: a cycle; 3: nothing there; 4: too many
    hops); element columns become those of the element found. Each hop is one
    equi-join of the rows that still are references, written once; it ends
    when none is.
    """
    plain, ended = _followed(rows, nodes, max_hops)
    return reduce(DataFrame.unionByName, ended, plain)


def _followed(rows: DataFrame, nodes: DataFrame, max_hops: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows that are no references, those that were, by hop)"""
    extra = [c for c in rows.columns if c not in ELEMENT_COLUMNS]
    plain = rows.where(F.col("element_type") != REFERENCE).select(*extra, *ELEMENT_COLUMNS, F.col("path").alias("at_path"), F.col("key").alias("at_key"), F.lit(0).alias("hops"), F.lit(0).alias("ref_state"))
    open_ = rows.where(F.col("element_type") == REFERENCE).select(*extra, *ELEMENT_COLUMNS, F.col("path").alias("at_path"), F.col("key").alias("at_key"), F.array(F.concat("path", F.array("key"))).alias("seen"))
    look = nodes.select(F.col("tree_id").alias("t_id"), F.col("path").alias("t_path"), F.col("key").alias("t_key"), *(F.col(c).alias(f"t_{c}") for c in ELEMENT_COLUMNS))
    ended: list[DataFrame] = []
    for hop in range(1, max_hops + 1):
        to = open_.withColumn("to", target(F.col("at_path"), F.col("at_key"), F.col("ref")))
        to = to.withColumn("to_path", F.when(F.size("to") > 0, F.slice("to", 1, F.size("to") - 1))).withColumn("to_key", F.when(F.size("to") > 0, F.element_at("to", -1)))
        to = to.withColumn("cycle", F.array_contains("seen", F.col("to"))).withColumn("to_id", tree_id(F.col("to_path")))
        hit = to.join(look, (F.col("to_id") == F.col("t_id")) & (F.col("to_path") == F.col("t_path")) & (F.col("to_key") == F.col("t_key")) & ~F.coalesce("cycle", F.lit(False)), "left")
        state = F.when(F.col("to_key").isNull(), 1).when(F.col("cycle"), 2).when(F.col("t_key").isNull(), 3).when((F.col("t_element_type") == REFERENCE) & F.lit(hop == max_hops), 4).when(F.col("t_element_type") != REFERENCE, 0)
        hit = written(hit.withColumn("ref_state", state), "hop")
        new = [F.when(F.col("t_key").isNotNull(), F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in ELEMENT_COLUMNS]
        ended.append(hit.where("ref_state is not null").select(*extra, *new, F.coalesce("t_path", "at_path").alias("at_path"), F.coalesce("t_key", "at_key").alias("at_key"), F.lit(hop).alias("hops"), "ref_state"))
        left = hit.where("ref_state is null")
        if left.isEmpty():
            break
        open_ = left.select(*extra, *(F.col(f"t_{c}").alias(c) for c in ELEMENT_COLUMNS), F.col("t_path").alias("at_path"), F.col("t_key").alias("at_key"), F.concat("seen", F.array("to")).alias("seen"))
    return plain, ended


def resolve(rows: DataFrame, nodes: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """follow, and an error where a reference leads nowhere: that of the first such row."""
    plain, ended = _followed(rows, nodes, max_hops)
    bad = reduce(DataFrame.unionByName, [e.where("ref_state > 0").select("ref_state", "path", "key") for e in ended]).orderBy("path", "key").first()
    if bad:
        raise STATES[bad["ref_state"]](f"reference at {[bytes(p) for p in bad['path']]} / {bytes(bad['key'])}")
    return reduce(DataFrame.unionByName, ended, plain)


def target_value_hashes(rows: DataFrame, nodes: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """rows of references with value_hash, that of the element each leads to in at most the hops it allows (and max_hops)."""
    limited = rows.withColumn("hops_allowed", F.coalesce(F.col("max_hops").cast("int"), F.lit(max_hops)))
    found = resolve(limited, nodes, max_hops)
    if bad := found.where("hops > hops_allowed").select("path", "key").first():
        raise ReferenceLimit(f"reference at {bad['path']} / {bytes(bad['key'])}")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = value_hashes([of_row(r) for r in batch.to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "key", "hops")), pa.array(h, pa.binary())], ["path", "key", "hops", "value_hash"])

    return found.select("path", "key", "hops", *ELEMENT_COLUMNS).mapInArrow(hashed, "path array<binary>, key binary, hops int, value_hash binary")


def absolute(rows: DataFrame) -> DataFrame:
    """rows with relative references rewritten as absolute ones."""
    is_ref = F.col("element_type") == REFERENCE
    segs = target(F.col("path"), F.col("key"), F.col("ref"))
    ref = F.struct(F.lit(ABSOLUTE).cast("tinyint").alias("kind"), F.lit(0).cast("tinyint").alias("n"), segs.alias("segs"))
    return rows.withColumn("ref", F.when(is_ref, ref).otherwise(F.col("ref")))


def inverse(path: Column, key: Column, ref: Column) -> Column:
    """The reference that leads back from where ``ref`` at (path, key) points; null where its kind has none."""
    kind, n, segs = ref["kind"], ref["n"], ref["segs"]
    size = F.size(path)
    here = F.concat(path, F.array(key))
    last = F.element_at(path, -1)

    def made(k: int | Column, steps: Column, parts: Column) -> Column:
        k = k if isinstance(k, Column) else F.lit(k)
        return F.struct(k.cast("tinyint").alias("kind"), steps.cast("tinyint").alias("n"), parts.cast("array<binary>").alias("segs"))

    zero = F.lit(0)
    below = F.slice(here, F.least(n.cast("int"), size) + 1, F.greatest(size + 1 - n.cast("int"), zero))
    return (
        F.when(kind == ABSOLUTE, made(ABSOLUTE, zero, here))
        .when((kind == UPSTREAM_ROOT) & (n <= size), made(UPSTREAM_ROOT, n, below))
        .when((kind == UPSTREAM_ROOT_WITH_PARENT) & (n <= size) & (size > 0), made(UPSTREAM_ROOT, n, below))
        .when((kind == UPSTREAM_ELEMENT) & (n <= size), made(UPSTREAM_ELEMENT, F.size(segs) - 1, F.slice(here, size - n.cast("int") + 1, n.cast("int") + 1)))
        .when((kind == COUSIN) & (size > 0), made(COUSIN, zero, F.array(last)))
        .when((kind == REMOVED_COUSIN) & (size > 0), F.when(F.size(segs) > 0, made(UPSTREAM_ELEMENT, F.size(segs), F.array(last, key))))
        .when(kind == SIBLING, made(SIBLING, zero, F.array(key)))
    )
