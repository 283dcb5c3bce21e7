"""Point reads, existence and emptiness, and the ways to shape a result."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidPath, NotSupported, PathKeyNotFound, PathNotFound, PathParentLayerNotFound, WrongElementType
from ..functions.scalar import varint
from ..functions.serde import of_row
from ..model import BIG_SUM_TREE, COUNT_SUM_TREE, COUNT_TREE, ELEMENT, ELEMENT_COLUMNS, ITEM, ITEM_WITH_SUM, PROVABLE_COUNT_SUM_TREE, PROVABLE_COUNT_TREE, SUM_ITEM, SUM_TREE, binary, contributions, path_literal, tree_id
from ..plans.compile import RESULT, Options, in_tree, query_raw, resolved, tree_exists
from ..plans.query import PathQuery
from .references import absolute, resolve


def _at(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> DataFrame:
    return in_tree(nodes, path).where(F.col("key") == binary(key))


def get_raw(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> DataFrame:
    """The element at path and key as it is; an error where there is none."""
    row = _at(nodes, path, key).select(*RESULT)
    if row.isEmpty():
        raise (PathKeyNotFound if tree_exists(nodes, path) else PathParentLayerNotFound)(f"{path} / {key}")
    return row


def get(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> DataFrame:
    """get_raw, with a reference followed to what it leads to."""
    return resolve(get_raw(nodes, path, key), nodes).select(*RESULT)


def get_raw_optional(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> DataFrame:
    """One row: the element, or nulls where the key or the tree is missing."""
    return get_many_raw_optional(nodes, nodes.sparkSession.range(1).select(path_literal(tuple(path)).alias("path"), binary(key).alias("key")))


def get_many_raw_optional(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each (path, key) of wanted, with the element or nulls: one join for all."""
    look = nodes.select("tree_id", F.col("path").alias("n_path"), F.col("key").alias("n_key"), *ELEMENT_COLUMNS)
    w = wanted.select("path", "key", tree_id(F.col("path")).alias("w_id"))
    return w.join(look, (F.col("w_id") == F.col("tree_id")) & (F.col("path") == F.col("n_path")) & (F.col("key") == F.col("n_key")), "left").select(*RESULT)


def has_raw(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> bool:
    return not _at(nodes, path, key).select("key").isEmpty()


def has_many(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those (path, key) of wanted that are there."""
    return wanted.select("path", "key").join(nodes.select("path", "key"), ["path", "key"], "left_semi")


def check_subtree_exists(nodes: DataFrame, path: Sequence[bytes], error: type = PathNotFound) -> None:
    """An error unless every prefix of the path names a tree."""
    path = tuple(path)
    for k in range(1, len(path) + 1):
        if not tree_exists(nodes, path[:k]):
            raise error(f"subtree doesn't exist at {path[:k]}")


def check_subtree_exists_invalid_path(nodes: DataFrame, path: Sequence[bytes]) -> None:
    check_subtree_exists(nodes, path, InvalidPath)


def is_empty_tree(nodes: DataFrame, path: Sequence[bytes]) -> bool:
    check_subtree_exists(nodes, path)
    return in_tree(nodes, path).select("key").isEmpty()


def scan(nodes: DataFrame, path: Sequence[bytes], start: bytes | None = None, end: bytes | None = None, descending: bool = False) -> DataFrame:
    """An ordered scan of one tree from ``start`` (a cursor's seek) to ``end`` (included), backwards if descending."""
    df = in_tree(nodes, path)
    if start is not None:
        df = df.where(F.col("key") >= binary(start))
    if end is not None:
        df = df.where(F.col("key") <= binary(end))
    return df.orderBy(F.desc("key") if descending else F.asc("key")).select(*RESULT)


def seek(nodes: DataFrame, path: Sequence[bytes], key: bytes | None = None, last: bool = False) -> DataFrame:
    """The element where a cursor comes to rest, if there is one: the first key from ``key`` on, or the last one up to it; without a key the tree's first or last."""
    return (scan(nodes, path, end=key, descending=True) if last else scan(nodes, path, start=key)).limit(1)


def get_with_absolute_refs(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> DataFrame:
    return absolute(get_raw(nodes, path, key))


def get_optional_with_absolute_refs(nodes: DataFrame, path: Sequence[bytes], key: bytes) -> DataFrame:
    """One row, like get_raw_optional, with a reference as an absolute one."""
    return absolute(get_raw_optional(nodes, path, key))


def or_default(rows: DataFrame) -> DataFrame:
    """What each element counts for where it may be none of the kind: sum, big sum and count, 0 (and for a count 1) by default."""
    value, big, n = contributions()
    return rows.select("path", "key", value.alias("sum_or_default"), F.coalesce("big_sum_value", big).alias("big_sum_or_default"), n.alias("count_or_default"))


# Path queries, by what they return


def _typed(rows: DataFrame, allowed: Sequence[int], what: str) -> DataFrame:
    bad = rows.where(~F.col("element_type").isin(*allowed)).select("path", "key", "element_type").first()
    if bad:
        raise WrongElementType(f"{what}: element of type {bad['element_type']} at {bytes(bad['key'])}")
    return rows


def query_item_value(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    """The bytes of items in result order; a sum item's are its varint."""
    rows = _typed(resolved(nodes, pq, options), (ITEM, ITEM_WITH_SUM, SUM_ITEM), "path queries can only refer to items")
    return rows.select("path", "key", F.coalesce("item_value", varint(F.col("sum_value"))).alias("value"))


def query_item_value_or_sum(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    """What each element holds, by kind: item, sum, big sum, count, count and sum, item and sum."""
    allowed = (ITEM, SUM_ITEM, ITEM_WITH_SUM, SUM_TREE, BIG_SUM_TREE, COUNT_TREE, COUNT_SUM_TREE, PROVABLE_COUNT_TREE, PROVABLE_COUNT_SUM_TREE)
    rows = _typed(resolved(nodes, pq, options), allowed, "path queries can only refer to items, sums and counts")
    t = F.col("element_type")
    kind = F.when(t == ITEM, "item").when(t == ITEM_WITH_SUM, "item and sum").when(t.isin(SUM_ITEM, SUM_TREE), "sum").when(t == BIG_SUM_TREE, "big sum").when(t.isin(COUNT_TREE, PROVABLE_COUNT_TREE), "count").otherwise("count and sum")
    return rows.select("path", "key", kind.alias("kind"), "item_value", "sum_value", "big_sum_value", "count_value")


def query_sums(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    """The sums of sum items; through a reference an item with a sum is an error."""
    rows = _typed(resolved(nodes, pq, options), (SUM_ITEM, ITEM_WITH_SUM), "path queries over sums can only refer to sum items")
    rows = rows.withColumn("through", F.col("hops") > 0)
    if not rows.where(F.col("through") & (F.col("element_type") == ITEM_WITH_SUM)).isEmpty():
        raise WrongElementType("the reference must result in a sum item")
    return rows.select("path", "key", "sum_value")


def query_many_raw(nodes: DataFrame, queries: Sequence[PathQuery], options: Options | None = None) -> DataFrame:
    return query_raw(nodes, PathQuery.merge(queries), options)


def query_encoded_many(nodes: DataFrame, queries: Sequence[PathQuery], options: Options | None = None) -> DataFrame:
    """The merger of queries, references followed, as elements' bytes in result order."""

    @F.pandas_udf("binary")
    def encoded(rows: pd.DataFrame) -> pd.Series:
        clean = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else v
        whole = lambda c, v: int(v) if v is not None and c not in ("item_value", "flags", "ref") else v
        return pd.Series([of_row({c: whole(c, clean(r[c])) for c in ELEMENT_COLUMNS}) for r in rows.to_dict("records")])

    rows = resolved(nodes, PathQuery.merge(queries), options)
    return rows.select("path", "key", encoded(F.struct(*ELEMENT_COLUMNS)).alias("element"))


def query_raw_keys_optional(nodes: DataFrame, pq: PathQuery, options: Options | None = None, dereference: bool = False) -> DataFrame:
    """A row for every key that the query could return, null where there is no such element. Needs a limit and no offset."""
    if pq.limit is None:
        raise NotSupported("limits must be set for keys to be optional")
    if pq.offset:
        raise NotSupported("offsets are not supported when keys are optional")
    keys = pq.terminal_keys(pq.limit)
    options = options or Options(error_if_path_missing=False)
    found = resolved(nodes, pq, options).select(*RESULT) if dereference else query_raw(nodes, pq, options)
    wanted = nodes.sparkSession.createDataFrame([([bytearray(p) for p in path], bytearray(k), n) for n, (path, k) in enumerate(keys)], "path array<binary>, key binary, place int")
    return wanted.join(found, ["path", "key"], "left").orderBy("place").select(*RESULT)


def query_keys_optional(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    return query_raw_keys_optional(nodes, pq, options, dereference=True)


# Result shapes


def elements(rows: DataFrame) -> DataFrame:
    return rows.select(*ELEMENT_COLUMNS)


def key_elements(rows: DataFrame) -> DataFrame:
    return rows.select("key", *ELEMENT_COLUMNS)


def keys(rows: DataFrame) -> DataFrame:
    return rows.select("key")


def by_key(rows: DataFrame) -> DataFrame:
    """One row per key; of rows that share a key the one with the last path."""
    return rows.groupBy("key").agg(F.max_by(F.struct(*ELEMENT_COLUMNS), "path").alias("element"))


def _segment(k: int) -> Column:
    return F.when(F.size("path") >= -k, F.element_at("path", k))


def keys_by_last_segment(rows: DataFrame, segment: int = -1) -> DataFrame:
    """Keys grouped by the last segment of their path (-2: the one before)."""
    return rows.groupBy(_segment(segment).alias("segment")).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def elements_by_path(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("key", "element_type"))).alias("elements"), F.count("*").alias("n"))


def elements_by_last_segment(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_segment(-1).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("path", "key", "element_type"))).alias("elements"))


def counts_below(rows: DataFrame, depth: int) -> DataFrame:
    """How many rows lie below each path prefix of ``depth`` segments: one level of the tree of results."""
    return rows.where(F.size("path") >= depth).groupBy(F.slice("path", 1, depth).alias("path")).agg(F.count("*").alias("n"))


def level_results(rows: DataFrame) -> dict:
    """A result as nested dicts, a level for each path segment and the element's columns at the end; a result for one reader."""
    out: dict = {}
    for r in rows.select(*RESULT).collect():
        at = out
        for p in map(bytes, r["path"]):
            at = at.setdefault(p, {})
        at[bytes(r["key"])] = {c: r[c] for c in ELEMENT_COLUMNS}
    return out


def map_elements(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with some of their elements' columns computed anew."""
    if unknown := set(columns) - set(ELEMENT_COLUMNS):
        raise InvalidInput(f"elements have no {sorted(unknown)}")
    return rows.withColumns({c: v.cast(dict(ELEMENT)[c]) for c, v in columns.items()})
