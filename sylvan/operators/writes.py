"""Inserts, deletes and batches: each takes a node table and gives the next one.

Nothing is changed in place. A write is a ``Delta``: rows to put, keys to take
out. ``Delta.over`` gives the next node table, ``Store.apply`` keeps the delta
beside what it changes. A delta holds the trees above what it changes too,
with sums and counts settled by the difference: stored aggregates that are
right before a write are right after it, and no other tree is touched. A
forest that never had them gets them from ``aggregates.propagate``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ClearingTreeWithSubtreesNotAllowed, DeletingNonEmptyTree, InvalidBatchOperation, InvalidInput, InvalidPath, OverrideNotAllowed, StopHeightTooLarge, WrongElementType
from ..functions.scalar import added_bytes, element_bytes
from ..model import BULK_APPEND_TREE, COLUMNS, COMMITMENT_TREE, DENSE_TREE, ELEMENT, ELEMENT_COLUMNS, KEYED_TREES, MMR_TREE, REFERENCE, SCHEMA, binary, is_tree, path_literal, tree_id
from ..plans.compile import MAX_TREES_NAMED, in_tree, near
from ..sources.store import Delta, written
from . import logs
from .aggregates import settled, tree_aggregates
from .references import resolve

KEY = ["path", "key"]


@dataclass
class InsertOptions:
    validate_override: bool = False  # refuse any override
    validate_tree_override: bool = True  # refuse to override trees
    check_references: bool = True
    check_parents: bool = True


@dataclass
class DeleteOptions:
    allow_non_empty_trees: bool = False
    error_on_non_empty: bool = True


def _full(rows: DataFrame) -> DataFrame:
    return rows.select(tree_id(F.col("path")).alias("tree_id"), "path", "key", *ELEMENT_COLUMNS)


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select("path", "key")


def _at(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of nodes at (path, key) of wanted, a written table."""
    nodes = near(nodes, wanted)
    w = wanted.select(F.col("path").alias("w_path"), F.col("key").alias("w_key"), tree_id(F.col("path")).alias("w_id"))
    return nodes.join(w, (F.col("tree_id") == F.col("w_id")) & (F.col("path") == F.col("w_path")) & (F.col("key") == F.col("w_key")), "left_semi").select(*COLUMNS)


def _without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """nodes without those at (path, key) of gone."""
    return Delta(nodes.limit(0), _keys(gone)).over(nodes)


def _children(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """(path, key) of those of trees that hold something."""
    t = trees.select("path", "key", F.concat("path", F.array("key")).alias("at"))
    ids = [r["id"] for r in t.select(tree_id(F.col("at")).alias("id")).distinct().limit(MAX_TREES_NAMED + 1).collect()]
    if len(ids) <= MAX_TREES_NAMED:
        nodes = nodes.where(F.col("tree_id").isin(ids))
    return t.join(nodes.select(F.col("path").alias("at")), "at", "left_semi").select("path", "key")


def _below(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """(path, key) of all that lies below trees, at any depth: each path looks for each of its beginnings."""
    gone = trees.select(F.concat("path", F.array("key")).alias("gone_at")).distinct()
    up = nodes.select("path").distinct().withColumn("gone_at", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda k: F.slice("path", F.lit(1), k))))
    hit = up.join(gone, "gone_at", "left_semi").select("path").distinct()
    return nodes.join(hit, "path", "left_semi").select("path", "key")


def _settle(nodes: DataFrame, old: DataFrame, put: DataFrame, gone: DataFrame) -> Delta:
    """The delta that puts and takes out these rows, with the trees above them. old: rows of nodes at the keys of put and gone."""
    plain = Delta(put, gone)
    after = plain.over(nodes)
    # A tree in place of a tree keeps what lies in it: its aggregates are those of its contents.
    kept = written(old.where(is_tree()).select("path", "key").join(put.where(F.col("element_type").isin(*KEYED_TREES)), KEY).select(*COLUMNS), "kept")
    if not kept.isEmpty():
        agg = tree_aggregates(after, kept)
        kept = written(kept.withColumn("at__", F.concat("path", F.array("key"))).drop("sum_value", "big_sum_value", "count_value").join(agg, F.col("at__") == F.col("tree_path")).select(*COLUMNS), "kept")
        put = _without(put, kept).unionByName(kept)
        plain = Delta(put, gone)
        after = plain.over(nodes)
    trees = settled(after, old, put)
    return plain if trees is None else Delta(_without(put, trees).unionByName(trees), gone)


def missing_parents(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Paths of rows that name no tree."""
    asked = rows.select("path").distinct().where(F.size("path") > 0)
    keys = asked.select(F.slice("path", 1, F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("key"))
    trees = near(nodes, keys).where(is_tree()).select(F.concat("path", F.array("key")).alias("path"))
    return asked.join(trees, "path", "left_anti")


def insert_delta(nodes: DataFrame, rows: DataFrame, options: InsertOptions | None = None) -> Delta:
    """Puts rows in, in place of those with the same path and key. Rows must not repeat a path and key."""
    options = options or InsertOptions()
    rows = written(_full(rows), "put")
    old = written(_at(nodes, rows), "old")
    if options.check_parents and (bad := missing_parents(nodes, rows).first()):
        raise InvalidPath(f"there is no tree at {bad['path']}")
    if options.validate_override or options.validate_tree_override:
        over = old if options.validate_override else old.where(is_tree())
        if bad := over.first():
            raise OverrideNotAllowed(f"there is an element at {bad['path']} / {bad['key']}")
    if options.check_references:
        refs = rows.where(F.col("element_type") == REFERENCE)
        if not refs.isEmpty():
            resolve(refs, Delta(rows, _keys(rows.limit(0))).over(nodes))
    return _settle(nodes, old, rows, _keys(rows.limit(0)))


def insert(nodes: DataFrame, rows: DataFrame, options: InsertOptions | None = None) -> DataFrame:
    """nodes after ``insert_delta``."""
    return insert_delta(nodes, rows, options).over(nodes)


def insert_if_not_exists(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next nodes, rows that went in): those whose path and key were free."""
    rows = written(_full(rows), "put")
    new = written(_without(rows, _at(nodes, rows)), "new")
    return _settle(nodes, new.limit(0), new, _keys(new.limit(0))).over(nodes), new


def existing(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """What is already at the rows' paths and keys."""
    return _at(nodes, written(_keys(rows), "wanted"))


def changed(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are new or differ from what is there; had: whether something was, previous: it."""
    old = nodes.select("path", "key", F.struct(*ELEMENT_COLUMNS).alias("previous"), F.lit(True).alias("was"))
    x = _full(rows).withColumn("now", F.struct(*ELEMENT_COLUMNS)).join(old, KEY, "left")
    return x.where(~F.col("now").eqNullSafe(F.col("previous"))).select(*COLUMNS, F.coalesce("was", F.lit(False)).alias("had"), "previous")


def insert_if_changed(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next nodes, changed rows with what was there before)."""
    diff = written(changed(nodes, rows), "changed")
    return insert(nodes, diff.select(*COLUMNS)), diff


def delete_delta(nodes: DataFrame, wanted: DataFrame, options: DeleteOptions | None = None) -> Delta:
    """Takes out the elements at (path, key) of wanted. A tree that holds something is an error, is left, or goes with all below it, by the options."""
    options = options or DeleteOptions()
    old = written(_at(nodes, written(_keys(wanted), "wanted")), "old")
    trees = old.where(is_tree())
    gone = _keys(old)
    if not trees.isEmpty():
        if options.allow_non_empty_trees:
            gone = written(gone.unionByName(_below(nodes, trees)).distinct(), "gone")
        else:
            full = written(_children(nodes, trees), "full")
            if options.error_on_non_empty and (bad := full.first()):
                raise DeletingNonEmptyTree(f"the tree at {bad['path']} / {bad['key']} is not empty")
            old = old.join(full, KEY, "left_anti").select(*COLUMNS)
            gone = _keys(old)
    return _settle(nodes, old, old.limit(0), gone)


def delete(nodes: DataFrame, wanted: DataFrame, options: DeleteOptions | None = None) -> DataFrame:
    """nodes after ``delete_delta``."""
    return delete_delta(nodes, wanted, options).over(nodes)


def delete_with_removed_bytes(nodes: DataFrame, wanted: DataFrame, split: Callable[[DataFrame], DataFrame], options: DeleteOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(next nodes, what ``split`` makes of the removed rows): the rows come with path, key, flags and bytes_left, the bytes given back."""
    delta = delete_delta(nodes, wanted, options)
    removed = _at(nodes, written(delta.gone, "gone")).select("path", "key", "flags", _stored_bytes().alias("bytes_left"))
    return delta.over(nodes), split(removed)


def _stored_bytes() -> Column:
    return added_bytes(F.col("key"), element_bytes(F.col("item_value"), F.col("flags")))


def delete_if_empty_trees(nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next nodes, trees deleted): of wanted those that are empty trees."""
    hit = written(_at(nodes, written(_keys(wanted), "wanted")).where(is_tree()), "hit")
    empty = written(hit.join(_children(nodes, hit), KEY, "left_anti").select(*COLUMNS), "empty")
    return _settle(nodes, empty, empty.limit(0), _keys(empty)).over(nodes), empty


def clear_subtree_delta(nodes: DataFrame, path: Sequence[bytes], allow_subtrees: bool = False, error_if_subtrees: bool = True) -> Delta | None:
    """Takes all out of a tree, or nothing (None) where it has trees in it and that is not allowed."""
    if not allow_subtrees and not in_tree(nodes, path).where(is_tree()).isEmpty():
        if error_if_subtrees:
            raise ClearingTreeWithSubtreesNotAllowed(str(path))
        return None
    p = path_literal(tuple(path))
    n = len(tuple(path))
    inside = (F.slice("path", 1, n) == p) & (F.size("path") >= n) if n else F.lit(True)
    return _settle(nodes, in_tree(nodes, path).select(*COLUMNS), nodes.limit(0).select(*COLUMNS), _keys(nodes.where(inside)))


def clear_subtree(nodes: DataFrame, path: Sequence[bytes], allow_subtrees: bool = False, error_if_subtrees: bool = True) -> tuple[DataFrame, bool]:
    """(next nodes, whether it was cleared). A tree with trees in it is cleared, with all below, only if allowed."""
    delta = clear_subtree_delta(nodes, path, allow_subtrees, error_if_subtrees)
    return (nodes, False) if delta is None else (delta.over(nodes), True)


def find_subtrees(nodes: DataFrame, path: Sequence[bytes]) -> DataFrame:
    """Paths of the tree at ``path`` and of all trees below it. Paths are stored whole, so no recursion is needed."""
    n = len(tuple(path))
    at = F.concat("path", F.array("key"))
    below = nodes.where(is_tree()).where((F.slice("path", 1, n) == path_literal(tuple(path))) if n else F.lit(True)).where(F.size("path") >= n)
    return nodes.sparkSession.range(1).select(path_literal(tuple(path)).alias("path")).unionByName(below.select(at.alias("path")))


def keys_up_tree_while_empty(nodes: DataFrame, path: Sequence[bytes], key: bytes, stop_height: int | None = None, pending: DataFrame | None = None) -> list[tuple[tuple[bytes, ...], bytes]]:
    """The key, then each ancestor that becomes empty with it, not above ``stop_height``. pending: ops of a batch to take account of."""
    path = tuple(path)
    if stop_height is not None and stop_height > len(path):
        raise StopHeightTooLarge(f"stop height {stop_height} is more than {len(path)}")
    if pending is not None:
        put, gone = pending.where(F.col("op").isin(*PUTS)), pending.where(F.col("op").isin(*DELETES))
        nodes = Delta(_full(put), _keys(gone)).over(nodes)
    found: list[tuple[tuple[bytes, ...], bytes]] = []
    while stop_height is None or len(path) > stop_height:
        # Judged with the deletes of this run: the tree must hold nothing but the child just deleted.
        if found and not in_tree(nodes, (*path, key)).where(F.col("key") != binary(found[-1][1])).isEmpty():
            break
        found.append((path, key))
        if not path:
            break
        path, key = path[:-1], path[-1]
    return found


def _at_keys(spark: SparkSession, keys: Sequence[tuple[tuple[bytes, ...], bytes]]) -> DataFrame:
    return spark.createDataFrame([([bytearray(x) for x in p], bytearray(k)) for p, k in keys], "path array<binary>, key binary")


def delete_up_tree_while_empty(nodes: DataFrame, path: Sequence[bytes], key: bytes, stop_height: int | None = None, options: DeleteOptions | None = None) -> tuple[DataFrame, int]:
    """(next nodes, how many elements went): the key, then each ancestor that became empty, not above ``stop_height``.

    Only the first may raise on a tree that is not empty; an ancestor that
    holds more just ends it. The path is short, so the steps are few.
    """
    keys = keys_up_tree_while_empty(nodes, path, key, stop_height)
    if not keys:
        return nodes, 0
    spark = nodes.sparkSession
    first = delete_delta(nodes, _at_keys(spark, keys[:1]), options)
    if not keys[1:]:
        return first.over(nodes), 1
    # What is left changes where the highest one went; the trees between are gone.
    top = _at(nodes, _at_keys(spark, keys[-1:]))
    return _settle(nodes, top, top.limit(0), first.gone.unionByName(_at_keys(spark, keys[1:]))).over(nodes), len(keys)


def delete_ops(nodes: DataFrame, wanted: DataFrame, options: DeleteOptions | None = None, pending: DataFrame | None = None, first_seq: int = 0) -> DataFrame:
    """Batch ops that delete what is at (path, key) of wanted, instead of doing it; what ``pending`` ops delete already counts as gone."""
    options = options or DeleteOptions()
    here = nodes if pending is None else Delta(_full(pending.where(F.col("op").isin(*PUTS))), _keys(pending.where(F.col("op").isin(*DELETES)))).over(nodes)
    hit = written(_at(here, written(_keys(wanted), "wanted")), "hit")
    full = _children(here, hit.where(is_tree()))
    if not options.allow_non_empty_trees:
        if options.error_on_non_empty and (bad := full.first()):
            raise DeletingNonEmptyTree(f"the tree at {bad['path']} / {bad['key']} is not empty")
        hit = hit.join(full, KEY, "left_anti")
    return hit.select((F.monotonically_increasing_id() + first_seq).alias("seq"), F.when(is_tree(), DELETE_TREE).otherwise(DELETE).alias("op"), *COLUMNS[1:])


def delete_up_tree_ops(nodes: DataFrame, path: Sequence[bytes], key: bytes, stop_height: int | None = None, pending: DataFrame | None = None) -> DataFrame:
    """The batch ops of ``delete_up_tree_while_empty``; with ``pending`` ops, those and then these."""
    keys = keys_up_tree_while_empty(nodes, path, key, stop_height, pending)
    first = 0 if pending is None else (pending.agg(F.max("seq")).first()[0] or 0) + 1
    rows = [(first + i, DELETE_TREE if i else DELETE, [bytearray(x) for x in p], bytearray(k)) for i, (p, k) in enumerate(keys)]
    ops = nodes.sparkSession.createDataFrame(rows, "seq bigint, op string, path array<binary>, key binary")
    ops = ops.select("seq", "op", "path", "key", *(F.lit(None).cast(t).alias(c) for c, t in ELEMENT))
    return ops if pending is None else pending.unionByName(ops)


# Batches

INSERT_KNOWN, INSERT_IF_NOT_EXISTS, INSERT_OR_REPLACE, REPLACE, PATCH, REFRESH_REFERENCE, DELETE, DELETE_TREE = (
    "insert known new", "insert if not exists", "insert or replace", "replace", "patch", "refresh reference", "delete", "delete tree",
)
COMMITMENT_INSERT, MMR_APPEND, BULK_APPEND, DENSE_INSERT = "commitment tree insert", "mmr append", "bulk append", "dense tree insert"
PUTS = (INSERT_KNOWN, INSERT_IF_NOT_EXISTS, INSERT_OR_REPLACE, REPLACE, PATCH, REFRESH_REFERENCE)
DELETES = (DELETE, DELETE_TREE)
APPENDS = (COMMITMENT_INSERT, MMR_APPEND, BULK_APPEND, DENSE_INSERT)
CHECK_NOT, CHECK_ERROR, CHECK_DELETE_CHILDREN, CHECK_SKIP = "don't check", "error", "delete children", "skip"
OPS_SCHEMA = "seq bigint, op string, " + SCHEMA.split(", ", 1)[1]


LOG_OF = {COMMITMENT_INSERT: COMMITMENT_TREE, MMR_APPEND: MMR_TREE, BULK_APPEND: BULK_APPEND_TREE, DENSE_INSERT: DENSE_TREE}


@dataclass
class BatchOptions:
    disable_consistency_check: bool = False
    error_if_exists: bool = True  # for insert-if-not-exists; else such an op is skipped
    deleting_trees: str = CHECK_ERROR
    validate_tree_override: bool = True
    validate_override: bool = False  # refuse inserts (not replaces and patches) where something is
    check_existence: bool = False  # hold "insert known new" and "replace" to their word; the default takes it
    trust_references: bool = False  # refresh references without looking whether one is there


def batch_conflicts(ops: DataFrame) -> DataFrame:
    """What makes a batch inconsistent: (reason, path, key, n).

    Reasons: the same op twice; several ops on one path and key (appends of
    the same kind are fine); an insert below a tree that the batch deletes; an
    append to a tree that it deletes; an op that is none.
    """
    known = F.col("op").isin(*PUTS, *DELETES, *APPENDS)
    odd = ops.where(~known).groupBy("path", "key").agg(F.count("*").alias("n")).select(F.lit("unknown op").alias("reason"), "path", "key", "n")
    body = F.struct("op", *ELEMENT_COLUMNS)
    same = ops.where(~F.col("op").isin(*APPENDS)).groupBy("path", "key").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(body)).alias("kinds")).where("n > 1")
    repeated = same.select(F.when(F.col("kinds") < F.col("n"), "repeated op").otherwise("several ops on one key").alias("reason"), "path", "key", "n")
    gone = ops.where(F.col("op").isin(*DELETES)).select(F.concat("path", F.array("key")).alias("gone_at")).distinct()
    puts = ops.where(F.col("op").isin(*PUTS, *APPENDS))
    up = puts.select("path", "key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda k: F.slice("path", F.lit(1), k))).alias("gone_at"))
    under = up.join(gone, "gone_at", "left_semi").groupBy("path", "key").agg(F.count("*").alias("n")).select(F.lit("insert below a delete").alias("reason"), "path", "key", "n")
    both = ops.where(F.col("op").isin(*APPENDS)).withColumn("gone_at", F.concat("path", F.array("key"))).join(gone, "gone_at", "left_semi")
    appended = both.groupBy("path", "key").agg(F.count("*").alias("n")).select(F.lit("append to a deleted tree").alias("reason"), "path", "key", "n")
    return odd.unionByName(repeated).unionByName(under).unionByName(appended)


def last_ops(ops: DataFrame) -> DataFrame:
    """Of several ops on one path and key the last."""
    w = W.partitionBy("path", "key").orderBy(F.desc("seq"))
    return ops.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def append_ops(nodes: DataFrame, log: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log entries, tree rows) of a batch's appends: values in order of seq after what each log holds.

    The value is the op's item_value. The tree's row gets its new count, and
    a mountain range its size. An error where there is no tree of the op's
    kind, or a dense tree would hold more than its height allows. Positions
    come from one range sort of all appends, so a log may get most of them.
    """
    new = written(ops.select(F.concat("path", F.array("key")).alias("log_path"), "op", "seq", F.col("item_value").alias("value")), "appends")
    kind = F.coalesce(*(F.when(F.col("op") == op, k) for op, k in LOG_OF.items()))
    per = new.groupBy("log_path").agg(F.count("*").alias("added"), F.min(kind).alias("kind"), F.max(kind).alias("other"))
    have = log.groupBy(F.col("path").alias("have_path")).agg(F.count("*").alias("had"))
    per = per.join(have, F.col("log_path") == F.col("have_path"), "left").select("log_path", "added", "kind", "other", F.coalesce("had", F.lit(0)).alias("had"))
    trees = nodes.where(is_tree()).withColumn("at__", F.concat("path", F.array("key")))
    x = written(per.join(trees, F.col("log_path") == F.col("at__"), "left").withColumn("now", F.col("had") + F.col("added")), "grown")
    wrong = F.col("element_type").isNull() | (F.col("element_type") != F.col("kind")) | (F.col("kind") != F.col("other"))
    if bad := x.where(wrong).first():
        raise WrongElementType(f"there is no such log at {bad['log_path']}")
    if bad := x.where((F.col("kind") == DENSE_TREE) & (F.col("now") > F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("height").cast("int")) - 1)).first():
        raise InvalidInput(f"the dense tree at {bad['log_path']} is full")
    grown = {
        "log_count": F.when(F.col("kind") != MMR_TREE, F.col("now")).otherwise(F.col("log_count")).cast("bigint"),
        "mmr_size": F.when(F.col("kind") == MMR_TREE, logs.mmr_size(F.col("now"))).otherwise(F.col("mmr_size")).cast("bigint"),
    }
    tree_rows = x.select(*(grown.get(c, F.col(c)).alias(c) for c in COLUMNS))
    at = logs.numbered(new.withColumn("tree_id", tree_id(F.col("log_path"))), ["tree_id", "log_path", "seq"])
    first = at.groupBy("log_path").agg(F.min("n__").alias("first"))
    at = at.join(first, "log_path").join(x.select("log_path", "had"), "log_path")
    return at.select("tree_id", F.col("log_path").alias("path"), (F.col("had") + F.col("n__") - F.col("first")).alias("position"), "value"), tree_rows


def batch_delta(nodes: DataFrame, ops: DataFrame, options: BatchOptions | None = None, log: DataFrame | None = None, flags: Callable[..., Column] | None = None) -> tuple[Delta, DataFrame | None]:
    """(delta of a batch, its log entries): all of its inserts, deletes and appends or, on an error, none.

    ``insert known new``, ``replace`` and ``patch`` write without looking, as
    their word is taken, unless ``check_existence``; ``refresh reference`` is
    an error where no reference is, unless ``trust_references``. Appends need
    the log table. ``flags``: see ``apply_batch_with_flags``.
    """
    options = options or BatchOptions()
    ops = written(ops, "ops")
    if not options.disable_consistency_check and (bad := batch_conflicts(ops).first()):
        raise InvalidBatchOperation(f"{bad['reason']}: {bad['path']} / {bad['key']}")
    appends = ops.where(F.col("op").isin(*APPENDS))
    has_appends = not appends.isEmpty()
    if has_appends and log is None:
        raise InvalidBatchOperation("a batch with appends needs the log table")
    ops = written(last_ops(ops.where(~F.col("op").isin(*APPENDS))), "last_ops")
    old = written(_at(nodes, ops), "old")
    here = old.select("path", "key", F.col("element_type").alias("old_type"), F.col("item_value").alias("old_value"), F.col("flags").alias("old_flags"))
    puts = ops.where(F.col("op").isin(*PUTS)).join(here, KEY, "left")
    gone = ops.where(F.col("op").isin(*DELETES))
    there = F.col("old_type").isNotNull()

    def refuse(rows: DataFrame, what: str, error: type = InvalidBatchOperation) -> None:
        if bad := rows.first():
            raise error(f"{what} {bad['path']} / {bad['key']}")

    if_new = (F.col("op") == INSERT_IF_NOT_EXISTS) & there
    if options.error_if_exists:
        refuse(puts.where(if_new), "there is an element at")
    puts = puts.where(~if_new)
    if options.validate_override:
        refuse(puts.where(there & F.col("op").isin(INSERT_KNOWN, INSERT_OR_REPLACE)), "there is an element at", OverrideNotAllowed)
    if options.check_existence:
        refuse(puts.where(there & (F.col("op") == INSERT_KNOWN)), "there is an element at")
        refuse(puts.where(~there & F.col("op").isin(REPLACE, PATCH)), "there is no element at")
    if not options.trust_references:
        refuse(puts.where((F.col("op") == REFRESH_REFERENCE) & ~F.coalesce(F.col("old_type") == REFERENCE, F.lit(False))), "there is no reference at")
    if options.validate_tree_override:
        refuse(puts.where(is_tree("old_type") & ~F.col("op").isin(REPLACE, PATCH)), "there is a tree at", OverrideNotAllowed)
    if flags is not None:
        before = F.when(there, added_bytes(F.col("key"), element_bytes(F.col("old_value"), F.col("old_flags"))))
        puts = puts.withColumn("flags", flags(F.col("old_flags"), F.col("flags"), before, _stored_bytes()))
    puts = written(_full(puts), "put")
    trees = old.join(_keys(gone), KEY, "left_semi").where(is_tree())
    out_keys = _keys(gone)
    if not trees.isEmpty():
        full = written(_children(_without(nodes, gone), trees), "full")
        if options.deleting_trees == CHECK_ERROR:
            refuse(full, "there is more in the tree", DeletingNonEmptyTree)
        elif options.deleting_trees == CHECK_SKIP:
            out_keys = out_keys.join(full, KEY, "left_anti")
            old = _without(old, full)
        elif options.deleting_trees == CHECK_DELETE_CHILDREN:
            out_keys = written(out_keys.unionByName(_below(nodes, trees)).distinct(), "gone")
    entries = None
    if has_appends:
        after = Delta(puts, out_keys).over(nodes)
        entries, grown = append_ops(after, log, appends)
        entries, grown = written(entries, "entries"), written(grown, "grown")
        old = old.unionByName(_at(nodes, grown.select("path", "key")).join(_keys(old), KEY, "left_anti").select(*COLUMNS))
        puts = _without(puts, grown).unionByName(grown)
    # Ops that were skipped change nothing.
    old = old.join(_keys(puts).unionByName(out_keys).distinct(), KEY, "left_semi").select(*COLUMNS)
    after = Delta(puts, out_keys).over(nodes)
    if bad := missing_parents(after, puts).first():
        raise InvalidPath(f"there is no tree at {bad['path']}")
    refs = puts.where(F.col("element_type") == REFERENCE)
    if not refs.isEmpty():
        resolve(refs, after)  # pending elements included
    return _settle(nodes, old, puts, out_keys), entries


def apply_batch(nodes: DataFrame, ops: DataFrame, options: BatchOptions | None = None) -> DataFrame:
    """nodes after a batch without appends; those need ``apply_batch_with_logs``, and are an error here."""
    return batch_delta(nodes, ops, options)[0].over(nodes)


def apply_batch_with_logs(nodes: DataFrame, log: DataFrame, ops: DataFrame, options: BatchOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, log) after a batch whose ops may append to logs."""
    delta, entries = batch_delta(nodes, ops, options, log)
    return delta.over(nodes), log if entries is None else log.unionByName(entries.select(*log.columns))


def apply_batch_with_flags(nodes: DataFrame, ops: DataFrame, update: Callable[..., Column], split: Callable[[DataFrame], DataFrame], options: BatchOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(next nodes, removed bytes as ``split`` deals them).

    update: (old flags, new flags, stored bytes before, stored bytes now) as
    columns, to the flags that are written; old ones are null for new
    elements. split gets path, key, flags (the old ones) and bytes_left for
    every element that shrank or went.
    """
    ops = written(ops, "ops")
    delta, _ = batch_delta(nodes, ops, options, flags=update)
    was = _at(nodes, ops).select("path", "key", F.col("flags").alias("old_flags"), _stored_bytes().alias("before"))
    now = delta.over(nodes).select("path", "key", _stored_bytes().alias("after"))
    left = was.join(now, KEY, "left").withColumn("bytes_left", F.col("before") - F.coalesce("after", F.lit(0)))
    removed = left.where("bytes_left > 0").select("path", "key", F.col("old_flags").alias("flags"), "bytes_left")
    return delta.over(nodes), split(removed)


def apply_partial_batch(nodes: DataFrame, ops: DataFrame, more, options: BatchOptions | None = None) -> DataFrame:
    """A batch in two phases: ``more`` gets the nodes after the first and gives ops for the second, or None."""
    middle = apply_batch(nodes, ops, options)
    extra = more(middle)
    return middle if extra is None else apply_batch(middle, extra, options)


def apply_partial_batch_with_flags(nodes: DataFrame, ops: DataFrame, more, update: Callable[..., Column], split: Callable[[DataFrame], DataFrame], options: BatchOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """apply_partial_batch with the callbacks of ``apply_batch_with_flags`` in both phases; removed bytes of both."""
    middle, removed = apply_batch_with_flags(nodes, ops, update, split, options)
    extra = more(middle)
    if extra is None:
        return middle, removed
    out, again = apply_batch_with_flags(middle, extra, update, split, options)
    return out, removed.unionByName(again)


def apply_one_by_one(nodes: DataFrame, ops: Sequence[DataFrame], options: BatchOptions | None = None) -> DataFrame:
    """Ops applied in turn; for a few ops and for tests."""
    for op in ops:
        nodes = apply_batch(nodes, op, options)
    return nodes
