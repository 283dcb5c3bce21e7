"""Root hashes of all trees, and proofs of path queries against them.

The shape of a tree depends on its keys alone: the middle key of the sorted
keys is the root, and so on down. A node's hash covers its key, its value's
hash and its children, in trees of provable counts also how much lies below;
a tree element's value hash covers the root of the tree or log it names. So
one hash covers the forest, logs included where their entries are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidProof, NotSupported
from ..functions.hashing import ZERO, blake3, blake3_many, kv_hashes, node_hashes, value_hashes, varint
from ..functions.serde import deserialize, of_row
from ..model import BIG_SUM_TREE, COUNTING, ELEMENT_COLUMNS, KEYED_TREES, PROVABLE_COUNT_SUM_TREE, PROVABLE_COUNT_TREE, SUMMING, TREES, contributions, path_literal, tree_id
from ..plans.compile import ENTERED, LOOKED_UP, ROW, Options, Walk, near, seen
from ..plans.query import PathQuery, Query, QueryItem, span
from ..sources.store import written
from .logs import log_roots, numbered

BLOCK = 4096  # nodes of a tree hashed in one group
COUNTED = (PROVABLE_COUNT_TREE, PROVABLE_COUNT_SUM_TREE)
ROWS_AT_ONCE = 16_384


def place(i: int, n: int, block: int = BLOCK) -> tuple[int, int]:
    """Of node i of n: (start, size) of the part of at most ``block`` nodes it lies in, or (i, 0) where it is above them."""
    lo = 0
    while n > block:
        mid = n // 2
        if i < lo + mid:
            n = mid
        elif i > lo + mid:
            lo, n = lo + mid + 1, n - mid - 1
        else:
            return i, 0
    return lo, n


def fold_many(runs: Sequence[Sequence[bytes]], counts: Sequence[Sequence[int] | None] | None = None) -> list[tuple[bytes, int]]:
    """(hash, count) of the tree of each run of nodes, in order of key; all levels of one depth are hashed together, deepest first.

    counts: for runs of trees whose hashes cover counts, those of the nodes.
    """
    counts = counts or [None] * len(runs)
    levels: list[list[tuple[int, int, int]]] = [[(r, 0, len(run)) for r, run in enumerate(runs) if run]]
    while levels[-1]:
        levels.append([(r, a, b) for r, lo, n in levels[-1] for a, b in ((lo, n // 2), (lo + n // 2 + 1, n - n // 2 - 1)) if b])
    known: dict[tuple[int, int, int], tuple[bytes, int]] = {}
    none = (ZERO, 0)
    for level in reversed(levels):
        left = [known.get((r, lo, n // 2), none) for r, lo, n in level]
        right = [known.get((r, lo + n // 2 + 1, n - n // 2 - 1), none) for r, lo, n in level]
        total = [0 if counts[r] is None else counts[r][lo + n // 2] + a[1] + b[1] for (r, lo, n), a, b in zip(level, left, right, strict=True)]
        tails = [None if counts[r] is None else t for (r, _, _), t in zip(level, total, strict=True)]
        hashes = node_hashes([runs[r][lo + n // 2] for r, lo, n in level], [a for a, _ in left], [b for b, _ in right], tails)
        known.update(zip(level, zip(hashes, total, strict=True), strict=True))
    return [known[r, 0, len(run)] if run else none for r, run in enumerate(runs)]


def fold(kv: Sequence[bytes], counts: Sequence[int] | None = None) -> bytes:
    """Hash of the tree of these nodes, in order of key."""
    return fold_many([kv], [counts])[0][0]


def top_hash(have: dict[tuple[int, int], tuple[bytes, int]], lo: int, n: int, block: int, counted: bool) -> tuple[bytes, int]:
    """(hash, count) of nodes lo to lo + n of a tree from those of its blocks and, as (node, 0), of the nodes above them."""
    if not n:
        return ZERO, 0
    if n <= block:
        return have[lo, n]
    mid = n // 2
    (a, x), (b, y), (kv, own) = top_hash(have, lo, mid, block, counted), top_hash(have, lo + mid + 1, n - mid - 1, block, counted), have[lo + mid, 0]
    total = x + y + own if counted else 0
    return node_hashes([kv], [a], [b], [total if counted else None])[0], total


def runs_of(batches: Iterator[pa.RecordBatch], key: Callable[[dict], tuple], most: int = ROWS_AT_ONCE) -> Iterator[list[list[dict]]]:
    """Whole runs of rows that share a key, given in its order: about ``most`` rows of them at a time."""
    held: list[list[dict]] = []
    size, last = 0, None
    for batch in batches:
        for r in batch.to_pylist():
            k = key(r)
            if k != last or not held:
                if size >= most:
                    yield held
                    held, size = [], 0
                held.append([])
                last = k
            held[-1].append(r)
            size += 1
    if held:
        yield held


def digests_of(rows: list[dict]) -> tuple[list[bytes], list[bytes]]:
    """(value hash, kv hash) of rows; the value hash of a tree element also covers the root below it, under ``root``."""
    d = value_hashes([of_row(r) for r in rows])
    below = [i for i, r in enumerate(rows) if r["element_type"] in KEYED_TREES or (r["element_type"] in TREES and r["root"] is not None)]
    for i, h in zip(below, blake3_many([d[i] + bytes(rows[i]["root"] or ZERO) for i in below]), strict=True):
        d[i] = h
    return d, kv_hashes([bytes(r["key"]) for r in rows], d)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


_PATH = pa.list_(pa.binary())
_NODES = "tree_id bigint, path array<binary>, key binary, digest binary, kv binary, own bigint, counted boolean, root binary"
LARGE = 65_536  # nodes of a tree whose rows are not brought to one task


@dataclass
class Hashes:
    """Hashes of a forest, as written tables by depth.

    nodes: a row an element, with its number i in its tree of ``size``, and
    the block (lo, part) it is in; blocks: a row a block, or node above the
    blocks (part 0), with its hash, count, and first and last key; roots:
    (path, root, count) of all trees and logs.
    """

    nodes: dict[int, DataFrame]
    blocks: dict[int, DataFrame]
    roots: DataFrame
    block: int


_BLOCKS = "tree_id bigint, path array<binary>, size bigint, counted boolean, lo bigint, part bigint, h binary, n bigint, low binary, high binary"
_ROOTS = "path array<binary>, root binary, n bigint"


def block_hashes(rows: DataFrame) -> DataFrame:
    """A row a block from rows with tree_id, path, i, size, lo, part, key, kv, own and counted. A task folds many blocks together."""
    key = ["tree_id", "path", "lo", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in runs_of(batches, lambda r: (r["tree_id"], r["lo"], r["part"], r["path"])):
            inner = [r for r in runs if r[0]["part"]]
            folded = iter(fold_many([[x["kv"] for x in r] for r in inner], [[x["own"] for x in r] if r[0]["counted"] else None for r in inner]))
            h = [next(folded) if r[0]["part"] else (r[0]["kv"], r[0]["own"]) for r in runs]
            same = {c: ([r[0][c] for r in runs], t) for c, t in (("tree_id", pa.int64()), ("path", _PATH), ("size", pa.int64()), ("counted", pa.bool_()), ("lo", pa.int64()), ("part", pa.int64()))}
            yield _batch(same | {"h": ([a for a, _ in h], pa.binary()), "n": ([b for _, b in h], pa.int64()), "low": ([r[0]["key"] for r in runs], pa.binary()), "high": ([r[-1]["key"] for r in runs], pa.binary())})

    x = rows.select("tree_id", "path", "lo", "part", "i", "size", "counted", "key", "kv", "own")
    return x.repartition(*key).sortWithinPartitions(*key, "i").mapInArrow(run, _BLOCKS)


def roots_of_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """(path, root, n) of each tree from its blocks: one row in ``block`` of the tree's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in runs_of(batches, lambda r: (r["tree_id"], r["path"])):
            tops = [top_hash({(r["lo"], r["part"]): (r["h"], r["n"]) for r in rows}, 0, rows[0]["size"], block, rows[0]["counted"]) for rows in runs]
            yield _batch({"path": ([r[0]["path"] for r in runs], _PATH), "root": ([h for h, _ in tops], pa.binary()), "n": ([n for _, n in tops], pa.int64())})

    return blocks.repartition("tree_id", "path").sortWithinPartitions("tree_id", "path", "lo").mapInArrow(run, _ROOTS)


def _with_trees(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """rows with what ``trees`` says of their tree. Large trees are few and are sent to the rows, so that no task gets all rows of one."""
    names = [c for c in trees.columns if c not in ("tree_id", "path")]
    large = F.broadcast(trees.where(F.col("size") > LARGE).select(F.col("tree_id").alias("t_id"), F.col("path").alias("t_path"), *names))
    on = (F.col("tree_id") == F.col("t_id")) & (F.col("path") == F.col("t_path"))
    small = rows.join(large.drop(*names), on, "left_anti").join(trees.where(F.col("size") <= LARGE), ["tree_id", "path"])
    return small.unionByName(rows.join(large, on).drop("t_id", "t_path"))


def _placed(entries: DataFrame, roots: DataFrame | None, counted: DataFrame, block: int) -> DataFrame:
    """Hashes of each node, its number in the tree and its block. own: what it counts for; counted: whether its tree's hashes cover counts; root: of the tree or log it names.

    Numbers come first: what is hashed is then dealt by key, whatever the trees' sizes, and hashed once.
    """
    x = entries.withColumn("at", F.concat("path", F.array("key"))).withColumn("own", contributions()[2])
    x = x.join(roots.select(F.col("path").alias("at"), "root"), "at", "left") if roots is not None else x.withColumn("root", F.lit(None).cast("binary"))
    x = numbered(x.select("tree_id", "path", "key", *ELEMENT_COLUMNS, "own", "root"), ["tree_id", "path", "key"])
    trees = x.groupBy("tree_id", "path").agg(F.min("n__").alias("first"), F.count("*").alias("size"))
    trees = trees.join(counted.select(F.col("at").alias("path"), F.lit(True).alias("counted")), "path", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
    x = _with_trees(x, written(trees, "trees")).withColumn("i", F.col("n__") - F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                d, kv = digests_of(rows)
                at = [place(r["i"], r["size"], block) for r in rows]
                own = {"digest": pa.array(d, pa.binary()), "kv": pa.array(kv, pa.binary()), "lo": pa.array([a for a, _ in at], pa.int64()), "part": pa.array([n for _, n in at], pa.int64())}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names)

    schema = _NODES + ", i bigint, size bigint, lo bigint, part bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return x.select("tree_id", "path", "key", *ELEMENT_COLUMNS, "own", "counted", "root", "i", "size").mapInArrow(run, schema)


def hash_forest(nodes: DataFrame, log: DataFrame | None = None, block: int = BLOCK) -> Hashes:
    """Hashes of all trees, deepest level first: each needs the roots below it. With the log table, tree elements of logs cover their logs' roots."""
    depths = sorted((r["d"] for r in nodes.select(F.size("path").alias("d")).distinct().collect()), reverse=True)
    counted = nodes.where(F.col("element_type").isin(*COUNTED)).select(F.concat("path", F.array("key")).alias("at"))
    done = None if log is None else written(log_roots(nodes, log).select("path", "root", F.lit(0).cast("bigint").alias("n")), "log_roots")
    out = Hashes({}, {}, done, block)
    for d in depths:
        below = None if done is None else done.where(F.size("path") == d + 1)
        out.nodes[d] = written(_placed(nodes.where(F.size("path") == d), below, counted.where(F.size("at") == d), block), "hash_nodes")
        out.blocks[d] = written(block_hashes(out.nodes[d]), "hash_blocks")
        roots = written(roots_of_blocks(out.blocks[d], block), "roots")
        done = roots if done is None else done.unionByName(roots)
    out.roots = done if done is not None else nodes.sparkSession.createDataFrame([], _ROOTS)
    return out


def tree_roots(nodes: DataFrame, block: int = BLOCK, log: DataFrame | None = None) -> DataFrame:
    """(path, root) of every tree that holds something."""
    return hash_forest(nodes, log, block).roots.select("path", "root")


def _root(roots: DataFrame) -> bytes:
    row = roots.where(F.size("path") == 0).first()
    return bytes(row["root"]) if row else ZERO


def root_hash_of(hashes: Hashes) -> bytes:
    return _root(hashes.roots)


def root_hash(nodes: DataFrame, log: DataFrame | None = None) -> bytes:
    return _root(tree_roots(nodes, log=log))


def root_key(nodes: DataFrame, path: Sequence[bytes] = ()) -> bytes | None:
    """The key at the root of a tree: the middle one of its sorted keys; None where it is empty."""
    from ..plans.compile import in_tree

    x = in_tree(nodes, path).select("key")
    n = x.count()
    # One partition in two is sorted past, but only one row comes to the driver.
    return None if not n else bytes(x.orderBy("key").offset(n // 2).limit(1).first()["key"])


def verify_roots(nodes: DataFrame, stored: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Trees whose stored root is not that of what they hold, with both roots."""
    now = tree_roots(nodes, log=log).withColumnRenamed("root", "now")
    x = stored.join(now, "path", "full")
    return x.where(~F.coalesce("root", F.lit(bytearray(ZERO))).eqNullSafe(F.coalesce("now", F.lit(bytearray(ZERO)))))


def describe_bad_roots(nodes: DataFrame, stored: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """verify_roots for people: path as text and both roots in hexadecimal."""
    return verify_roots(nodes, stored, log).select(F.concat_ws("/", F.transform("path", F.hex)).alias("path"), F.hex("root").alias("stored"), F.hex("now").alias("found"))


def node_hashes_at(hashes: Hashes, path: Sequence[bytes], keys: Sequence[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
    """(value hash, kv hash) of the elements at ``keys`` of a tree; what is not there is left out."""
    from ..model import path_literal

    p = path_literal(tuple(path))
    if len(tuple(path)) not in hashes.nodes:
        return {}
    rows = hashes.nodes[len(tuple(path))].where((F.col("tree_id") == tree_id(p)) & (F.col("path") == p) & F.col("key").isin([bytearray(k) for k in keys])).collect()
    return {bytes(r["key"]): (bytes(r["digest"]), bytes(r["kv"])) for r in rows}


def with_value_hash(nodes: DataFrame, hashes: Hashes) -> DataFrame:
    """nodes and the value hash and kv hash of each."""
    out = None
    for d, t in hashes.nodes.items():
        x = nodes.where(F.size("path") == d).join(t.select("tree_id", "path", "key", F.col("digest").alias("value_hash"), F.col("kv").alias("kv_hash")), ["tree_id", "path", "key"])
        out = x if out is None else out.unionByName(x)
    return out


def feature(element: dict) -> tuple[str, int | None, int | None]:
    """(kind, sum, count) that an element brings to a tree that takes account of them."""
    k = element["kind"]
    name = "count and sum" if k in COUNTING and k in SUMMING else "count" if k in COUNTING else "big sum" if k == BIG_SUM_TREE else "sum" if "sum" in element else "basic"
    return name, element.get("big_sum", element.get("sum")), element.get("count")


# Proofs


@dataclass
class Layer:
    """The proof of one tree: a partial tree, and the layers of the trees below that the query enters.

    Nodes: ("hash", hash, count), ("kv", key, value, root below, left, right),
    ("digest", key, value hash, own count, left, right); counts are given in
    trees whose hashes cover them.
    """

    tree: tuple | None
    below: dict[bytes, Layer] = field(default_factory=dict)

    def to_bytes(self) -> bytes:
        out = _tree_bytes(self.tree) + varint(len(self.below))
        return out + b"".join(_blob(k) + v.to_bytes() for k, v in sorted(self.below.items()))

    @staticmethod
    def from_bytes(data: bytes) -> Layer:
        try:
            layer, at = _read_layer(data, 0)
        except IndexError as e:
            raise InvalidProof("the proof is cut off") from e
        if at != len(data):
            raise InvalidProof("there is more than a proof")
        return layer


def _blob(v: bytes) -> bytes:
    return varint(len(v)) + v


def _option(n: int | None) -> bytes:
    return varint(0 if n is None else n + 1)


def _tree_bytes(t: tuple | None) -> bytes:
    """A partial tree from its root down: a mark, then the node's fields, then its children."""
    if t is None:
        return b"\0"
    if t[0] == "hash":
        return b"\1" + t[1] + _option(t[2])
    if t[0] == "kv":
        head = b"\2" + _blob(t[1]) + _blob(t[2]) + (b"\0" if t[3] is None else b"\1" + t[3])
    else:
        head = b"\3" + _blob(t[1]) + t[2] + _option(t[3])
    return head + _tree_bytes(t[4]) + _tree_bytes(t[5])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def _read(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise InvalidProof("the proof is cut off")
    return data[at : at + n], at + n


def _read_blob(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = _read_number(data, at)
    return _read(data, at, n)


def _read_option(data: bytes, at: int) -> tuple[int | None, int]:
    n, at = _read_number(data, at)
    return (n - 1 if n else None), at


def _read_tree(data: bytes, at: int, depth: int = 0) -> tuple[tuple | None, int]:
    mark, at = data[at], at + 1
    if mark == 0:
        return None, at
    if mark > 3 or depth > 128:  # no tree of the canonical shape is that deep
        raise InvalidProof("this is not a proof")
    if mark == 1:
        h, at = _read(data, at, 32)
        n, at = _read_option(data, at)
        return ("hash", h, n), at
    key, at = _read_blob(data, at)
    if mark == 2:
        value, at = _read_blob(data, at)
        has, at = data[at], at + 1
        extra, at = _read(data, at, 32) if has else (None, at)
    else:
        value, at = _read(data, at, 32)
        extra, at = _read_option(data, at)
    left, at = _read_tree(data, at, depth + 1)
    right, at = _read_tree(data, at, depth + 1)
    return ("kv" if mark == 2 else "digest", key, value, extra, left, right), at


def _read_layer(data: bytes, at: int, depth: int = 0) -> tuple[Layer, int]:
    if depth > 256:
        raise InvalidProof("this is not a proof")
    tree, at = _read_tree(data, at)
    n, at = _read_number(data, at)
    below = {}
    for _ in range(n):
        k, at = _read_blob(data, at)
        below[k], at = _read_layer(data, at, depth + 1)
    return Layer(tree, below), at


Show = Callable[[int, "bytes | None", "bytes | None"], bool]  # (depth, nearest keys on either side): whether what lies between is opened


def _gap(lo: bytes | None, hi: bytes | None) -> QueryItem | None:
    return span("range_full") if lo is None and hi is None else QueryItem.of(lo, False, hi, False)


def _collides(items: Sequence[QueryItem], lo: bytes | None, hi: bytes | None) -> bool:
    gap = _gap(lo, hi)
    return gap is not None and any(i.collides_with(gap) for i in items)


class _Part:
    """One tree as far as a proof needs it: its blocks, and the nodes of those that are opened."""

    def __init__(self, blocks: list[Row], block: int):
        self.block = block
        self.size = blocks[0]["size"] if blocks else 0
        self.counted = bool(blocks and blocks[0]["counted"])
        self.have = {(r["lo"], r["part"]): (bytes(r["h"]), r["n"]) for r in blocks}
        self.key_at = {r["lo"]: bytes(r["low"]) for r in blocks if not r["part"]}
        self.rows: dict[int, Row] = {}

    def wanted(self, show: Show) -> list[tuple[int, int, int, bytes | None, bytes | None]]:
        """Blocks and nodes above them that ``show`` opens: (lo, part), depth and the nearest keys on either side."""
        out = []

        def walk(lo: int, n: int, depth: int, a: bytes | None, b: bytes | None) -> None:
            if not n or not show(depth, a, b):
                return
            if n <= self.block:
                out.append((lo, n, depth, a, b))
                return
            mid = lo + n // 2
            out.append((mid, 0, depth, a, b))
            walk(lo, n // 2, depth + 1, a, self.key_at[mid])
            walk(mid + 1, n - n // 2 - 1, depth + 1, self.key_at[mid], b)

        walk(0, self.size, 0, None, None)
        return out

    def hidden(self, lo: int, n: int) -> tuple[bytes, int]:
        if n > self.block or (lo, n) in self.have:
            return top_hash(self.have, lo, n, self.block, self.counted)
        rows = [self.rows[i] for i in range(lo, lo + n)]
        return fold_many([[bytes(r["kv"]) for r in rows]], [[r["own"] for r in rows] if self.counted else None])[0]

    def partial(self, show: Show, full: Callable[[bytes], bool]) -> tuple | None:
        """The partial tree: what ``show`` opens, with values where ``full``, hashes for the rest."""

        def walk(lo: int, n: int, depth: int, a: bytes | None, b: bytes | None) -> tuple | None:
            if not n:
                return None
            if not show(depth, a, b):
                h, count = self.hidden(lo, n)
                return "hash", h, count if self.counted else None
            mid = lo + n // 2
            r = self.rows[mid]
            k = bytes(r["key"])
            sides = walk(lo, n // 2, depth + 1, a, k), walk(mid + 1, n - n // 2 - 1, depth + 1, k, b)
            if full(k):
                return "kv", k, of_row(r), None if r["root"] is None else bytes(r["root"]), *sides
            return "digest", k, bytes(r["digest"]), r["own"] if self.counted else None, *sides

        return walk(0, self.size, 0, None, None)


def _parts(nodes: DataFrame, hashes: Hashes, depth: int, shows: dict[tuple[bytes, ...], Show]) -> dict[tuple[bytes, ...], _Part]:
    """Trees of one depth, all in two jobs: their blocks (a row in ``block`` nodes), then the nodes of the blocks opened."""
    spark = nodes.sparkSession
    blocks: dict[tuple[bytes, ...], list[Row]] = {p: [] for p in shows}
    if depth in hashes.blocks:
        paths = spark.createDataFrame([([bytearray(x) for x in p],) for p in shows], "path array<binary>").withColumn("tree_id", tree_id(F.col("path")))
        for r in hashes.blocks[depth].join(paths, ["tree_id", "path"], "left_semi").collect():
            blocks[tuple(map(bytes, r["path"]))].append(r)
    parts = {p: _Part(rows, hashes.block) for p, rows in blocks.items()}
    opened = [([bytearray(x) for x in p], lo, part) for p, t in parts.items() for lo, part, *_ in t.wanted(shows[p])]
    if opened:
        which = spark.createDataFrame(opened, "path array<binary>, lo bigint, part bigint").withColumn("tree_id", tree_id(F.col("path")))
        rows = hashes.nodes[depth].join(which, ["tree_id", "path", "lo", "part"], "left_semi").join(nodes.where(F.size("path") == depth), ["tree_id", "path", "key"])
        for r in rows.collect():
            parts[tuple(map(bytes, r["path"]))].rows[r["i"]] = r
    return parts


_CUT = "i bigint, part bigint, h binary, n bigint, key binary, digest binary, own bigint, root binary"


def _cut(opened: DataFrame, shows: Sequence[Show], wanted: dict[tuple[int, int], tuple]) -> DataFrame:
    """Opened blocks of one tree cut down to what is shown: a row a node (part 0), and a row with the hash of each run of nodes that stays hidden.

    wanted: of each block its depth, the nearest keys on either side and which of ``shows`` open it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in runs_of(batches, lambda r: (r["lo"], r["part"])):
            open_, hidden = {}, {}

            def walk(rows: list[dict], show: Show, lo: int, n: int, depth: int, a: bytes | None, b: bytes | None) -> None:
                if not n:
                    return
                at = lo - rows[0]["i"]
                if not show(depth, a, b):
                    hidden[lo, n] = rows[at : at + n]
                    return
                mid = rows[at + n // 2]
                open_[mid["i"]] = mid
                walk(rows, show, lo, n // 2, depth + 1, a, mid["key"])
                walk(rows, show, mid["i"] + 1, n - n // 2 - 1, depth + 1, mid["key"], b)

            for rows in runs:
                lo, part = rows[0]["lo"], rows[0]["part"]
                depth, a, b, which = wanted[lo, part]
                for j in which:
                    walk(rows, shows[j], lo, part or 1, depth, a, b)
            found = fold_many([[r["kv"] for r in x] for x in hidden.values()], [[r["own"] for r in x] if x[0]["counted"] else None for x in hidden.values()])
            shown, none = list(open_.values()), [None] * len(hidden)
            same = {c: ([r[c] for r in shown] + none, t) for c, t in (("key", pa.binary()), ("digest", pa.binary()), ("own", pa.int64()), ("root", pa.binary()))}
            i, part = [r["i"] for r in shown] + [lo for lo, _ in hidden], [0] * len(shown) + [n for _, n in hidden]
            h, n = [None] * len(shown) + [h for h, _ in found], [None] * len(shown) + [n for _, n in found]
            yield _batch({"i": (i, pa.int64()), "part": (part, pa.int64()), "h": (h, pa.binary()), "n": (n, pa.int64())} | same)

    x = opened.select("lo", "part", "i", "counted", "key", "digest", "kv", "own", "root")
    return x.repartition("lo", "part").sortWithinPartitions("lo", "part", "i").mapInArrow(run, _CUT)


def _chunk_part(nodes: DataFrame, hashes: Hashes, path: Sequence[bytes], shows: Sequence[Show]) -> _Part:
    """One tree as far as chunks of its levels need it.

    Many levels open many blocks, most of whose nodes stay hidden: executors
    fold those, and the driver gets what the chunks show and the hashes beside it.
    """
    spark, depth, p = nodes.sparkSession, len(path), path_literal(path)
    here = (F.col("tree_id") == tree_id(p)) & (F.col("path") == p)
    out = _Part(hashes.blocks[depth].where(here).collect() if depth in hashes.blocks else [], hashes.block)
    wanted: dict[tuple[int, int], tuple] = {}
    for j, show in enumerate(shows):
        for lo, part, *at in out.wanted(show):
            wanted.setdefault((lo, part), (*at, []))[-1].append(j)
    if wanted:
        which = spark.createDataFrame(list(wanted), "lo bigint, part bigint")
        span_ = F.col("i").between(min(lo for lo, _ in wanted), max(lo + part for lo, part in wanted))
        shown = []
        for r in _cut(hashes.nodes[depth].where(here & span_).join(F.broadcast(which), ["lo", "part"], "left_semi"), shows, wanted).collect():
            if r["part"]:
                out.have[r["i"], r["part"]] = bytes(r["h"]), r["n"]
            else:
                shown.append(r)
        keys = spark.createDataFrame([([bytearray(x) for x in path], r["key"]) for r in shown], "path array<binary>, key binary")
        values = {bytes(r["key"]): r.asDict() for r in near(nodes.where(here), keys).join(F.broadcast(keys), ["path", "key"], "left_semi").select("key", *ELEMENT_COLUMNS).collect()}
        out.rows = {r["i"]: values[bytes(r["key"])] | r.asDict() for r in shown}
    return out


def prove_query(nodes: DataFrame, pq: PathQuery, hashes: Hashes | None = None, log: DataFrame | None = None) -> Layer:
    """What shows a verifier who knows the root hash all rows of a query, and that there are no others up to its limit.

    The trees of a level are read together, two jobs a level, whatever their
    number. Of a tree the driver gets one row in BLOCK of its nodes, and the
    blocks that hold rows of the result or stand beside them: a proof is for
    one reader and is as large as its result. Offsets and a limit of 0 are not
    proved. ``hashes``: of these nodes, where they are known.
    """
    if pq.offset:
        raise NotSupported("queries with an offset are not proved")
    if pq.limit == 0:
        raise NotSupported("queries for nothing are not proved")
    hashes = hashes or hash_forest(nodes, log)
    entered, last = (None, None) if pq.limit is None else seen(nodes, pq)

    def along(path: tuple[bytes, ...], q: Query | None):
        """(items, direction, what to do below a key) of a walk along path, then q."""
        if path:
            return [QueryItem.key(path[0])], True, lambda at, k: along(path[1:], q) if path[1:] or q else None

        def enter(at: tuple[bytes, ...], k: bytes):
            b = q.branch_for(k)
            if b.empty or (entered is not None and (*at, k) not in entered):
                return None
            return along(tuple(b.path or ()), b.query)

        return q.items, q.left_to_right if q.disjoint else None, enter

    def cut(at: tuple[bytes, ...], items: Sequence[QueryItem], forward: bool | None) -> Sequence[QueryItem]:
        """Items up to where a limited query stops in the tree, if it stops in it or below."""
        if last is None or forward is None or len(last) <= len(at) or last[: len(at)] != at:
            return items
        k = last[len(at)]
        bound = span("range_to_inclusive", end=k) if forward else span("range_from", k)
        return [x for i in items if (x := i.intersect(bound).both) is not None]

    out = Layer(None)
    level = {(): (out, *along(tuple(pq.path), pq.query))}
    depth = 0
    while level:
        asked = {at: cut(at, items, forward) for at, (_, items, forward, _) in level.items()}
        shows: dict[tuple[bytes, ...], Show] = {at: lambda _, a, b, items=items: _collides(items, a, b) for at, items in asked.items()}
        parts = _parts(nodes, hashes, depth, shows)
        following = {}
        for at, (layer, _, _, enter) in level.items():
            items = asked[at]
            part = parts[at]
            layer.tree = part.partial(shows[at], lambda k, items=items: any(i.contains(k) for i in items))
            for r in part.rows.values():
                k = bytes(r["key"])
                if r["element_type"] in KEYED_TREES and any(i.contains(k) for i in items) and (sub := enter(at, k)):
                    layer.below[k] = Layer(None)
                    following[(*at, k)] = (layer.below[k], *sub)
        level, depth = following, depth + 1
    return out


def get_proved_path_query(nodes: DataFrame, pq: PathQuery, hashes: Hashes | None = None, log: DataFrame | None = None) -> bytes:
    """The proof of a query as bytes."""
    return prove_query(nodes, pq, hashes, log).to_bytes()


def entries_of(layer: Layer, root: bytes, counted: bool, at: tuple[bytes, ...] = ()) -> list[tuple]:
    """What a layer shows, in order of key, if it leads to ``root``: ("row", key, value, root below), ("digest", key), ("gap", key before, key after)."""
    out: list[tuple] = []
    levels: list[list[tuple]] = []  # nodes by depth: all of a depth are hashed together, deepest first
    known: dict[int, tuple[bytes, int]] = {}

    def node(t: tuple | None, lo: bytes | None, hi: bytes | None, depth: int) -> None:
        if t is None:
            return
        if t[0] == "hash":
            if counted and t[2] is None:
                raise InvalidProof("a count is left out")
            out.append(("gap", lo, hi))
            known[id(t)] = t[1], t[2] or 0
            return
        kind, k, v, extra, left, right = t
        if (lo is not None and k <= lo) or (hi is not None and k >= hi):
            raise InvalidProof("keys are out of order")
        if len(levels) == depth:
            levels.append([])
        levels[depth].append(t)
        node(left, lo, k, depth + 1)
        out.append(("digest", k) if kind == "digest" else ("row", k, v, extra))
        node(right, k, hi, depth + 1)

    node(layer.tree, None, None, 0)
    nodes = [t for level in levels for t in level]
    rows = [t for t in nodes if t[0] == "kv"]
    own = {id(t): t[3] for t in nodes if t[0] == "digest"}
    digests = {id(t): t[2] for t in nodes if t[0] == "digest"} | {id(t): d for t, d in zip(rows, value_hashes([t[2] for t in rows]), strict=True)}
    below = []
    for t in rows:
        element = deserialize(t[2])
        own[id(t)] = element["count"] if element["kind"] in COUNTING else 1
        if element["kind"] in KEYED_TREES or (element["kind"] in TREES and t[3] is not None):
            below.append(t)
    digests |= {id(t): d for t, d in zip(below, blake3_many([digests[id(t)] + (t[3] or ZERO) for t in below]), strict=True)}
    if counted and None in own.values():
        raise InvalidProof("a count is left out")
    kv = {id(t): h for t, h in zip(nodes, kv_hashes([t[1] for t in nodes], [digests[id(t)] for t in nodes]), strict=True)}
    none = (ZERO, 0)
    for level in reversed(levels):
        sides = [tuple(none if x is None else known[id(x)] for x in t[4:]) for t in level]
        totals = [own[id(t)] + a[1] + b[1] if counted else 0 for t, (a, b) in zip(level, sides, strict=True)]
        hashes = node_hashes([kv[id(t)] for t in level], [a[0] for a, _ in sides], [b[0] for _, b in sides], [n if counted else None for n in totals])
        known |= {id(t): x for t, x in zip(level, zip(hashes, totals, strict=True), strict=True)}
    if (ZERO if layer.tree is None else known[id(layer.tree)][0]) != root:
        raise InvalidProof(f"the layer at {at} does not lead to its root")
    return out


def _find(entries: list[tuple], k: bytes) -> tuple | None:
    """The row of a key, or None where its absence is shown."""
    for e in entries:
        if e[0] == "gap" and _collides([QueryItem.key(k)], e[1], e[2]):
            raise InvalidProof("a part that the query asks for is left out")
        if e[0] != "gap" and e[1] == k:
            if e[0] == "digest":
                raise InvalidProof("a value that the query asks for is left out")
            return e
    return None


def _down(layer: Layer, entries: list[tuple], path: Sequence[bytes], at: tuple[bytes, ...]) -> tuple[Layer, list[tuple], tuple | None] | None:
    """(layer, its entries, the tree's own row) at the end of a path of trees; None where some tree on it is not there."""
    row = None
    for k in path:
        row = _find(entries, k)
        if row is None or row[2][0] not in KEYED_TREES:
            return None
        if k not in layer.below:
            raise InvalidProof("a layer is missing")
        layer, at = layer.below[k], (*at, k)
        entries = entries_of(layer, row[3] or ZERO, row[2][0] in COUNTED, at)
    return layer, entries, row


def verify_query(proof: Layer | bytes, pq: PathQuery, root: bytes) -> list[tuple[tuple[bytes, ...], bytes, dict]]:
    """(path, key, element) of the query's rows, in order, if the proof leads to ``root`` and leaves no gap before the limit.

    Where a query says so (``add_parent_tree``) the tree it runs in comes before its rows.
    """
    if isinstance(proof, bytes):
        proof = Layer.from_bytes(proof)
    walk = Walk(pq, Options())
    out: list[tuple[tuple[bytes, ...], bytes, dict]] = []

    def tell(level: int, kind: int, at: tuple[bytes, ...], k: bytes, value: bytes | None) -> None:
        if walk.see(level, kind, value is not None, at, k) and value is not None:
            out.append((at, k, deserialize(value)))

    def run(layer: Layer, entries: list[tuple], at: tuple[bytes, ...], q: Query, level: int) -> None:
        for item in q.items if q.left_to_right else q.items[::-1]:
            for e in entries if q.left_to_right else entries[::-1]:
                hit = _collides([item], e[1], e[2]) if e[0] == "gap" else item.contains(e[1])
                if not hit:
                    continue
                if not walk.back_to(level):
                    return
                if e[0] == "gap":
                    raise InvalidProof("a part that the query asks for is left out")
                if e[0] == "digest":
                    raise InvalidProof("a value that the query asks for is left out")
                _, k, value, below = e
                b = q.branch_for(k)
                if value[0] not in KEYED_TREES or b.empty:
                    tell(level, ROW, at, k, value)
                    continue
                steps = tuple(b.path or ())
                if k not in layer.below:
                    raise InvalidProof("a layer is missing")
                child, here = layer.below[k], (*at, k)
                inside = entries_of(child, below or ZERO, value[0] in COUNTED, here)
                if b.query is None:
                    found = _down(child, inside, steps[:-1], here)
                    row = _find(found[1], steps[-1]) if found else None
                    tell(level, LOOKED_UP, (*here, *steps[:-1]), steps[-1], row[2] if row else None)
                    continue
                walk.see(level, ENTERED, False, at, k)
                found = _down(child, inside, steps, here)
                if found:
                    tree = (*here, *steps)
                    if b.query.add_parent_tree:  # costs no place
                        out.append((tree[:-1], tree[-1], deserialize(found[2][2] if steps else value)))
                    run(found[0], found[1], tree, b.query, level + 1)

    found = _down(proof, entries_of(proof, root, False), tuple(pq.path), ())
    if found:
        if pq.query.add_parent_tree and pq.path:
            out.append((tuple(pq.path[:-1]), pq.path[-1], deserialize(found[2][2])))
        run(found[0], found[1], tuple(pq.path), pq.query, 1)
    return out


def verify_query_get_parent_tree_info(proof: Layer | bytes, pq: PathQuery, root: bytes) -> tuple[tuple[str, int | None, int | None], list[tuple[tuple[bytes, ...], bytes, dict]]]:
    """(what the tree that is asked brings to the one above: kind, sum and count, the query's rows). Not for subqueries, nor the topmost tree."""
    if pq.query.descends:
        raise NotSupported("the tree above is not told for queries with subqueries")
    if not pq.path:
        raise NotSupported("nothing is above the topmost tree")
    if isinstance(proof, bytes):
        proof = Layer.from_bytes(proof)
    found = _down(proof, entries_of(proof, root, False), tuple(pq.path), ())
    if found is None:
        raise InvalidProof("the tree that is asked is not there")
    return feature(deserialize(found[2][2])), verify_query(proof, pq, root)


def prove_query_many(nodes: DataFrame, queries: Sequence[PathQuery], hashes: Hashes | None = None) -> Layer:
    """One proof for several queries: that of their merger. Each of them can be verified on it."""
    return prove_query(nodes, PathQuery.merge(queries), hashes)


def verify_query_exactly(proof: Layer | bytes, pq: PathQuery, root: bytes) -> list[tuple[tuple[bytes, ...], bytes, dict]]:
    """verify_query, and an error if the proof shows values that the query does not ask for."""
    if isinstance(proof, bytes):
        proof = Layer.from_bytes(proof)
    out = verify_query(proof, pq, root)

    def shown(p: Layer, path: tuple[bytes, ...]) -> Iterator[tuple[tuple[bytes, ...], bytes]]:
        def walk(t: tuple | None) -> Iterator[tuple[tuple[bytes, ...], bytes]]:
            if t and t[0] != "hash":
                if t[0] == "kv":
                    yield path, t[1]
                yield from walk(t[4])
                yield from walk(t[5])

        yield from walk(p.tree)
        for k, below in p.below.items():
            yield from shown(below, (*path, k))

    for path, k in shown(proof, ()):
        items = pq.query_items_at_path(path)
        if items is None or not any(i.contains(k) for i in items):
            raise InvalidProof(f"the proof shows {k!r} at {path}, which the query does not ask for")
    return out


def verify_with_absence(proof: Layer | bytes, pq: PathQuery, root: bytes, most: int) -> list[tuple[tuple[bytes, ...], bytes, dict | None]]:
    """A row for every key that the query could return, None for those proved not to be there."""
    found = {(p, k): e for p, k, e in verify_query(proof, pq, root)}
    return [(p, k, found.get((p, k))) for p, k in pq.terminal_keys(most)]


def verify_chained(proof: Layer | bytes, first: PathQuery, then: Sequence, root: bytes) -> list[list[tuple[tuple[bytes, ...], bytes, dict]]]:
    """Dependent queries on one proof: each of ``then`` makes the next query from the rows of the last, or None to stop."""
    out = [verify_query(proof, first, root)]
    for make in then:
        pq = make(out[-1])
        if pq is None:
            break
        out.append(verify_query(proof, pq, root))
    return out


def boundaries(proof: Layer, path: Sequence[bytes]) -> list[bytes]:
    """Keys of a layer that stand in the proof without their values: they show what is not there."""
    for k in path:
        if k not in proof.below:
            raise InvalidProof(f"the proof has no layer at {tuple(path)}")
        proof = proof.below[k]

    def walk(t: tuple | None) -> list[bytes]:
        if not t or t[0] == "hash":
            return []
        return walk(t[4]) + ([t[1]] if t[0] == "digest" else []) + walk(t[5])

    return walk(proof.tree)


# Chunks of levels


def max_depth_of(count: int) -> int:
    """Largest height of a balanced tree of so many nodes: a tree of height h has fib(h + 2) - 1 nodes or more."""
    if count < 1:
        return 0
    a, b, h = 1, 2, 1  # fewest nodes of heights h and h + 1
    while b <= count:
        a, b, h = b, a + b + 1, h + 1
    return h


def chunk_depths(depth: int, most: int) -> list[int]:
    """A depth cut into the fewest parts of at most ``most`` levels, as even as can be, longer ones first."""
    parts = -(-depth // most)
    return [depth // parts + (k < depth % parts) for k in range(parts)] if depth else []


def chunk_depths_with_minimum(depth: int, most: int, least: int) -> list[int]:
    """Like chunk_depths, but the first part has ``least`` levels or more, where the depth allows."""
    parts = chunk_depths(depth, most)
    if not parts or parts[0] >= least or len(parts) == 1:
        return parts
    first = min(least, depth)
    return [first, *chunk_depths(depth - first, most)]


@dataclass(frozen=True)
class Leaf:
    """What lies below a chunk of levels between two neighbouring keys: its hash, and its count in trees that cover counts."""

    hash: bytes
    count: int | None
    low: bytes | None
    high: bytes | None
    above: tuple[bytes, ...]  # keys from the chunk's root down to it


@dataclass(frozen=True)
class Chunk:
    """Verified levels of a tree: elements by key, and the leaves where the next chunks begin."""

    elements: dict[bytes, dict]
    leaves: list[Leaf]
    above: dict[bytes, tuple[bytes, ...]]  # of each key, those from the root down to it

    def trace(self, key: bytes) -> Leaf | None:
        """The leaf below which a key lies that is in none of these levels, if there is one."""
        return next((x for x in self.leaves if (x.low is None or key > x.low) and (x.high is None or key < x.high)), None) if key not in self.elements else None

    def ancestor(self, at: Leaf | bytes, levels: int) -> bytes:
        """The key so many levels above a leaf or key; the root where there are not as many."""
        up = at.above if isinstance(at, Leaf) else self.above[at]
        if not up:
            raise InvalidInput("there is nothing above")
        return up[max(0, len(up) - levels)]


def prove_trunk(nodes: DataFrame, path: Sequence[bytes], levels: int, hashes: Hashes | None = None) -> Layer:
    """The top levels of a tree with all their values, and the way to it from the root."""
    hashes = hashes or hash_forest(nodes)
    path = tuple(path)
    out = layer = Layer(None)
    for d in range(len(path) + 1):
        at = path[:d]
        if d < len(path):
            key = QueryItem.key(path[d])
            show: Show = lambda _, a, b, key=key: _collides([key], a, b)
            layer.tree = _parts(nodes, hashes, d, {at: show})[at].partial(show, lambda k, key=key: key.contains(k))
            layer.below[path[d]] = Layer(None)
            layer = layer.below[path[d]]
        else:
            show = lambda depth, a, b: depth < levels
            layer.tree = _chunk_part(nodes, hashes, at, [show]).partial(show, lambda k: True)
    return out


def verify_trunk(proof: Layer, path: Sequence[bytes], levels: int, root: bytes) -> Chunk:
    """The chunk, if the proof leads to the root and opens just so many levels."""
    found = _down(proof, entries_of(proof, root, False), tuple(path), ())
    if found is None:
        raise InvalidProof("the tree that is asked is not there")
    return _chunk(found[0].tree, levels, None, None)


def _chunk(tree: tuple | None, levels: int, low: bytes | None, high: bytes | None) -> Chunk:
    out = Chunk({}, [], {})

    def walk(t: tuple | None, depth: int, a: bytes | None, b: bytes | None, up: tuple[bytes, ...]) -> None:
        if t is None:
            return
        if (t[0] == "hash") != (depth == levels):
            raise InvalidProof("a chunk opens the levels asked for, with values, and no more")
        if t[0] == "hash":
            out.leaves.append(Leaf(t[1], t[2], a, b, up))
            return
        if t[0] != "kv":
            raise InvalidProof("a value is left out")
        out.elements[t[1]] = deserialize(t[2])
        out.above[t[1]] = up
        walk(t[4], depth + 1, a, t[1], (*up, t[1]))
        walk(t[5], depth + 1, t[1], b, (*up, t[1]))

    walk(tree, 0, low, high, ())
    return out


def prove_branch(nodes: DataFrame, path: Sequence[bytes], leaf: Leaf, levels: int, hashes: Hashes | None = None) -> Layer:
    """The next levels below a leaf of an earlier chunk."""
    return prove_branches(nodes, path, [leaf], levels, hashes)[0]


def prove_branches(nodes: DataFrame, path: Sequence[bytes], leaves: Sequence[Leaf], levels: int, hashes: Hashes | None = None) -> list[Layer]:
    """The next levels below each of some leaves of earlier chunks, read together."""
    hashes = hashes or hash_forest(nodes)
    path = tuple(path)
    shows = [_below(leaf, levels) for leaf in leaves]
    part = _chunk_part(nodes, hashes, path, shows)
    return [_branch(part, leaf, show) for leaf, show in zip(leaves, shows, strict=True)]


def _below(leaf: Leaf, levels: int) -> Show:
    """Opens the way to a leaf and so many levels below it."""

    def inside(a: bytes | None, b: bytes | None) -> bool:
        return (leaf.low is None or (a is not None and a >= leaf.low)) and (leaf.high is None or (b is not None and b <= leaf.high))

    def holds(a: bytes | None, b: bytes | None) -> bool:
        return (a is None or (leaf.low is not None and a <= leaf.low)) and (b is None or (leaf.high is not None and b >= leaf.high))

    first = {"depth": None}

    def show(depth: int, a: bytes | None, b: bytes | None) -> bool:
        if inside(a, b):
            if first["depth"] is None or depth < first["depth"]:
                first["depth"] = depth
            return depth < first["depth"] + levels
        return holds(a, b)

    return show


def _branch(part: _Part, leaf: Leaf, show: Show) -> Layer:
    tree = part.partial(show, lambda k: (leaf.low is None or k > leaf.low) and (leaf.high is None or k < leaf.high))
    # Down to where the leaf is: past the keys above it.
    while tree is not None and tree[0] == "digest":
        tree = tree[5] if leaf.low is not None and tree[1] <= leaf.low else tree[4]
    if tree is None or len(leaf.above) > 128:
        raise InvalidInput("there is nothing below this leaf")
    return Layer(tree)


def verify_branch(proof: Layer, leaf: Leaf, levels: int) -> Chunk:
    """The chunk below a leaf, if it leads to the leaf's hash."""
    entries_of(proof, leaf.hash, leaf.count is not None)
    chunk = _chunk(proof.tree, levels, leaf.low, leaf.high)
    if any((leaf.low is not None and k <= leaf.low) or (leaf.high is not None and k >= leaf.high) for k in chunk.elements):
        raise InvalidProof("keys are out of order")
    return chunk


def elements_by_chunks(nodes: DataFrame, path: Sequence[bytes], keys: Sequence[bytes], trunk: int, branch: int, hashes: Hashes | None = None) -> dict[bytes, dict | None]:
    """The element of each key, None where the tree has none, from a trunk of so many levels and the branches below it.

    Branch after branch until all keys are settled: each is verified against
    the leaf it hangs from, and lies between closer keys than the one above.
    Those of a round are proved together.
    """
    if branch < 1:
        raise InvalidInput("a branch has one level or more")
    hashes = hashes or hash_forest(nodes)
    out: dict[bytes, dict | None] = {}
    todo = [(verify_trunk(prove_trunk(nodes, path, trunk, hashes), path, trunk, root_hash_of(hashes)), list(keys))]
    while todo:
        below: dict[Leaf, list[bytes]] = {}
        for chunk, asked in todo:
            for k in asked:
                leaf = chunk.trace(k)
                if leaf is None:
                    out[k] = chunk.elements.get(k)
                else:
                    below.setdefault(leaf, []).append(k)
        proofs = prove_branches(nodes, path, list(below), branch, hashes) if below else []
        todo = [(verify_branch(p, leaf, branch), asked) for p, (leaf, asked) in zip(proofs, below.items(), strict=True)]
    return out


def trunk_query(proof: Layer, path: Sequence[bytes], levels: int, root: bytes, keys: Sequence[bytes]) -> dict[bytes, dict | Leaf | None]:
    """For each key what a trunk says: its element, the leaf to ask further, or None where it is not in the tree."""
    chunk = verify_trunk(proof, path, levels, root)
    return {k: chunk.elements.get(k) or chunk.trace(k) for k in keys}


def levels(nodes: DataFrame, path: Sequence[bytes], depth: int) -> DataFrame:
    """The top levels of a tree as rows, with each node's depth: a filter on its number among the sorted keys."""
    from ..plans.compile import in_tree

    x = numbered(in_tree(nodes, path).select("key"), ["key"])
    n = x.count()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in b.column("n__").to_pylist():
                lo, size, d = 0, n, 0
                while i != lo + size // 2:
                    mid = size // 2
                    lo, size = (lo, mid) if i < lo + mid else (lo + mid + 1, size - mid - 1)
                    d += 1
                out.append(d)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.int32())], ["key", "depth"])

    return x.select("key", "n__").mapInArrow(walk, "key binary, depth int").where(F.col("depth") < depth)
