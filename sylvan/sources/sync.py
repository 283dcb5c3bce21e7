"""State sync: one forest brought to the state of another whose root hash is known, chunk by chunk.

A chunk is a block of a tree: at most a few thousand nodes that lie side by
side. Level by level from the root, a provider tells the blocks' hashes of the
trees that differ, which must give the roots known to be right; then come the
blocks, and each must give its hash before it is taken. What a block says of
the roots below is then known to be right, too. All of a level is verified by
tasks, some blocks each, and no more than a limit of bytes is fetched at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidProof
from ..functions.hashing import ZERO
from ..model import COLUMNS, ELEMENT_COLUMNS, KEYED_TREES, contributions, tree_id
from ..operators.integrity import BLOCK, COUNTED, Hashes, block_hashes, digests_of, hash_forest, roots_of_blocks
from .store import Store, written

CHUNK_BYTES = 64 << 20  # fetched at once
BUCKETS = 1024


class Provider:
    """Serves a forest's trees by chunks. It need not be trusted."""

    def __init__(self, nodes: DataFrame, block: int = BLOCK):
        self.nodes = nodes
        self.hashes: Hashes = hash_forest(nodes, block=block)
        self.block = block

    def root_hash(self) -> bytes:
        row = self.hashes.roots.where(F.size("path") == 0).first()
        return bytes(row["root"]) if row else ZERO

    def tops(self, depth: int, trees: DataFrame) -> DataFrame:
        """Blocks of the trees asked for (path): path, size, lo, part, hash, count, and their bytes."""
        return self.hashes.blocks[depth].join(trees.select("path"), "path", "left_semi")

    def sizes(self, depth: int, blocks: DataFrame) -> DataFrame:
        """(path, lo, part, bytes) of blocks."""
        size = F.octet_length("key") + F.coalesce(F.octet_length("item_value"), F.lit(0)) + 64
        rows = self.hashes.nodes[depth].join(blocks.select("path", "lo", "part"), ["path", "lo", "part"], "left_semi").select("tree_id", "path", "key", "lo", "part")
        held = rows.join(self.nodes.where(F.size("path") == depth), ["tree_id", "path", "key"])
        return held.groupBy("path", "lo", "part").agg(F.sum(size).alias("bytes"))

    def fetch(self, depth: int, blocks: DataFrame) -> DataFrame:
        """Elements of the blocks asked for (path, lo, part), each with its number i in its tree and the root below it."""
        which = self.hashes.nodes[depth].join(blocks.select("path", "lo", "part"), ["path", "lo", "part"], "left_semi").select("tree_id", "path", "key", "lo", "part", "i", "size", "root")
        return which.join(self.nodes.where(F.size("path") == depth), ["tree_id", "path", "key"]).select(*COLUMNS, "lo", "part", "i", "size", "root")


def chunks_by_bytes(sizes: DataFrame, limit: int) -> DataFrame:
    """sizes (path, lo, part, bytes) with chunk: blocks dealt to chunks of about ``limit`` bytes, in order within a hash bucket.

    A block is never cut. Buckets bound what one window holds; there are at
    most one in ``limit`` bytes of them.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, min(BUCKETS, total // max(1, limit)))
    w = W.partitionBy("bucket").orderBy("path", "lo", "part").rowsBetween(W.unboundedPreceding, -1)
    x = sizes.withColumn("bucket", F.pmod(F.xxhash64("path", "lo", "part"), F.lit(buckets)).cast("int"))
    x = x.withColumn("slot", F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / limit).cast("bigint"))
    return x.select("path", "lo", "part", "bytes", F.format_string("%04d-%08d", "bucket", "slot").alias("chunk"))


class Session:
    """Brings a store to the state whose root hash is given."""

    def __init__(self, store: Store, root_hash: bytes, block: int = BLOCK):
        self.store, self.want, self.block = store, root_hash, block
        self.nodes = store.read()
        self.have = hash_forest(self.nodes, block=block).roots
        spark = store.spark
        top = [([], bytearray(root_hash), False)] if root_hash != ZERO else []
        #: Trees of the level at hand: path, the root known to be right, whether its hashes cover counts.
        self.level = spark.createDataFrame(top, "path array<binary>, root binary, counted boolean")
        self.taken: list[DataFrame] = []
        self.kept: list[DataFrame] = []
        self.fetched = 0

    def missing(self) -> DataFrame:
        """Trees of the level that the store lacks or has otherwise."""
        return self.level.join(self.have.select("path", "root"), ["path", "root"], "left_anti")

    def check_tops(self, trees: DataFrame, tops: DataFrame) -> DataFrame:
        """The blocks that a provider tells, if they give the trees' roots: an error otherwise."""
        tops = written(tops.drop("counted", "tree_id").join(trees.select("path", "counted"), "path").withColumn("tree_id", tree_id(F.col("path"))), "tops")
        try:
            found = written(roots_of_blocks(tops, self.block), "told")
        except Exception as e:  # blocks that do not make a tree
            raise InvalidProof("the blocks do not make their trees") from e
        if bad := trees.join(found.select("path", F.col("root").alias("told")), "path", "left").where("not root <=> told").first():
            raise InvalidProof(f"the blocks of the tree at {bad['path']} do not give its root")
        return tops

    def apply(self, blocks: DataFrame, rows: DataFrame) -> DataFrame:
        """Takes a chunk: rows of ``blocks``, if each block gives its hash and nothing else is there; an error otherwise, before anything is taken."""
        rows = written(rows.select(*COLUMNS, "lo", "part", "i", "size", "root").withColumn("tree_id", tree_id(F.col("path"))), "chunk")
        if not rows.join(blocks.select("path", "lo", "part"), ["path", "lo", "part"], "left_anti").isEmpty():
            raise InvalidInput("a chunk holds nodes that were not asked for")
        shape = rows.join(blocks.select("path", "lo", "part", "counted", F.col("size").alias("told_size")), ["path", "lo", "part"])
        if not shape.where("size <> told_size").isEmpty():
            raise InvalidProof("a chunk says its tree has another size")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                here = batch.to_pylist()
                if here:
                    kv = digests_of(here)[1]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree_id", "path", "lo", "part", "i", "size", "counted", "key", "own")), pa.array(kv, pa.binary())], ["tree_id", "path", "lo", "part", "i", "size", "counted", "key", "own", "kv"])

        kv = shape.withColumn("own", contributions()[2]).select("tree_id", "path", "lo", "part", "i", "size", "counted", "key", "own", "root", *ELEMENT_COLUMNS)
        kv = kv.mapInArrow(hashed, "tree_id bigint, path array<binary>, lo bigint, part bigint, i bigint, size bigint, counted boolean, key binary, own bigint, kv binary")
        found = block_hashes(kv).select("path", "lo", "part", F.col("h").alias("now"), F.col("n").alias("now_n"))
        wrong = blocks.join(found, ["path", "lo", "part"], "left").where("not h <=> now or (counted and n <> now_n)")
        if bad := wrong.first():
            raise InvalidProof(f"block {bad['lo']} of the tree at {bad['path']} does not give its hash")
        # Keys must stand in order, or a forged order would give another tree from the same blocks.
        w = W.partitionBy("path", "lo", "part").orderBy("i")
        if not rows.withColumn("last", F.lag("key").over(w)).where("key <= last").isEmpty():
            raise InvalidProof("keys are out of order")
        self.taken.append(rows)
        return rows

    def descend(self) -> bool:
        """Goes to the trees that the level's elements name; whether there are any. Trees that are as they should be are taken from the store."""
        same = self.level.join(self.have.select("path", "root"), ["path", "root"], "left_semi").select("path")
        own = self.nodes.join(same, "path", "left_semi").select(*COLUMNS)
        own = written(own, "own")
        self.kept.append(own)
        fresh = written(reduce(DataFrame.unionByName, self.taken), "level") if self.taken else None
        trees = own.where(F.col("element_type").isin(*KEYED_TREES)).withColumn("at", F.concat("path", F.array("key")))
        below = trees.join(self.have.select(F.col("path").alias("at"), "root"), "at").select(F.col("at").alias("path"), "root", F.col("element_type").isin(*COUNTED).alias("counted"))
        if fresh is not None:
            named = fresh.where(F.col("element_type").isin(*KEYED_TREES) & F.col("root").isNotNull() & (F.col("root") != F.lit(bytearray(ZERO))))
            below = below.unionByName(named.select(F.concat("path", F.array("key")).alias("path"), "root", F.col("element_type").isin(*COUNTED).alias("counted")))
            self.kept.append(fresh.select(*COLUMNS))
        self.taken = []
        self.level = written(below, "level")
        return not self.level.isEmpty()

    def commit(self) -> None:
        """Makes the result the store's version, if its root is the one wanted."""
        out = reduce(DataFrame.unionByName, self.kept, self.nodes.limit(0).select(*COLUMNS))
        row = hash_forest(out, block=self.block).roots.where(F.size("path") == 0).first()
        if (bytes(row["root"]) if row else ZERO) != self.want:
            raise InvalidProof("the forest does not have the root hash that was asked for")
        self.store.write(out)


def sync(store: Store, provider: Provider, root_hash: bytes | None = None, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Brings the store to the provider's state, or to that of ``root_hash`` if a trusted one is known; how many trees were fetched."""
    session = Session(store, provider.root_hash() if root_hash is None else root_hash, provider.block)
    fetched, depth = 0, 0
    if session.want == ZERO:
        session.commit()
        return 0
    while True:
        trees = written(session.missing(), "missing")
        n = trees.count()
        if n:
            if depth not in provider.hashes.blocks:
                raise InvalidProof("the provider does not have the trees")
            blocks = session.check_tops(trees, provider.tops(depth, trees))
            dealt = written(chunks_by_bytes(provider.sizes(depth, blocks), chunk_bytes), "chunks")
            for r in dealt.select("chunk").distinct().orderBy("chunk").toLocalIterator():
                part = blocks.join(dealt.where(F.col("chunk") == r["chunk"]).select("path", "lo", "part"), ["path", "lo", "part"], "left_semi")
                session.apply(part, provider.fetch(depth, part))
            fetched += n
        if not session.descend():
            break
        depth += 1
    session.commit()
    return fetched
