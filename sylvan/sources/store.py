"""Forests on disk: node, log and side tables in one folder, snapshots of it, and tables written to cut lineage.

A commit is one small file that names the parts of every table, so all tables
are seen at one version and a commit is whole or not there. A part is a base
or a delta; a read merges the deltas over the base by key, a compaction writes
a new base. The file is created without overwriting: of two writers that
started from one version the second gets an error and may try again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, NotSupported, TransactionConflict
from ..model import COLUMNS, SCHEMA, binary, path_literal, tree_id

LOG_SCHEMA = "tree_id bigint, path array<binary>, position bigint, value binary"
AUX_SCHEMA = "path array<binary>, key binary, value binary"
META_SCHEMA = "path array<binary>, key binary, value binary"
SCHEMAS = {"nodes": SCHEMA, "log_entries": LOG_SCHEMA, "aux": AUX_SCHEMA, "meta": META_SCHEMA}
FORMAT = 3  # of the tables and of a commit; a store of a later format is not read
MAX_DELTAS = 8  # parts of a table before it is compacted
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, and the master local, one temporary folder a session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidInput("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="sylvan-")
    return _fallback[app]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Removes all that ``written`` has written for this application: for its end, or when nothing reads earlier results any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what follows neither recomputes it nor loses it with an executor."""
    path = f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Delta:
    """A change of the node table: rows put in, in place of those with their path and key, and (path, key) taken out."""

    put: DataFrame
    gone: DataFrame

    def over(self, nodes: DataFrame) -> DataFrame:
        keys = self.put.select("path", "key").unionByName(self.gone.select("path", "key"))
        k = keys.select(F.col("path").alias("k_path"), F.col("key").alias("k_key"), tree_id(F.col("path")).alias("k_id"))
        left = nodes.join(k, (F.col("tree_id") == F.col("k_id")) & (F.col("path") == F.col("k_path")) & (F.col("key") == F.col("k_key")), "left_anti")
        return left.select(*COLUMNS).unionByName(self.put.select(*COLUMNS))


class Store:
    """A forest in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, n: int) -> dict | None:
        fs, p = self._fs(f"{self.root}/_commits/{n:012d}")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # being written, or its writer was lost
            return None

    def head(self, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
        """(number, parts of each table) of the last whole commit, or of the one named; -1 where there is none."""
        for n in reversed(self._commits()):
            if (version is None or n == version) and (found := self._manifest(n)) is not None:
                if found["format"] > FORMAT:
                    raise NotSupported(f"the store has format {found['format']}")
                return n, found["tables"]
        if version is not None:
            raise InvalidInput(f"there is no version {version}")
        return -1, {t: [] for t in SCHEMAS}

    def _commit(self, n: int, parts: dict[str, list[str]]) -> None:
        fs, p = self._fs(f"{self.root}/_commits/{n:012d}")
        try:
            out = fs.create(p, False)
        except Exception as e:  # the Java error of a file that is there
            raise TransactionConflict(f"version {n} has been written since") from e
        out.write(bytearray(json.dumps({"format": FORMAT, "tables": parts}).encode()))
        out.close()

    def _merged(self, table: str, parts: list[str]) -> DataFrame:
        """A table from its parts: the last base and the deltas after it; of a log, all entries."""
        read = lambda p, extra="": self.spark.read.schema(SCHEMAS[table] + extra).parquet(f"{self.root}/{p}")
        deltas = [p for p in parts if "/delta-" in p]
        out = reduce(DataFrame.unionByName, [read(p) for p in parts if p not in deltas], self.spark.createDataFrame([], SCHEMAS[table])) if len(parts) != 1 or deltas else read(parts[0])
        if not deltas:
            return out
        seq = [read(p, ", gone boolean").withColumn("seq__", F.lit(k)) for k, p in enumerate(deltas)]
        key = ["tree_id", "path", "key"]
        rest = [c for c in COLUMNS if c not in key]
        last = reduce(DataFrame.unionByName, seq).groupBy(*key).agg(F.max_by(F.struct(*rest, "gone"), "seq__").alias("r"))
        k = last.select(*(F.col(c).alias(f"k_{c}") for c in key))
        left = out.join(k, [F.col(c) == F.col(f"k_{c}") for c in key], "left_anti")
        return left.select(*COLUMNS).unionByName(last.where("not r.gone").select(*key, *(F.col(f"r.{c}") for c in rest)))

    def read(self, table: str = "nodes", version: int | None = None) -> DataFrame:
        """A table at its current version, or at an earlier one; a table never written is empty."""
        return self._merged(table, self.head(version)[1][table])

    def transaction(self) -> Transaction:
        return Transaction(self)

    def write(self, df: DataFrame, table: str = "nodes", partitions: int | None = None) -> None:
        """Makes df the current version of a table."""
        t = self.transaction()
        t.write(df, table, partitions)
        t.commit()

    def apply(self, delta: Delta) -> None:
        """Keeps a change beside what it changes: what is written grows with the change, not with the forest."""
        t = self.transaction()
        t.apply(delta)
        t.commit()

    def append(self, entries: DataFrame) -> None:
        """Adds entries to the logs."""
        t = self.transaction()
        t.append(entries)
        t.commit()

    def tree(self, path) -> TreeView:
        """One tree, written to at once."""
        return TreeView(self, path)

    def compact(self, table: str = "nodes") -> None:
        """Writes a table's parts as one."""
        self.write(self.read(table), table)

    def wipe(self) -> None:
        t = self.transaction()
        for table, schema in SCHEMAS.items():
            t.write(self.spark.createDataFrame([], schema), table)
        t.commit()

    def flush(self) -> None:
        """A write is durable when its job has committed."""

    def put_meta(self, key: bytes, value: bytes) -> None:
        """A value about the forest as a whole."""
        row = self.spark.createDataFrame([([], bytearray(key), bytearray(value))], META_SCHEMA)
        self.write(put(self.read("meta"), row), "meta")

    def get_meta(self, key: bytes) -> bytes | None:
        row = get(self.read("meta"), (), key).first()
        return None if row is None else bytes(row["value"])

    def create_checkpoint(self, path: str) -> None:
        """A copy of the current version of every table, which later writes do not touch."""
        other = Store(self.spark, path)
        if other._commits():
            raise InvalidInput("there is a checkpoint already")
        _, parts = self.head()
        t = other.transaction()
        for table in SCHEMAS:
            t.write(self._merged(table, parts[table]), table)
        t.commit()

    def open_checkpoint(self, path: str) -> Store:
        return Store(self.spark, path)

    def delete_checkpoint(self, path: str) -> None:
        """Removes a checkpoint; a folder without commits is no checkpoint and stays."""
        if path.rstrip("/") == self.root or not Store(self.spark, path)._commits():
            raise InvalidInput("this is not a checkpoint")
        fs, p = self._fs(path)
        fs.delete(p, True)


class Transaction:
    """Changes of several tables that become visible together. It reads its own writes; others do not until it commits."""

    def __init__(self, store: Store):
        self.store, self.open = store, True
        self.version, parts = store.head()
        self.parts = {t: list(p) for t, p in parts.items()}
        self.made: list[str] = []

    def _path(self, table: str, kind: str) -> str:
        if not self.open:
            raise InvalidInput("the transaction has ended")
        path = f"{table}/{kind}-{uuid.uuid4().hex}"
        self.made.append(path)
        return path

    def read(self, table: str = "nodes") -> DataFrame:
        return self.store._merged(table, self.parts[table])

    def write(self, df: DataFrame, table: str = "nodes", partitions: int | None = None) -> None:
        """Replaces a table, nodes in order of tree and key: file and row-group statistics then find a tree's range."""
        path = self._path(table, "base")
        df = df.select(*self.store.spark.createDataFrame([], SCHEMAS[table]).columns)
        if table in ("nodes", "log_entries"):
            order = ["tree_id", "key"] if table == "nodes" else ["tree_id", "position"]
            df = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
        df.write.parquet(f"{self.store.root}/{path}")
        self.parts[table] = [path]

    def apply(self, delta: Delta) -> None:
        """Adds a change of the nodes; after MAX_DELTAS of them the table is written anew."""
        path = self._path("nodes", "delta")
        gone = delta.gone.select("path", "key").join(delta.put.select("path", "key"), ["path", "key"], "left_anti").distinct()
        types = dict(self.store.spark.createDataFrame([], SCHEMA).dtypes)
        none = [F.lit(None).cast(types[c]).alias(c) for c in COLUMNS[3:]]
        rows = delta.put.select(*COLUMNS, F.lit(False).alias("gone")).unionByName(gone.select(tree_id(F.col("path")).alias("tree_id"), "path", "key", *none, F.lit(True).alias("gone")))
        rows.sortWithinPartitions("tree_id", "key").write.parquet(f"{self.store.root}/{path}")
        self.parts["nodes"].append(path)
        if len(self.parts["nodes"]) > MAX_DELTAS:
            self.write(self.read())

    def append(self, entries: DataFrame) -> None:
        path = self._path("log_entries", "part")
        entries.select("tree_id", "path", "position", "value").sortWithinPartitions("tree_id", "position").write.parquet(f"{self.store.root}/{path}")
        self.parts["log_entries"].append(path)

    def tree(self, path) -> TreeView:
        """One tree as the transaction has it."""
        return TreeView(self, path)

    def savepoint(self) -> dict[str, list[str]]:
        """Where the transaction stands; ``back_to`` it undoes what came after."""
        return {t: list(p) for t, p in self.parts.items()}

    def back_to(self, savepoint: dict[str, list[str]]) -> None:
        self.parts = {t: list(p) for t, p in savepoint.items()}

    def commit(self) -> None:
        if not self.open:
            raise InvalidInput("the transaction has ended")
        self.store._commit(self.version + 1, self.parts)
        self.open = False

    def rollback(self) -> None:
        """Ends the transaction and removes what it wrote."""
        self.open = False
        for path in self.made:
            fs, p = self.store._fs(f"{self.store.root}/{path}")
            fs.delete(p, True)


class TreeView:
    """One tree of a store or a transaction: reads see it alone, and writes reach no other tree. Sums above are not settled; ``operators.writes`` does that."""

    def __init__(self, owner: Store | Transaction, path):
        self.owner, self.path = owner, tuple(path)

    def read(self) -> DataFrame:
        p = path_literal(self.path)
        return self.owner.read().where((F.col("tree_id") == tree_id(p)) & (F.col("path") == p))

    def get(self, key: bytes) -> DataFrame:
        return self.read().where(F.col("key") == binary(key))

    def put(self, rows: DataFrame) -> None:
        """Elements by key, wherever their path says they are."""
        p = path_literal(self.path)
        here = rows.select(tree_id(p).alias("tree_id"), p.alias("path"), *COLUMNS[2:])
        self.owner.apply(Delta(here, here.select("path", "key").limit(0)))

    def delete(self, keys: DataFrame) -> None:
        gone = keys.select(path_literal(self.path).alias("path"), "key")
        self.owner.apply(Delta(self.owner.read().limit(0), gone))


def put(side: DataFrame, rows: DataFrame) -> DataFrame:
    """A side table (aux or meta) with rows put in place of those with the same path and key."""
    return side.join(rows.select("path", "key"), ["path", "key"], "left_anti").select("path", "key", "value").unionByName(rows.select("path", "key", "value"))


def get(side: DataFrame, path, key: bytes) -> DataFrame:
    return side.where((F.col("path") == path_literal(path)) & (F.col("key") == binary(key)))


def delete(side: DataFrame, rows: DataFrame) -> DataFrame:
    return side.join(rows.select("path", "key"), ["path", "key"], "left_anti").select("path", "key", "value")
