"""The relational form of a forest: one row per element, and the columns each kind of element uses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of element; the numbers are part of the data format and stay fixed.
ITEM, REFERENCE, TREE, SUM_ITEM, SUM_TREE, BIG_SUM_TREE, COUNT_TREE, COUNT_SUM_TREE, PROVABLE_COUNT_TREE = range(9)
ITEM_WITH_SUM, PROVABLE_COUNT_SUM_TREE, COMMITMENT_TREE, MMR_TREE, BULK_APPEND_TREE, DENSE_TREE = range(9, 15)
NAMES = (
    "item", "reference", "tree", "sum item", "sum tree", "big sum tree", "count tree", "count sum tree", "provable count tree",
    "item with sum item", "provable count sum tree", "commitment tree", "mmr tree", "bulk append tree", "dense tree",
)
LOG_TREES = (COMMITMENT_TREE, MMR_TREE, BULK_APPEND_TREE, DENSE_TREE)
KEYED_TREES = (TREE, SUM_TREE, BIG_SUM_TREE, COUNT_TREE, COUNT_SUM_TREE, PROVABLE_COUNT_TREE, PROVABLE_COUNT_SUM_TREE)
TREES = KEYED_TREES + LOG_TREES
SUMMING = (SUM_TREE, COUNT_SUM_TREE, PROVABLE_COUNT_SUM_TREE)
COUNTING = (COUNT_TREE, COUNT_SUM_TREE, PROVABLE_COUNT_TREE, PROVABLE_COUNT_SUM_TREE)

#: Kinds of reference path; fixed likewise.
ABSOLUTE, UPSTREAM_ROOT, UPSTREAM_ROOT_WITH_PARENT, UPSTREAM_ELEMENT, COUSIN, REMOVED_COUSIN, SIBLING = range(7)

MAX_KEY_BYTES = 255
ELEMENT = (
    ("element_type", "tinyint"),
    ("item_value", "binary"),
    ("sum_value", "bigint"),
    ("big_sum_value", "decimal(38,0)"),
    ("count_value", "bigint"),
    ("ref", "struct<kind:tinyint,n:tinyint,segs:array<binary>>"),
    ("max_hops", "tinyint"),
    ("log_count", "bigint"),
    ("chunk_power", "tinyint"),
    ("mmr_size", "bigint"),
    ("height", "tinyint"),
    ("flags", "binary"),
)
ELEMENT_COLUMNS = [c for c, _ in ELEMENT]
SCHEMA = "tree_id bigint, path array<binary>, key binary, " + ", ".join(f"{c} {t}" for c, t in ELEMENT)
COLUMNS = ["tree_id", "path", "key", *ELEMENT_COLUMNS]


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


def path_literal(path: Sequence[bytes]) -> Column:
    return F.array(*map(binary, path)).cast("array<binary>")


def tree_id(path: Column) -> Column:
    """What nodes are bucketed and joined by; equality of paths is always checked too."""
    return F.xxhash64(path)


def nodes(df: DataFrame, path: Column, key: Column, element_type: Column | int, **values: Column) -> DataFrame:
    """Rows of the node table from the rows of any frame; columns not given are null."""
    kind = element_type if isinstance(element_type, Column) else F.lit(element_type)
    given = {"element_type": kind} | values
    cols = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in ELEMENT]
    p = path.cast("array<binary>")
    return df.select(tree_id(p).alias("tree_id"), p.alias("path"), key.cast("binary").alias("key"), *cols)


@dataclass(frozen=True)
class Reference:
    """A reference path: how to reach another element from where this one lies."""

    kind: int
    segments: tuple[bytes, ...] = ()
    n: int = 0

    def resolve(self, path: Sequence[bytes], key: bytes) -> tuple[bytes, ...]:
        """Path and key of the target, as one list."""
        path, segs = tuple(path), self.segments
        if self.kind == ABSOLUTE:
            return segs
        if self.kind in (UPSTREAM_ROOT, UPSTREAM_ROOT_WITH_PARENT, UPSTREAM_ELEMENT):
            if self.n > len(path) or (self.kind == UPSTREAM_ROOT_WITH_PARENT and not path):
                from .errors import InvalidInput

                raise InvalidInput("reference stored path cannot satisfy reference constraints")
            keep = len(path) - self.n if self.kind == UPSTREAM_ELEMENT else self.n
            return path[:keep] + segs + (path[-1:] if self.kind == UPSTREAM_ROOT_WITH_PARENT else ())
        if self.kind == SIBLING:
            return path + segs[:1]
        if not path:
            from .errors import InvalidInput

            raise InvalidInput("reference stored path cannot satisfy reference constraints")
        return path[:-1] + (segs[:1] if self.kind == COUSIN else segs) + (key,)


def element(path: Iterable[bytes], key: bytes, kind: int, *, item: bytes | None = None, sum: int | None = None, big_sum: int | None = None, count: int | None = None, ref: Reference | None = None, hops: int | None = None, log_count: int | None = None, chunk_power: int | None = None, mmr_size: int | None = None, height: int | None = None, flags: bytes | None = None) -> tuple:
    """A row for ``frame``: path, key and the element's values."""
    if len(key) > MAX_KEY_BYTES:
        from .errors import InvalidInput

        raise InvalidInput("a key has at most 255 bytes")
    r = None if ref is None else (ref.kind, ref.n, [bytearray(s) for s in ref.segments])
    data = (kind, None if item is None else bytearray(item), sum, big_sum, count, r, hops, log_count, chunk_power, mmr_size, height, None if flags is None else bytearray(flags))
    return ([bytearray(p) for p in path], bytearray(key), *data)


def frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A node table of rows made by ``element``."""
    from decimal import Decimal

    rows = [(*r[:5], None if r[5] is None else Decimal(r[5]), *r[6:]) for r in rows]
    schema = "path array<binary>, key binary, " + ", ".join(f"{c} {t}" for c, t in ELEMENT)
    return spark.createDataFrame(rows, schema).select(tree_id(F.col("path")).alias("tree_id"), "path", "key", *ELEMENT_COLUMNS)


def is_kind(*kinds: int, column: str = "element_type") -> Column:
    return F.col(column).isin(*kinds)


def is_tree(column: str = "element_type") -> Column:
    return is_kind(*TREES, column=column)


def contributions() -> tuple[Column, Column, Column]:
    """(sum, big sum, count) of an element, as the trees that take account of them see it."""
    t = F.col("element_type")
    value = F.when(t.isin(SUM_ITEM, ITEM_WITH_SUM, *SUMMING), F.coalesce("sum_value", F.lit(0))).otherwise(F.lit(0).cast("bigint"))
    big = F.when(t == BIG_SUM_TREE, F.coalesce("big_sum_value", F.lit(0).cast("decimal(38,0)"))).otherwise(value.cast("decimal(38,0)"))
    n = F.when(t.isin(*COUNTING), F.coalesce("count_value", F.lit(0))).otherwise(F.lit(1).cast("bigint"))
    return value, big, n


def contribution(parent_type: Column) -> tuple[Column, Column, Column]:
    """(sum, big sum, count) that an element gives to the tree of the given type that holds it."""
    value, big, n = contributions()
    return (
        F.when(parent_type.isin(*SUMMING), value),
        F.when(parent_type == BIG_SUM_TREE, big),
        F.when(parent_type.isin(*COUNTING), n),
    )


def target(path: Column, key: Column, ref: Column) -> Column:
    """Path and key, as one list, that a reference at (path, key) points to; null where its kind cannot be satisfied."""
    kind, n, segs = ref["kind"], ref["n"].cast("int"), ref["segs"]
    size = F.size(path)
    head = lambda k: F.slice(path, F.lit(1), k)
    fits = n <= size
    safe = F.least(n, size)
    last = F.slice(path, F.greatest(size, F.lit(1)), F.lit(1))
    parent = head(F.greatest(size - 1, F.lit(0)))
    return (
        F.when(kind == ABSOLUTE, segs)
        .when((kind == UPSTREAM_ROOT) & fits, F.concat(head(safe), segs))
        .when((kind == UPSTREAM_ROOT_WITH_PARENT) & fits & (size > 0), F.concat(head(safe), segs, last))
        .when((kind == UPSTREAM_ELEMENT) & fits, F.concat(head(size - safe), segs))
        .when((kind == COUSIN) & (size > 0), F.concat(parent, F.slice(segs, 1, 1), F.array(key)))
        .when((kind == REMOVED_COUSIN) & (size > 0), F.concat(parent, segs, F.array(key)))
        .when(kind == SIBLING, F.concat(path, F.slice(segs, 1, 1)))
    )


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def int_key(n: int, size: int = 4) -> bytes:
    """A big-endian key: byte order is numeric order."""
    return n.to_bytes(size, "big")


def key_of(number: Column, size: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 2 * size, "0"))


def number_of(key: Column) -> Column:
    return F.conv(F.hex(key), 16, 10).cast("bigint")
