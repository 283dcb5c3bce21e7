"""Storage flags by epoch: who owns an element's bytes, and which epoch a removed byte is charged to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidInput

OVERHEAD = 3  # bytes of an epoch's own flag, which are not given back; a fixed value
SINGLE, MULTI, SINGLE_OWNED, MULTI_OWNED = range(4)
OWNER_BYTES = 32


def removed_by_epoch(held: DataFrame, removed: DataFrame) -> DataFrame:
    """Splits removed bytes over epochs, newest first.

    held: id, base_epoch, epoch, bytes (of each epoch after the base).
    removed: id, bytes_left. An epoch whose bytes, less its overhead, are used
    up gives all of those; the last one reached gives what is left; the rest
    is charged to the base epoch. Per id the running sum of what newer epochs
    can give decides, so it is a window over an element's epochs, of which
    there are few.
    """
    x = removed.join(held, "id")
    free = F.when(F.col("epoch") != F.col("base_epoch"), F.greatest(F.col("bytes") - OVERHEAD, F.lit(0)))
    newer = W.partitionBy("id").orderBy(F.desc("epoch"))
    x = x.withColumn("free", F.coalesce(free, F.lit(0)))
    x = x.withColumn("before", F.coalesce(F.sum("free").over(newer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.greatest(F.col("bytes_left") - F.col("before"), F.lit(0))
    own = x.select("id", "epoch", F.least(left, F.col("free")).alias("removed")).where("removed > 0")
    given = x.groupBy("id", "base_epoch").agg(F.first("bytes_left").alias("b"), F.sum("free").alias("f"))
    base = given.select("id", F.col("base_epoch").alias("epoch"), F.greatest(F.col("b") - F.col("f"), F.lit(0)).alias("removed")).where("removed > 0")
    return own.unionByName(base)


def combine_added(ours: dict[int, int], base: int, epoch: int, added: int) -> dict[int, int]:
    """Bytes by epoch after ``added`` bytes more in a later epoch, what its own flag takes included."""
    out = dict(ours)
    if epoch != base and added:
        out[epoch] = out.get(epoch, 0) + added
    return out


def combine_removed(ours: dict[int, int], removed: dict[int, int]) -> dict[int, int]:
    """Bytes by epoch after removals; an epoch with only its overhead left goes."""
    out = {e: n - removed.get(e, 0) for e, n in ours.items()}
    return {e: n for e, n in out.items() if n > OVERHEAD}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def serialize(base: int, epochs: dict[int, int] | None = None, owner: bytes | None = None) -> bytes:
    """Flags as bytes: a kind, the owner if there is one, the base epoch, then epochs and their bytes."""
    kind = (MULTI if epochs else SINGLE) + (SINGLE_OWNED if owner is not None else 0)
    out = bytes([kind]) + (owner or b"") + base.to_bytes(2, "big")
    return out + b"".join(e.to_bytes(2, "big") + _varint(n) for e, n in sorted((epochs or {}).items()))


def deserialize(data: bytes) -> tuple[int, dict[int, int], bytes | None]:
    kind, at = data[0], 1
    owner = None
    if kind >= SINGLE_OWNED:
        owner, at = data[1 : 1 + OWNER_BYTES], 1 + OWNER_BYTES
    base, at = int.from_bytes(data[at : at + 2], "big"), at + 2
    epochs = {}
    while at < len(data):
        e = int.from_bytes(data[at : at + 2], "big")
        epochs[e], at = _read_varint(data, at + 2)
    return base, epochs, owner


# What a batch does to flags: the two callbacks of writes.apply_batch_with_flags

RAISE, OURS, THEIRS = "raise", "ours", "theirs"  # whose owner stays where two differ


def merged_owner(ours: bytes | None, theirs: bytes | None, strategy: str = RAISE) -> bytes | None:
    if ours is None or theirs is None or ours == theirs:
        return theirs if ours is None else ours
    if strategy == RAISE:
        raise InvalidInput("the flags have different owners")
    return ours if strategy == OURS else theirs


def split_removed(flags: bytes | None, removed: int) -> dict[int, int]:
    """Removed bytes by epoch, newest first, each as far as it can give; the rest is the base epoch's. Elements without flags: under epoch -1."""
    if not removed:
        return {}
    if flags is None:
        return {-1: removed}
    base, epochs, _ = deserialize(flags)
    out = {}
    for e in sorted(epochs, reverse=True):
        n = min(removed, max(0, epochs[e] - OVERHEAD))
        if n:
            out[e] = n
            removed -= n
    if removed:
        out[base] = out.get(base, 0) + removed
    return out


def updated(old: bytes | None, new: bytes | None, before: int | None, now: int, strategy: str = THEIRS) -> bytes | None:
    """The flags to write for an element that had ``old`` and ``before`` bytes and gets ``new`` and ``now`` bytes.

    Of one size the old ones stay; a bigger element books its growth on the
    new base epoch, a smaller one takes what it lost from the newest epochs.
    """
    if old is None or before is None:
        return new
    if new is None:
        raise InvalidInput("flags cannot be taken from an element that has some")
    if now == before:
        return old
    (base, epochs, owner), (new_base, more, new_owner) = deserialize(old), deserialize(new)
    if new_base < base:
        raise InvalidInput("an element cannot be updated in an older base epoch")
    both = {e: epochs.get(e, 0) + more.get(e, 0) for e in {*epochs, *more}}
    if now < before and new_base > base:
        if not epochs:  # all its bytes are of the base epoch, and of the owner who had them
            return old
        both = combine_removed(both, {e: n for e, n in split_removed(old, before - now).items() if e != base})
    elif new_base > base:
        both = combine_added(both, base, new_base, now - before)
    return serialize(base, both, merged_owner(owner, new_owner, strategy))


def update_flags(old: Column, new: Column, before: Column, now: Column) -> Column:
    """``updated`` over columns."""

    @F.pandas_udf("binary")
    def run(o: pd.Series, n: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        clean = lambda v: None if v is None or v is pd.NA else bytes(v)
        return pd.Series([updated(clean(x), clean(y), None if pd.isna(a) else int(a), int(c)) for x, y, a, c in zip(o, n, b, w, strict=True)], dtype=object)

    return run(old, new, before, now)


def split_removal_bytes(removed: DataFrame) -> DataFrame:
    """Of (path, key, flags, bytes_left) a row for each epoch that gives bytes back: path, key, owner, epoch, removed."""

    @F.pandas_udf("array<struct<epoch:int,removed:bigint>>")
    def parts(flags: pd.Series, left: pd.Series) -> pd.Series:
        return pd.Series([[{"epoch": e, "removed": n} for e, n in sorted(split_removed(None if f is None else bytes(f), int(b)).items())] for f, b in zip(flags, left, strict=True)])

    @F.pandas_udf("binary")
    def owners(flags: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else deserialize(bytes(f))[2] for f in flags], dtype=object)

    return removed.select("path", "key", owners("flags").alias("owner"), F.explode(parts("flags", "bytes_left")).alias("p")).select("path", "key", "owner", "p.*")
