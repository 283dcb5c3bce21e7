"""Append-only logs: positions, chunks and buffers, and the roots of mountain ranges and dense trees.

A log is the rows of ``log_entries`` with its path; an append adds rows with
the next positions. Roots are folds: leaves are reduced in aligned blocks, one
block a group, until each peak is one hash, so no group grows with the log.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidProof
from ..functions.hashing import ZERO, blake3, blake3_many
from ..model import BULK_APPEND_TREE, COMMITMENT_TREE, DENSE_TREE, MMR_TREE, path_literal, tree_id
from ..plans.query import QueryItem
from ..sources.store import written

FOLD = 12  # a block of the fold has 2**FOLD leaves
LEAF, INNER = b"\0", b"\1"


# Positions


def numbered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with n__, its rows' numbers in order: a range sort deals rows to partitions, each counts its own, and no task sees more than its part."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part__", F.spark_partition_id()).withColumn("id__", F.monotonically_increasing_id()), "numbered")
    starts, at = [], 0
    for r in rows.groupBy("part__").agg(F.count("*").alias("n"), F.min("id__").alias("first")).orderBy("part__").collect():
        starts.append((r["part__"], r["first"], at))
        at += r["n"]
    table = df.sparkSession.createDataFrame(starts, "part__ int, first__ bigint, start__ bigint")
    return rows.join(F.broadcast(table), "part__").withColumn("n__", F.col("start__") + F.col("id__") - F.col("first__")).drop("part__", "id__", "first__", "start__")


def append(log: DataFrame, path: Sequence[bytes], values: DataFrame, order: list[Column], capacity: int | None = None) -> DataFrame:
    """Entries for ``values`` (a column value), in ``order``, after those already in the log at ``path``."""
    p = path_literal(tuple(path))
    before = of(log, path).count()
    at = numbered(values, order)
    if capacity is not None and before + values.count() > capacity:
        raise InvalidInput(f"the tree holds at most {capacity} values")
    return at.select(tree_id(p).alias("tree_id"), p.alias("path"), (F.col("n__") + before).alias("position"), "value")


def of(log: DataFrame, path: Sequence[bytes]) -> DataFrame:
    p = path_literal(tuple(path))
    return log.where((F.col("tree_id") == tree_id(p)) & (F.col("path") == p))


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.count("*").alias("n"))


def get_value(log: DataFrame, path: Sequence[bytes], position: int) -> DataFrame:
    return of(log, path).where(F.col("position") == position).select("position", "value")


def query_positions(items: Sequence[QueryItem], position: Column, size: int) -> Column:
    """Items over big-endian positions of ``size`` bytes, as a predicate on numbers."""
    out = F.lit(False)
    for i in items:
        (lo, lo_out), (hi, hi_in) = i.lower_bound(), i.upper_bound()
        hit = F.lit(True)
        if lo is not None:
            n = _number(lo, size)
            hit = hit & (position > n if lo_out else position >= n)
        if hi is not None:
            n = _number(hi, size)
            hit = hit & (position <= n if hi_in else position < n)
        out = out | hit
    return out


def _number(key: bytes, size: int) -> int:
    if len(key) != size:
        raise InvalidInput(f"positions have {size} bytes")
    return int.from_bytes(key, "big")


# Mountain ranges


def leaf_index_to_pos(i: Column) -> Column:
    """Place of leaf i among all nodes: two for each leaf before it, less those not yet joined."""
    return 2 * i - F.bit_count(i)


def mmr_size(leaves: Column) -> Column:
    return 2 * leaves - F.bit_count(leaves)


def hash_count_for_push(leaves: Column) -> Column:
    """Hashes for one more leaf: its own and one for each trailing one bit of the count."""
    return 1 + F.bit_count(leaves.bitwiseXOR(leaves + 1)) - 1


def leaf_count(size: int) -> int:
    """Leaves of a range of so many nodes; peaks are taken from the largest."""
    leaves, left = 0, size
    for h in reversed(range(size.bit_length())):
        peak = (1 << h + 1) - 1
        if peak <= left:
            left -= peak
            leaves += 1 << h
    if left:
        raise InvalidInput(f"no mountain range has {size} nodes")
    return leaves


def peaks(leaves: int) -> list[tuple[int, int]]:
    """(first leaf, height) of each peak, largest first."""
    out, first = [], 0
    for h in reversed(range(leaves.bit_length())):
        if leaves >> h & 1:
            out.append((first, h))
            first += 1 << h
    return out


def get_peaks(size: int) -> list[int]:
    """Positions of the peaks among all nodes."""
    out, at = [], -1
    for _, h in peaks(leaf_count(size)):
        at += (1 << h + 1) - 1
        out.append(at)
    return out


def bag(tops: Sequence[bytes]) -> bytes:
    """One hash of the peaks: from the right, each joined under the one before. No peaks: zeros."""
    if not tops:
        return ZERO
    root = tops[-1]
    for t in reversed(tops[:-1]):
        root = blake3(INNER + root + t)
    return root


def _fold(hashes: list[bytes]) -> bytes:
    while len(hashes) > 1:
        hashes = blake3_many([INNER + a + b for a, b in zip(hashes[::2], hashes[1::2], strict=True)])
    return hashes[0]


def mmr_peaks(log: DataFrame, path: Sequence[bytes]) -> list[bytes]:
    """Hashes of the peaks of the log at ``path``: at most 64, whatever its length."""
    x = of(log, path).select("position", "value")
    n = x.count()
    tops = peaks(n)
    peak = F.lit(None).cast("int")
    for k, (first, _) in enumerate(tops):
        peak = F.when(F.col("position") >= first, k).otherwise(peak)
    x = x.select(peak.alias("peak"), "position", "value")
    starts = F.array(*(F.lit(f).cast("bigint") for f, _ in tops)) if tops else F.array().cast("array<bigint>")
    x = x.select("peak", (F.col("position") - F.element_at(starts, F.col("peak") + 1)).alias("i"), "value").withColumn("leaf", F.lit(True))
    height = max((h for _, h in tops), default=0)
    while True:

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            hs = pdf["value"].tolist()
            if pdf["leaf"].iloc[0]:
                hs = blake3_many([LEAF + v for v in hs])
            return pd.DataFrame({"peak": [pdf["peak"].iloc[0]], "i": [pdf["i"].iloc[0] >> FOLD], "value": [_fold(list(map(bytes, hs)))], "leaf": [False]})

        x = written(x.groupBy("peak", F.shiftright("i", FOLD).alias("block")).applyInPandas(block, "peak int, i bigint, value binary, leaf boolean"), "fold")
        height -= FOLD
        if height <= 0:
            break
    return [bytes(r["value"]) for r in x.orderBy("peak").collect()]  # one row a peak


def _peaks_of_all(entries: DataFrame) -> DataFrame:
    """(path, height, value) of the peaks of every log in ``entries``: all logs are folded together, a block of leaves a group.

    The peak of a leaf is the highest bit in which its position differs from
    the log's length; below it lie 2**height leaves.
    """
    n = entries.groupBy(F.col("path").alias("n_path")).agg(F.count("*").alias("n"))
    x = entries.join(n, F.col("path") == F.col("n_path"))
    height = F.length(F.bin(F.col("n").bitwiseXOR(F.col("position")))) - 1
    first = F.call_function("shiftleft", F.call_function("shiftright", "n", F.col("height") + 1), F.col("height") + 1)
    x = x.withColumn("height", height.cast("int")).select("path", "height", (F.col("position") - first).alias("i"), "value", F.lit(True).alias("leaf"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        hs = list(map(bytes, pdf["value"]))
        if pdf["leaf"].iloc[0]:
            hs = blake3_many([LEAF + v for v in hs])
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "height": [pdf["height"].iloc[0]], "i": [pdf["i"].iloc[0] >> FOLD], "value": [_fold(hs)], "leaf": [False]})

    tallest = x.agg(F.max("height")).first()[0]
    while tallest is not None:
        x = written(x.groupBy("path", "height", F.shiftright("i", FOLD).alias("block")).applyInPandas(block, "path array<binary>, height int, i bigint, value binary, leaf boolean"), "fold")
        tallest -= FOLD
        if tallest <= 0:
            break
    return x.select("path", "height", "value")


def _bagged(tops: DataFrame) -> DataFrame:
    """(path, root) from peaks: at most 64 a log."""

    @F.pandas_udf("binary")
    def bags(lists: pd.Series) -> pd.Series:
        return pd.Series([bag([bytes(p["value"]) for p in reversed(ps)]) for ps in lists])

    return tops.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("height", "value"))).alias("tops")).select("path", bags("tops").alias("root"))


def log_roots(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """(path, root) of every log that a tree element names and that holds something: of all logs of a kind together.

    A commitment tree's own tree over a curve is out of scope: its anchor is
    taken as zeros, and its root covers all its entries.
    """
    trees = nodes.where(F.col("element_type").isin(MMR_TREE, BULK_APPEND_TREE, DENSE_TREE, COMMITMENT_TREE)).select(F.concat("path", F.array("key")).alias("t_path"), F.col("element_type").alias("kind"), F.coalesce("chunk_power", F.lit(0)).cast("int").alias("power"))
    x = written(log.join(trees, F.col("path") == F.col("t_path")).select("path", "position", "value", "kind", "power"), "entries")
    mmr = _bagged(_peaks_of_all(x.where(F.col("kind") == MMR_TREE).select("path", "position", "value")))
    chunked = x.where(F.col("kind").isin(BULK_APPEND_TREE, COMMITMENT_TREE))
    n = chunked.groupBy(F.col("path").alias("n_path")).agg(F.count("*").alias("n"))
    chunked = written(chunked.join(n, F.col("path") == F.col("n_path")).withColumn("chunk", F.call_function("shiftright", "position", "power")).withColumn("chunks", F.call_function("shiftright", "n", "power")), "chunked")

    @F.pandas_udf("binary")
    def blobs(lists: pd.Series) -> pd.Series:
        return pd.Series([serialize_chunk([bytes(e["value"]) for e in es]) for es in lists])

    @F.pandas_udf("binary")
    def dense(lists: pd.Series) -> pd.Series:
        return pd.Series([dense_root([bytes(e["value"]) for e in es]) for es in lists])

    @F.pandas_udf("binary")
    def states(range_root: pd.Series, buffer_root: pd.Series, kind: pd.Series) -> pd.Series:
        out = [blake3(b"bulk_state" + bytes(a or ZERO) + bytes(b or ZERO)) for a, b in zip(range_root, buffer_root, strict=True)]
        return pd.Series([commitment_state_root(ZERO, h) if k == COMMITMENT_TREE else h for h, k in zip(out, kind, strict=True)])

    def listed(rows: DataFrame, *keys: str) -> DataFrame:  # chunks, buffers and dense trees: bounded by their power or height
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("entries"))

    whole = listed(chunked.where("chunk < chunks"), "path", "chunk").select("path", F.col("chunk").cast("bigint").alias("position"), blobs("entries").alias("value"))
    ranges = _bagged(_peaks_of_all(written(whole, "blobs"))).withColumnRenamed("root", "range_root")
    buffers = listed(chunked.where("chunk >= chunks"), "path").select("path", dense("entries").alias("buffer_root"))
    state = chunked.select("path", "kind").distinct().join(ranges, "path", "left").join(buffers, "path", "left").select("path", states("range_root", "buffer_root", "kind").alias("root"))
    own = listed(x.where(F.col("kind") == DENSE_TREE), "path").select("path", dense("entries").alias("root"))
    return mmr.unionByName(state).unionByName(own)


def mmr_root(log: DataFrame, path: Sequence[bytes]) -> bytes:
    return bag(mmr_peaks(log, path))


class Mmr:
    """A mountain range in memory: pushes, proofs and their checks, for the values that a proof is about."""

    def __init__(self, values: Sequence[bytes] = ()):
        self.levels: list[list[bytes]] = [[]]
        self.n = 0
        for v in values:
            self.push(v)

    def push(self, value: bytes) -> int:
        """Adds a leaf; its position among all nodes."""
        pos = 2 * self.n - self.n.bit_count()
        self.levels[0].append(blake3(LEAF + value))
        h, i = 0, self.n
        while i & 1:
            if len(self.levels) == h + 1:
                self.levels.append([])
            self.levels[h + 1].append(blake3(INNER + self.levels[h][i - 1] + self.levels[h][i]))
            h, i = h + 1, i >> 1
        self.n += 1
        return pos

    @property
    def tops(self) -> list[bytes]:
        return [self.levels[h][first >> h] for first, h in peaks(self.n)]

    def root(self) -> bytes:
        return bag(self.tops)

    def prove(self, leaves: Sequence[int]) -> dict:
        """What shows that the leaves are in the range: for each, the siblings up to its peak, and the other peaks."""
        if any(not 0 <= i < self.n for i in leaves):
            raise InvalidInput("there is no such leaf")
        paths = {}
        for i in leaves:
            first, h = next((f, h) for f, h in peaks(self.n) if f <= i < f + (1 << h))
            paths[i] = [self.levels[k][(i >> k) ^ 1] for k in range(h)]
        return {"n": self.n, "paths": paths, "peaks": self.tops}


def verify_mmr(proof: dict, values: dict[int, bytes], root: bytes) -> dict[int, bytes]:
    """The proved values, if every one leads to its peak and the peaks to the root."""
    n = proof["n"]
    shape = peaks(n)
    if len(proof["peaks"]) != len(shape) or bag(proof["peaks"]) != root:
        raise InvalidProof("the peaks do not give the root")
    if set(values) != set(proof["paths"]):
        raise InvalidProof("the proof is about other leaves")
    for i, value in values.items():
        k, (first, h) = next(((k, p) for k, p in enumerate(shape) if p[0] <= i < p[0] + (1 << p[1])), (None, (0, 0)))
        if k is None or len(proof["paths"][i]) != h:
            raise InvalidProof("a path has the wrong length")
        x = blake3(LEAF + value)
        for level, other in enumerate(proof["paths"][i]):
            x = blake3(INNER + (other + x if i >> level & 1 else x + other))
        if x != proof["peaks"][k]:
            raise InvalidProof(f"leaf {i} does not lead to its peak")
    return values


def verify_growth(old_n: int, old_root: bytes, new_n: int, new_root: bytes, old_peaks: Sequence[bytes], joined: Sequence[bytes], new_peaks: Sequence[bytes]) -> bool:
    """Whether a range of new_n leaves continues one of old_n: its peaks are made of the old ones and ``joined``, siblings to their right, in order."""
    if bag(old_peaks) != old_root or bag(new_peaks) != new_root or len(old_peaks) != len(peaks(old_n)) or len(new_peaks) != len(peaks(new_n)) or new_n < old_n:
        return False
    have = {(f, h): p for (f, h), p in zip(peaks(old_n), old_peaks, strict=True)}
    extra = iter(joined)

    def node(f: int, h: int) -> bytes | None:
        if (f, h) in have:
            return have[f, h]
        if f >= old_n:
            return next(extra, None)
        a, b = node(f, h - 1), node(f + (1 << h - 1), h - 1)
        return None if a is None or b is None else blake3(INNER + a + b)

    return all(f >= old_n or node(f, h) == p for (f, h), p in zip(peaks(new_n), new_peaks, strict=True))


def growth_siblings(old_n: int, m: Mmr) -> list[bytes]:
    """What verify_growth needs besides the peaks."""
    known = set(peaks(old_n))
    out: list[bytes] = []

    def walk(f: int, h: int) -> None:
        if (f, h) in known:
            return
        if f >= old_n:
            out.append(m.levels[h][f >> h])
            return
        walk(f, h - 1)
        walk(f + (1 << h - 1), h - 1)

    for f, h in peaks(m.n):
        if f < old_n:
            walk(f, h)
    return out


# Bulk append: chunks of 2**power entries and a buffer


def bulk_chunk_count(n: Column, power: int) -> Column:
    return F.floor(n / (1 << power)).cast("bigint")


def bulk_chunks(log: DataFrame, path: Sequence[bytes], power: int) -> DataFrame:
    """Completed chunks: chunk number, and its values in order. A chunk has 2**power entries, so groups are bounded."""
    x = of(log, path)
    whole = (x.count() >> power) << power
    x = x.where(F.col("position") < whole).groupBy(F.shiftright("position", power).alias("chunk"))
    return x.agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("entries")).select("chunk", F.col("entries.value").alias("values"))


def bulk_buffer(log: DataFrame, path: Sequence[bytes], power: int) -> DataFrame:
    """Entries after the last completed chunk: fewer than 2**power."""
    x = of(log, path)
    whole = (x.count() >> power) << power
    return x.where(F.col("position") >= whole).select("position", (F.col("position") - whole).alias("slot"), "value")


def serialize_chunk(values: Sequence[bytes]) -> bytes:
    """A chunk as bytes: fixed-size entries without lengths where all sizes agree, else a length before each."""
    n = len(values).to_bytes(4, "big")
    sizes = {len(v) for v in values}
    if len(sizes) == 1:
        return b"\1" + n + sizes.pop().to_bytes(4, "big") + b"".join(values)
    return b"\0" + n + b"".join(len(v).to_bytes(4, "big") + v for v in values)


def deserialize_chunk(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[1:5], "big")
    out, at = [], 5
    if data[:1] == b"\1":
        size = int.from_bytes(data[5:9], "big")
        out = [data[9 + k * size : 9 + (k + 1) * size] for k in range(n)]
        at = 9 + n * size
    else:
        for _ in range(n):
            size = int.from_bytes(data[at : at + 4], "big")
            out.append(data[at + 4 : at + 4 + size])
            at += 4 + size
    if at != len(data) or len(out) != n:
        raise InvalidInput("this is not a chunk")
    return out


def bulk_state_root(log: DataFrame, path: Sequence[bytes], power: int) -> bytes:
    """Root over the range of chunk blobs and the dense tree of the buffer."""

    def blob(values: pd.Series) -> pd.Series:
        return pd.Series([serialize_chunk([bytes(v) for v in vs]) for vs in values])

    chunks = bulk_chunks(log, path, power).select("chunk", F.pandas_udf(blob, "binary")("values").alias("value"))
    p = path_literal(tuple(path))
    as_log = written(chunks.select(tree_id(p).alias("tree_id"), p.alias("path"), F.col("chunk").cast("bigint").alias("position"), "value"), "chunks")
    buffer = [bytes(r["value"]) for r in bulk_buffer(log, path, power).orderBy("slot").collect()]  # fewer than 2**power
    return blake3(b"bulk_state" + mmr_root(as_log, path) + dense_root(buffer))


def commitment_state_root(anchor: bytes, bulk_root: bytes) -> bytes:
    return blake3(b"ct_state" + anchor + bulk_root)


# Dense trees: a full binary tree filled level by level


def dense_capacity(height: int) -> int:
    if not 1 <= height <= 16:
        raise InvalidInput("a dense tree has 1 to 16 levels")
    return (1 << height) - 1


def dense_level(position: Column) -> Column:
    return F.length(F.bin(position + 1)) - 1


def dense_parent(position: Column) -> Column:
    return F.when(position > 0, F.floor((position - 1) / 2).cast("bigint"))


def dense_root(values: Sequence[bytes]) -> bytes:
    """Root of at most 65,535 values: each node hashes its value's hash and its children's, missing ones zeros."""
    n = len(values)
    own = blake3_many(values)
    node = [ZERO] * (2 * n + 2)
    level_end = n
    while level_end > 0:
        start = (1 << level_end.bit_length() - 1) - 1
        at = range(start, level_end)
        for p, h in zip(at, blake3_many([own[p] + node[2 * p + 1] + node[2 * p + 2] for p in at]), strict=True):
            node[p] = h
        level_end = start
    return node[0] if n else ZERO


def dense_tree_root(log: DataFrame, path: Sequence[bytes], height: int) -> bytes:
    rows = of(log, path).orderBy("position").limit(dense_capacity(height) + 1).collect()  # bounded by the tree's height
    if len(rows) > dense_capacity(height):
        raise InvalidInput("the dense tree is over full")
    return dense_root([bytes(r["value"]) for r in rows])


def dense_prove(values: Sequence[bytes], positions: Sequence[int]) -> dict:
    """Values, value hashes and sibling hashes that lead from positions to the root."""
    n, own = len(values), blake3_many(values)
    need = set()
    for p in positions:
        if not 0 <= p < n:
            raise InvalidInput("there is no such position")
        while p >= 0:
            need.add(p)
            p = (p - 1) // 2
    below = {c for p in need for c in (2 * p + 1, 2 * p + 2)} - need
    sub = {c: (_dense_node(values, c) if c < n else ZERO) for c in below}
    return {"n": n, "values": {p: values[p] for p in positions}, "hashes": {p: own[p] for p in need - set(positions)}, "below": sub}


def _dense_node(values: Sequence[bytes], p: int) -> bytes:
    if p >= len(values):
        return ZERO
    return blake3(blake3(values[p]) + _dense_node(values, 2 * p + 1) + _dense_node(values, 2 * p + 2))


def dense_verify(proof: dict, root: bytes) -> dict[int, bytes]:
    known = proof["values"]

    def node(p: int) -> bytes:
        if p in proof["below"]:
            if p >= proof["n"] and proof["below"][p] != ZERO:
                raise InvalidProof("there is nothing past the end")
            return proof["below"][p]
        h = blake3(known[p]) if p in known else proof["hashes"].get(p)
        if h is None:
            raise InvalidProof("a hash is missing")
        return blake3(h + node(2 * p + 1) + node(2 * p + 2))

    if (node(0) if proof["n"] else ZERO) != root:
        raise InvalidProof("the values do not lead to the root")
    return known


def bulk_prove(values: Sequence[bytes], power: int, start: int, end: int) -> dict:
    """What shows the entries [start, end) of a bulk tree to a reader who knows its state root: whole chunks, and the buffer."""
    whole = len(values) >> power
    blobs = [serialize_chunk(values[k << power : (k + 1) << power]) for k in range(whole)]
    m = Mmr(blobs)
    need = [k for k in range(whole) if k << power < end and (k + 1) << power > start]
    return {"n": len(values), "power": power, "chunks": {k: blobs[k] for k in need}, "mmr": m.prove(need), "buffer": list(values[whole << power :])}


def bulk_verify(proof: dict, root: bytes, start: int, end: int) -> dict[int, bytes]:
    """Entries [start, end) by position, if the proof leads to the state root and leaves none of them out."""
    n, power = proof["n"], proof["power"]
    whole = n >> power
    if proof["mmr"]["n"] != whole or len(proof["buffer"]) != n - (whole << power):
        raise InvalidProof("the counts do not agree")
    mmr = bag(proof["mmr"]["peaks"])
    if blake3(b"bulk_state" + mmr + dense_root(proof["buffer"])) != root:
        raise InvalidProof("the parts do not give the state root")
    verify_mmr(proof["mmr"], proof["chunks"], mmr)
    known = {(whole << power) + i: v for i, v in enumerate(proof["buffer"])}
    for k, blob in proof["chunks"].items():
        known |= {(k << power) + i: v for i, v in enumerate(deserialize_chunk(blob))}
    wanted = range(start, min(end, n))
    if any(p not in known for p in wanted):
        raise InvalidProof("an entry is left out")
    return {p: known[p] for p in wanted}


def positions_of(items: Sequence[QueryItem], n: int, size: int) -> list[int]:
    """Positions below n that items over big-endian keys ask for: for proofs, which are about few."""
    return [p for p in range(n) if any(i.contains(p.to_bytes(size, "big")) for i in items)]


def dense_verify_for_query(proof: dict, root: bytes, items: Sequence[QueryItem]) -> dict[int, bytes]:
    """dense_verify, and an error unless the proof shows just the positions asked for."""
    found = dense_verify(proof, root)
    if sorted(found) != positions_of(items, proof["n"], 2):
        raise InvalidProof("the proof is about other positions")
    return found


# Commitments: entries of a fixed shape; the curve's own tree is out of scope


def commitment_rows(notes: DataFrame, payload_bytes: int) -> DataFrame:
    """Values for a log from (cmx, rho, payload): cmx and rho of 32 bytes, the payload of the size given."""
    bad = notes.where((F.octet_length("cmx") != 32) | (F.octet_length("rho") != 32) | (F.octet_length("payload") != payload_bytes) | F.col("cmx").isNull() | F.col("rho").isNull() | F.col("payload").isNull())
    if not bad.isEmpty():
        raise InvalidInput("a note has parts of the wrong size")
    return notes.withColumn("value", F.concat("cmx", "rho", "payload"))

