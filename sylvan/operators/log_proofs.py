"""Proofs of what a log holds at some positions, from the forest's root hash down to the values.

A proof is the way to the log's tree element, whose hash covers the log's
root, and then what leads from the values to that root. Of a mountain range
the driver gets one hash in 4,096 leaves and the leaf hashes of the blocks
that hold the positions asked; of a bulk tree the same of its chunks, the
chunks that are touched and the buffer; a dense tree is bounded by its height.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidProof, NotSupported
from ..functions.hashing import ZERO, blake3, blake3_many
from ..functions.serde import deserialize
from ..model import BULK_APPEND_TREE, COMMITMENT_TREE, DENSE_TREE, MMR_TREE, path_literal, tree_id
from ..plans.query import PathQuery, Query, QueryItem, normalised
from ..sources.store import written
from . import logs
from .integrity import Hashes, Layer, _down, _find, entries_of, hash_forest, prove_query

KEY_BYTES = {MMR_TREE: 8, BULK_APPEND_TREE: 8, COMMITMENT_TREE: 8, DENSE_TREE: 2}


def positions(items: Sequence[QueryItem], n: int, size: int) -> list[int]:
    """Positions below n that items over big-endian keys of ``size`` bytes ask for, in order."""
    out: list[int] = []
    for i in normalised(items):
        (lo, lo_out), (hi, hi_in) = i.lower_bound(), i.upper_bound()
        first = 0 if lo is None else logs._number(lo, size) + int(lo_out)
        end = n if hi is None else logs._number(hi, size) + int(hi_in)
        out += range(first, min(n, end))
    return sorted(set(out))


def mmr_prove(log: DataFrame, path: Sequence[bytes], leaves: Sequence[int]) -> dict:
    """What ``Mmr.prove`` gives, of a log of any length."""
    x = logs.of(log, path).select("position", "value")
    n = x.count()
    shape = logs.peaks(n)
    number = F.lit(None).cast("int")
    first = F.lit(0).cast("bigint")
    for k, (at, _) in enumerate(shape):
        number = F.when(F.col("position") >= at, k).otherwise(number)
        first = F.when(F.col("position") >= at, at).otherwise(first)
    x = x.select(number.alias("peak"), (F.col("position") - first).alias("i"), "value").withColumn("block", F.shiftright("i", logs.FOLD))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        hs = blake3_many([logs.LEAF + bytes(v) for v in pdf.sort_values("i")["value"]])
        return pd.DataFrame({"peak": [pdf["peak"].iloc[0]], "block": [pdf["block"].iloc[0]], "hash": [logs._fold(hs)]})

    def hashed(batches):
        for pdf in batches:
            yield pd.DataFrame({"peak": pdf["peak"], "i": pdf["i"], "hash": blake3_many([logs.LEAF + bytes(v) for v in pdf["value"]])})

    blocks = {(r["peak"], r["block"]): bytes(r["hash"]) for r in x.groupBy("peak", "block").applyInPandas(fold, "peak int, block bigint, hash binary").collect()}
    where = {leaf: next((k, leaf - f, h) for k, (f, h) in enumerate(shape) if f <= leaf < f + (1 << h)) for leaf in leaves}
    touched = sorted({(k, i >> logs.FOLD) for k, i, _ in where.values()})
    inside: dict[tuple[int, int], bytes] = {}
    if touched:
        which = log.sparkSession.createDataFrame(touched, "peak int, block bigint")
        rows = x.join(which, ["peak", "block"], "left_semi").select("peak", "i", "value").mapInPandas(hashed, "peak int, i bigint, hash binary")
        inside = {(r["peak"], r["i"]): bytes(r["hash"]) for r in rows.collect()}
    known: dict[tuple[int, int, int], bytes] = {}

    def node(k: int, level: int, i: int) -> bytes:
        if level == min(logs.FOLD, shape[k][1]):
            return blocks[k, i]
        if level == 0:
            return inside[k, i]
        if (k, level, i) not in known:
            known[k, level, i] = blake3(logs.INNER + node(k, level - 1, 2 * i) + node(k, level - 1, 2 * i + 1))
        return known[k, level, i]

    paths = {leaf: [node(k, level, (i >> level) ^ 1) for level in range(h)] for leaf, (k, i, h) in where.items()}
    return {"n": n, "paths": paths, "peaks": [node(k, h, 0) for k, (_, h) in enumerate(shape)]}


@dataclass
class LogProof:
    way: Layer
    parts: dict

    def to_bytes(self) -> bytes:
        """The way, its length before it, then the parts with bytes in hexadecimal."""
        way = self.way.to_bytes()

        def plain(v):
            if isinstance(v, dict):
                return {"keys": list(v), "values": [plain(x) for x in v.values()]}
            return v.hex() if isinstance(v, bytes) else [plain(x) for x in v] if isinstance(v, list) else v

        return len(way).to_bytes(4, "big") + way + json.dumps(plain(self.parts)).encode()

    @staticmethod
    def from_bytes(data: bytes) -> LogProof:
        n = int.from_bytes(data[:4], "big")

        def full(v):
            if isinstance(v, dict):
                return dict(zip(v["keys"], map(full, v["values"]), strict=True))
            return bytes.fromhex(v) if isinstance(v, str) else [full(x) for x in v] if isinstance(v, list) else v

        try:
            return LogProof(Layer.from_bytes(data[4 : 4 + n]), full(json.loads(data[4 + n :])))
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidProof("this is not a proof") from e


def prove_log(nodes: DataFrame, log: DataFrame, path: Sequence[bytes], items: Sequence[QueryItem], hashes: Hashes | None = None) -> LogProof:
    """The entries at the positions that items ask for, of the log that the tree element at ``path`` names. hashes: made with the log table."""
    hashes = hashes or hash_forest(nodes, log)
    path = tuple(path)
    way = prove_query(nodes, PathQuery(path[:-1], Query.one(path[-1])), hashes)
    row = nodes.where((F.col("path") == path_literal(path[:-1])) & (F.col("key") == path_literal(path[-1:])[0])).first()
    kind = row["element_type"] if row else None
    if kind not in KEY_BYTES:
        raise NotSupported("there is no log at this path")
    entries = logs.of(log, path).select("position", "value")
    n = entries.count()
    asked = positions(items, n, KEY_BYTES[kind])
    if kind == DENSE_TREE:
        values = [bytes(r["value"]) for r in entries.orderBy("position").collect()]  # bounded by the tree's height
        return LogProof(way, logs.dense_prove(values, asked) if values else {"n": 0, "values": {}, "hashes": {}, "below": {}})
    if kind == MMR_TREE:
        values = {r["position"]: bytes(r["value"]) for r in entries.where(_at(asked)).collect()} if asked else {}
        return LogProof(way, mmr_prove(log, path, asked) | {"values": values})
    power = row["chunk_power"] or 0
    whole = n >> power
    chunks = sorted({i >> power for i in asked if i >> power < whole})
    blobs = _blobs(log, path, power)
    known = {r["position"]: bytes(r["value"]) for r in blobs.where(_at(chunks)).select("position", "value").collect()} if chunks else {}
    buffer = [bytes(r["value"]) for r in entries.where(F.col("position") >= whole << power).orderBy("position").collect()]  # fewer than a chunk
    return LogProof(way, {"n": n, "power": power, "chunks": known, "mmr": mmr_prove(blobs, path, chunks), "buffer": buffer})


def _at(numbers: Sequence[int]):
    """Positions in a sorted list, as ranges."""
    out, first = F.lit(False), None
    for k, i in enumerate(numbers):
        first = i if first is None else first
        if k + 1 == len(numbers) or numbers[k + 1] != i + 1:
            out = out | F.col("position").between(first, i)
            first = None
    return out


def _blobs(log: DataFrame, path: Sequence[bytes], power: int) -> DataFrame:
    """A bulk tree's chunks as a log of their own."""

    @F.pandas_udf("binary")
    def blob(values: pd.Series) -> pd.Series:
        return pd.Series([logs.serialize_chunk([bytes(v) for v in vs]) for vs in values])

    p = path_literal(tuple(path))
    chunks = logs.bulk_chunks(log, path, power)
    return written(chunks.select(tree_id(p).alias("tree_id"), p.alias("path"), F.col("chunk").cast("bigint").alias("position"), blob("values").alias("value")), "blobs")


def verify_log(proof: LogProof | bytes, path: Sequence[bytes], items: Sequence[QueryItem], root: bytes) -> dict[int, bytes]:
    """The entries at the positions that items ask for, if the proof leads from them to the forest's root and leaves none out."""
    if isinstance(proof, bytes):
        proof = LogProof.from_bytes(proof)
    path = tuple(path)
    found = _down(proof.way, entries_of(proof.way, root, False), path[:-1], ())
    row = _find(found[1], path[-1]) if found else None
    if row is None:
        raise InvalidProof("there is no log at this path")
    element, log_root = deserialize(row[2]), row[3]
    kind, p = element["kind"], proof.parts
    if kind not in KEY_BYTES:
        raise InvalidProof("there is no log at this path")
    if log_root is None:
        if p["n"]:
            raise InvalidProof("the log's root is left out")
        return {}
    asked = positions(items, p["n"], KEY_BYTES[kind])
    if kind == DENSE_TREE:
        got = logs.dense_verify(p, log_root)
    elif kind == MMR_TREE:
        got = logs.verify_mmr(p, p["values"], log_root)
    else:
        whole = p["n"] >> p["power"]
        if p["power"] != (element["chunk_power"] or 0) or p["mmr"]["n"] != whole or len(p["buffer"]) != p["n"] - (whole << p["power"]):
            raise InvalidProof("the counts do not agree")
        state = blake3(b"bulk_state" + logs.bag(p["mmr"]["peaks"]) + logs.dense_root(p["buffer"]))
        if (logs.commitment_state_root(ZERO, state) if kind == COMMITMENT_TREE else state) != log_root:
            raise InvalidProof("the parts do not give the log's root")
        logs.verify_mmr(p["mmr"], p["chunks"], logs.bag(p["mmr"]["peaks"]))
        got = {(whole << p["power"]) + i: v for i, v in enumerate(p["buffer"])}
        for k, blob in p["chunks"].items():
            got |= {(k << p["power"]) + i: v for i, v in enumerate(logs.deserialize_chunk(blob))}
    if any(i not in got for i in asked):
        raise InvalidProof("an entry is left out")
    return {i: got[i] for i in asked}
