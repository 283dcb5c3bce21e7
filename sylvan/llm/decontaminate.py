"""Benchmark decontamination with SimHash over item-sized windows.

Every window of a document as long as an item has a 64-bit SimHash of its
word n-grams. A multi-index over five blocks finds all items within RADIUS
bits: two fingerprints that differ in at most 19 bits differ in at most 3 in
some block. Candidates are verified by the exact similarity of the two
n-gram multisets (sum of smaller counts over sum of larger ones). An item of
fewer words than an n-gram is looked for as the sequence of words it is.

Windows that cannot pass the verification are not fingerprinted: at
similarity t, 2t / (1 + t) of a window's n-grams must be those of an item. A
bit table of all items' n-grams, of fixed size, tells the few texts that have
such a window; these are written, and items are searched in them block by
block, so neither a task nor the driver holds more than one block's index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .words import chunks, grams, hashes, spans

NGRAM = 5
THRESHOLD = 0.8
RADIUS = 19  # windows at similarity 0.8 are 10 bits apart on average; 1 in some thousands lies beyond 19
CUTS = (0, 13, 26, 39, 52, 64)  # the fingerprint's blocks of bits
ITEM_BLOCK = 1024  # items in one index, and so the bound of what is sent to a task
ITEM_BYTES = 4 << 20  # of text in one index, but for a single longer item
GATE_BITS = 24  # the bit table has 2**24 slots: 2 MB, whatever the benchmark
HIT = "array<struct<item_id:long,first_word:long,n_words:long,distance:int,similarity:double>>"


def window_hashes(g: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """SimHash of g[b:b + size] for each b: bit k is set where most of the n-grams have it set."""
    bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)))
    return np.packbits(2 * (total[begin + size] - total[begin]) > size, axis=1).view(np.uint64).ravel()


def block_of(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return (prints >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)).astype(np.int64)


def words_of(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, word hashes, where each text's words start) of consecutive texts."""
    for i, j, data, at in chunks(texts):
        start, end = spans(data)
        yield i, j, hashes(data, start, end), np.searchsorted(start, at)


def short_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n of a text's words, as ``grams`` hashes a text of these words alone."""
    return grams(words, np.array([0, len(words)]), n)[0] if len(words) >= n else np.zeros(0, np.uint64)


class Index:
    """Fingerprints of some items, with every block value near one of theirs."""

    def __init__(self, items: list[tuple[int, str | None]], ngram: int = NGRAM):
        self.ids, self.grams, self.ngram = [], [], ngram
        self.short: dict[int, dict[int, list[int]]] = {}  # number of words: hash of them: items
        for i, _, words, first in words_of([t for _, t in items]):
            g, where = grams(words, first, ngram)
            for d, n in enumerate(np.diff(first).tolist()):
                if 0 < n < ngram:
                    self.short.setdefault(n, {}).setdefault(int(g[where[d]]), []).append(items[i + d][0])
                elif n:
                    self.ids.append(items[i + d][0])
                    self.grams.append(g[where[d] : where[d + 1]].copy())
        self.sizes = np.array([len(g) for g in self.grams], np.int64)
        self.counts = [Counter(g.tolist()) for g in self.grams]
        self.known = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))
        self.hash = np.array([window_hashes(g, np.zeros(1, np.int64), len(g))[0] for g in self.grams], np.uint64)
        self.blocks = []
        for lo, hi in zip(CUTS[:-1], CUTS[1:], strict=True):
            masks = np.array([sum(1 << b for b in c) for k in range(RADIUS // (len(CUTS) - 1) + 1) for c in combinations(range(hi - lo), k)], np.int64)
            near = (block_of(self.hash, lo, hi)[:, None] ^ masks).ravel()
            order = np.argsort(near, kind="stable")
            self.blocks.append((np.searchsorted(near[order], np.arange((1 << hi - lo) + 1)), (order // len(masks)).astype(np.int32)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in prints, item, distance) of all pairs within RADIUS."""
        rows, items = [], []
        for lo, hi, (first, order) in zip(CUTS[:-1], CUTS[1:], self.blocks, strict=True):
            v = block_of(prints, lo, hi)
            n = first[v + 1] - first[v]
            rows.append(np.repeat(np.arange(len(prints)), n))
            items.append(order[np.repeat(first[v] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        pair = np.unique(np.concatenate(rows) * len(self.hash) + np.concatenate(items))
        row, item = np.divmod(pair, len(self.hash))
        distance = np.bitwise_count(prints[row] ^ self.hash[item])
        ok = distance <= RADIUS
        return row[ok], item[ok], distance[ok]

    def hits(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """For each item found in a text of these words its best window: (item, first word, words, distance, similarity)."""
        out = []
        for n, known in self.short.items():
            found: dict[int, int] = {}
            for at, h in enumerate(short_grams(words, n).tolist()):
                if h in known:
                    found.setdefault(h, at)
            out += [(i, at, n, 0, 1.0) for h, at in found.items() for i in known[h]]
        g = grams(words, np.array([0, len(words)]), self.ngram)[0]
        if not len(g) or not len(self.hash):
            return out
        known = self.known[np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)] == g
        total = np.concatenate(([0], np.cumsum(known)))
        best: dict[int, tuple[float, int, int, int]] = {}
        for size in np.unique(self.sizes).tolist():
            width, begin = open_windows(total, size, threshold)
            if not len(begin):
                continue
            lo, hi = int(begin[0]), int(begin[-1]) + width
            row, item, distance = self.within(window_hashes(g[lo:hi], begin - lo, width))
            same = self.sizes[item] == size
            for r, i, d in zip(row[same], item[same], distance[same], strict=True):
                at = int(begin[r])
                common = sum((Counter(g[at : at + width].tolist()) & self.counts[i]).values())
                s = common / (size + width - common)
                if s >= threshold and (int(i) not in best or (s, -at) > (best[int(i)][0], -best[int(i)][1])):
                    best[int(i)] = (s, at, width, int(d))
        return out + [(self.ids[i], at, min(width + self.ngram - 1, len(words)), d, s) for i, (s, at, width, d) in sorted(best.items())]


def open_windows(total: np.ndarray, size: int, threshold: float) -> tuple[int, np.ndarray]:
    """(width, starts) of the windows that could reach the threshold with an item of ``size`` n-grams; total: running count of known n-grams."""
    width = min(size, len(total) - 1)
    need = threshold * (size + width) / (1 + threshold) * (1 - 1e-12)
    if total[-1] < need:
        return width, np.zeros(0, np.int64)
    return width, np.flatnonzero(total[width:] - total[: len(total) - width] >= need)


@dataclass
class Gate:
    """What tells texts that may hold an item: a bit table of n-grams, and the items' sizes. It errs on the side of yes only."""

    bits: np.ndarray
    sizes: list[int]
    short: list[int]
    ngram: int
    threshold: float

    def known(self, g: np.ndarray) -> np.ndarray:
        slot = g >> np.uint64(64 - GATE_BITS)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def opens(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text, given where its words start (one entry more than texts), whether it may hold an item."""
        out = np.zeros(len(first) - 1, bool)
        for n in self.short:
            g, where = grams(words, first, n)
            hit = np.concatenate(([0], np.cumsum(self.known(g))))[where]
            out |= (np.diff(hit) > 0) & (np.diff(first) >= n)
        if self.sizes:
            g, where = grams(words, first, self.ngram)
            total = np.concatenate(([0], np.cumsum(self.known(g))))
            # The least that any window needs: the smallest item's, or, where the text is smaller, its own.
            n = np.diff(where)
            least = self.threshold * (self.sizes[0] + np.minimum(n, self.sizes[0])) / (1 + self.threshold) * (1 - 1e-12)
            for d in np.flatnonzero(~out & (n > 0) & (np.diff(total[where]) >= least)):
                own = total[where[d] : where[d + 1] + 1] - total[where[d]]
                out[d] = any(len(open_windows(own, size, self.threshold)[1]) for size in self.sizes)
        return out


def gate_of(items: DataFrame, ngram: int, threshold: float) -> Gate:
    """The gate of a table of items. The driver gets at most 2**18 words of the bit table and the distinct sizes."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, size = [np.zeros(0, np.int64)], set()
            for _, _, words, first in words_of(batch.column("text").to_pylist()):
                g, where = grams(words, first, ngram)
                slot.append((g >> np.uint64(64 - GATE_BITS)).astype(np.int64))
                size |= {(n if 0 < n < ngram else ngram, m) for n, m in zip(np.diff(first).tolist(), np.diff(where).tolist(), strict=True) if m}
            slot = np.unique(np.concatenate(slot))
            # A row is a word of the table, or, with no bits, a size.
            rows = [(int(s >> 6), int(np.int64(np.uint64(1) << np.uint64(s & 63))), 0, 0) for s in slot] + [(-1, 0, n, m) for n, m in sorted(size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["word", "bits", "words", "size"])

    found = items.select("text").mapInArrow(slots, "word long, bits long, words long, size long").groupBy("word", "words", "size").agg(F.bit_or("bits").alias("bits")).collect()
    table = np.zeros(1 << GATE_BITS - 6, np.int64)
    for r in found:
        if r["word"] >= 0:
            table[r["word"]] = r["bits"]
    sizes = [(r["words"], r["size"]) for r in found if r["word"] < 0]
    return Gate(table.view(np.uint8), sorted({m for n, m in sizes if n == ngram}), sorted({n for n, _ in sizes if n < ngram}), ngram, threshold)


def items_of(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("text <> ''").distinct(), "items")


def item_blocks(items: DataFrame, block: int = ITEM_BLOCK, ngram: int = NGRAM) -> Iterator[Index]:
    """Indexes of at most ``block`` items and about ITEM_BYTES of text each, dealt by a hash of the text; one at a time is on the driver."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // max(1, block // 2)), -(-size["bytes"] // ITEM_BYTES))
    for k in range(parts if size["n"] else 0):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
        for lo in range(0, len(rows), block):
            yield Index([(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["text"], str(r["item_id"])))[lo : lo + block]], ngram)


def _opens(gate: Gate):
    @F.pandas_udf("boolean")
    def opens(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0, bool), *(gate.opens(words, first) for _, _, words, first in words_of(texts.tolist()))]))

    return opens


def _find(index: Index, threshold: float):
    @F.pandas_udf(HIT)
    def find(texts: pd.Series) -> pd.Series:
        out: list = []
        for _, _, words, first in words_of(texts.tolist()):
            for a, b in zip(first[:-1], first[1:], strict=True):
                found = index.hits(words[a:b], threshold)
                out.append([{"item_id": i, "first_word": at, "n_words": n, "distance": d, "similarity": s} for i, at, n, d, s in found])
        return pd.Series(out)

    return find.asNondeterministic()  # so that the optimizer never evaluates it twice for a row


def contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, block: int = ITEM_BLOCK) -> DataFrame:
    """Benchmark items in documents: a row for each row of docs and item found in it.

    Columns: doc_id, item_id, first_word, n_words, distance (bits), similarity,
    contaminated (always true). The window named is the best one, the first of
    equals. Words are split at ASCII white space, in lower case. Null texts are
    empty and hold nothing; items without words are in nothing; an item of
    fewer words than ``ngram`` is in every text that has these words in a row.
    Items equal in id and text count once. Repeated rows and ids count each
    time; very long texts are read whole. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = items_of(benchmark, scratch)
    rows = docs.select("doc_id", text_of().alias("t"))
    asked = scratch.table(rows.where(_opens(gate_of(items, ngram, threshold))("t")), "asked")
    named = lambda hits: asked.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*", F.lit(True).alias("contaminated"))
    found = [scratch.table(named(_find(index, threshold)("t")), "found") for index in item_blocks(items, block, ngram)]
    found = found or [scratch.table(named(F.array().cast(HIT)), "found")]
    scratch.keep(*found)
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, block: int = ITEM_BLOCK) -> DataFrame:
    """docs without the rows that hold an item; all columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = items_of(benchmark, scratch)
    opens = _opens(gate_of(items, ngram, threshold))(text_of())
    asked = scratch.table(docs.where(opens), "asked")
    for index in item_blocks(items, block, ngram):
        asked = scratch.table(asked.withColumn("hits__", _find(index, threshold)(text_of())).where(F.size("hits__") == 0).drop("hits__"), "clean")
    scratch.keep(asked)
    return docs.where(~opens).unionByName(asked)
