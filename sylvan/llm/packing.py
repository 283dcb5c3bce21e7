"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are those of the encoded texts and an end mark. Documents longer than
the largest capacity are cut into pieces; pieces are dealt by a hash to shards
of bounded size that are packed on their own. In a shard pieces go, longest first, to the open
bin with the least room that still holds them. Where none does, a bin opens at the capacity with the
least cost per token it can expect to hold. Two policies (that one, and always
the largest capacity) are packed and priced; the cheaper stays. Last, every
bin shrinks to the smallest capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_key, text_of
from .tokens import VOCABULARY, encode, length_of

CAPACITIES = (256, 512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
PACKED = "doc_id long, piece int, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_used long, capacity long"


def cost(capacity: float) -> float:
    """Price of a sequence: its tokens, attention's share, and what any sequence takes."""
    return capacity + capacity * capacity / 32768 + 16


def pack(lengths: Sequence[int], capacities: Sequence[int], price: Callable[[float], float] = cost) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin) for pieces in falling order of length, none above the largest capacity."""
    caps = sorted(set(capacities))

    def shrunk(used: float) -> int:
        return caps[bisect_left(caps, used)]

    n = len(lengths)
    falling = -np.asarray(lengths, np.int64)
    left = np.concatenate((np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]))

    def least_cost(k: int) -> int:
        best = None
        for c in caps[bisect_left(caps, lengths[k]) :]:
            room = c - lengths[k]
            later = max(k + 1, int(np.searchsorted(falling, -room)))  # first piece still to come that fits the room
            used = lengths[k] + min(room, int(left[later]))
            rate = price(shrunk(used)) / used
            if best is None or rate < best[0]:
                best = rate, c
        return best[1]

    def run(choose: Callable[[int], int]) -> tuple[float, list[int], list[int]]:
        open_bins: list[tuple[int, int]] = []
        of, used = [], []
        for k in range(n):
            at = bisect_left(open_bins, (lengths[k], -1))
            if at < len(open_bins):
                room, b = open_bins.pop(at)
            else:
                room, b = choose(k), len(used)
                used.append(0)
            of.append(b)
            used[b] += lengths[k]
            if room > lengths[k]:
                insort(open_bins, (room - lengths[k], b))
        sizes = [shrunk(u) for u in used]
        return sum(map(price, sizes)), of, sizes

    tries = [run(least_cost), run(lambda k: caps[-1])]
    best = min(tries, key=lambda t: t[0])
    return best[1], best[2]


def pack_shard(rows: pd.DataFrame, capacities: Sequence[int]) -> pd.DataFrame:
    """Packs the pieces of one shard; columns shard, uid, doc_id, text_key, piece, piece_start, n_tokens."""
    rows = rows.sort_values(["doc_id", "text_key", "piece", "uid"], kind="stable")
    rows = rows.iloc[np.argsort(-rows["n_tokens"].to_numpy(np.int64), kind="stable")]
    size = rows["n_tokens"].to_numpy(np.int64)
    of, capacity = pack(size.tolist(), capacities)
    of = np.array(of, np.int64)
    by_bin = np.argsort(of, kind="stable")
    sums = np.concatenate(([0], np.cumsum(size[by_bin])))
    first = np.searchsorted(of[by_bin], np.arange(len(capacity) + 1))
    offset = np.zeros(len(of), np.int64)
    offset[by_bin] = sums[:-1] - sums[first][of[by_bin]]
    used = np.diff(sums[first])
    place = {"bin_id": (int(rows["shard"].iloc[0]) << 32) + of, "bin_offset": offset, "bin_used": used[of], "capacity": np.array(capacity, np.int64)[of]}
    return rows[["uid", "doc_id", "piece", "piece_start", "n_tokens"]].assign(**place)


def _placed(rows: DataFrame, capacities: Sequence[int], shard_pieces: int, scratch: Scratch) -> DataFrame:
    """Pieces of rows (uid, doc_id, text_key, n_tokens), a written table, with their places."""
    most = max(capacities)
    shards = max(1, -(-(rows.agg(F.sum(F.ceil(F.col("n_tokens") / most))).first()[0] or 0) // shard_pieces))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / most).cast("int") - 1)))
    pieces = pieces.withColumn("piece_start", F.col("piece").cast("long") * most).withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("piece_start"), F.lit(most)))
    # Dealt by piece, so that the pieces of one very long text do not meet in a shard.
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "text_key", "uid", "piece"), F.lit(shards)).cast("int").alias("shard"), "uid", "doc_id", "text_key", "piece", "piece_start", "n_tokens")
    caps = tuple(capacities)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf.assign(doc_id=pdf["doc_id"].astype("Int64")), caps)

    return dealt.groupBy("shard").applyInPandas(packed, "uid long, " + PACKED)


def _named(docs: DataFrame, **columns: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.monotonically_increasing_id().alias("uid"), *(c.alias(n) for n, c in columns.items()))


def best_fit_packing(docs: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES, shard_pieces: int = SHARD_PIECES, vocabulary: str = VOCABULARY, scratch: Scratch | None = None) -> DataFrame:
    """A row for each piece of each row of docs: where it lies in which sequence.

    Columns: doc_id, piece, piece_start (in the document), n_tokens, bin_id,
    bin_offset, bin_used, capacity. ``length`` gives a row's tokens (default:
    those of its text in ``vocabulary`` and an end mark, so that no row is
    empty; null or less than 1 counts as 1). Rows longer than the largest
    capacity are cut at its multiples; nothing is dropped. A null text is
    empty; very long texts are encoded whole and their pieces dealt apart.
    Repeated rows are packed as often as they occur, null ids like others; no
    rows give no rows. Ties go by doc_id, then a hash of the text. Shards hold
    about ``shard_pieces`` pieces. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    n = length if length is not None else length_of(text_of(), vocabulary) + 1
    rows = scratch.table(_named(docs, n_tokens=F.greatest(F.coalesce(n.cast("long"), F.lit(1)), F.lit(1))), "lengths")
    return _placed(rows, capacities, shard_pieces, scratch).drop("uid")


def packed_sequences(docs: DataFrame, end_token: int, capacities: Sequence[int] = CAPACITIES, shard_pieces: int = SHARD_PIECES, vocabulary: str = VOCABULARY) -> DataFrame:
    """The sequences themselves: one row each, encoded texts end to end, every text closed by ``end_token``.

    Columns: bin_id, capacity, tokens, doc_ids and starts (of the pieces, in
    order). Odd rows count as in best_fit_packing.
    """
    scratch = Scratch(docs.sparkSession, "packing")

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([[*encode(t, vocabulary), end_token] for t in texts])

    encoded = scratch.table(_named(docs, tokens=ids(text_of())), "encoded")
    placed = _placed(encoded.select("uid", "doc_id", "text_key", F.size("tokens").cast("long").alias("n_tokens")), capacities, shard_pieces, scratch)
    pieces = placed.join(encoded.select("uid", "tokens"), "uid")
    part = F.struct("bin_offset", "doc_id", F.slice("tokens", (F.col("piece_start") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("tokens"))
    # A sequence holds at most the largest capacity, so the lists are bounded.
    bins = pieces.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return bins.select("bin_id", "capacity", F.flatten(F.col("parts.tokens")).alias("tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.bin_offset").alias("starts"))
