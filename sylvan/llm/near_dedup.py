"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed word n-grams; equal sets collapse to one class
first. Min-hash bands propose candidates. Within a band's bucket the min-hash
values of each pair are compared some at a time; a pair is dropped as soon as
the posterior probability (uniform prior) that its similarity reaches the
threshold is below the tolerance. What is left is verified on the whole sets.

Pairs never leave a task. A bucket larger than a block, by members or by the
n-grams in them, is dealt as pairs of blocks, and a task reports, for each row, the number of its links and a
forest of the links found; a pair that shares several buckets is handled in
the first of its bands only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, sieve, sieved, text_key, text_of, without_rows
from .words import gram_sets, mix

NGRAM = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 28, 4  # a pair at 0.8 shares no band once in 2.6 million times
HASHES = BANDS * BAND_ROWS
STEP = 16  # min-hash values compared at a time
TOLERANCE = 1e-6
BLOCK = 512  # members of a bucket compared in one group with as many others
BLOCK_GRAMS = 1 << 21  # and their n-grams, so that long texts make smaller blocks
_rng = np.random.default_rng(4242)
FLIP = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
TIMES = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of n compared values that must agree for P(similarity >= threshold) to reach the tolerance.

    The values are cut to 16 bits, so unlike ones agree once in 65,536 times. With
    a uniform prior the posterior is a beta distribution, whose upper tail at t
    is a binomial sum.
    """
    t = threshold + (1 - threshold) / 65536
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def minhashes(g: np.ndarray, where: np.ndarray) -> np.ndarray:
    """HASHES min-hash values of each set of the n-grams g[where[i]:where[i + 1]]; none may be empty."""
    halves = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32), (g >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(where) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((halves[k & 1] ^ FLIP[k]) * TIMES[k], where[:-1])
    return out


SIGNED = "uid long, doc_id long, text_key long, n long, fp1 long, fp2 long, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("t").to_pylist()
        n, fp1, fp2 = (np.zeros(len(texts), t) for t in (np.int64, np.uint64, np.uint64))
        bands: list = [None] * len(texts)
        sigs: list = [None] * len(texts)
        for i, j, g, where in gram_sets(texts, ngram):
            full = np.flatnonzero(np.diff(where))
            if not len(full):
                continue
            m = minhashes(g, np.concatenate((where[full], where[-1:])))
            small = (m * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
            keys = mix(small.view(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
            for k, d in enumerate(full):
                s = np.unique(g[where[d] : where[d + 1]])
                n[i + d], fp1[i + d], fp2[i + d] = len(s), s.sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                bands[i + d], sigs[i + d] = keys[k].view(np.int64), small[k].tobytes()
        keep = [batch.column(c) for c in ("uid", "doc_id", "text_key")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(n), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["uid", "doc_id", "text_key", "n", "fp1", "fp2", "bands", "sig"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows, given in order of ``keys``: tables of some groups each, and where each group starts."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        at = edges(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), np.append(at[:-1], at[-1])
            held = pa.Table.from_batches(t.slice(at[-1]).to_batches()).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(edges(t), len(t))


def _pairs(at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i, j), i < j, of each group, about ``most`` at a time."""
    sizes = np.diff(at)
    i = np.arange(at[-1])
    ends = np.repeat(at[1:], sizes)
    count = ends - i - 1
    lo = 0
    while lo < len(i):
        total = np.cumsum(count[lo : lo + most])
        hi = lo + max(1, int(np.searchsorted(total, most, "right")))
        c = count[lo:hi]
        a = np.repeat(i[lo:hi], c)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        lo = hi


def _survivors(t: pa.Table, at: np.ndarray, threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs that pruning leaves, in the first band they share."""
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
    n, band, part = (t.column(c).to_numpy() for c in ("n", "band", "part"))
    two = t.column("bi").to_numpy() != t.column("bj").to_numpy()
    need = [least_matches(s, threshold, tolerance) for s in range(STEP, HASHES + 1, STEP)]
    for a, b in _pairs(at):
        ok = (~two[a] | (part[a] != part[b])) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) * (1 - 1e-12))
        a, b = a[ok], b[ok]
        same = np.zeros(len(a), np.int64)
        for s, least in enumerate(need):
            if not len(a):
                break
            same += (sig[a, s * STEP : (s + 1) * STEP] == sig[b, s * STEP : (s + 1) * STEP]).sum(1)
            ok = same >= least
            a, b, same = a[ok], b[ok], same[ok]
        if not len(a):
            continue
        shared = (sig[a] == sig[b]).reshape(len(a), BANDS, BAND_ROWS).all(2)
        ok = shared.argmax(1) == band[a]
        yield a[ok], b[ok]


def _prune(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    for t, at in _groups(batches, ["bucket", "bi", "bj"]):
        found = [np.stack(p) for p in _survivors(t, at, threshold, tolerance)]
        if not found or not sum(f.shape[1] for f in found):
            continue
        a, b = np.concatenate(found, 1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        group = np.searchsorted(at, a, "right") - 1
        size = np.diff(at)
        used = np.unique(np.concatenate((a, b)))
        mates: dict[int, bytes] = {}
        firsts, begin = np.unique(a, return_index=True)
        for i, lo, hi in zip(firsts, begin, np.append(begin[1:], len(a)), strict=True):
            bits = np.zeros(size[group[lo]], bool)
            bits[b[lo:hi] - at[group[lo]]] = True
            mates[int(i)] = np.packbits(bits).tobytes()
        x = t.take(pa.array(used))
        place = used - at[np.searchsorted(at, used, "right") - 1]
        out = x.select(["bucket", "bi", "bj", "rep"]).append_column("place", pa.array(place)).append_column("mates", pa.array([mates.get(int(i)) for i in used], pa.binary()))
        yield from out.combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch], ngram: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, null, rows linked to a) and, of the links found, a forest (a, b, 0)."""
    keys = ["bucket", "bi", "bj", "place"]
    for t, at in _groups(batches, keys[:3]):
        if len(t) > 1:  # a document given twice, id and text alike
            new = np.zeros(len(t), bool)
            new[0] = True
            for k in keys:
                c = t.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            at = np.append(0, np.cumsum(new))[at]
            t = t.filter(pa.array(new))
        rep, place, weight = (t.column(c).to_numpy() for c in ("rep", "place", "size"))
        mates, texts = t.column("mates"), t.column("t")
        rows_a, rows_b, rows_n = [], [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            m = hi - lo
            sets = []
            for _, _, g, where in gram_sets(texts.slice(lo, m).to_pylist(), ngram):
                sets += [np.unique(g[x:y]) for x, y in zip(where[:-1], where[1:], strict=True)]
            sizes = np.array([len(s) for s in sets])
            links = np.zeros((m, m), bool)
            for i in range(m):
                bits = mates[lo + i].as_py()
                if bits:
                    flag = np.unpackbits(np.frombuffer(bits, np.uint8))
                    p = place[lo:hi]
                    links[i] = (p < len(flag)) & flag[np.minimum(p, len(flag) - 1)].astype(bool)
            if m == 2:
                common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                shared = np.array([[0, common], [common, 0]])
            else:
                shared = _common(sets)
            union = sizes[:, None] + sizes[None, :] - shared
            links &= shared / np.maximum(union, 1) >= threshold
            links |= links.T
            w = weight[lo:hi]
            counts = links @ w
            some = np.flatnonzero(links.any(1))
            rows_a += rep[lo + some].tolist()
            rows_b += [None] * len(some)
            rows_n += counts[some].tolist()
            for x, y in _forest(links):
                rows_a.append(int(rep[lo + x]))
                rows_b.append(int(rep[lo + y]))
                rows_n.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(rows_a, pa.int64()), pa.array(rows_b, pa.int64()), pa.array(rows_n, pa.int64())], ["a", "b", "links"])


def _common(sets: list[np.ndarray], tile: int = 4096) -> np.ndarray:
    """How many values each two sets share, by products of 0/1 matrices of some values each."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, owner = (np.cumsum(often) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(often.sum()), tile):
        x, y = np.searchsorted(column, (lo, lo + tile))
        part = np.zeros((len(sets), tile), np.float32)
        part[owner[x:y], column[x:y] - lo] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the matrix joins: each node with the first node of its part."""
    left = links.any(1)
    out = []
    while left.any():
        root = int(left.argmax())
        seen = np.zeros(len(links), bool)
        front = seen.copy()
        front[root] = True
        while front.any():
            seen |= front
            front = links[front].any(0) & ~seen
        left &= ~seen
        out += [(int(x), root) for x in np.flatnonzero(seen) if x != root]
    return out


def near_dedup(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, scratch: Scratch | None = None) -> DataFrame:
    """Classes of near copies: one row per row of docs.

    Columns: doc_id, class_id (smallest doc_id among the rows joined by
    links, directly or in steps), n_links (other rows whose n-gram sets have a
    Jaccard similarity of ``threshold`` or more, copies included), class_size,
    first_of_class, text_key. Words are split at ASCII white space, in lower
    case; a text of fewer words than ``ngram`` has one n-gram of them all. A
    null text is empty; a text without words has no n-gram, no link and a
    class of its own. Null doc_ids count as largest; a class of them alone has
    a null class_id. Of rows that repeat an id and a text one is first. Other
    columns are ignored; an empty table gives no rows.

    Pairs at the threshold are missed with a probability near 4e-7 (bands)
    and a few times ``tolerance`` (pruning); the similarity of every pair
    left is that of the whole sets of 64-bit n-gram hashes, and sets of one
    size with the same two 64-bit sums count as equal. The pairs within a
    family of near copies that differ are all compared, as their links are
    all counted: work there grows with the square of its different texts.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near_dedup")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("t"))
    signed = scratch.table(rows.mapInArrow(lambda it: _sign(it, ngram), SIGNED), "signed")
    full = signed.where("n > 0")
    reps = scratch.table(full.groupBy("fp1", "fp2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("size")), "reps")
    of_rep = signed.join(reps.select(F.col("rep").alias("uid"), "size"), "uid")
    banded = of_rep.select(F.col("uid").alias("rep"), "n", F.posexplode("bands").alias("band", "bucket"))
    several = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("grams")).where("members > 1")
    shared = scratch.table(banded.drop("n").join(several, "bucket"), "shared")
    parts = F.least(F.col("members"), F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("grams") / block_grams)))
    dealt = shared.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("rep", "bucket"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("rep", "band", "bucket", "part", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"))
    with_sig = dealt.join(signed.select(F.col("uid").alias("rep"), "n", "sig"), "rep")
    key = ["bucket", "bi", "bj"]
    needed = scratch.table(
        with_sig.repartition(*key).sortWithinPartitions(*key, "rep").mapInArrow(lambda it: _prune(it, threshold, tolerance), "bucket long, bi int, bj int, rep long, place long, mates binary"),
        "needed",
    )
    names = scratch.table(needed.select("rep").distinct().join(of_rep.select(F.col("uid").alias("rep"), "doc_id", "text_key", "size"), "rep"), "names")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("t"))
    # Only texts that may be among those named are shuffled.
    text = sieved(text, F.col("text_key"), sieve(names, "text_key"), "maybe__").where("maybe__").drop("maybe__")
    # Named as a shuffle join so that the plan, and with it what moves, is the same at every size.
    texts = names.hint("merge").join(text, names["doc_id"].eqNullSafe(text["doc_id"]) & (names["text_key"] == text["text_key"])).select("rep", "size", "t")
    found = scratch.table(
        needed.join(texts, "rep").repartition(*key).sortWithinPartitions(*key, "place").mapInArrow(lambda it: _verify(it, ngram, threshold), "a long, b long, links long"),
        "found",
    )
    parts = scratch.table(connected_components(found.where("b is not null"), scratch), "parts")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classed = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    classed = classed.select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    member = full.select("uid", "doc_id", "text_key", "fp1", "fp2", "n").join(classed, ["fp1", "fp2", "n"])
    member = scratch.table(
        member.select("uid", "doc_id", "text_key", "class", "n_links").unionByName(
            signed.where("n = 0").select("uid", "doc_id", "text_key", F.col("uid").alias("class"), F.lit(0).cast("long").alias("n_links"))
        ),
        "members",
    )
    first = member.groupBy("class").agg(F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first"))
    # Written, so that both sides of the join are plain shuffles, which Spark splits where a class is large.
    first = scratch.table(first, "first")
    scratch.keep(member, first)
    return member.join(first, "class").select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", "class_size", (F.col("uid") == F.col("first.uid")).alias("first_of_class"), "text_key")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near_dedup: that with the smallest doc_id. All columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "near_dedup")
    found = scratch.table(near_dedup(docs, scratch=scratch).where("not first_of_class or class_size > 1"), "classes")
    kept = found.where("first_of_class").select("doc_id", "text_key")
    gone = found.where("not first_of_class").select("doc_id", "text_key").distinct()
    gone = scratch.table(gone.join(kept.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_anti"), "gone")
    scratch.keep(gone)
    return without_rows(docs, gone)
