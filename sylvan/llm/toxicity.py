"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models over word
and word-prefix features; each model also sees the probabilities of the
categories before it. In training those are out-of-fold predictions, so a
later model meets earlier ones as unsure as they will be on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .linear import Rows, fit, sigmoid
from .words import BASE, TABLE, chunks, hashes, mix, spans

PREFIXES = (3, 4, 5, 6, 7, 8)
LEVELS = 3  # a feature is a word or prefix found once or more, twice or more, three times or more
FOLDS = 5
MAX_TRAIN_ROWS = 12_000  # bound of the labelled sample
FEATURES = 2048
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic", "toxic_spam": "toxic * (1 - quality)"}


def text_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word prefix, with repeats; words are runs of letters and digits."""
    start, end = spans(data, letters=True)
    owner = np.searchsorted(at, start, "right") - 1
    owners, found = [owner], [hashes(data, start, end)]
    total = np.zeros(len(start), np.uint64)
    for k in range(max(PREFIXES)):
        long = end - start > k + 1
        start, end, owner, total = start[long], end[long], owner[long], total[long]
        total = total * BASE + TABLE[data[start + k]]
        if k + 1 in PREFIXES:
            owners.append(owner)
            found.append(mix(total + (np.uint64(k + 1) << np.uint64(40))))
    return np.concatenate(owners), np.concatenate(found)


def _counted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, feature) once, with its count."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _feature_counts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each fold, feature and level: rows that have it, and how many of them are in each category."""
    for batch in batches:
        labels = np.array(batch.column("labels").to_pylist(), float).reshape(-1, k)
        folds = batch.column("fold").to_numpy()
        for i, _, data, at in chunks(batch.column("t").to_pylist()):
            owner, h, count = _counted(*text_features(data, at))
            fold = folds[i + owner]
            for level in range(1, LEVELS + 1):
                for f in range(FOLDS):
                    ok = (count >= level) & (fold == f)
                    if not ok.any():
                        continue
                    value, inverse, n = np.unique(h[ok], return_inverse=True, return_counts=True)
                    hits = [np.bincount(inverse, labels[i + owner[ok], c]).astype(np.int64) for c in range(k)]
                    fixed = [np.full(len(value), x, np.int32) for x in (f, level)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64)), *map(pa.array, hits)], ["fold", "level", "h", "n", *(f"c{c}" for c in range(k))])


def _chosen(counts: DataFrame, size: list[int], features: int) -> list[tuple[int, int]]:
    """(feature, level) with the largest chi-square statistics; counts: h, level, n, c0...; size: rows, and rows of each category."""
    chi = F.lit(0.0)
    for c, hits in enumerate(size[1:]):
        p = hits / size[0] if size[0] else 0
        if 0 < p < 1:
            e = F.col("n") * p
            chi = F.greatest(chi, (F.col(f"c{c}") - e) ** 2 / (e * (1 - p) * (1 - F.col("n") / (size[0] + 1))))
    best = counts.where("n >= 3").select("h", "level", chi.alias("chi")).where("chi > 6").orderBy(F.desc("chi"), "h", "level").limit(features).collect()
    return [(r["h"], r["level"]) for r in best]


class Lookup:
    """Numbers of known features; a bit table turns most other words away."""

    def __init__(self, known: np.ndarray, levels: np.ndarray):
        self.words = np.unique(known)
        self.size = len(known)
        self.slot = np.full((LEVELS, len(self.words)), -1, np.int64)
        self.slot[levels - 1, np.searchsorted(self.words, known)] = np.arange(len(known))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.words >> np.uint64(46)).astype(np.int64)] = True

    def rows(self, data: np.ndarray, at: np.ndarray) -> Rows:
        owner, h = text_features(data, at)
        maybe = self.bits[(h >> np.uint64(46)).astype(np.int64)]
        owner, h = owner[maybe], h[maybe]
        if not len(h):
            return Rows(np.zeros(len(at), np.int64), np.zeros(0, np.int64), self.size)
        place = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[place] == h
        pair, count = np.unique(owner[ok] * len(self.words) + place[ok], return_counts=True)
        owner, place = np.divmod(pair, len(self.words))
        owners, slots = [], []
        for level in range(LEVELS):
            slot = self.slot[level, place]
            ok = (slot >= 0) & (count > level)
            owners.append(owner[ok])
            slots.append(slot[ok])
        owner, slot = np.concatenate(owners), np.concatenate(slots)
        order = np.lexsort((slot, owner))
        return Rows(np.searchsorted(owner[order], np.arange(len(at))), slot[order], self.size)


@dataclass
class Chain:
    """A fitted chain; its size is bounded by the number of features, whatever the corpus."""

    categories: list[str]
    known: np.ndarray
    levels: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    out_of_fold: np.ndarray | None = None
    fitted: bool = True

    def probabilities(self, x: Rows) -> np.ndarray:
        n = len(x.start) - 1
        p = np.zeros((n, 0))
        for w in self.weights:
            z = x.dot(w[: x.width]) + p @ w[x.width : -1] + w[-1]
            p = np.column_stack((p, sigmoid(z)))
        return p

    def score(self, texts: list[str | None]) -> np.ndarray:
        look = Lookup(self.known, self.levels)
        out = np.zeros((len(texts), len(self.categories)))
        for i, j, data, at in chunks(texts):
            out[i:j] = self.probabilities(look.rows(data, at))
        return out

    def column(self, text: Column) -> Column:
        """A struct of one probability per category."""
        chain = Chain(self.categories, self.known, self.levels, self.weights)

        @F.pandas_udf(", ".join(f"{c} double" for c in self.categories))
        def score(t: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(chain.score(t.tolist()), columns=chain.categories)

        return score(text)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, max_train_rows: int = MAX_TRAIN_ROWS, features: int = FEATURES, scratch: Scratch | None = None) -> Chain:
    """Fits the chain on labelled rows of docs.

    ``categories``: name and SQL over the columns of labels, 0 or 1, in chain
    order. Rows with a null in any of them or no doc_id are left out; of
    labels that repeat a doc_id the largest values count, of documents that
    repeat one the text that comes first in order. At most
    ``max_train_rows`` rows are used, half of them from rows with a category
    set, chosen by a hash of doc_id and weighted back to their share; the
    features are the ``features`` with the largest chi-square statistic in
    that sample, and for a fold's models in the sample without the fold, so
    an out-of-fold probability has seen nothing of its row's label. Without
    labelled rows every probability is 0.5.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    y = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(e).cast("double").alias(f"y{i}") for i, e in enumerate(categories.values())))
    y = y.dropna().groupBy("doc_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))))
    y = y.select("doc_id", F.array(*(f"y{i}" for i in range(len(names)))).alias("labels"), F.expr(" or ".join(f"y{i} > 0" for i in range(len(names)))).alias("hit"))
    y = scratch.table(y, "labels")
    share = {r["hit"]: r["n"] for r in y.groupBy("hit").agg(F.count("*").alias("n")).collect()}
    half = max_train_rows // 2
    take = {h: min(share.get(h, 0), max(half, max_train_rows - share.get(not h, 0))) for h in (True, False)}
    chosen = [y.where(F.col("hit") == h).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[h]) for h in (True, False)]
    chosen = scratch.table(chosen[0].unionByName(chosen[1]), "chosen")
    # At most max_train_rows rows of numbers: small enough to broadcast, and to fit on the driver.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    found = scratch.table(text.join(F.broadcast(chosen), "doc_id"), "found")
    one = found.groupBy("doc_id").agg(F.min(F.struct("t", "labels", "hit")).alias("r"))
    sample = scratch.table(one.select("doc_id", "r.*", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "sample")
    k = len(names)
    sums = [F.count("*").alias("n"), *(F.sum(F.col("labels")[c]).alias(f"c{c}") for c in range(k))]
    rows_of = {r["fold"]: [r["n"], *(int(r[f"c{c}"]) for c in range(k))] for r in sample.groupBy("fold").agg(*sums).collect()}
    size = [sum(v) for v in zip(*rows_of.values(), strict=True)]
    if not size:
        return Chain(names, np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(1 + c) for c in range(k)], np.zeros((0, k)), False)
    columns = ["n", *(f"c{c}" for c in range(k))]
    counts = sample.select("t", "labels", "fold").mapInArrow(lambda it: _feature_counts(it, k), "fold int, level int, h long, " + ", ".join(f"{c} long" for c in columns))
    # One row a feature: its counts in all rows, and in each fold.
    split = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in columns for f in range(FOLDS)]
    counts = scratch.table(counts.groupBy("h", "level").agg(*(F.sum(c).alias(c) for c in columns), *split).where("n >= 3"), "counts")
    views = {None: _chosen(counts, size, features)}
    for f in sorted(rows_of) if len(rows_of) > 1 else ():
        views[f] = _chosen(counts.select("h", "level", *((F.col(c) - F.col(f"{c}_{f}")).alias(c) for c in columns)), [a - b for a, b in zip(size, rows_of[f], strict=True)], features)
    every = sorted(set().union(*map(set, views.values())))
    number = {x: i for i, x in enumerate(every)}
    known, levels = np.array([h for h, _ in every], np.int64).view(np.uint64), np.array([x for _, x in every], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(known, levels)
        for batch in batches:
            rows = []
            for _, _, data, at in chunks(batch.column("t").to_pylist()):
                x = look.rows(data, at)
                rows += [x.idx[a:b] for a, b in zip(x.start[:-1], x.start[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "hit", "labels", "fold")), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "hit", "labels", "fold", "idx"])

    got = sample.select("doc_id", "hit", "labels", "fold", "t").mapInArrow(encode, "doc_id long, hit boolean, labels array<double>, fold int, idx array<long>").toArrow().sort_by("doc_id")
    sizes = np.array([len(v) for v in got.column("idx").to_pylist()], np.int64)
    x = Rows(np.concatenate(([0], np.cumsum(sizes))), np.array([i for v in got.column("idx").to_pylist() for i in v], np.int64), len(known))
    labelled = np.array(got.column("labels").to_pylist(), float)
    hit = np.array(got.column("hit").to_pylist(), bool)
    weight = np.where(hit, share.get(True, 0) / max(1, take[True]), share.get(False, 0) / max(1, take[False]))
    weight *= len(weight) / weight.sum()
    fold = got.column("fold").to_numpy()
    seen = {f: x.only([number[v] for v in view]) for f, view in views.items()}
    whole = seen[None]
    best = [every[number[v]] for v in views[None]]
    chain = Chain(names, np.array([h for h, _ in best], np.int64).view(np.uint64), np.array([v for _, v in best], np.int64))
    p = np.zeros((len(weight), 0))
    for c in range(k):
        own = np.zeros(len(weight))
        for f in rows_of:
            rest, part = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(rest):  # all rows in one fold
                rest = part
            xs = seen.get(f, whole)
            w = fit(xs.take(rest), p[rest], labelled[rest, c], weight[rest])
            own[part] = sigmoid(xs.take(part).dot(w[: xs.width]) + p[part] @ w[xs.width : -1] + w[-1])
        chain.weights.append(fit(whole, p, labelled[:, c], weight))
        p = np.column_stack((p, own))
    chain.out_of_fold = p
    scratch.keep()
    return chain


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Per row of docs: doc_id, p_<category> for each category, toxic (p_toxic >= threshold).

    Null texts are empty; a text without known features gets the intercepts'
    probabilities. Without labelled rows nothing is toxic. Whole texts are read. Repeated rows and null ids are scored
    like any other; other columns are ignored; no rows give no rows.
    """
    chain = fit_chain(docs, labels, **options)
    scored = docs.select(F.col("doc_id"), chain.column(text_of()).alias("p"))
    return scored.select("doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in chain.categories), ((F.col("p.toxic") >= threshold) & F.lit(chain.fitted)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs without the rows that the chain calls toxic; all columns stay as they are."""
    chain = fit_chain(docs, labels, **options)
    if not chain.fitted:
        return docs
    return docs.withColumn("toxicity__", chain.column(text_of())).where(F.col("toxicity__.toxic") < threshold).drop("toxicity__")
