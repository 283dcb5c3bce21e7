"""Quality scores from a generalised additive model with pairwise interactions.

Numeric features of a text are cut into quantile bins. Boosting goes round
the features, each turn a tree of at most four leaves over one feature's bins,
added to that feature's lookup table; then round the strongest pairs, with a
split of each axis, into two-way tables. A score is a sum of table entries.
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
from .linear import sigmoid
from .words import STEP, hashes, mix, spans

MAX_TRAIN_ROWS = 20_000  # bound of the labelled sample
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 250, 80, 0.1, 20
NAMES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digit", "punctuation", "high_byte",
    "space", "distinct_words", "top_word", "distinct_pairs", "top_pair", "log_lines", "repeated_lines", "line_length",
    "short_words", "byte_entropy", "marked_words", "stop_marks",
)
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_IS_MARK = np.zeros(256, bool)
_IS_MARK[_MARKS] = True
_FULL_STOP = np.zeros(256, bool)
_FULL_STOP[[ord(c) for c in ".,;:!?"]] = True


def features(text: str) -> list[float]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    seen = np.bincount(data, minlength=256)
    start, end = spans(data)
    w = len(start)
    if not w:
        return [np.log1p(n), *[0.0] * 7, 1.0, *[0.0] * (len(NAMES) - 9)]
    size = end - start
    h = hashes(data, start, end)
    _, count = np.unique(h, return_counts=True)
    pair = mix(h[:-1] * STEP[0] + h[1:]) if w > 1 else h
    _, pairs = np.unique(pair, return_counts=True)
    lines = [x for x in text.split("\n") if x]
    share = seen[seen > 0] / n
    last = data[end - 1]
    return [
        np.log1p(n), np.log1p(w), size.mean(), np.log1p(size.max()), seen[_UPPER].sum() / n, seen[_DIGIT].sum() / n,
        seen[_MARKS].sum() / n, seen[128:].sum() / n, 1 - size.sum() / n, len(count) / w,
        count.max() / w, len(pairs) / len(pair), pairs.max() / len(pair),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), (size <= 3).mean(),
        -(share * np.log2(share)).sum(), (_IS_MARK[last] & ~_FULL_STOP[last]).mean(), _FULL_STOP[last].mean(),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Step per bin of the tree of at most ``leaves`` leaves that lowers the loss most, split by split; g, h: gradient and curvature by bin."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def split(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        at = np.arange(lo + 1, hi)
        lg, lh, rg, rh = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[at], ch[hi] - ch[at]
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
        gain[(lh < least) | (rh < least)] = 0
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    parts = [(0, len(g), *split(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        lo, hi, gain, at = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(lo, at, *split(lo, at)), (at, hi, *split(at, hi))]
    out = np.zeros(len(g))
    for lo, hi, _, _ in parts:
        out[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a two-way table into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    q = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    q.append((cg[-1, -1] - q[0][0] - q[1][0] - q[2][0], ch[-1, -1] - q[0][1] - q[1][1] - q[2][1]))
    gain = sum(x**2 / (y + ridge) for x, y in q)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for (x, y), rows, cols in zip(q, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, cols] = -x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


@dataclass
class AdditiveModel:
    """Lookup tables; their size depends on the numbers of features, bins and pairs only."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]) if cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        b, p = self.bins(x, self.cuts), self.bins(x, self.pair_cuts)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[p[:, i], p[:, j]]
        return sigmoid(z)

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(t: pd.Series) -> pd.Series:
            x = np.array([features(v) for v in t], float).reshape(-1, len(NAMES))
            return pd.Series(model.score(x))

        return score(text)


def fit_model(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits tables to 0/1 labels; a sixth of the rows decides when each boosting stops."""
    n, k = x.shape
    m = AdditiveModel()
    if not n:
        return m
    p = (y.sum() + 0.5) / (n + 1)
    m.base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return m
    test = np.arange(n) % 6 == 5
    fit = ~test
    m.cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    m.pair_cuts = [np.unique(np.quantile(c, np.arange(1, PAIR_BINS) / PAIR_BINS)) for c in x.T]
    b, pb = m.bins(x, m.cuts), m.bins(x, m.pair_cuts)
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    z = np.full(n, m.base)

    def loss() -> float:
        return float((np.logaddexp(0, z[test]) - y[test] * z[test]).mean()) if test.any() else 0.0

    def boost(rounds: int, turn, tables: list[np.ndarray], undo) -> None:
        nonlocal z
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(rounds):
            turn()
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif (since := since + 1) >= PATIENCE:
                break
        for t, old in zip(tables, kept, strict=True):
            t[...] = old
        z = undo()

    def mains() -> None:
        for j in range(k):
            q = sigmoid(z)
            g = np.bincount(b[fit, j], (q - y)[fit], len(m.tables[j]))
            h = np.bincount(b[fit, j], (q * (1 - q))[fit], len(m.tables[j]))
            step = RATE * _tree(g, h)
            m.tables[j] += step
            z[:] += step[b[:, j]]

    boost(ROUNDS, mains, m.tables, lambda: m.base + sum(t[b[:, j]] for j, t in enumerate(m.tables)))
    q = sigmoid(z)
    gains = []
    for i in range(k):
        for j in range(i):
            shape = len(m.pair_cuts[i]) + 1, len(m.pair_cuts[j]) + 1
            if min(shape) > 1:
                cell = pb[fit, i] * shape[1] + pb[fit, j]
                g, h = (np.bincount(cell, v[fit], shape[0] * shape[1]).reshape(shape) for v in (q - y, q * (1 - q)))
                gains.append((_cross(g, h)[0], i, j, shape))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1:3]))[:PAIRS]
    m.pairs = [(i, j, np.zeros(shape)) for _, i, j, shape in chosen]
    main = z.copy()

    def crosses() -> None:
        for i, j, t in m.pairs:
            q = sigmoid(z)
            cell = pb[fit, i] * t.shape[1] + pb[fit, j]
            g, h = (np.bincount(cell, v[fit], t.size).reshape(t.shape) for v in (q - y, q * (1 - q)))
            step = RATE * _cross(g, h)[1]
            t += step
            z[:] += step[pb[:, i], pb[:, j]]

    boost(PAIR_ROUNDS, crosses, [t for _, _, t in m.pairs], lambda: main + sum((t[pb[:, i], pb[:, j]] for i, j, t in m.pairs), np.zeros(n)))
    return m


def held_out(column: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text divides by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, scratch: Scratch | None = None) -> AdditiveModel:
    """A model of labels.quality from rows not held out, at most ``max_train_rows`` of them, chosen by a hash of doc_id."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    y = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    chosen = scratch.table(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows), "chosen")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # At most max_train_rows pairs of numbers are broadcast, and, repeated ids put together, as many rows of features come to the driver.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).join(F.broadcast(chosen), "doc_id")
    measured = rows.select("doc_id", "y", "t").mapInArrow(measure, "doc_id long, y int, x array<double>")
    got = measured.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("doc_id")
    scratch.keep()
    if not len(got):
        return AdditiveModel()
    return fit_model(np.array(got.column("x").to_pylist(), float), got.column("y").to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold).

    Scores depend on the text alone. Null texts are empty and get the score of
    one. Labels with a null are left out; of labels that repeat a doc_id the
    largest counts, of documents that repeat a labelled one the row whose
    features come first in order; without labels every score is 0.5. Very
    long texts are read whole. Repeated rows and null
    ids are scored like any other; other columns are ignored.
    """
    model = train(docs, labels, **options)
    scored = docs.select("doc_id", held_out().alias("held_out"), model.column(text_of()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
