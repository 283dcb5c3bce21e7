import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm.common import Scratch, connected_components
from sylvan.llm.exact_dedup import cut_points, drop_exact_copies, exact_dedup
from sylvan.llm.near_dedup import HASHES, drop_near_copies, least_matches, minhashes, near_dedup
from sylvan.llm.words import gram_sets

SCHEMA = "doc_id long, text string, lang string, kept string, rep int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    rows, n = [], 0

    def add(t):
        nonlocal n
        rows.append((n, t))
        n += 1

    shared = words(rng, 60)
    for _ in range(25):
        add(" ".join(words(rng, rng.randrange(30, 300)) + (shared if rng.random() < 0.5 else [])))
    base = words(rng, 200)
    for _ in range(40):  # one large family of near copies
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        add(" ".join(w))
    for _ in range(6):
        b = words(rng, 120)
        for k in range(3):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(120)] = "changed"
            add(" ".join(w))
    for _ in range(12):
        add(" ".join(base))
    for t in (None, "", "  ", "one two", "One  two", "one two three", "é" * 9000, " ".join(words(rng, 20000, 10**6))):
        add(t)
    rows.append((3, rows[3][1]))  # a repeated row
    rows.append((4, " ".join(base)))  # a repeated id with another text
    rows.append((None, " ".join(base)))
    return rows


def sets(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t=0.8):
    s = [sets(x) for _, x in rows]
    links = [[j for j in range(len(rows)) if j != i and s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j])] for i in range(len(rows))]
    seen, part = {}, list(range(len(rows)))
    for i in range(len(rows)):
        if i in seen:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                todo += links[x]
    for i in range(len(rows)):
        part[i] = seen[i]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i]]
        known = [x for x in ids if x is not None]
        out.append((d, min(known) if known else None, len(links[i]), len(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, grams", [(512, 1 << 21), (7, 1 << 21), (512, 1500)])
def test_near_dedup_against_all_pairs(spark, block, grams):
    rows = corpus()
    got = near_dedup(frame(spark, rows), block=block, block_grams=grams).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.class_size) for r in got), key=str) == brute(rows)
    assert sum(r.first_of_class for r in got) == len({(r.class_id, r.text_key if r.class_size == 1 else 0) for r in got})


def test_drop_near_copies_keeps_one_of_each_class(spark):
    rows = [r for r in corpus() if r[0] not in (3, 4, None)]
    out = drop_near_copies(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "kept", "rep"]
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c, _, _ in brute(rows)})


def test_near_dedup_of_an_empty_table(spark):
    assert near_dedup(frame(spark, [])).count() == 0
    assert drop_near_copies(frame(spark, [])).count() == 0


def test_pruning_follows_the_posterior():
    rng = np.random.default_rng(1)
    # Draw similarities from the prior and matches given them; among draws below the bound the share at 0.8 or more is small.
    s = rng.random(400_000)
    m = rng.binomial(32, s)
    least = least_matches(32, 0.8, 1e-2)
    assert (s[m < least] >= 0.8).sum() / 400_000 < 0.01
    assert (s[m == least - 1] >= 0.8).mean() < 0.01 < (s[m == least] >= 0.8).mean() * 1.5
    assert least_matches(16, 0.8, 0.0) == 0


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    diffs = []
    for _ in range(60):
        a, b = pool[:200], np.concatenate((pool[:150], pool[1000 + _ * 10 : 1050 + _ * 10]))
        m = minhashes(np.concatenate((a, b)), np.array([0, 200, 400]))
        diffs.append((m[0] == m[1]).mean() - 150 / 250)
        rng.shuffle(pool)
    assert abs(np.mean(diffs)) < 0.02 and np.std(diffs) < 2 * (0.24 / HASHES) ** 0.5


def test_grams_match_tuples():
    texts = [t for _, t in corpus()]
    seen = {}
    for i, j, g, where in gram_sets(texts, 5):
        for d in range(i, j):
            mine, want = g[where[d - i] : where[d - i + 1]], sets(texts[d])
            assert len(set(mine.tolist())) == len(want)
            seen |= dict.fromkeys(mine.tolist(), 1)
    assert len(seen) == len(set().union(*(sets(t) for t in texts)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_against_text_equality(spark, bits):
    rows = [r for r in corpus() if r[0] not in (3,)] + [(900, "é" * 9000), (901, "é" * 8999 + "e"), (None, None)]
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    got = exact_dedup(frame(spark, rows), digest_bits=bits).collect()
    want = sorted(((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept) and sum(r.kept for r in got) == len(groups)


def test_drop_exact_copies(spark):
    rows = corpus() + [(7, None), (7, None)]
    out = drop_exact_copies(frame(spark, rows)).collect()
    assert len(out) == len({t or "" for _, t in rows})
    best = {}
    for d, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    assert sorted((r.text or "", r.doc_id) for r in out) == sorted(best.items())
    assert exact_dedup(frame(spark, [])).count() == 0 and drop_exact_copies(frame(spark, [])).count() == 0


def test_cut_points_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    ends = cut_points(data)
    assert ends[-1] == len(data) and all(b > a for a, b in zip(ends, ends[1:]))
    moved = cut_points(b"x" * 100 + data)
    assert len(set(ends) & {e - 100 for e in moved}) > 0.8 * len(ends)
    assert cut_points(b"") == [0] and cut_points(b"a" * 20_000)[-1] == 20_000


def test_groups_keep_every_batch():
    import pyarrow as pa

    from sylvan.llm.near_dedup import _groups

    rows = [(k // 3, k) for k in range(40)]
    batches = [pa.RecordBatch.from_pydict({"g": [g for g, _ in rows[i : i + 4]], "v": [v for _, v in rows[i : i + 4]]}) for i in range(0, 40, 4)]
    seen = []
    for t, at in _groups(iter(batches), ["g"]):
        for lo, hi in zip(at[:-1], at[1:]):
            assert len(set(t.column("g").to_pylist()[lo:hi])) == 1
        seen += t.column("v").to_pylist()
    assert seen == list(range(40))


def test_a_sieve_clears_no_wanted_row(spark):
    from sylvan.llm.common import sieve, sieved, without_rows

    docs = spark.range(5000).selectExpr("id as doc_id", "concat('t', id % 700) as text", "1 as sieve_bits")
    wanted = docs.where("doc_id % 9 = 0").selectExpr("doc_id", "xxhash64(text) as text_key")
    x = sieved(docs.selectExpr("*", "xxhash64(text) as text_key"), F.col("text_key"), sieve(wanted, "text_key"), "m")
    assert x.count() == 5000 and x.join(wanted, ["doc_id", "text_key"]).where("not m").isEmpty()
    left = without_rows(docs, wanted)
    assert left.columns == docs.columns and left.exceptAll(docs.where("doc_id % 9 <> 0")).isEmpty() and left.count() == docs.where("doc_id % 9 <> 0").count()
