import random
from collections import Counter

import numpy as np
import pytest

from sylvan.llm.decontaminate import RADIUS, Index, contamination, drop_contaminated, window_hashes


def grams(text, n=5):
    w = (text or "").lower().split()
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def brute(docs, items, t=0.8):
    out = {}
    for k, (d, text) in enumerate(docs):
        g = grams(text)
        for i, item in items:
            short = (item or "").lower().split()
            if 0 < len(short) < 5:
                w = (text or "").lower().split()
                if any(w[a : a + len(short)] == short for a in range(len(w) - len(short) + 1)):
                    out[k, i] = 1.0
                continue
            want = Counter(grams(item))
            size = sum(want.values())
            if not size or not want.keys() & set(g):  # nothing in common in any window
                continue
            width = min(size, len(g))
            best = max(sum((Counter(g[a : a + width]) & want).values()) / sum((Counter(g[a : a + width]) | want).values()) for a in range(len(g) - width + 1))
            if best >= t:
                out[k, i] = best
    return out


def case():
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(8, 70)))) for i in range(40)] + [(100, None), (101, "two words"), (103, "Rare"), (104, "one two three four"), (102, "a b a b a b a b a b a b a b")]
    items.append(items[0])
    docs = []
    for d in range(120):
        w = say(rng.randrange(0, 200))
        if d % 2:
            part = items[rng.randrange(40)][1].split()
            for _ in range(rng.randrange(3)):
                part[rng.choice([0, -1, rng.randrange(len(part))])] = "changed"
            if d % 3 == 0:
                part = part[rng.randrange(4) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in part]
        docs.append((d, "\n ".join(w)))
    docs += [(500, None), (501, ""), (502, "Two  words"), (505, "so many of two words\nthere"), (506, "rare one two three four"), (507, "one two three"), (503, "x " * 2000 + items[3][1]), (None, items[4][1]), (1, docs[1][1]), (504, "a b a b a b a b a b a b a b")]
    return docs, items


@pytest.mark.parametrize("block", [1024, 16])
def test_against_every_window(spark, block):
    docs, items = case()
    want = brute(docs, items)
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got), key=str) == sorted(((docs[k][0], i, round(s, 9)) for (k, i), s in want.items()), key=str)
    assert len(want) > 30 and all(r.contaminated and r.distance <= RADIUS for r in got)


def test_drop_contaminated(spark):
    docs, items = case()
    frame = spark.createDataFrame([(i, t, "en", 1) for i, t in docs], "doc_id long, text string, lang string, hits int")
    out = drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    bad = {k for k, _ in brute(docs, items)}
    assert out.columns == frame.columns and sorted((str(r.doc_id) for r in out.collect())) == sorted(str(d) for k, (d, _) in enumerate(docs) if k not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(frame, none).count() == len(docs) and contamination(frame.limit(0), none).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    index = Index([(i, " ".join(f"t{rng.integers(1000)}" for _ in range(30))) for i in range(50)])
    prints = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for k in range(2000):
        flips = rng.choice(64, rng.integers(0, 26), replace=False)
        prints[k] = index.hash[k % 50] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    row, item, distance = index.within(prints)
    all_pairs = np.bitwise_count(prints[:, None] ^ index.hash[None, :])
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(all_pairs <= RADIUS)), strict=True))


def test_window_hash_is_the_majority():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 2**63, 40, dtype=np.uint64)
    bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    want = [np.packbits(bits[b : b + 7].sum(0) > 3.5).view(np.uint64)[0] for b in range(34)]
    assert window_hashes(g, np.arange(34), 7).tolist() == [int(x) for x in want]
