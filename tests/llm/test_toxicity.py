import random

import numpy as np

from sylvan.llm.linear import Rows, fit, sigmoid
from sylvan.llm.toxicity import Chain, Lookup, drop_toxic, fit_chain, toxicity
from sylvan.llm.words import chunks

SF = "/root/testdata/sf0.01"


def test_fit_recovers_weights():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 6)) < 0.4).astype(float)
    d = rng.normal(size=(4000, 1))
    want = np.array([2.0, -1.5, 0, 1, 0, -3, 0.7, 0.3])
    y = (rng.random(4000) < sigmoid(x @ want[:6] + d @ want[6:7] + want[7])).astype(float)
    rows, cols = np.nonzero(x)
    sparse = Rows(np.searchsorted(rows, np.arange(4001)), cols, 6)
    assert np.abs(fit(sparse, d, y, np.ones(4000), l2=0.1) - want).max() < 0.35
    assert fit(sparse, d, np.zeros(4000), np.ones(4000))[-1] < -7


def test_lookup_finds_each_feature_once():
    texts = ["Bad bad words", "", None, "badly worded, bad-tempered"]
    (_, _, data, at), = chunks(texts)
    from sylvan.llm.toxicity import text_features

    owner, h = text_features(data, at)
    assert set(owner.tolist()) == {0, 3}
    one = np.unique(h)
    two = np.unique(h[owner == 0], return_counts=True)
    known, levels = np.concatenate((one, two[0])), np.concatenate((np.ones(len(one), int), np.full(len(two[0]), 2)))
    x = Lookup(known, levels).rows(data, at)
    want = [len(set(h[owner == d].tolist())) for d in range(4)]
    want[0] += int((two[1] > 1).sum())
    want[3] += sum(int((h[owner == 3] == v).sum() > 1) for v in two[0])
    assert [len(set(x.idx[a:b].tolist())) for a, b in zip(x.start[:-1], x.start[1:])] == want and want[0] > 4


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity(docs, labels.where("doc_id % 3 <> 0"))
    rows = got.select("doc_id", "toxic").join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "toxic as y"), "doc_id").select("toxic", "y").collect()
    wrong = [sum(1 for p, y in rows if y == v and p != bool(y)) / sum(1 for _, y in rows if y == v) for v in (0, 1)]
    assert wrong[0] < 0.01 and wrong[1] < 0.1
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "p_toxic_spam", "toxic"] and got.count() == docs.count()


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fine", "good", "calm"]) for _ in range(9)) + (" vile" if i % 3 == 0 else ""), "x") for i in range(90)]
    rows += [(None, "vile", "x"), (500, None, "x"), (501, "", "x"), (3, rows[3][1], "x"), (502, "vile " + "calm " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(90)] + [(None, 1, 1), (7, None, 1), (8, 0, 1)], "doc_id long, toxic int, quality int")
    got = {(r.doc_id, r.toxic) for r in toxicity(docs, labels).collect()}
    assert got >= {(0, True), (1, False), (None, True), (500, False), (501, False), (502, True)}
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(90) if i % 3] + [500, 501])
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {(r.p_toxic, r.toxic) for r in toxicity(docs, labels.limit(0)).collect()} == {(0.5, False)}
    assert drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_later_models_use_earlier_out_of_fold_predictions(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(12)) + (" odd" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 8 == 0)) for i in range(400)], "doc_id long, a int, b int")
    chain = fit_chain(docs, labels, {"a": "a", "b": "b"}, max_train_rows=300)
    assert len(chain.out_of_fold) == 300 and 0 < len(chain.known) <= 2048 and [len(w) for w in chain.weights] == [len(chain.known) + 1, len(chain.known) + 2]
    assert chain.weights[1][-2] > 0.1  # b needs a
    assert ((chain.out_of_fold[:, 0] > 0.5).mean() - 75 / 300) < 0.35
    assert isinstance(chain, Chain) and chain.score(["odd w1 w2", "w1 w2"])[:, 0].tolist()[0] > 0.5


def test_out_of_fold_probabilities_have_not_seen_their_labels(spark):
    """Words that occur in one document alone, or in a few, and labels that are chance: nothing can be learnt."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(30))) for i in range(600)]
    labels = [(i, rng.randrange(2), 1) for i in range(600)]
    chain = fit_chain(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {"toxic": "toxic"})
    y = np.array([t for _, t, _ in labels])
    assert abs(((chain.out_of_fold[:, 0] > 0.5) == y).mean() - 0.5) < 0.08


def test_of_repeated_ids_the_first_text_counts(spark):
    rows = [(i, ("vile " if i % 2 else "calm ") * 5) for i in range(80)] + [(i, "a " + ("calm " if i % 2 else "vile ") * 5) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(80)], "doc_id long, toxic int, quality int")
    for part in (rows, rows[::-1]):  # "a ..." is first: there the words stand for the other class
        chain = fit_chain(spark.createDataFrame(part, "doc_id long, text string"), labels)
        p = chain.score(["vile vile", "calm calm"])[:, chain.categories.index("toxic")]
        assert p[0] < 0.5 < p[1]


def plain_scores(chain, texts):
    """The chain by loops over words."""
    from sylvan.llm.toxicity import text_features

    out = []
    for t in texts:
        found = {}
        for _, _, data, at in chunks([t]):
            for h in text_features(data, at)[1].tolist():
                found[h] = found.get(h, 0) + 1
        p = []
        for w in chain.weights:
            z = w[-1] + sum(w[i] for i, (h, v) in enumerate(zip(chain.known.tolist(), chain.levels.tolist())) if found.get(h, 0) >= v) + sum(a * b for a, b in zip(p, w[len(chain.known) : -1]))
            p.append(1 / (1 + np.exp(-z)))
        out.append(p)
    return np.array(out)


def test_query_against_loops(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    chain = fit_chain(docs, labels)
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = plain_scores(chain, [r.text or "" for r in rows])
    assert len(got) == len(rows) == docs.count()
    for r, p in zip(rows, want):
        assert np.allclose([got[r.doc_id][f"p_{c}"] for c in chain.categories], p) and got[r.doc_id].toxic == (got[r.doc_id].p_toxic >= 0.5)
