"""One text of some megabytes, a copy of it and a near copy, through every operator on documents."""

import pytest

from sylvan.llm import quality, secrets
from sylvan.llm.decontaminate import contamination
from sylvan.llm.exact_dedup import exact_dedup
from sylvan.llm.near_dedup import near_dedup
from sylvan.llm.packing import best_fit_packing
from sylvan.llm.tokens import encode, token_counts
from sylvan.llm.toxicity import toxicity

WORDS = 300_000
ITEM = " ".join(f"item{i}" for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(WORDS))
    near = long.replace(" w7919 ", " other ").replace(" w15838 ", " " + ITEM + " ")
    rows = [(1, long), (2, long), (3, near), (4, "a short text"), (5, long + " api_key=abcdefgh1234")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_copies(docs):
    got = {r.doc_id: r for r in near_dedup(docs).collect()}
    assert {d: (r.class_id, r.n_links) for d, r in got.items()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 0), 5: (1, 3)}
    exact = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert {d: (r.keep_id, r.group_size) for d, r in exact.items()} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)} and exact[1].n_chunks > 100


def test_what_is_in_them(spark, docs):
    items = spark.createDataFrame([(7, ITEM), (8, "nothing of the kind is anywhere in these texts here")], "item_id long, text string")
    (hit,) = contamination(docs, items).collect()
    assert (hit.doc_id, hit.item_id, hit.n_words, hit.similarity) == (3, 7, 30, 1.0)
    found = {r.doc_id: r.n_assign for r in secrets.secret_scan(docs).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_lengths_and_scores(spark, docs):
    n = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    assert token_counts(docs).first().tokens_total == sum(n.values())
    placed = best_fit_packing(docs, shard_pieces=100).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in placed} == {d: k + 1 for d, k in n.items()}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity(docs, labels).count() == 5 and all(0 <= r.score <= 1 for r in quality.quality(docs, labels).collect())
