"""The pipeline against plain loops over the rows of the smallest tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sylvan.llm.tokens import encode
from sylvan.llm.toxicity import fit_chain
from tests.llm.test_dedup import brute as near_classes
from tests.llm.test_packing import check
from tests.llm.test_toxicity import plain_scores

SF = "/root/testdata/sf0.001"


def grams(text, n=5):
    w = (text or "").lower().split()
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def holds(text, items):
    """Whether some window as long as an item is as similar to it as 0.8; only items that share an n-gram can be."""
    g = grams(text)
    seen = set(g)
    for want in items:
        if seen & want.keys():
            size = want.total()
            width = min(size, len(g))
            for a in range(len(g) - width + 1):
                have = Counter(g[a : a + width])
                if (have & want).total() >= 0.8 * (have | want).total():
                    return True
    return False


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The tables, and rows that a stage should drop, or that are odd."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    some = docs.where("length(text) between 600 and 3000").orderBy("doc_id").limit(3).collect()
    rows = [(90_000, some[0].text), (90_001, some[1].text + " and one word more"), (90_002, "Before it. " + item + " After it."), (90_003, None), (90_004, ""), (90_005, "word " * 30_000), (90_005, "word " * 30_000), (90_006, "short text")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    columns = [F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]
    docs.unionByName(extra.select(*columns)).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path


def test_pipeline_against_loops(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    chain = fit_chain(docs, labels)
    toxic = plain_scores(chain, [t or "" for _, t in rows])[:, chain.categories.index("toxic")] >= 0.5
    clean = [r for r, bad in zip(rows, toxic) if not bad]
    assert 0 < len(clean) < len(rows)
    best = {}
    for d, t in clean:
        best[t or ""] = max(best.get(t or "", -1), d)
    single = [(d, t) for t, d in best.items()]
    assert len(single) < len(clean) - 2
    classes = {c for _, c, _, _ in near_classes(single)}
    apart = [(d, t) for d, t in single if d in classes]
    assert len(apart) < len(single)
    items = [Counter(grams(r.text)) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in apart if not holds(t, items)]
    assert len(kept) < len(apart) and 90_002 not in {d for d, _ in kept}
    got = corpus_pipeline.run(spark, tables).collect()
    check(got, [(d, len(encode(t)) + 1) for d, t in kept])


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("maybe__x", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
