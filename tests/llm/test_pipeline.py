"""The pipeline's stages, each held against brute force over what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from cellmap.llm.common import settle
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_near_copies import brute as brute_near

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = settle(stage(spark, docs, DATA), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= before.items() and after
        kept[name] = before, after
    before, after = kept["exact_dedup"]
    assert set(after) == {r[0] for r in brute_exact(list(before.items())) if r[3]}
    before, after = kept["near_dedup"]
    ids = sorted(before)
    assert set(after) == {ids[i] for i, root in enumerate(brute_near([before[d] for d in ids])) if i == root}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = kept["quality_classifier"]
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.95 * len(good)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(kept["near_dedup"][1])
    assert corpus_pipeline.run(spark, DATA).count() == len(packed)
