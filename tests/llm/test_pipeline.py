import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_each_keep_what_they_should(spark):
    from test_dedup import brute_classes, normal

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        seen.append(name)
        if name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(normal(before[i]), i)
            assert after == set(first.values())
        if name == "n-gram Jaccard join":
            ids = sorted(before)
            assert after == {i for i, (k, _) in zip(ids, brute_classes([before[i] for i in ids])) if ids[k] == i}
        if name.startswith("mixing"):
            assert docs.columns[: len(columns)] == columns
        else:
            assert docs.columns == columns
    assert len(seen) == 5
