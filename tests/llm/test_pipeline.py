"""The corpus pipeline: each stage on all its predecessor kept."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_similar import brute_kept
from tracewell.llm import packing, quality_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in docs.collect() if model.score(r["text"]) >= 0.5)
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(x[0] for x in brute_kept(rows))
        if name == "personal_data":
            assert after.count() == docs.count() and not [r for r in after.collect() if "@mail" in r["text"]]
        if name == "mix_sources":
            before, each = {r["doc_id"]: r["text"] for r in docs.collect()}, after.collect()
            assert all(before[r["doc_id"]] == r["text"] for r in each)
            assert max([r["doc_id"] for r in each].count(i) for i in {r["doc_id"] for r in each}) <= 3
        if name == "pack":
            e = packing.Encoder(packing.tokenizer_path())
            assert sum(r["length"] for r in after.collect()) == sum(len(x) + 1 for x in e.ids([r["text"] for r in docs.collect()]))
        else:
            assert after.columns == names
        docs = after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and len(corpus_pipeline.STAGES) == 5
