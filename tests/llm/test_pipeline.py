"""The pipeline on a small table against what each stage promises; SQL twins of the queries."""

import pytest

import corpus_pipeline
from corvane.llm import entries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query(name, same_as_sql):
    same_as_sql(entries.QUERIES[name], entries.ORACLES[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}")
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for a, b in zip(names, names[1:], strict=False):
        assert kept[b] <= kept[a]
    assert len(kept["language"]) >= 0.98 * len(before)
    clean = entries.op10_decontaminate(spark, DATA).filter("not contaminated")
    assert kept["decontaminate"] >= kept["near_dedup"] & {r.doc_id for r in clean.select("doc_id").collect()}
    assert kept["encode"] == kept["decontaminate"]
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 50
