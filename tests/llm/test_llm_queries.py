"""Registered queries against DuckDB, and the pipeline against its stages' plain meaning."""

import pytest

import corpus_pipeline
from check_oracle import compare, connect
from pagebundle.llm.queries import ORACLE, QUERIES
from test_shingles import slow_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_counterpart(spark, name):
    assert compare(spark, connect(SF), SF, name) is None


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    now, seen = docs, {}
    for name, function in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(function(spark, now, d), f"test-{name}")
        assert now.columns[: len(docs.columns)] == docs.columns
        seen[name] = now
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in seen["quality_rules"].collect()}
    assert all(len(texts[i].split()) >= 50 for i in kept) and len(kept) > 0.8 * len(texts)
    one = [r["doc_id"] for r in seen["simhash_neardup"].collect()]
    want = slow_components([(i, texts[i]) for i in kept])
    assert sorted(one) == sorted(set(want.values()))
    last = seen["byte_bpe"].collect()
    assert {r["doc_id"] for r in last} == set(one) and all(len(r["token_ids"]) > 0 for r in last)
    assert corpus_pipeline.run(spark, d).count() == len(last)
