"""Columns of the user keep their values, whatever they are called."""

import public_tokenizers
import pytest

from pagebundle.llm.bpe import with_token_ids
from pagebundle.llm.quality import keep_good
from pagebundle.llm.sharding import with_shard

NAMES = ("kept", "base_failed", "slot", "shard", "token_ids", "s")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{' '.join(f'word{j}' for j in range(60))} {i}", "en", *[f"{n}{i}" for n in NAMES]) for i in range(3)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {', '.join(f'{n} string' for n in NAMES)}")


def own(df):
    return sorted(tuple(r[n] for n in ("doc_id", *NAMES)) for r in df.collect())


def test_quality_keeps_them(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and own(kept) == own(docs)


def test_sharding_keeps_them(docs):
    placed = with_shard(docs, "doc_id", ["a", "b"], 13)
    assert own(placed) == own(docs) and placed.columns[-2:] == ["_slot", "_shard"]


def test_encoding_keeps_them(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = with_token_ids(docs, path, public_tokenizers.PATTERN)
    assert own(coded) == own(docs) and all(len(r["_token_ids"]) > 60 for r in coded.collect())
