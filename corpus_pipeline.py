"""From raw documents to token ids: quality rules, near-dedup, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
``docs``; the last adds what it encodes. ``run`` writes every stage's result to the
shared checkpoint folder before the next one reads it, so a lost executor costs one
stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagebundle.llm.bpe import with_token_ids
from pagebundle.llm.common import stage, table
from pagebundle.llm.mixing import mixed_documents
from pagebundle.llm.pii import sanitise
from pagebundle.llm.quality import keep_good
from pagebundle.llm.shingles import shingle_components
from pagebundle.llm.simhash import keep_one_per_component

#: Cutoffs learned with exact binomial tests and a tokenizer are among the stages: tests
#: compare them with brute force instead.
ORACLE_SQL = None

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (Jaccard 0.8 or more) the one with the smallest id stays."""
    return keep_one_per_component(docs, components=shingle_components)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers and the terms that give them away are replaced in the texts."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the schedule; sources short for their weight repeat."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text beside the columns of documents."""
    return with_token_ids(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("simhash_neardup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", mixing),
    ("byte_bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
