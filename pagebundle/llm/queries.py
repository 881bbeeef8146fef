"""The operators' queries, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagebundle.llm.common import table
from pagebundle.llm.leaks import LEAKS_SQL
from pagebundle.llm.mixing import MIXING_SQL
from pagebundle.llm.phrases import PHRASES_SQL
from pagebundle.llm.sharding import SHARDING_SQL
from pagebundle.llm.urlgraph import url_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op6_url_filter": url_sql(), "op7_sharding": SHARDING_SQL, "op9_source_mixing": MIXING_SQL, "op12_phrases": PHRASES_SQL, "op13_decontamination": LEAKS_SQL}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.simhash import simhash_digest

    return simhash_digest(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.quality import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagebundle.llm.bpe import bpe_digest

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.langid import language_digest

    return language_digest(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.sharding import sharding_digest

    return sharding_digest(table(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.mixing import mixing_digest

    return mixing_digest(table(spark, sf_dir, "documents"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.urlgraph import url_digest

    return url_digest(table(spark, sf_dir, "pages"))


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pagebundle.llm.alignment import alignment_digest

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_digest(table(spark, sf_dir, "documents"), *paths)


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.phrases import phrase_digest

    return phrase_digest(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagebundle.llm.leaks import leak_digest

    return leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
