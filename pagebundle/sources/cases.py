"""Evaluation cases and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = (
    "id string, opis string, znane_typy array<string>, typ_biezacego_dokumentu string, "
    "poprzednia_strona string, aktualna_strona string, nastepna_strona string, "
    "oczekiwane struct<isFirstPage:boolean,documentType:string,isKnownType:boolean>"
)


def read_cases(spark: SparkSession, path: str, only_ids: list[str] | None = None) -> DataFrame:
    """One JSON object per file; ``source`` keeps the file-name order."""
    cases = (
        spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
        .withColumn("source", F.input_file_name())
    )
    return cases.where(F.col("id").isin(only_ids)) if only_ids else cases


def write_report(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
