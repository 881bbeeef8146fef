"""Writing child records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending_children(documents: DataFrame, high_water: DataFrame) -> DataFrame:
    """Documents not yet created: index above the bundle's high-water mark.

    high_water: bundle_id, last_created.
    """
    marks = high_water.select("bundle_id", "last_created")
    return (
        documents.join(marks, "bundle_id", "left")
        .where(F.col("document_index") > F.coalesce("last_created", F.lit(0)))
        .drop("last_created")
    )


def advanced_marks(documents: DataFrame, high_water: DataFrame) -> DataFrame:
    """High-water marks after all pending children are created."""
    seen = documents.select("bundle_id", F.col("document_index").alias("last_created"))
    return (
        seen.unionByName(high_water.select("bundle_id", "last_created"))
        .groupBy("bundle_id").agg(F.max("last_created").alias("last_created"))
    )


def written_before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows that earlier batches wrote under ``path``; empty if there are none yet."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_children(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append children of one batch once, in whatever order they come and also when replayed.

    Earlier batches decide what is new and the batch's own folder is overwritten, so a
    replay writes the same rows to the same place. Parts of a document are rows of their own.
    """
    key = ["bundle_id", "document_index"]
    schema = "bundle_id long, document_index int, batch_id long"
    if "part" in batch.columns:
        key.append("part")
        schema += f", part {batch.schema['part'].dataType.simpleString()}"
    created = written_before(batch.sparkSession, path, schema, batch_id)
    if "part" in key:
        created = created.fillna(0, ["part"])  # batches written without parts
    fresh = batch.dropDuplicates(key).join(created.select(*key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
