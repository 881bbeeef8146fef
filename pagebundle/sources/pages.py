"""Page rows from tables, whole-file texts and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "bundle_id long, page_number int, text string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored text layer; a page without text is an empty string."""
    pages = spark.read.schema(PAGE_SCHEMA).parquet(path)
    return pages.withColumn("text", F.coalesce("text", F.lit("")))


def explode_pages(
    files: DataFrame, id_col: str, text_col: str, separator: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One record per file -> ordered 1-based page rows (with the columns to ``keep``)."""
    return files.select(
        F.col(id_col).alias("bundle_id"), *keep,
        F.posexplode(F.split(F.coalesce(text_col, F.lit("")), separator)).alias("pos", "text"),
    ).select("bundle_id", (F.col("pos") + 1).alias("page_number"), "text", *keep)


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """Files <bundle_id>/<page_number>.<ext>; unreadable images give no row."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    parts = F.split("image.origin", "/")
    return images.select(
        F.element_at(parts, -2).cast("long").alias("bundle_id"),
        F.regexp_extract(F.element_at(parts, -1), r"^(\d+)", 1).cast("int").alias("page_number"),
        "image",
    )
