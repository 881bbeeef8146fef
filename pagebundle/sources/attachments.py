"""Choosing the source file of a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.functions.text import strip


def is_pdf(extension: Column) -> Column:
    return F.coalesce(
        F.lower(F.regexp_replace(extension, r"^\.+", "")) == "pdf", F.lit(False)
    )


def single_pdf_per_element(attachments: DataFrame) -> DataFrame:
    """Exactly one PDF per element, else the error to report."""
    pdf = is_pdf(F.col("extension"))
    counted = attachments.groupBy("element_id").agg(
        F.count_if(pdf).alias("pdf_count"),
        F.min(F.when(pdf, F.col("attachment_id"))).alias("first_pdf"),
    )
    n = F.col("pdf_count")
    return counted.select(
        "element_id", "pdf_count",
        F.when(n == 1, F.col("first_pdf")).alias("attachment_id"),
        F.when(n == 0, fixed.NO_PDF_ERROR).when(n > 1, fixed.MANY_PDF_ERROR).alias("error"),
    )


def attachments_by_id(requests: DataFrame, attachments: DataFrame) -> DataFrame:
    """(request_id, element_id, raw_id) -> the attachment, or the first check it fails."""
    trimmed = strip(F.coalesce("raw_id", F.lit("")))
    number = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("int"))
    asked = requests.withColumn("wanted", F.when(number > 0, number).cast("long"))
    found = attachments.select(
        F.col("attachment_id").alias("wanted"), F.col("element_id").alias("owner_id"),
        "file_name", "extension",
    )
    error = (
        F.when(
            F.col("wanted").isNull(),
            F.format_string(fixed.ATTACHMENT_BAD_ID, F.coalesce("raw_id", F.lit(""))),
        )
        .when(F.col("file_name").isNull(), F.format_string(fixed.ATTACHMENT_MISSING, "wanted"))
        .when(
            F.coalesce(F.col("owner_id") != F.col("element_id"), F.lit(True)),
            F.format_string(
                fixed.ATTACHMENT_FOREIGN, "wanted",
                F.coalesce(F.col("owner_id").cast("string"), F.lit("nieznanego")), "element_id",
            ),
        )
        .when(
            ~is_pdf(F.col("extension")),
            F.format_string(fixed.ATTACHMENT_NOT_PDF, "file_name", "wanted"),
        )
    )
    # unusable ids have nothing to look up; as null keys they would meet in one task
    usable = asked.where("wanted IS NOT NULL").join(found, "wanted", "left")
    unusable = asked.where("wanted IS NULL").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in found.schema if f.name != "wanted"}
    )
    return usable.unionByName(unusable).select(
        "request_id", "element_id", "raw_id", error.alias("error"),
        F.when(error.isNull(), F.col("file_name")).alias("file_name"),
    )
