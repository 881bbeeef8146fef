"""Per-job and cumulative processing metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle.operators.scan import RANGE_ROWS, in_ranges, prefix_scan

COUNTERS = ("pages", "ocr_pages", "llm_calls", "documents", "documents_requiring_review")


def job_metrics(
    states: DataFrame, docs: DataFrame, filled: DataFrame, durations: DataFrame
) -> DataFrame:
    """One row per bundle.

    filled: bundle_id, filled_pages (possibly several parts); durations: bundle_id,
    duration_seconds. A model call is a page that was undecided by the rules.
    """
    asked = F.col("by_verdict") | (
        F.col("kind").isin("unmatched", "verdict") & ~F.col("is_empty")
    )
    per_page = states.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(asked).alias("llm_calls")
    )
    per_doc = docs.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("requires_review").alias("documents_requiring_review"),
    )
    per_fill = filled.groupBy("bundle_id").agg(F.sum("filled_pages").alias("ocr_pages"))
    joined = per_page.join(per_doc, "bundle_id", "left").join(per_fill, "bundle_id", "left").join(
        durations, "bundle_id", "left"
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        "bundle_id", *[F.coalesce(c, zero).alias(c) for c in COUNTERS],
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
    )


def review_rate(review: Column, documents: Column) -> Column:
    return F.when(documents > 0, F.round(review / documents, 4)).otherwise(F.lit(0.0))


def _totals(columns: dict[str, Column]) -> list[Column]:
    return [
        columns["jobs"].alias("split_requests_total"),
        *[columns[c].alias(f"{c}_total") for c in COUNTERS],
        review_rate(columns["documents_requiring_review"], columns["documents"])
        .alias("review_rate"),
        F.round(columns["duration_seconds"], 3).alias("processing_seconds_total"),
    ]


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("jobs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTERS, "duration_seconds")],
    ]


def metrics_snapshot(metrics: DataFrame) -> DataFrame:
    summed = metrics.agg(*_sums())
    return summed.select(*_totals({c: F.col(c) for c in summed.columns}))


def metrics_by_window(metrics: DataFrame, window: str) -> DataFrame:
    """Totals per tumbling window of ``ts`` (batch or watermarked stream)."""
    summed = metrics.groupBy(F.window("ts", window)).agg(*_sums())
    columns = {c: F.col(c) for c in summed.columns if c != "window"}
    return summed.select("window.start", "window.end", *_totals(columns))


def metrics_running(metrics: DataFrame, order: str, block: int = RANGE_ROWS) -> DataFrame:
    """The snapshot after each job; ``order`` is the unique finishing order."""
    names = (*COUNTERS, "duration_seconds")
    ranged, at = in_ranges(metrics.select(order, *names), [order], block)
    scanned = prefix_scan(
        ranged, [], [order], at,
        sums={"jobs": F.lit(1), **{f"run_{c}": F.col(c) for c in names}},
    )
    columns = {"jobs": F.col("jobs"), **{c: F.col(f"run_{c}") for c in names}}
    return scanned.select(order, *_totals(columns))
