"""Comparing model verdicts with expected answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle import fixed


def _shown(value: Column) -> Column:
    """Quoted text, preferring single quotes."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def evaluate_verdicts(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """cases: id, expected struct (null field = not checked); verdicts: id, verdict,
    guard, seconds, error. A missing verdict fails its case."""
    got = F.col("verdict")

    def mismatch(name: str, shown) -> Column:
        want, have = F.col(f"expected.{name}"), got[name]
        return F.when(
            want.isNotNull() & (want != have),
            F.format_string(fixed.EVAL_MISMATCH, F.lit(name), shown(want), shown(have)),
        )

    flag = lambda c: F.initcap(c.cast("string"))
    found = F.array_compact(
        F.array(
            mismatch("isFirstPage", flag), mismatch("documentType", _shown),
            mismatch("isKnownType", flag),
        )
    )
    none = F.array().cast("array<string>")
    return cases.join(verdicts, "id", "left").select(
        "id",
        F.coalesce(
            got.isNotNull() & (F.size(found) == 0) & (F.size(F.coalesce("guard", none)) == 0),
            F.lit(False),
        ).alias("pass"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        "error",
        F.when(got.isNotNull(), found).otherwise(none).alias("mismatches"),
        F.coalesce("guard", none).alias("guard"),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("pass").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("total_seconds"),
    )
