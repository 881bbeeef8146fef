"""Bundles of tenants: who has a dictionary of their own may use any bundle ids.

Where pages name their dictionary (``dict_id``), a bundle is the pair of both. Inside
the library the pair is one key: ``bundle_id`` becomes a struct, and every grouping,
window, range and join on it keeps tenants apart without naming them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_keyed(df: DataFrame) -> bool:
    return isinstance(df.schema["bundle_id"].dataType, T.StructType)


def keyed(df: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``df`` with the pair as ``bundle_id`` if it (or ``pages``) names dictionaries.

    Rows about pages that do not name one themselves belong to every tenant whose
    ``pages`` have that bundle id and page number.
    """
    if is_keyed(df):
        return df
    if "dict_id" not in df.columns:
        if pages is None or "dict_id" not in pages.columns:
            return df
        owners = pages.select("bundle_id", "page_number", "dict_id").distinct()
        df = df.join(owners, ["bundle_id", "page_number"])
    return df.withColumn("bundle_id", F.struct("dict_id", "bundle_id"))


def unkeyed(df: DataFrame) -> DataFrame:
    """``df`` with dict_id and bundle_id as columns of their own."""
    if not is_keyed(df):
        return df
    rest = [c for c in df.columns if c not in ("bundle_id", "dict_id")]
    return df.select(F.col("bundle_id.dict_id").alias("dict_id"), F.col("bundle_id.bundle_id").alias("bundle_id"), *rest)
