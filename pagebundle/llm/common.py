"""What several operators share: words, staged tables, typed empty input, free column names."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagebundle.staging import stage

__all__ = ["WORDS", "WORDS_BYTES", "stage", "table", "fresh", "size_checked_broadcast", "crc_bucket", "stable_number", "small_table", "short_batches", "hash_bitmap", "may_hold"]

#: Maximal runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def size_checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    Pass a staged table: its rows are counted first. Beyond the bound Spark joins by
    shuffle; the result is the same.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def stable_number(key: Column) -> Column:
    """The first 15 hex digits of the MD5 of the key's text as a long (null: an empty text)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A bounded table made on the driver, as a literal that the JVM parses."""
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False)
    fields = ", ".join(f"`{part.split()[0].strip('`')}`: {part.split()[1]}" for part in schema.split(","))
    parsed = F.from_json(F.lit(text), f"array<struct<{fields}>>")
    return spark.range(1).select(F.inline(parsed))


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lets at most ``rows`` texts at a time travel to a Python worker, which bounds its memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def hash_bitmap(hashes: DataFrame, column: str, bits: int):
    """A broadcast bitmap of the top ``bits`` bits of the longs in ``column``; its size is fixed.

    Value without its bit set does not occur; others may. See ``may_hold``.
    """
    top = F.shiftrightunsigned(column, 64 - bits)
    words = (
        hashes.select(F.shiftright(top, 6).alias("word"), top.alias("top"))
        .select("word", F.expr("shiftleft(1L, cast(top & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
    )
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    rows = words.toArrow()  # at most one row for each 64 bits
    table[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.tobytes())


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) may be among the values of a bitmap (read as uint64)."""
    bits = len(bitmap).bit_length() + 5
    top = hashes >> np.uint64(64 - bits)
    return (bitmap[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)
