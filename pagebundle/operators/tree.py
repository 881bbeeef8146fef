"""Concatenation of ordered lists over page blocks, by a tree of blocks.

A list that belongs to one document or bundle is first built per block of pages, then
per range of ``FAN`` blocks, then as a whole. So the pages of a huge document are sorted
in many tasks, and the last one only appends ranges. Usual documents have one block;
the further levels then handle one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: blocks of a range; a multiple of it, as a section's offset is, never parts a range
FAN = 1024
#: offset between sections that come one after the other, each with its own blocks
SECTION = 1 << 32


def sorted_values(item: Column, value: str, chosen: Column | None = None) -> Column:
    """An aggregate: the field ``value`` of all (chosen) structs in their order."""
    items = F.collect_list(item if chosen is None else F.when(chosen, item))
    return F.array_sort(items).getField(value)


def concatenated(
    rows: DataFrame, keys: list[str], block: str, lists: list[str],
    sums: tuple[str, ...] = (), mins: tuple[str, ...] = (),
) -> DataFrame:
    """(keys, lists, sums, mins): one row per key from one row per (keys, block).

    ``lists`` are arrays, appended in the order of ``block`` (a long); ``sums`` and ``mins``
    are added up and compared.
    """
    for level in (F.floor(F.col(block) / FAN).cast("long"), None):
        ranges = [] if level is None else [level.alias("_range")]
        part = F.struct(F.col(block).alias("at"), *lists)
        rows = rows.groupBy(*keys, *ranges).agg(
            F.array_sort(F.collect_list(part)).alias("_parts"),
            *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins],
        ).select(
            *keys, *([F.col("_range").alias(block)] if ranges else []),
            *[F.flatten(F.col("_parts").getField(c)).alias(c) for c in lists],
            *sums, *mins,
        )
    return rows
