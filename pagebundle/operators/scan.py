"""Ordered running values per key without one task ever holding a whole key.

Every key's rows are cut into blocks along their order. Running values are
computed inside each block (one task per key *and* block), blocks are reduced
to one row each, and what earlier blocks contribute is joined back. With blocks
of a few thousand rows the only per-key work left is on that short reduced
table, so a key that holds a third of the data still spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagebundle.staging import stage

_BLOCK = "_block"
_RANGE = "_range"
#: rows of a range of a table-wide running value
RANGE_ROWS = 1_000_000


def page_block(page: Column | str, size: int) -> Column:
    page = F.col(page) if isinstance(page, str) else page
    return F.floor((page - 1) / F.lit(size)).cast("long")


def in_ranges(df: DataFrame, order: list[str], rows: int) -> tuple[DataFrame, Column]:
    """A table of ``df`` in ranges of its (unique) order, and the column of the range.

    For running values over a whole table: ranges hold about ``rows`` rows whatever the
    gaps between the order's values, so one carry per range stays a short table.
    """
    table = stage(df, "unranged")
    parts = max(1, -(-table.count() // rows))
    ranged = table.repartitionByRange(parts, *order).withColumn(_RANGE, F.spark_partition_id())
    return stage(ranged, "ranged"), F.col(_RANGE)


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    priors: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums, minima and last non-null values (priors: without
    the row itself).

    ``order`` must be unique within a key, ``block`` a non-decreasing function of
    it, and the keys not null. ``df`` is read twice: pass a table, not a costly plan.
    """
    sums, mins, lasts, priors = sums or {}, mins or {}, lasts or {}, priors or {}
    df = df.withColumn(_BLOCK, block)

    def last_by_order(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))

    totals = df.groupBy(*keys, _BLOCK).agg(
        F.lit(1).alias("_present"),
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.min(v).alias(f"_t_{n}") for n, v in mins.items()],
        *[last_by_order(v)["_v"].alias(f"_t_{n}") for n, v in (lasts | priors).items()],
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        _BLOCK,
        F.count("_present").over(earlier).alias("_earlier"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in mins],
        *[F.last(f"_t_{n}", True).over(earlier).alias(f"_c_{n}") for n in lasts | priors],
    ).where("_earlier > 0")

    ordered = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    inside = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    names = [*sums, *mins, *lasts, *priors]
    local = df.select(
        "*",
        *[F.sum(v).over(inside).alias(f"_l_{n}") for n, v in sums.items()],
        *[F.min(v).over(inside).alias(f"_l_{n}") for n, v in mins.items()],
        *[F.last(v, True).over(inside).alias(f"_l_{n}") for n, v in lasts.items()],
        *[F.last(v, True).over(before).alias(f"_l_{n}") for n, v in priors.items()],
    )
    joined = local.join(carried, [*keys, _BLOCK], "left")

    def combined(name: str) -> Column:
        here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if name in sums:
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif name in mins:
            value = F.least(here, carry)
        else:
            value = F.coalesce(here, carry)
        return value.alias(name)

    kept = [c for c in df.columns if c not in (_BLOCK, _RANGE)]
    return joined.select(*kept, *[combined(n) for n in names])


def spread_over_blocks(
    ranges: DataFrame, start: Column, end: Column, size: int
) -> DataFrame:
    """One copy of each row per page block its range touches (column _block)."""
    return ranges.withColumn(
        _BLOCK, F.explode(F.sequence(page_block(start, size), page_block(end, size)))
    )


def with_block(pages: DataFrame, size: int) -> DataFrame:
    return pages.withColumn(_BLOCK, page_block("page_number", size))


def join_ranges(
    pages: DataFrame, ranges: DataFrame, size: int, how: str = "inner"
) -> DataFrame:
    """Pages with the ranges (bundle_id, start_page, end_page, ...) that contain them.

    Both sides meet on (bundle, block), so long bundles spread over many tasks.
    """
    spread = spread_over_blocks(ranges, F.col("start_page"), F.col("end_page"), size)
    p, r = with_block(pages, size).alias("p"), spread.alias("r")
    condition = (
        (F.col("p.bundle_id") == F.col("r.bundle_id"))
        & (F.col(f"p.{_BLOCK}") == F.col(f"r.{_BLOCK}"))
        & F.col("p.page_number").between(F.col("r.start_page"), F.col("r.end_page"))
    )
    joined = p.join(r, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(_BLOCK)
    extra = [c for c in ranges.columns if c != "bundle_id" and c not in pages.columns]
    return joined.select("p.*", *[F.col(f"r.{c}") for c in extra]).drop(_BLOCK)
