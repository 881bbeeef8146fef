"""Cutting bundles into segments.

Rules decide per page; where a segment starts and which type is current follow
from running values over the pages of a bundle (operators.scan), so no bundle
is ever folded by one task. Model verdicts make the current type depend on
earlier verdicts; the few pages where that matters are resolved first
(operators.verdicts) and then treated like rule-made first pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagebundle import fixed
from pagebundle.config import SplitConfig
from pagebundle.operators import reads as rd
from pagebundle.operators import rules
from pagebundle.operators.scan import page_block, prefix_scan, spread_over_blocks, with_block
from pagebundle.operators.tenants import keyed, unkeyed

FACT_COLUMNS = [
    "bundle_id", "page_number", "is_first", "document_type", "confidence", "signals",
    "affinities", "is_empty", "confirmed_empty",
]


def page_facts(reads: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Everything later steps need to know about a page, without its text."""
    text = F.col("text")
    return rules.classify_pages(reads, patterns, cfg).select(
        "bundle_id", "page_number", "is_first", "document_type", "confidence", "signals",
        "affinities",
        rd.is_empty(text, cfg).alias("is_empty"),
        rd.confirmed_empty(text, F.col("blank"), cfg).alias("confirmed_empty"),
    )


def removal_breaker(facts: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Per bundle: candidate and total pages, and whether removal must not happen."""
    counted = facts.groupBy("bundle_id").agg(
        F.count_if("confirmed_empty").alias("candidates"),
        F.count(F.lit(1)).alias("total"),
        F.max("page_number").alias("last_page"),
    )
    share = F.col("candidates") / F.col("total")
    tripped = (F.col("candidates") > 0) & (
        (share > cfg.empty_page_max_share) | (F.col("candidates") >= F.col("total"))
    )
    return counted.withColumn("tripped", tripped & F.lit(cfg.empty_mode == "remove"))


def with_removable(facts: DataFrame, cfg: SplitConfig) -> DataFrame:
    """facts + removable: confirmed empty, mode remove, breaker not tripped."""
    if cfg.empty_mode != "remove":
        return facts.withColumn("removable", F.lit(False))
    safe = removal_breaker(facts, cfg).where("candidates > 0 AND NOT tripped")
    per_block = spread_over_blocks(
        safe, F.lit(1), F.col("last_page"), cfg.block_pages
    ).select("bundle_id", "_block", F.lit(True).alias("_safe"))
    return (
        with_block(facts, cfg.block_pages)
        .join(per_block, ["bundle_id", "_block"], "left")
        .withColumn("removable", F.col("confirmed_empty") & F.coalesce("_safe", F.lit(False)))
        .drop("_block", "_safe")
    )


def page_states(facts: DataFrame, cfg: SplitConfig) -> DataFrame:
    """One row per page with its segment, the current type and the decision made.

    ``facts`` carries ``removable`` and is read twice, so it should be a table.
    """
    page, first = F.col("page_number"), F.col("is_first")
    scanned = prefix_scan(
        facts,
        ["bundle_id"],
        ["page_number"],
        page_block("page_number", cfg.block_pages),
        sums={"first_n": first.cast("int")},
        mins={
            "live_from": F.when(~F.col("removable"), page),
            "first_from": F.when(first, page),
        },
        lasts={
            "head": F.when(first, F.struct(page.alias("page"), F.col("document_type").alias("type")))
        },
    )
    # an unknown run opens at the first page kept before any first page
    unknown_seen = F.coalesce(
        F.col("live_from") < F.coalesce("first_from", F.lit(2**31 - 1)), F.lit(False)
    )
    known = F.col("first_n") > 0
    opens_unknown = ~known & unknown_seen & (page == F.col("live_from"))
    current = F.col("head.type")
    kind = (
        F.when(first, "first")
        .when(known & rules.has_affinity(F.col("affinities"), current), "phrase")
        .when(F.col("removable"), "removed")
        .otherwise("unmatched")
    )
    return scanned.select(
        "bundle_id", "page_number", "is_empty", "confirmed_empty", "affinities",
        (F.col("first_n") + unknown_seen.cast("int")).cast("int").alias("segment_id"),
        known.alias("known"),
        (first | opens_unknown).alias("is_start"),
        current.alias("current_type"),
        F.when(known, F.col("head.page")).when(unknown_seen, F.col("live_from"))
        .alias("start_page"),
        F.when(known, current).otherwise(F.lit(fixed.UNKNOWN_DOCUMENT_TYPE)).alias("segment_type"),
        F.when(first, F.col("confidence")).otherwise(F.lit(fixed.UNKNOWN_CONFIDENCE))
        .alias("start_confidence"),
        F.when(first, F.col("signals")).otherwise(F.array(F.lit(fixed.UNKNOWN_RUN_SIGNAL)))
        .alias("start_signals"),
        kind.alias("kind"),
        (F.col("by_verdict") if "by_verdict" in facts.columns else F.lit(False))
        .alias("by_verdict"),
    )


def no_verdicts(states: DataFrame) -> DataFrame:
    """The columns verdict-aware states have, empty."""
    from pagebundle.operators.verdicts import HINT_SCHEMA

    return states.withColumn("hint", F.lit(None).cast(HINT_SCHEMA))


def page_context(pages: DataFrame, cfg: SplitConfig, previous: int, following: int) -> DataFrame:
    """pages + the start of the neighbouring pages' texts ('' at the bundle's ends).

    Neighbours inside a block come from a window over (bundle, block); a block's outer
    neighbours are one row per block, joined on the same partitioning. Tenants that share
    bundle ids (``dict_id``) are not each other's neighbours.
    """
    names, pages = pages.columns, keyed(pages)
    size = cfg.block_pages
    block = page_block("page_number", size)
    ordered = Window.partitionBy("bundle_id", "_block").orderBy("page_number")
    page = F.col("page_number")
    edges = pages.where((page % size == 0) | (page % size == 1))
    last, first = page % size == 0, page % size == 1

    def edge(rows: Column, step: int, chars: int, name: str) -> DataFrame:
        shown = F.struct((page + step).alias("at"), F.substring("text", 1, chars).alias("text"))
        return edges.where(rows).select("bundle_id", (block + step).alias("_block"), shown.alias(name))

    outer = (
        edge(last, 1, previous, "before")
        .unionByName(edge(first, -1, following, "after"), allowMissingColumns=True)
        .groupBy("bundle_id", "_block")
        .agg(F.max("before").alias("_before"), F.max("after").alias("_after"))
    )

    def neighbour(step: int, chars: int, beyond: str) -> Column:
        move = F.lag if step < 0 else F.lead
        near = F.when(
            move("page_number").over(ordered) == page + step,
            F.substring(move("text").over(ordered), 1, chars),
        )
        far = F.when(F.col(beyond)["at"] == page, F.col(beyond)["text"])
        return F.coalesce(near, far, F.lit(""))

    found = (
        pages.withColumn("_block", block)
        .join(outer, ["bundle_id", "_block"], "left")
        .select(
            *pages.columns,
            neighbour(-1, previous, "_before").alias("previous_text"),
            neighbour(1, following, "_after").alias("next_text"),
        )
    )
    return unkeyed(found).select(*names, "previous_text", "next_text")


def decision_detail(states: DataFrame) -> Column:
    """Short human-readable note on what decided a page."""
    return (
        F.when(F.col("kind") == "first", F.concat_ws(", ", "start_signals"))
        .when(
            F.col("kind") == "phrase",
            F.concat_ws(", ", rules.matched_phrases(F.col("affinities"), F.col("current_type"))),
        )
        .otherwise(F.lit(""))
    )
