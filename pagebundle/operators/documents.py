"""Documents, their reasons and signals, and bundle-level results.

Lists that can grow with a bundle (signals, reasons, warnings, removed pages) are
kept as ordered rows. Where the result is one nested record or one text, it is
built by blocks of pages and concatenated (operators.tree): one row per document
or bundle at every size, the same whatever ``block_pages`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.config import SplitConfig
from pagebundle.functions import text as tx
from pagebundle.operators import rules
from pagebundle.operators import segments as sg
from pagebundle.operators.scan import join_ranges, page_block
from pagebundle.operators.tree import SECTION, concatenated, sorted_values

DOC = ["bundle_id", "document_index"]


def _part(page: Column, start: Column, cfg: SplitConfig) -> Column:
    return F.floor((page - start) / F.lit(cfg.block_pages)).cast("int")


def documents(states: DataFrame, cfg: SplitConfig) -> DataFrame:
    """One row per document. All grouping values come with the page, so only
    fixed-width values are aggregated, before and after the single shuffle."""
    page = F.col("page_number")
    grouped = (
        states.where("segment_id > 0")
        .groupBy("bundle_id", "segment_id", "start_page", "segment_type", "known")
        .agg(
            F.max(F.when(F.col("kind") != "removed", page)).alias("end_page"),
            F.max(F.when(F.col("is_start"), F.col("start_confidence"))).alias("confidence"),
            F.max((F.col("kind") == "unmatched") & F.col("known")).alias("forced"),
        )
    )
    review = F.col("forced") | (F.col("confidence") < cfg.min_auto_accept_confidence)
    return grouped.select(
        "bundle_id",
        F.col("segment_id").alias("document_index"),
        F.col("segment_type").alias("document_type"),
        "confidence",
        review.alias("requires_review"),
        "start_page",
        "end_page",
        tx.document_file_name(
            F.col("segment_type"), F.col("start_page"), F.col("end_page")
        ).alias("output_file_name"),
        "known",
    )


def removed_pages(states: DataFrame, docs: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Removed pages lying inside a document (those trailing one belong to none)."""
    removed = states.where("kind = 'removed'").select("bundle_id", "page_number")
    return join_ranges(
        removed, docs.select(*DOC, "start_page", "end_page"), cfg.block_pages
    ).select(*DOC, "page_number", "start_page")


def phrase_continuations(states: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Phrase -> the pages it attached, per document."""
    hits = states.where("kind = 'phrase'").select(
        "bundle_id", F.col("segment_id").alias("document_index"), "page_number", "start_page",
        _part(F.col("page_number"), F.col("start_page"), cfg).alias("part"),
        F.posexplode(
            rules.matched_phrases(F.col("affinities"), F.col("current_type"))
        ).alias("pos", "phrase"),
    )
    key = [*DOC, "start_page", "phrase"]
    blocks = hits.groupBy(*key, F.col("part").cast("long").alias("part")).agg(
        F.array_sort(F.collect_list("page_number")).alias("pages"),
        F.min(F.struct("page_number", "pos")).alias("at"),
    )
    return concatenated(blocks, key, "part", ["pages"], mins=("at",)).select(
        *DOC, "start_page", "phrase", "pages",
        F.col("at.page_number").alias("page_number"), F.col("at.pos").alias("position"),
        F.format_string(
            fixed.CONTINUATION_SIGNAL + "%s(%s)", "phrase",
            F.array_join(F.col("pages").cast("array<string>"), ","),
        ).alias("signal"),
    )


def document_signals(states: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Ordered signal rows: start-page signals, glued pages, phrase continuations."""
    base = states.withColumnRenamed("segment_id", "document_index")
    start = base.where("is_start").select(
        *DOC, "start_page", F.lit(0).alias("section"), "page_number",
        F.posexplode("start_signals").alias("position", "signal"),
    )
    glued = base.where("kind = 'unmatched' AND known").select(
        *DOC, "start_page", F.lit(1).alias("section"), "page_number", F.lit(0).alias("position"),
        F.concat(F.lit(fixed.GLUED_SIGNAL), F.col("page_number").cast("string")).alias("signal"),
    )
    phrases = phrase_continuations(states, cfg).select(
        *DOC, "start_page", F.lit(2).alias("section"), "page_number", "position", "signal"
    )
    return start.unionByName(glued).unionByName(phrases)


def unmatched_details(affinities: Column, hint: Column) -> Column:
    """Which types' phrases a page hit and what the model suggested about it."""
    quoted = lambda names: F.array_join(
        F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "
    )
    types = rules.affinity_types(affinities)
    phrases = F.when(
        F.size(types) > 0, F.concat(F.lit(fixed.DETAIL_AFFINITIES), quoted(types))
    ).otherwise(F.lit(fixed.DETAIL_NO_AFFINITY))
    verdict, guard = hint["verdict"], hint["guard"]
    kind = F.when(verdict["isKnownType"], fixed.DETAIL_KNOWN_KIND).otherwise(
        fixed.DETAIL_NEW_KIND
    )
    proposal = (
        F.when(
            verdict["documentType"] != "",
            F.format_string(
                fixed.DETAIL_PROPOSAL, kind, verdict["documentType"],
                tx.two_decimals(verdict["confidence"]),
            ),
        )
        .when(verdict["isFirstPage"], fixed.DETAIL_PROBABLE_START)
        .otherwise(fixed.DETAIL_UNDETERMINED)
    )
    shown = F.slice(verdict["suggestedNewPatterns"], 1, fixed.SUGGESTED_PHRASES_SHOWN)
    suggested = F.when(
        F.size(shown) > 0, F.concat(F.lit(fixed.DETAIL_SUGGESTED), quoted(shown))
    ).otherwise("")
    rejected = F.when(
        F.size(guard) > 0, F.format_string(fixed.DETAIL_REJECTED, F.array_join(guard, "; "))
    ).otherwise("")
    opinion = F.when(verdict.isNull(), fixed.DETAIL_NO_VERDICT).otherwise(
        F.concat(rejected, proposal, suggested)
    )
    return F.concat_ws("; ", phrases, opinion)


def review_reasons(states: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Ordered reason rows of documents that need review; decided page by page."""
    threshold = cfg.min_auto_accept_confidence
    base = states.withColumnRenamed("segment_id", "document_index")
    low = F.col("start_confidence") < threshold
    starts = base.where(F.col("is_start") & low).select(*DOC, "start_page", "page_number",
                                                        "known", "start_confidence")
    headline = starts.where("NOT known").select(
        *DOC, "start_page", F.lit(0).alias("section"), "page_number",
        F.lit(fixed.REASON_UNKNOWN_TYPE).alias("reason"),
    )
    page = F.col("page_number")
    detail = unmatched_details(F.col("affinities"), F.col("hint"))
    wording = (
        F.when(F.col("is_empty"), F.format_string(fixed.REASON_EMPTY_PAGE, page))
        .when(F.col("known"), F.format_string(fixed.REASON_GLUED_PAGE, page, detail))
        .otherwise(F.format_string(fixed.REASON_UNKNOWN_PAGE, page, detail))
    )
    # a glued page forces review; an unknown document needs it below the threshold
    in_review = F.col("known") | F.lit(fixed.UNKNOWN_CONFIDENCE < threshold)
    pages = base.where((F.col("kind") == "unmatched") & in_review).select(
        *DOC, "start_page", F.lit(1).alias("section"), "page_number", wording.alias("reason")
    )
    lowest = starts.select(
        *DOC, "start_page", F.lit(2).alias("section"), "page_number",
        F.format_string(
            fixed.REASON_LOW_CONFIDENCE, tx.two_decimals(F.col("start_confidence")),
            F.lit(f"{threshold:.2f}"),
        ).alias("reason"),
    )
    return headline.unionByName(pages).unionByName(lowest)


def _listed(pages: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Per bundle its pages as a sorted list, their number and the first of them."""
    blocks = pages.groupBy("bundle_id", page_block("page_number", cfg.block_pages).cast("long").alias("part")).agg(
        F.array_sort(F.collect_list("page_number")).alias("pages"), F.count(F.lit(1)).alias("n"),
        F.min("page_number").alias("page_number"),
    )
    whole = concatenated(blocks, ["bundle_id"], "part", ["pages"], sums=("n",), mins=("page_number",))
    return whole.withColumn("listed", F.array_join(F.col("pages").cast("array<string>"), ", "))


def bundle_warnings(states: DataFrame, docs: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Ordered warning rows per bundle."""
    unknown = docs.where("NOT known").select(
        "bundle_id", F.lit(0).alias("section"), F.col("start_page").alias("page_number"),
        F.format_string(fixed.WARN_UNKNOWN_RANGE, "start_page", "end_page").alias("warning"),
    )
    glued = states.where("kind = 'unmatched' AND known").select(
        "bundle_id", F.lit(0).alias("section"), "page_number",
        F.format_string(fixed.WARN_GLUED, "page_number", "segment_type").alias("warning"),
    )
    result = unknown.unionByName(glued)
    if cfg.empty_mode == "keep":
        return result
    totals = sg.removal_breaker(states, cfg)

    def summary(pages: DataFrame, section: int, template: str) -> DataFrame:
        return (
            _listed(pages, cfg).join(totals.select("bundle_id", "total"), "bundle_id")
            .select(
                "bundle_id", F.lit(section).alias("section"), "page_number",
                F.format_string(template, "n", "listed", "total").alias("warning"),
            )
        )

    if cfg.empty_mode == "report":
        return result.unionByName(
            summary(states.where("confirmed_empty"), 2, fixed.WARN_REPORT)
        )
    breaker = totals.where("tripped").select(
        "bundle_id", F.lit(3).alias("section"), F.col("last_page").alias("page_number"),
        F.format_string(fixed.WARN_BREAKER, "candidates", "total").alias("warning"),
    )
    removed = summary(states.where("kind = 'removed'"), 1, fixed.WARN_REMOVED)
    return result.unionByName(removed).unionByName(breaker)


def bundle_summary(states: DataFrame, docs: DataFrame) -> DataFrame:
    pages = states.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("page_count"))
    counted = docs.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if("requires_review").alias("review_count"),
    )
    zero = F.lit(0).cast("long")
    return pages.join(counted, "bundle_id", "left").select(
        "bundle_id", "page_count",
        F.coalesce("document_count", zero).alias("document_count"),
        F.coalesce("review_count", zero).alias("review_count"),
        F.when(F.coalesce("review_count", zero) > 0, fixed.STATUS_REVIEW)
        .otherwise(fixed.STATUS_COMPLETED).alias("status"),
    )


def document_records(
    docs: DataFrame, signals: DataFrame, reasons: DataFrame, removed: DataFrame, cfg: SplitConfig
) -> DataFrame:
    """Documents with their signals, review reasons and removed pages as arrays, one row each."""
    part = _part(F.col("page_number"), F.col("start_page"), cfg).cast("long")

    def entries(df: DataFrame, kind: str, value: str, position: Column) -> DataFrame:
        section = F.col("section") if "section" in df.columns else F.lit(0)
        return df.select(
            *DOC, (section.cast("long") * SECTION + part).alias("part"), F.lit(kind).alias("entry"),
            F.struct("page_number", position.alias("position"), F.col(value).cast("string").alias("value")).alias("item"),
        )

    tall = (
        entries(signals, "signal", "signal", F.col("position"))
        .unionByName(entries(reasons, "reason", "reason", F.lit(0)))
        .unionByName(entries(removed, "removed", "page_number", F.lit(0)))
    )
    kinds = {"signals": "signal", "review_reasons": "reason", "removed_pages": "removed"}
    blocks = tall.groupBy(*DOC, "part").agg(
        *[sorted_values(F.col("item"), "value", F.col("entry") == kind).alias(name) for name, kind in kinds.items()]
    )
    lists = concatenated(blocks, DOC, "part", list(kinds))
    none = F.array().cast("array<string>")
    return docs.join(lists, DOC, "left").withColumns(
        {name: F.coalesce(name, none).cast("array<int>" if name == "removed_pages" else "array<string>") for name in kinds}
    )


def split_results(records: DataFrame, summary: DataFrame, cfg: SplitConfig) -> DataFrame:
    """One nested record per bundle, documents in order."""
    item = F.struct(
        "document_index", "document_type", "confidence", "requires_review", "review_reasons",
        "start_page", "end_page", "output_file_name", "signals", "removed_pages",
    )
    blocks = records.groupBy(
        "bundle_id", page_block("start_page", cfg.block_pages).cast("long").alias("part")
    ).agg(F.array_sort(F.collect_list(item)).alias("documents"))
    whole = concatenated(blocks, ["bundle_id"], "part", ["documents"])
    return summary.join(whole, "bundle_id", "left")


def child_rows(
    records: DataFrame, parents: DataFrame, reasons_in_column: bool
) -> DataFrame:
    """Rows for child records, one per document; they inherit company and parent from the bundle.

    parents: bundle_id, parent_id, company_id.
    """
    def appended(prefix: str, items: Column, separator: str) -> Column:
        return F.when(
            F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, separator))
        ).otherwise("")

    comment = F.concat(
        F.format_string(
            fixed.COMMENT_HEAD, "document_type", "start_page", "end_page", "confidence",
            F.initcap(F.col("requires_review").cast("string")),
        ),
        appended(fixed.COMMENT_REMOVED, F.col("removed_pages").cast("array<string>"), ", "),
        appended(fixed.COMMENT_SIGNALS, F.col("signals"), ", "),
        F.lit("") if reasons_in_column
        else appended(fixed.COMMENT_REASONS, F.col("review_reasons"), "; "),
    )
    return records.join(parents, "bundle_id").select(
        *DOC, "parent_id", "company_id", "document_type", "requires_review",
        "output_file_name",
        F.array_join("review_reasons", "\n").alias("review_reasons_text"),
        comment.alias("comment"),
    )


def page_decisions(states: DataFrame) -> DataFrame:
    """The decision log: one row per page."""
    return states.select(
        "bundle_id", "page_number", F.col("kind").alias("decision"), "segment_id",
        F.coalesce("current_type", F.lit("")).alias("current_type"), "is_empty",
        sg.decision_detail(states).alias("detail"),
    )
