"""Named queries over the provided tables; each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagebundle import SplitConfig, fixed
from pagebundle.functions import text as tx
from pagebundle.operators import documents as dc
from pagebundle.operators import evaluation as ev
from pagebundle.operators import jobs as jb
from pagebundle.operators import metrics as mt
from pagebundle.operators import pageops as po
from pagebundle.operators import reads as rd
from pagebundle.operators import rules
from pagebundle.operators import segments as sg
from pagebundle.operators import verdicts as vd
from pagebundle.plans.split import Split, split_bundles
from pagebundle.sources import adapters as ad
from pagebundle.sources import attachments as at
from pagebundle.sources import dictionary as dic
from pagebundle.sources import sinks
from pagebundle.sources.pages import explode_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEEP = SplitConfig()
REPORT = SplitConfig(empty_page_mode="report")
REMOVE = SplitConfig(empty_page_mode="remove")
# low enough that some bundles have too many blank pages
STRICT = SplitConfig(empty_page_mode="remove", empty_page_max_share=0.12)
def now() -> Column:
    """The reporting time of the job queries."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


SEP = "|"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(col.cast("array<string>"), SEP)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return ad.document_pages(spark, sf)


def _scans(spark: SparkSession, sf: str, cfg: SplitConfig = KEEP):
    """Pages partly without text layer, their ink measure and recognised text."""
    pages = ad.blanked(_pages(spark, sf))
    ink = rd.ink_ratio(ad.gray_histogram(pages), cfg)
    return pages, ink, ad.recogniser_output(spark, sf, pages)


def _split(spark: SparkSession, sf: str) -> Split:
    return split_bundles(_pages(spark, sf), ad.trial_dictionary(spark), KEEP)


def _scan_split(spark: SparkSession, sf: str, cfg: SplitConfig, verdicts: bool = False) -> Split:
    pages, ink, ocr = _scans(spark, sf, cfg)
    replies = ad.responses(pages) if verdicts else None
    return split_bundles(pages, ad.trial_dictionary(spark), cfg, ink, ocr, replies)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    scored = rules.score_pages(_pages(spark, sf), ad.trial_dictionary(spark), KEEP)
    return scored.select("bundle_id", "page_number", F.inline("scored"))


# --- sources ------------------------------------------------------------------------------

@query
def scan_pages(spark, sf):
    return ad.conversation_pages(spark, sf)


@query
def explode_pages_(spark, sf):
    files = ad.table(spark, sf, "documents").select("doc_id", "text")
    return explode_pages(ad.balanced(files), "doc_id", "text", "\n")


QUERIES["explode_pages"] = QUERIES.pop("explode_pages_")


@query
def dictionary_load(spark, sf):
    patterns = dic.read_dictionary(ad.raw_dictionary(spark, sf), "row_no")
    return patterns.select(
        "pattern_idx", "document_type", "header", _joined("phrases").alias("phrases"),
        _joined("excluded_phrases").alias("excluded_phrases"), "weight",
    )


@query
def dictionary_join(spark, sf):
    k = F.col("p_partkey")
    types = ad.table(spark, sf, "part").select(
        k.alias("type_id"), F.col("p_name").alias("type_name"), F.col("p_type").alias("form"),
        (F.col("p_size") > 45).alias("deleted"), (F.col("p_retailprice") < 1500).alias("active"),
    )
    line = ad.table(spark, sf, "lineitem")
    rows = line.select(
        F.col("l_partkey").alias("type_id"), F.col("l_orderkey").alias("row_id"),
        F.col("l_linenumber").alias("row_no"), F.col("l_quantity").alias("weight"),
        (F.col("l_returnflag") != "R").alias("active"),
    )
    return dic.dictionary_join(types, rows, "ECONOMY").select(
        "type_id", "type_name", "row_id", "row_no", "weight"
    )


@query
def patterns_json(spark, sf):
    patterns, rejected = dic.parse_patterns(ad.pattern_payloads(spark, sf))
    accepted = patterns.select(
        F.col("dict_id").alias("payload_id"), "pattern_idx", "document_type", "header",
        _joined("phrases").alias("phrases"), "weight", F.lit(None).cast("string").alias("error"),
    )
    failed = rejected.select(
        "payload_id", F.lit(None).cast("int").alias("pattern_idx"),
        *[F.lit(None).cast("string").alias(c) for c in ("document_type", "header", "phrases")],
        F.lit(None).cast("double").alias("weight"), "error",
    )
    return accepted.unionByName(failed)


@query
def split_no_patterns(spark, sf):
    empty = dic.empty_dictionary(spark)
    return _document_columns(split_bundles(_pages(spark, sf), empty, KEEP).documents)


@query
def attachment_check(spark, sf):
    return at.single_pdf_per_element(ad.attachments(spark, sf))


@query
def attachment_by_id(spark, sf):
    o = F.col("o_orderkey")
    raw = (
        F.when(o % 7 == 0, "abc").when(o % 7 == 1, "-5").when(o % 7 == 2, None)
        .when(o % 7 == 3, F.concat(F.lit("9"), F.lpad(o.cast("string"), 8, "0")))
        .when(o % 7 == 4, F.concat(F.lit(" "), o.cast("string"), F.lit(" ")))
        .otherwise(o.cast("string"))
    )
    requests = ad.table(spark, sf, "orders").select(
        o.alias("request_id"),
        F.when(o % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
        .alias("element_id"),
        raw.alias("raw_id"),
    )
    return at.attachments_by_id(requests, ad.attachments(spark, sf))


@query
def file_name_clean(spark, sf):
    part = ad.table(spark, sf, "part")
    k = F.col("p_partkey")
    raw = F.concat(
        F.when(k % 3 == 0, "C:\\scans\\").when(k % 3 == 1, "/var/in/").otherwise(" "),
        F.col("p_name"),
        F.when(k % 4 == 0, ".PDF ").when(k % 4 == 1, ".pdf").when(k % 4 == 2, ".txt")
        .otherwise("\\"),
    )
    name = tx.clean_file_name(raw)
    return part.select(
        "p_partkey", name.alias("file_name"),
        F.when(~tx.is_pdf_name(name), fixed.ONLY_PDF_ERROR).alias("error"),
    )


# --- text ---------------------------------------------------------------------------------

@query
def normalize_text(spark, sf):
    return _pages(spark, sf).select(
        "bundle_id", "page_number", tx.normalize_text(F.col("text")).alias("norm")
    )


@query
def fold_digits(spark, sf):
    return ad.table(spark, sf, "orders").select(
        "o_orderkey",
        tx.fold_ocr_digits(F.concat_ws(" ", F.col("o_orderkey").cast("string"),
                                       "o_orderpriority")).alias("folded"),
    )


@query
def alnum_count(spark, sf):
    return _pages(spark, sf).select(
        "bundle_id", "page_number", tx.alnum_count(F.col("text")).alias("alnum")
    )


@query
def page_preview(spark, sf):
    return ad.table(spark, sf, "documents").select(
        "doc_id", tx.page_preview(F.col("text"), KEEP.raw_preview_chars).alias("preview")
    )


@query
def page_diagnostics(spark, sf):
    pages = ad.blanked(_pages(spark, sf))
    chars, text = tx.alnum_count(F.col("text")), F.col("text")
    filled = chars > 0
    return pages.select(
        "bundle_id", "page_number", chars.alias("alnum"), (~filled).alias("empty"),
        F.when(filled, tx.page_preview(text, KEEP.raw_preview_chars)).alias("raw"),
        F.when(filled, tx.page_preview(tx.normalize_text(text), KEEP.norm_preview_chars))
        .alias("norm"),
    )


@query
def document_file_name(spark, sf):
    kind = F.concat_ws("/", "p_name", "p_type", F.concat(F.lit("a:b\\"), F.col("p_brand")))
    end = (F.col("p_partkey") + F.col("p_size")).cast("int")
    return ad.table(spark, sf, "part").select(
        "p_partkey",
        tx.document_file_name(kind, F.col("p_size"), end).alias("file_name"),
    )


@query
def derive_name(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(
        F.col("p_name"),
        F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".PdF").otherwise(".pdf.txt"),
    )
    return ad.table(spark, sf, "part").select(
        "p_partkey",
        tx.derive_name(name, fixed.SUFFIX_REMOVED).alias("removed_name"),
        tx.derive_name(name, fixed.SUFFIX_EXTRACTED).alias("extracted_name"),
    )


# --- dictionary -----------------------------------------------------------------------------

def _part_patterns(spark, sf) -> DataFrame:
    patterns = dic.read_dictionary(ad.raw_dictionary(spark, sf), "row_no")
    return patterns.withColumn("active", F.col("pattern_idx") % 3 != 0)


@query
def active_patterns(spark, sf):
    return dic.active_patterns(_part_patterns(spark, sf)).select(
        "pattern_idx", "document_type", "header"
    )


@query
def phrase_list(spark, sf):
    return ad.raw_dictionary(spark, sf).select(
        "row_no", F.posexplode(dic.split_phrase_list(F.col("Phrases"))).alias("pos", "phrase")
    )


@query
def known_types(spark, sf):
    return dic.known_types(_part_patterns(spark, sf)).select("document_type")


# --- rules ------------------------------------------------------------------------------------

@query
def header_matches(spark, sf):
    return _scored(spark, sf).where("header_match").select(
        "bundle_id", "page_number", "pattern_idx"
    )


@query
def phrase_matches(spark, sf):
    return _scored(spark, sf).select(
        "bundle_id", "page_number", "pattern_idx",
        F.posexplode("matched").alias("pos", "phrase"),
    )


@query
def excluded_patterns(spark, sf):
    """Pattern hits an exclusion takes out, as a relational theta join."""
    patterns = dic.normalized_patterns(ad.trial_dictionary(spark))
    excluded = patterns.select("pattern_idx", F.explode("excluded").alias("phrase")).collect()
    norm = tx.normalize_text(F.col("text"))
    found = F.filter(
        F.array(*[
            F.when(F.contains(F.col("norm"), F.lit(r["phrase"])), F.lit(r["pattern_idx"]))
            for r in excluded
        ]),
        lambda i: i.isNotNull(),
    )
    return (
        _pages(spark, sf).select("bundle_id", "page_number", norm.alias("norm"))
        .select("bundle_id", "page_number", F.explode(F.array_distinct(found)).alias("pattern_idx"))
    )


@query
def rule_scores(spark, sf):
    return _scored(spark, sf).select("bundle_id", "page_number", "pattern_idx", "confidence")


@query
def rule_signals(spark, sf):
    signals = rules.pattern_signals(F.col("header_match"), F.col("header"), F.size("matched"))
    return _scored(spark, sf).select(
        "bundle_id", "page_number", "pattern_idx", _joined(signals).alias("signals")
    )


@query
def best_pattern(spark, sf):
    scored = rules.score_pages(_pages(spark, sf), ad.trial_dictionary(spark), KEEP)
    best = rules.best_pattern(F.col("scored"))
    return scored.select("bundle_id", "page_number", best.alias("b")).select(
        "bundle_id", "page_number", (-F.col("b.order_key")).alias("pattern_idx"),
        F.col("b.confidence").alias("confidence"),
    ).where("pattern_idx IS NOT NULL")


def _classification(pages, spark) -> DataFrame:
    return rules.classify_pages(pages, ad.trial_dictionary(spark), KEEP).select(
        "bundle_id", "page_number", "is_first", "document_type", "confidence",
        _joined("signals").alias("signals"),
    )


@query
def page_classification(spark, sf):
    return _classification(_pages(spark, sf), spark)


@query
def conversation_classification(spark, sf):
    return _classification(ad.conversation_pages(spark, sf), spark)


@query
def tenant_classification(spark, sf):
    """Every language is a tenant with a dictionary of its own (broadcast by dict_id)."""
    docs = ad.balanced(ad.table(spark, sf, "documents").select("doc_id", "text", "lang"))
    pages = explode_pages(docs, "doc_id", "text", "\n", keep=("lang",))
    langs = ("en", "fr", "de")
    shared = ad.trial_dictionary(spark)
    per_lang = reduce(
        DataFrame.unionByName,
        [shared.where(F.col("pattern_idx") >= i).withColumn("dict_id", F.lit(lang))
         for i, lang in enumerate(langs)],
    )
    return rules.classify_pages(
        pages.withColumnRenamed("lang", "dict_id"), per_lang, KEEP
    ).select("bundle_id", "page_number", "dict_id", "is_first", "document_type", "confidence")


@query
def tenant_classification_chunked(spark, sf):
    """Three tenants share every bundle id; the bounds force the dictionaries into chunks."""
    owner = F.explode(F.array(F.lit("en"), F.lit("fr"), F.lit("es"))).alias("dict_id")
    shared = ad.trial_dictionary(spark)
    per_lang = shared.withColumn("dict_id", F.lit("en")).unionByName(
        shared.where("pattern_idx >= 1").withColumn("dict_id", F.lit("fr"))
    )
    tiny = replace(KEEP, max_embedded_patterns=1)
    return rules.classify_pages(_pages(spark, sf).select("*", owner), per_lang, tiny).select(
        "bundle_id", "page_number", "dict_id", "is_first", "document_type", "confidence"
    )


@query
def split_tenants(spark, sf):
    """Two tenants share every bundle id; each has a dictionary of its own."""
    owner = F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("dict_id")
    shared = ad.trial_dictionary(spark)
    own = shared.withColumn("dict_id", F.lit("en")).unionByName(
        shared.where("pattern_idx >= 1").withColumn("dict_id", F.lit("fr"))
    )
    split = split_bundles(_pages(spark, sf).select("*", owner), own, KEEP).staged()
    return split.documents.drop("known")


@query
def phrase_affinities(spark, sf):
    pages = rules.classify_pages(_pages(spark, sf), ad.trial_dictionary(spark), KEEP)
    flat = pages.select("bundle_id", "page_number", "affinities").withColumn(
        "document_type", F.explode(rules.affinity_types(F.col("affinities")))
    )
    return flat.select(
        "bundle_id", "page_number", "document_type",
        _joined(rules.matched_phrases(F.col("affinities"), F.col("document_type")))
        .alias("phrases"),
    )


# --- text acquisition, blank pages ------------------------------------------------------------

@query
def ocr_candidates(spark, sf):
    return rd.ocr_candidates(ad.blanked(_pages(spark, sf)), KEEP).select("bundle_id", "page_number")


@query
def ink_ratio(spark, sf):
    return rd.ink_ratio(ad.gray_histogram(_pages(spark, sf)), KEEP)


@query
def blank_pages(spark, sf):
    pages, ink, _ = _scans(spark, sf)
    return rd.blank_flags(pages, ink, KEEP).select("bundle_id", "page_number", "blank")


@query
def ocr_merge(spark, sf):
    pages, ink, ocr = _scans(spark, sf)
    return rd.recognised(rd.blank_flags(pages, ink, KEEP), ocr).select(
        "bundle_id", "page_number", "filled", "text"
    )


@query
def ocr_summary(spark, sf):
    return rd.ocr_summary(*_scans(spark, sf), KEEP)


@query
def page_reads(spark, sf):
    pages, ink, ocr = _scans(spark, sf)
    return rd.page_reads(pages, ink, ocr, KEEP).select(
        "bundle_id", "page_number", "text", "blank"
    )


@query
def confirmed_empty(spark, sf):
    pages, ink, ocr = _scans(spark, sf)
    reads = rd.page_reads(pages, ink, ocr, KEEP)
    return reads.select(
        "bundle_id", "page_number",
        rd.confirmed_empty(F.col("text"), F.col("blank"), KEEP).alias("confirmed_empty"),
    )


def _raw_mode() -> Column:
    k = F.col("c_custkey")
    return (
        F.when(k % 5 == 0, " Remove ").when(k % 5 == 1, "REPORT").when(k % 5 == 2, "keep")
        .when(k % 5 == 3, None).otherwise(F.col("c_mktsegment"))
    )


@query
def empty_mode(spark, sf):
    return ad.table(spark, sf, "customer").select("c_custkey", rd.empty_mode(_raw_mode()).alias("mode"))


@query
def mode_warnings(spark, sf):
    return rd.mode_warnings(
        ad.table(spark, sf, "customer").select(
            F.col("c_custkey").alias("setting_id"), _raw_mode().alias("empty_page_mode"),
            (F.col("c_custkey") % 2 == 0).alias("ocr_enabled"),
        )
    )


def _scan_facts(spark, sf, cfg) -> DataFrame:
    pages, ink, ocr = _scans(spark, sf, cfg)
    reads = rd.page_reads(pages, ink, ocr, cfg)
    empty = rd.confirmed_empty(F.col("text"), F.col("blank"), cfg)
    return reads.select("bundle_id", "page_number", empty.alias("confirmed_empty"))


@query
def removal_breaker(spark, sf):
    return sg.removal_breaker(_scan_facts(spark, sf, STRICT), STRICT).select(
        "bundle_id", "candidates", "total", "tripped"
    )


@query
def removable_pages(spark, sf):
    facts = sg.with_removable(_scan_facts(spark, sf, STRICT), STRICT)
    return facts.where("removable").select("bundle_id", "page_number")


# --- segmentation -------------------------------------------------------------------------------

@query
def segment_starts(spark, sf):
    return _split(spark, sf).states.where("is_start").select("bundle_id", "page_number")


@query
def segments(spark, sf):
    return _split(spark, sf).states.select("bundle_id", "page_number", "segment_id")


@query
def current_type(spark, sf):
    return _split(spark, sf).states.select("bundle_id", "page_number", "current_type")


@query
def page_decisions(spark, sf):
    return dc.page_decisions(_scan_split(spark, sf, REMOVE).states)


@query
def unknown_runs(spark, sf):
    return _split(spark, sf).documents.where("NOT known").select(
        "bundle_id", "document_index", "start_page", "end_page"
    )


@query
def glued_pages(spark, sf):
    glued = _split(spark, sf).states.where("kind = 'unmatched' AND known")
    return glued.select("bundle_id", "page_number", F.col("segment_id").alias("document_index"))


def _document_columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        "bundle_id", "document_index", "document_type", "confidence", "requires_review",
        "start_page", "end_page", "output_file_name",
    )


@query
def split_documents(spark, sf):
    return _document_columns(_split(spark, sf).documents)


@query
def split_conversations(spark, sf):
    pages = ad.conversation_pages(spark, sf)
    return _document_columns(split_bundles(pages, ad.trial_dictionary(spark), KEEP).documents)


@query
def split_scans(spark, sf):
    return _document_columns(_scan_split(spark, sf, REMOVE).documents)


@query
def split_with_verdicts(spark, sf):
    return _document_columns(_scan_split(spark, sf, REMOVE, verdicts=True).documents)


@query
def page_context(spark, sf):
    return sg.page_context(_pages(spark, sf), KEEP, 2000, 2000).select(
        "bundle_id", "page_number", "previous_text", "next_text"
    )


# --- documents and bundles ------------------------------------------------------------------------

@query
def removed_pages(spark, sf):
    return _scan_split(spark, sf, REMOVE).staged().removed.select(
        "bundle_id", "document_index", "page_number"
    )


@query
def phrase_continuations(spark, sf):
    return dc.phrase_continuations(_split(spark, sf).states, KEEP).select(
        "bundle_id", "document_index", "page_number", "position", "signal"
    )


@query
def document_signals(spark, sf):
    return _split(spark, sf).staged().signals.select(
        "bundle_id", "document_index", "section", "page_number", "position", "signal"
    )


def _reasons(split: Split) -> DataFrame:
    return split.reasons.select("bundle_id", "document_index", "section", "page_number", "reason")


@query
def review_reasons(spark, sf):
    return _reasons(_split(spark, sf).staged())


@query
def review_reasons_with_verdicts(spark, sf):
    return _reasons(_scan_split(spark, sf, REMOVE, verdicts=True).staged())


@query
def bundle_warnings(spark, sf):
    return _scan_split(spark, sf, STRICT).staged().warnings


@query
def bundle_warnings_report(spark, sf):
    return _scan_split(spark, sf, REPORT).staged().warnings


@query
def bundle_status(spark, sf):
    return _split(spark, sf).staged().summary.select("bundle_id", "status")


@query
def bundle_summary(spark, sf):
    return _scan_split(spark, sf, REMOVE).staged().summary


#: records must not depend on where a bundle is cut
BLOCKS = replace(REMOVE, block_pages=4)


def _nested(split: Split) -> DataFrame:
    def each(of) -> Column:
        return F.array_join(F.transform("documents", of), SEP)

    return split.results.select(
        "bundle_id", "page_count", "document_count", "review_count", "status",
        F.size("documents").alias("documents"), each(lambda d: d["document_type"]).alias("types"),
        each(lambda d: F.array_join(d["signals"], ", ")).alias("signals"),
        each(lambda d: F.array_join(d["review_reasons"], "; ")).alias("reasons"),
        each(lambda d: F.array_join(d["removed_pages"].cast("array<string>"), ", ")).alias("removed"),
    )


@query
def split_result_nested(spark, sf):
    return _nested(_scan_split(spark, sf, REMOVE).staged())


@query
def split_result_nested_blocks(spark, sf):
    return _nested(_scan_split(spark, sf, BLOCKS).staged())


def _children(spark, sf, cfg: SplitConfig) -> DataFrame:
    split = _scan_split(spark, sf, cfg).staged()
    parents = ad.table(spark, sf, "documents").select(
        F.col("doc_id").alias("bundle_id"), F.col("doc_id").alias("parent_id"),
        F.col("source").alias("company_id"),
    )
    return dc.child_rows(split.records, parents, reasons_in_column=False)


@query
def child_rows(spark, sf):
    return _children(spark, sf, REMOVE)


@query
def child_rows_blocks(spark, sf):
    return _children(spark, sf, BLOCKS)


@query
def bundle_warnings_blocks(spark, sf):
    return _scan_split(spark, sf, replace(STRICT, block_pages=4)).staged().warnings


@query
def children_resume(spark, sf):
    split = _split(spark, sf).staged()
    marks = ad.table(spark, sf, "documents").where("lang <> 'de'").select(
        F.col("doc_id").alias("bundle_id"), (F.col("n_chars") % 4).cast("int").alias("last_created")
    )
    return sinks.pending_children(split.documents, marks).select(
        "bundle_id", "document_index", "document_type"
    )


# --- page operations --------------------------------------------------------------------------------

def _requests(spark, sf):
    pages = _pages(spark, sf)
    return pages, ad.page_requests(ad.page_counts(pages))


@query
def page_range(spark, sf):
    _, requests = _requests(spark, sf)
    parsed = po.parse_page_ranges(requests)
    spans = F.array_join(
        F.transform("intervals", lambda i: F.concat_ws("-", i["lo"].cast("string"),
                                                       i["hi"].cast("string"))), ","
    )
    return parsed.select(
        "request_id", "error", spans.alias("intervals"),
        po.selected_count(F.col("intervals")).alias("selected"),
    )


@query
def page_range_pages(spark, sf):
    return po.page_range(_requests(spark, sf)[1])


_EDITED = ("request_id", "bundle_id", "page_number", "new_page")


@query
def pages_remove(spark, sf):
    pages, requests = _requests(spark, sf)
    return po.remove_pages(pages, requests).select(*_EDITED, F.length("text").alias("chars"))


@query
def pages_extract(spark, sf):
    pages, requests = _requests(spark, sf)
    return po.extract_pages(pages, requests).select(*_EDITED, F.length("text").alias("chars"))


@query
def pages_merge(spark, sf):
    pages = _pages(spark, sf)
    counts = ad.page_counts(pages)
    return po.merge_bundles(pages, ad.merge_members(counts), counts).select(
        "output_id", "new_page", "bundle_id", "page_number", F.length("text").alias("chars")
    )


@query
def document_pages(spark, sf):
    pages = ad.blanked(_pages(spark, sf))
    split = _scan_split(spark, sf, REMOVE).staged()
    return po.document_pages(pages, split.documents, split.removed).select(
        "bundle_id", "document_index", "page_number", "new_page"
    )


@query
def document_content(spark, sf):
    split = _scan_split(spark, sf, REMOVE).staged()
    return po.document_content(_pages(spark, sf), split.documents, split.removed)


@query
def page_op_summary(spark, sf):
    pages, requests = _requests(spark, sf)
    names = requests.select(
        "request_id", F.concat(F.lit("scan"), F.col("bundle_id").cast("string"), F.lit(".PDF"))
        .alias("file_name"),
    )
    extracted = po.page_op_summary(
        po.extract_pages(pages, requests), names, F.lit(fixed.SUFFIX_EXTRACTED)
    )
    removed = po.page_op_summary(
        po.remove_pages(pages, requests), names, F.lit(fixed.SUFFIX_REMOVED)
    )
    return extracted.unionByName(removed)


@query
def pages_move(spark, sf):
    pages, requests = _requests(spark, sf)
    asked = requests.withColumn("remove_from_source", F.col("bundle_id") % 2 == 0)
    return po.move_pages(pages, asked).select(*_EDITED, "output")


@query
def pages_replace(spark, sf):
    pages, requests = _requests(spark, sf)
    asked = requests.withColumn("replace_in_place", F.col("bundle_id") % 2 == 0).withColumn(
        "category", F.concat(F.lit("c"), (F.col("bundle_id") % 3).cast("string"))
    )
    return po.replace_pages(pages, asked).select(*_EDITED, "output", "category")


@query
def bundle_validate(spark, sf):
    files = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("bundle_id"), (F.col("o_orderstatus") == "P").alias("encrypted"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("bad "), "o_orderstatus"))
        .alias("read_error"),
    )
    return po.validate_bundles(files).select("bundle_id", "status", "error")


# --- verdicts -----------------------------------------------------------------------------------------

def _replies(spark, sf) -> DataFrame:
    return ad.responses(_pages(spark, sf))


def _verdict_context(spark, sf) -> DataFrame:
    current = F.when(F.col("page_number") % 2 == 0, "Alpha")
    return vd.verdict_context(_pages(spark, sf), current, ad.trial_dictionary(spark), KEEP)


@query
def verdict_context(spark, sf):
    return _verdict_context(spark, sf)


@query
def prompt_render(spark, sf):
    template = "{{x}} [{typ_biezacego_dokumentu}] {aktualna_strona} <{poprzednia_strona}>"
    return _verdict_context(spark, sf).select(
        "bundle_id", "page_number", vd.render_prompt(template).alias("prompt")
    )


@query
def prompt_formats(spark, sf):
    """Widths, fills, cuts, a character and a quoted text; pages without the character get the default."""
    template = (
        "{typ_biezacego_dokumentu:*^9}|{aktualna_strona:>30.20}|{poprzednia_strona:05.3}|"
        "{nastepna_strona[1]}|{typ_biezacego_dokumentu!r}"
    )
    shown = vd.render_prompt(template, "brak {typ_biezacego_dokumentu}")
    return _verdict_context(spark, sf).select("bundle_id", "page_number", shown.alias("prompt"))


@query
def verdict_extract(spark, sf):
    return _replies(spark, sf).select(
        "bundle_id", "page_number", "current_type", vd.extract_json(F.col("content")).alias("json")
    )


@query
def verdict_parse(spark, sf):
    v = F.col("v")
    return (
        _replies(spark, sf).withColumn("v", vd.parse_verdict(F.col("content")))
        .select(
            "bundle_id", "page_number", "current_type", v.isNotNull().alias("usable"),
            v["isFirstPage"].alias("is_first"), v["documentType"].alias("document_type"),
            v["isKnownType"].alias("is_known"), v["confidence"].alias("confidence"),
            _joined(v["reasonCodes"]).alias("codes"),
            _joined(v["suggestedNewPatterns"]).alias("suggested"),
        )
    )


@query
def verdict_confidence(spark, sf):
    line = ad.table(spark, sf, "lineitem")
    raw = F.col("l_quantity") * 3 - 5 + F.col("l_discount")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        vd.normalize_confidence(raw).alias("confidence"),
    )


@query
def verdict_guard(spark, sf):
    judged = vd.judged_verdicts(_replies(spark, sf), ad.trial_dictionary(spark), KEEP)
    return judged.where("hint.verdict IS NOT NULL").select(
        "bundle_id", "page_number", "current_type", _joined("hint.guard").alias("guard")
    )


@query
def verdict_guard_tenants(spark, sf):
    """Every reply is asked for two tenants; a type of one is not known to the other."""
    owners = F.explode(F.array(F.lit("t0"), F.lit("t2"))).alias("dict_id")
    patterns = ad.trial_dictionary(spark)
    per_tenant = patterns.withColumn("dict_id", F.lit("t0")).unionByName(
        patterns.where(~F.col("document_type").isin("Alpha", "Delta")).withColumn("dict_id", F.lit("t2"))
    )
    judged = vd.judged_verdicts(_replies(spark, sf).select("*", owners), per_tenant, KEEP)
    return judged.where("hint.verdict IS NOT NULL").select(
        "bundle_id", "page_number", "current_type", "dict_id", _joined("hint.guard").alias("guard")
    )


@query
def verdict_gate(spark, sf):
    judged = vd.judged_verdicts(_replies(spark, sf), ad.trial_dictionary(spark), KEEP)
    return judged.select(
        "bundle_id", "page_number", "current_type", F.col("hint.accepted").alias("accepted")
    )


@query
def pending_verdicts(spark, sf):
    """With replies stored only where the current type is known so far."""
    pages, ink, ocr = _scans(spark, sf, REMOVE)
    stored = ad.responses(pages).where("current_type <> ''")
    split = split_bundles(pages, ad.trial_dictionary(spark), REMOVE, ink, ocr, stored)
    return vd.pending_verdicts(split.states)


@query
def pending_prompts(spark, sf):
    """Both prompts of every page that waits for a reply, from the texts after recognition."""
    pages, ink, ocr = _scans(spark, sf, REMOVE)
    stored = ad.responses(pages).where("current_type <> ''")
    split = split_bundles(pages, ad.trial_dictionary(spark), REMOVE, ink, ocr, stored)
    return vd.pending_prompts(
        rd.page_reads(pages, ink, ocr, REMOVE), split.states, ad.trial_dictionary(spark), REMOVE,
        "[{typ_biezacego_dokumentu}] {poprzednia_strona}|{aktualna_strona}|{nastepna_strona}",
        "Typy: {znane_typy}",
    )


@query
def eval_cases(spark, sf):
    return _evaluated(spark, sf).select(
        "id", "pass", "seconds", "error", _joined("mismatches").alias("mismatches"),
        _joined("guard").alias("guard"),
    )


@query
def eval_summary(spark, sf):
    return ev.eval_summary(_evaluated(spark, sf))


def _evaluated(spark, sf) -> DataFrame:
    """Every page with a stored reply under its type is a case with an expected answer."""
    key = F.concat_ws("-", F.col("bundle_id").cast("string"), F.col("page_number").cast("string"),
                      "current_type").alias("id")
    replies = _replies(spark, sf)
    p = F.col("page_number")
    cases = replies.select(
        key,
        F.struct(
            (p % 2 == 0).alias("isFirstPage"),
            F.when(p % 3 == 0, "Alpha").when(p % 3 == 1, "O'Beta").alias("documentType"),
            F.when(p % 4 != 0, p % 8 < 4).alias("isKnownType"),
        ).alias("expected"),
    )
    judged = vd.judged_verdicts(replies, ad.trial_dictionary(spark), KEEP)
    got = judged.select(
        key, F.col("hint.verdict").alias("verdict"), F.col("hint.guard").alias("guard"),
        (p % 50 / 10.0).alias("seconds"),
        F.when(F.col("hint.verdict").isNull(), "unusable reply").alias("error"),
    )
    return ev.evaluate_verdicts(cases, got)


# --- jobs ------------------------------------------------------------------------------------------------

def _log(spark, sf) -> DataFrame:
    return jb.job_log(ad.job_events(spark, sf))


def _jobs(spark, sf) -> DataFrame:
    return jb.job_state(_log(spark, sf))


@query
def job_state(spark, sf):
    return _jobs(spark, sf)


@query
def dedup_submissions(spark, sf):
    return jb.dedup_submissions(_log(spark, sf))


@query
def queue_position(spark, sf):
    return jb.queue_position(_jobs(spark, sf)).select("job_id", "status", "position")


@query
def queue_stats(spark, sf):
    return jb.queue_stats(_jobs(spark, sf), now())


@query
def expired_jobs(spark, sf):
    return jb.expired_jobs(_jobs(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"), 86_400).select(
        "job_id", "status"
    )


def _job_results(spark, sf, jobs) -> DataFrame:
    split = split_bundles(ad.conversation_pages(spark, sf), ad.trial_dictionary(spark), KEEP)
    return jobs.select("job_id", F.col("element_id").alias("bundle_id")).join(
        split.staged().summary, "bundle_id"
    )


def _job_status(spark, sf) -> DataFrame:
    jobs = _jobs(spark, sf)
    return jb.job_status(jobs, _job_results(spark, sf, jobs), now())


@query
def job_status(spark, sf):
    return _job_status(spark, sf)


@query
def result_readiness(spark, sf):
    lookups = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("lookup_id"), F.col("event_id").alias("job_id")
    )
    return jb.result_readiness(lookups, _jobs(spark, sf))


@query
def backlog_depth(spark, sf):
    return jb.backlog_depth(_log(spark, sf), KEEP.max_queue_size)


def _attempts(spark, sf) -> DataFrame:
    return jb.attempts_outcome(ad.job_events(spark, sf, signup="enter"), KEEP.max_attempts)


@query
def attempts_outcome(spark, sf):
    return _attempts(spark, sf)


@query
def stalled_elements(spark, sf):
    return jb.stalled_elements(_attempts(spark, sf), now(), 3600)


@query
def status_text(spark, sf):
    latest = _attempts(spark, sf).groupBy("element_id").agg(
        F.max(F.struct("epoch", "attempts"))["attempts"].alias("attempts")
    )
    return jb.status_text(_job_status(spark, sf), latest, KEEP.max_attempts)


@query
def poll_text(spark, sf):
    """Every event as a poll that found its job in some state, also lost or not to be asked."""
    states = F.array(*[F.lit(x) for x in ("lost", "busy", "unreachable", "timeout", "failed", "odd")])
    polls = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("element_id"),
        F.get(states, (F.col("event_id") % 6).cast("int")).alias("status"),
        F.lit(0).alias("position"), F.lit(0.0).alias("running_seconds"),
        F.lit(0).alias("document_count"), F.lit(0).alias("review_count"), F.lit("zly plik").alias("error"),
    )
    tries = ad.table(spark, sf, "events").groupBy(F.col("user_id").alias("element_id")).agg(
        (F.count("*") % 5).alias("attempts")
    )
    return jb.status_text(polls, tries, KEEP.max_attempts)


def _metrics(spark, sf) -> DataFrame:
    pages, ink, ocr = _scans(spark, sf, REMOVE)
    split = split_bundles(
        pages, ad.trial_dictionary(spark), REMOVE, ink, ocr, ad.responses(pages)
    ).staged()
    durations = ad.table(spark, sf, "documents").select(
        F.col("doc_id").alias("bundle_id"), (F.col("n_chars") / 8.0).alias("duration_seconds")
    )
    filled = rd.ocr_summary(pages, ink, ocr, REMOVE).select("bundle_id", "filled_pages")
    return mt.job_metrics(split.states, split.documents, filled, durations)


@query
def job_metrics(spark, sf):
    return _metrics(spark, sf)


@query
def metrics_snapshot(spark, sf):
    return mt.metrics_snapshot(_metrics(spark, sf))


@query
def metrics_running(spark, sf):
    return mt.metrics_running(_metrics(spark, sf), "bundle_id", 1_000_000)
