"""Page-range edits over many requests at once.

A request's range text becomes a short list of disjoint page intervals. Whether a
page is selected and which number it gets in the output follow from the intervals
alone, so edits neither sort nor count pages; pages and requests meet on
(bundle, page block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.functions.bind import bind
from pagebundle.functions.text import strip
from pagebundle.operators.scan import join_ranges, page_block, prefix_scan
from pagebundle.operators.tree import concatenated, sorted_values
from pagebundle.staging import stage

_INTEGER = r"^[+-]?\d+(_\d+)*$"
_INTERVALS = "array<struct<lo:long,hi:long>>"


def _integer(text: Column) -> Column:
    """Lenient integer parsing, exact at any length; null if it is none.

    ``order`` sorts like the number: signed digit count, then the digits (inverted for
    negative numbers); ``shown`` is the number written out; ``value`` fits its range or
    is null, for numbers that can lie in no bundle.
    """
    stripped = strip(text)
    negative = stripped.startswith("-")
    digits = F.regexp_replace(F.regexp_replace(stripped, "[+_-]", ""), "^0+(?=.)", "")

    def built(d: Column) -> Column:
        minus = negative & (d != "0")
        return F.struct(
            F.struct(
                F.when(minus, -F.length(d)).otherwise(F.length(d)).alias("size"),
                F.when(minus, F.translate(d, "0123456789", "9876543210")).otherwise(d).alias("digits"),
            ).alias("order"),
            F.concat(F.when(minus, "-").otherwise(""), d).alias("shown"),
            F.when(F.length(d) <= 18, F.concat(F.when(minus, "-").otherwise(""), d).try_cast("long")).alias("value"),
        )

    return F.when(stripped.rlike(_INTEGER), bind(digits, built))


def _token(token: Column) -> Column:
    """One token -> bounds and the error it causes, if any."""
    ranged = F.contains(token, F.lit("-"))
    dash = F.instr(token, "-")
    left = F.when(ranged, F.substring(token, F.lit(1), dash - 1)).otherwise(token)
    right = F.when(ranged, F.substring(token, dash + 1, F.length(token))).otherwise(token)

    def judged(t: Column) -> Column:
        bad = t["lo"].isNull() | t["hi"].isNull()
        error = (
            F.when(bad & ranged, F.format_string(fixed.RANGE_BAD_FRAGMENT, token))
            .when(bad, F.format_string(fixed.RANGE_BAD_NUMBER, token))
            .when(t["lo"]["order"] > t["hi"]["order"], F.format_string(fixed.RANGE_REVERSED, token))
        )
        return F.struct(t["lo"].alias("lo"), t["hi"].alias("hi"), error.alias("error"))

    return bind(F.struct(_integer(left).alias("lo"), _integer(right).alias("hi")), judged)


def _merged(intervals: Column) -> Column:
    """Sorted intervals joined where they touch or overlap."""

    def step(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], i["hi"]).alias("hi"))),
        )
        fits = (F.size(acc) > 0) & (i["lo"] <= F.try_element_at(acc, F.lit(-1))["hi"] + 1)
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(i)))

    return F.aggregate(F.array_sort(intervals), F.array().cast(_INTERVALS), step)


def parse_page_ranges(requests: DataFrame) -> DataFrame:
    """requests (spec, page_count) + intervals and error (exactly one is null)."""
    count = F.col("page_count").cast("long")
    beyond = _integer((count + 1).cast("string"))

    def inside(n: Column) -> Column:
        return F.coalesce(n["value"].between(1, count), F.lit(False))

    def outside(i: Column) -> Column:
        return F.when(~inside(i["lo"]), i["lo"]).when(~inside(i["hi"]), beyond)

    def judged(t: Column) -> Column:
        faulty = F.filter(t, lambda i: i["error"].isNotNull())
        # the smallest selected page out of bounds is reported
        first_outside = F.array_min(F.array_compact(F.transform(t, outside)))
        return (
            F.when(F.size(t) == 0, fixed.RANGE_EMPTY)
            .when(F.size(faulty) > 0, F.try_element_at(faulty, F.lit(1))["error"])
            .when(
                first_outside.isNotNull(),
                F.format_string(fixed.RANGE_OUTSIDE, first_outside["shown"], count),
            )
        )

    def parsed(t: Column) -> Column:
        bounds = F.transform(t, lambda i: F.struct(i["lo"]["value"].alias("lo"), i["hi"]["value"].alias("hi")))
        return bind(
            judged(t),
            lambda e: F.struct(
                e.alias("error"), F.when(e.isNull(), _merged(bounds)).alias("intervals")
            ),
        )

    texts = F.filter(F.transform(F.split("spec", ","), strip), lambda t: t != "")
    tokens = F.transform(F.coalesce(texts, F.array()), _token)
    return requests.withColumn("_parsed", bind(tokens, parsed)).select(
        *requests.columns, "_parsed.error", "_parsed.intervals"
    )


def selected_count(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda n, i: n + i["hi"] - i["lo"] + 1)


def _selected_up_to(intervals: Column, page: Column) -> Column:
    """How many selected pages are at or before ``page``."""
    return F.aggregate(
        intervals,
        F.lit(0).cast("long"),
        lambda n, i: n + F.greatest(F.lit(0), F.least(i["hi"], page) - i["lo"] + 1),
    )


def _is_selected(intervals: Column, page: Column) -> Column:
    return F.exists(intervals, lambda i: page.between(i["lo"], i["hi"]))


def page_range(requests: DataFrame) -> DataFrame:
    """The selected pages of every valid request as rows (bounds already checked)."""
    spans = parse_page_ranges(requests).where("error IS NULL").select(
        "request_id", F.inline("intervals")
    )
    return spans.select("request_id", F.explode(F.sequence("lo", "hi")).alias("page_number"))


def remove_requests(requests: DataFrame) -> DataFrame:
    """Parsed requests; selecting every page is an error for removal."""
    whole = F.col("error").isNull() & (selected_count(F.col("intervals")) >= F.col("page_count"))
    parsed = parse_page_ranges(requests)
    return parsed.withColumn(
        "error", F.when(whole, fixed.REMOVE_ALL_ERROR).otherwise(F.col("error"))
    )


def _with_requests(pages: DataFrame, parsed: DataFrame, size: int) -> DataFrame:
    ranged = parsed.where("error IS NULL").select(
        "request_id", "bundle_id", "intervals",
        F.lit(1).alias("start_page"), F.col("page_count").alias("end_page"),
    )
    return join_ranges(pages, ranged, size)


def remove_pages(pages: DataFrame, requests: DataFrame, size: int = 4096) -> DataFrame:
    """Remaining pages per valid request, renumbered."""
    page = F.col("page_number")
    return (
        _with_requests(pages, remove_requests(requests), size)
        .where(~_is_selected(F.col("intervals"), page))
        .withColumn(
            "new_page", (page - _selected_up_to(F.col("intervals"), page)).cast("int")
        )
        .drop("intervals", "start_page", "end_page")
    )


def extract_pages(pages: DataFrame, requests: DataFrame, size: int = 4096) -> DataFrame:
    """Selected pages per valid request, renumbered in page order."""
    page = F.col("page_number")
    parsed = parse_page_ranges(requests).where("error IS NULL")
    spans = parsed.select(
        "request_id", "bundle_id", "intervals", F.inline("intervals").alias("start_page", "end_page")
    )
    return (
        join_ranges(pages, spans, size)
        .withColumn("new_page", _selected_up_to(F.col("intervals"), page).cast("int"))
        .drop("intervals", "start_page", "end_page")
    )


def merge_bundles(
    pages: DataFrame, members: DataFrame, page_counts: DataFrame, size: int = 4096
) -> DataFrame:
    """Member bundles (output_id, member_order, bundle_id) one after another.

    page_counts: bundle_id, page_count. Offsets are running sums over members.
    """
    counted = members.join(page_counts.select("bundle_id", "page_count"), "bundle_id")
    placed = prefix_scan(
        counted,
        ["output_id"],
        ["member_order"],
        page_block("member_order", size),
        sums={"through": F.col("page_count")},
    )
    ranged = placed.select(
        "bundle_id", "output_id", "member_order",
        (F.col("through") - F.col("page_count")).alias("offset"),
        F.lit(1).alias("start_page"), F.col("page_count").alias("end_page"),
    )
    return (
        join_ranges(pages, ranged, size)
        .withColumn("new_page", (F.col("offset") + F.col("page_number")).cast("int"))
        .drop("offset", "start_page", "end_page")
    )


def merge_summary(outputs: DataFrame, members: DataFrame, page_counts: DataFrame) -> DataFrame:
    """outputs (output_id, output_file_name nullable) -> name, page count or error."""
    totals = (
        members.join(page_counts, "bundle_id").groupBy("output_id")
        .agg(F.sum("page_count").alias("page_count"))
    )
    return outputs.join(totals, "output_id", "left").select(
        "output_id",
        F.coalesce("output_file_name", F.lit(fixed.MERGED_NAME)).alias("output_file_name"),
        F.coalesce("page_count", F.lit(0).cast("long")).alias("page_count"),
        F.when(F.col("page_count").isNull(), fixed.MERGE_NOTHING_ERROR).alias("error"),
    )


def kept_intervals(docs: DataFrame, removed: DataFrame, size: int) -> DataFrame:
    """Each document as the page intervals between its removed pages.

    ``shift`` is the number of removed pages before the interval.
    """
    doc = ["bundle_id", "document_index"]
    slim = docs.select(*doc, "start_page", "end_page")
    inside = join_ranges(removed.select("bundle_id", "page_number"), slim, size)
    marks = stage(
        slim.withColumn("gap", F.col("start_page") - 1).withColumn("real", F.lit(0)).unionByName(
            inside.withColumn("real", F.lit(1)).withColumnRenamed("page_number", "gap")
        ),
        "document_gaps",
    )
    counted = prefix_scan(
        marks, doc, ["gap"], page_block("gap", size), sums={"shift": F.col("real")}
    )
    back = counted.withColumn("back", -F.col("gap"))
    spans = prefix_scan(
        back, doc, ["back"], F.floor(F.col("back") / F.lit(size)).cast("long"),
        priors={"next_gap": F.col("gap")},
    )
    return spans.select(
        *doc, "shift",
        F.col("start_page").alias("document_start"),
        (F.col("gap") + 1).alias("start_page"),
        F.coalesce(F.col("next_gap") - 1, F.col("end_page")).alias("end_page"),
    ).where("start_page <= end_page")


def document_pages(
    pages: DataFrame, docs: DataFrame, removed: DataFrame, size: int = 4096
) -> DataFrame:
    """Pages of every document without its removed ones, renumbered per document."""
    offset = F.col("page_number") - F.col("document_start") + 1 - F.col("shift")
    return (
        join_ranges(pages, kept_intervals(docs, removed, size), size)
        .withColumn("new_page", offset.cast("int"))
        .drop("document_start", "shift", "start_page", "end_page")
    )


def page_op_summary(results: DataFrame, names: DataFrame, suffix: Column) -> DataFrame:
    """Output name and page count per request; names: request_id, file_name."""
    counts = results.groupBy("request_id").agg(F.count(F.lit(1)).alias("page_count"))
    return names.join(counts, "request_id").select(
        "request_id",
        F.concat(F.regexp_replace("file_name", r"(?is)\.pdf\z", ""), suffix, F.lit(".pdf"))
        .alias("output_file_name"),
        "page_count",
    )


def move_pages(pages: DataFrame, requests: DataFrame, size: int = 4096) -> DataFrame:
    """Extract into a new output and, where asked, drop the pages from the source.

    requests carry ``remove_from_source``; a move that would empty its source fails
    as a whole.
    """
    parsed = remove_requests(requests).where(
        F.col("error").isNull() | ~F.col("remove_from_source")
    ).select(requests.columns)
    taken = extract_pages(pages, parsed, size).withColumn("output", F.lit("extracted"))
    left = remove_pages(pages, parsed.where("remove_from_source"), size).withColumn(
        "output", F.lit("source")
    )
    return taken.unionByName(left)


def replace_pages(pages: DataFrame, requests: DataFrame, size: int = 4096) -> DataFrame:
    """Removal that rewrites the source or adds a second output beside it.

    requests carry ``replace_in_place`` and ``category``; the new output inherits
    the source's category, and sources not rewritten stay as they are.
    """
    parsed = remove_requests(requests)
    good = parsed.where("error IS NULL")
    flags = good.select("request_id", "bundle_id", "replace_in_place", "category",
                        "page_count", "intervals")
    ranged = flags.withColumn("start_page", F.lit(1)).withColumn("end_page", F.col("page_count"))
    page = F.col("page_number")
    joined = join_ranges(pages, ranged, size).drop("start_page", "end_page", "page_count")
    edited = joined.where(~_is_selected(F.col("intervals"), page)).select(
        "request_id", "bundle_id", "page_number",
        F.when(F.col("replace_in_place"), "source").otherwise("added").alias("output"),
        "category",
        (page - _selected_up_to(F.col("intervals"), page)).cast("int").alias("new_page"),
    )
    untouched = joined.where(~F.col("replace_in_place")).select(
        "request_id", "bundle_id", "page_number", F.lit("source").alias("output"), "category",
        page.cast("int").alias("new_page"),
    )
    return edited.unionByName(untouched)


def validate_bundles(bundles: DataFrame) -> DataFrame:
    """bundles (bundle_id, encrypted, read_error) -> accepted flag and error text."""
    error = F.when(F.col("read_error").isNotNull(), F.col("read_error")).when(
        F.col("encrypted"), fixed.ENCRYPTED_ERROR
    )
    return bundles.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNotNull(), fixed.STATUS_FAILED).otherwise("accepted")
    )


def document_content(
    pages: DataFrame, docs: DataFrame, removed: DataFrame, size: int = 4096
) -> DataFrame:
    """Original texts of a document's pages, concatenated and base64-coded.

    One row per document; ``size`` output pages are put in order at a time.
    """
    rows = document_pages(pages, docs, removed, size)
    blocks = rows.groupBy("bundle_id", "document_index", page_block("new_page", size).cast("long").alias("part")).agg(
        sorted_values(F.struct("new_page", "text"), "text").alias("texts"), F.count(F.lit(1)).alias("pages")
    )
    whole = concatenated(blocks, ["bundle_id", "document_index"], "part", ["texts"], sums=("pages",))
    coded = F.translate(F.base64(F.encode(F.array_join("texts", "\n"), "UTF-8")), "\r\n", "")
    return whole.select("bundle_id", "document_index", "pages", coded.alias("content"))
