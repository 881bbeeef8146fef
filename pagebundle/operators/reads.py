"""Page texts after recognition, and which pages are really blank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.config import SplitConfig
from pagebundle.functions.text import alnum_count, has_alnum
from pagebundle.operators.scan import page_block
from pagebundle.operators.tree import concatenated

KEY = ["bundle_id", "page_number"]


def is_ocr_candidate(text: Column, cfg: SplitConfig) -> Column:
    return ~has_alnum(text, cfg.ocr_min_text_chars)


def ocr_candidates(pages: DataFrame, cfg: SplitConfig) -> DataFrame:
    return pages.where(is_ocr_candidate(F.col("text"), cfg))


def ink_ratio(histogram: DataFrame, cfg: SplitConfig) -> DataFrame:
    """(bundle_id, page_number, level, pixels) of the cropped core -> dark share."""
    dark = F.sum(F.when(F.col("level") <= cfg.dark_threshold, F.col("pixels")).otherwise(0))
    total = F.sum("pixels")
    ratio = F.when(total > 0, dark / total).otherwise(F.lit(0.0))
    return histogram.groupBy(*KEY).agg(ratio.alias("ink_ratio"))


def image_ink_ratio(images: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Rows (bundle_id, page_number, image) of Spark's image source -> dark share."""
    margin, threshold = cfg.blank_margin_ratio, cfg.dark_threshold

    def dark_share(height: int, width: int, channels: int, data: bytes) -> float:
        raster = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
        if channels >= 3:  # stored blue, green, red; luma in 16-bit fixed point
            bgr = raster[:, :, :3].astype(np.uint32)
            gray = (bgr @ np.array([7471, 38470, 19595], np.uint32) + 32768) >> 16
        else:
            gray = raster[:, :, 0]
        dx, dy = int(width * margin), int(height * margin)
        core = gray[dy : height - dy, dx : width - dx]
        return float((core <= threshold).sum() / core.size) if core.size else 0.0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            ratios = [
                dark_share(*row)
                for row in zip(*(columns[c] for c in ("height", "width", "nChannels", "data")))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bundle_id"), batch.column("page_number"),
                 pa.array(ratios, pa.float64())],
                names=[*KEY, "ink_ratio"],
            )

    flat = images.select(
        F.col("bundle_id").cast("long"), F.col("page_number").cast("int"),
        "image.height", "image.width", "image.nChannels", "image.data",
    )
    return flat.mapInArrow(measure, "bundle_id long, page_number int, ink_ratio double")


def blank_flags(pages: DataFrame, ink: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Candidate pages with ``blank``: measured and (almost) without ink."""
    measured = F.coalesce(F.col("ink_ratio") <= cfg.blank_max_ink_ratio, F.lit(False))
    return (
        ocr_candidates(pages, cfg)
        .join(ink.select(*KEY, "ink_ratio"), KEY, "left")
        .withColumn("blank", measured)
        .drop("ink_ratio")
    )


def recognised(candidates: DataFrame, ocr: DataFrame) -> DataFrame:
    """Candidates with ``filled``; text is replaced only by text with more content."""
    better = ~F.col("blank") & (
        alnum_count(F.coalesce("ocr_text", F.lit(""))) > alnum_count(F.col("text"))
    )
    return (
        candidates.join(ocr.select(*KEY, "ocr_text"), KEY, "left")
        .withColumn("filled", better)
        .withColumn("text", F.when(F.col("filled"), F.col("ocr_text")).otherwise(F.col("text")))
        .drop("ocr_text")
    )


def page_reads(
    pages: DataFrame, ink: DataFrame | None, ocr: DataFrame | None, cfg: SplitConfig
) -> DataFrame:
    """pages + ``blank`` with recognised text merged in.

    Only candidate pages travel to the joins; the bulk of the text is a narrow
    pass over the source.
    """
    if not cfg.ocr_enabled:
        return pages.withColumn("blank", F.lit(False))
    if ink is None:
        touched = ocr_candidates(pages, cfg).withColumn("blank", F.lit(False))
    else:
        touched = blank_flags(pages, ink, cfg)
    if ocr is not None:
        touched = recognised(touched, ocr).drop("filled")
    untouched = pages.where(~is_ocr_candidate(F.col("text"), cfg)).withColumn(
        "blank", F.lit(False)
    )
    return untouched.unionByName(touched)


def ocr_summary(
    pages: DataFrame, ink: DataFrame, ocr: DataFrame, cfg: SplitConfig
) -> DataFrame:
    """Pages filled, not improved and skipped as blank; one row per bundle."""
    rows = recognised(blank_flags(pages, ink, cfg), ocr)
    outcome = (
        F.when(F.col("blank"), "skipped").when(F.col("filled"), "filled").otherwise("kept")
    )

    names = ("filled", "kept", "skipped")

    def chosen(name: str) -> Column:
        return F.when(F.col("outcome") == name, F.col("page_number"))

    blocks = (
        rows.withColumn("outcome", outcome)
        .groupBy("bundle_id", page_block("page_number", cfg.block_pages).cast("long").alias("part"))
        .agg(*[F.array_sort(F.collect_list(chosen(n))).alias(n) for n in names])
    )
    whole = concatenated(blocks, ["bundle_id"], "part", list(names))
    return whole.select(
        "bundle_id",
        *[
            column
            for n in names
            for column in (
                F.size(n).cast("long").alias(f"{n}_pages"), F.array_join(F.col(n).cast("array<string>"), ",").alias(f"{n}_list")
            )
        ],
    )


def is_empty(text: Column, cfg: SplitConfig) -> Column:
    return ~has_alnum(text, cfg.empty_page_max_alnum + 1)


def confirmed_empty(text: Column, blank: Column, cfg: SplitConfig) -> Column:
    """No ink *and* no text: either alone proves nothing."""
    return blank & is_empty(text, cfg)


def empty_mode(col: Column) -> Column:
    mode = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(mode.isin("keep", "report", "remove"), mode).otherwise(F.lit("keep"))


def mode_warnings(settings: DataFrame) -> DataFrame:
    """(setting_id, code) of settings (setting_id, empty_page_mode, ocr_enabled) to be warned about.

    An unknown mode acts as keep; a mode that looks for empty pages needs recognition.
    """
    mode = empty_mode(F.col("empty_page_mode"))
    given = F.lower(F.trim(F.coalesce("empty_page_mode", F.lit(""))))
    codes = F.array_compact(
        F.array(
            F.when(given != mode, fixed.WARN_UNKNOWN_MODE),
            F.when((mode != "keep") & ~F.col("ocr_enabled"), fixed.WARN_MODE_NEEDS_OCR),
        )
    )
    return settings.select("setting_id", F.explode(codes).alias("code"))
