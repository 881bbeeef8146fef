"""Which patterns of a large dictionary a page can match at all.

The dictionary becomes an inverted index: every header and phrase is filed under one of
its own q-grams, the one that fewest terms of the dictionary hold (terms shorter than q
under themselves, the empty phrase under the empty gram that every page has). A text that
contains a term contains its gram, so looking up a page's grams loses no pattern; what
they find too much is left to the exact test of the caller. The work on a page depends on
its length and on what it nearly matches, not on the size of the dictionary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle.config import SplitConfig
from pagebundle.functions import text
from pagebundle.functions.bind import bind
from pagebundle.sources import dictionary as dic
from pagebundle.staging import stage

#: longest gram a term is filed under
GRAM = 6
# texts are cut into pieces, as substring() walks from the start of its text
_PIECE = 256
#: beyond either bound the index or the dictionary meets the pages over a salted key
BROADCAST_ROWS = 1_000_000
BROADCAST_CHARS = 64_000_000
_SALTS = 32
_BODY, _ZONE = "body", "zone"
PAGE_KEY = ("bundle_id", "page_number", "dict_id")


def _signature(gram: Column) -> Column:
    return F.xxhash64("dict_id", "place", gram)


def numbered_patterns(patterns: DataFrame) -> DataFrame:
    """The prepared dictionary as a table, with a number that no two rows share."""
    return stage(
        dic.normalized_patterns(patterns).withColumn("pattern_no", F.monotonically_increasing_id()),
        "numbered_patterns",
    )


def rarest_grams(numbered: DataFrame) -> DataFrame:
    """(dict_id, place, gram, sig, width, pattern_no): where each header and phrase is filed."""

    def entry(place: str, term: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), term.alias("term"))

    phrases = F.coalesce(
        F.transform("phrases", lambda p: entry(_BODY, p["norm"])),
        F.array().cast("array<struct<place:string,term:string>>"),
    )
    uses = numbered.select(
        "pattern_no", "dict_id",
        F.inline(F.array_distinct(F.array_append(phrases, entry(_ZONE, F.col("header_fold"))))),
    ).where("term IS NOT NULL")
    term = ["dict_id", "place", "term"]
    width = F.least(F.length("term"), F.lit(GRAM))
    grams = (
        uses.select(*term).distinct()
        .select(
            *term, width.alias("width"),
            F.explode(F.sequence(F.lit(1), F.length("term") - width + 1)).alias("at"),
        )
        .select(*term, "width", F.substring("term", F.col("at"), F.col("width")).alias("gram"))
        .withColumn("sig", _signature(F.col("gram")))
    )
    holders = grams.groupBy("sig").agg(F.count(F.lit(1)).alias("holders"))
    filed = (
        grams.join(holders, "sig").groupBy(*term)
        .agg(F.min(F.struct("holders", "sig", "width", "gram")).alias("g"))
        .select(*term, "g.sig", "g.width", "g.gram")
    )
    return stage(
        uses.join(filed, term).select("dict_id", "place", "gram", "sig", "width", "pattern_no").distinct(),
        "term_index",
    )


def _pieces(place: str, whole: Column) -> Column:
    """Pieces of a text, each with the start of the next one; one piece of an empty text."""
    cut = F.when(whole == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    )

    def piece(parts: Column, own: Column, at: Column) -> Column:
        ahead = F.coalesce(F.substring(F.get(parts, at + 1), 1, GRAM - 1), F.lit(""))
        return F.struct(
            F.lit(place).alias("place"), (at == 0).alias("first"), F.length(own).alias("own"),
            F.concat(own, ahead).alias("piece"),
        )

    return bind(cut, lambda parts: F.transform(parts, lambda own, at: piece(parts, own, at)))


def page_grams(pages: DataFrame, widths: dict[str, list[int]], cfg: SplitConfig) -> DataFrame:
    """PAGE_KEY and sig of every gram, of the widths that are in use, of every page."""
    norm = text.normalize_text(F.col("text"))
    pieces = bind(
        norm,
        lambda n: F.concat(
            _pieces(_BODY, n), _pieces(_ZONE, text.header_zone(n, cfg.header_zone_chars))
        ),
    )

    def in_use(place: str) -> Column:
        return F.array(*map(F.lit, widths.get(place, []))).cast("array<int>")

    starts = F.when(F.col("width") == 0, F.col("first").cast("int")).otherwise(
        F.least(F.col("own"), F.length("piece") - F.col("width") + 1)
    )
    return (
        pages.select(*PAGE_KEY, F.inline(pieces))
        .withColumn("width", F.explode(
            F.when(F.col("place") == _BODY, in_use(_BODY)).otherwise(in_use(_ZONE))
        ))
        .withColumn("at", F.explode(F.when(starts > 0, F.sequence(F.lit(1), starts))))
        .select(*PAGE_KEY, _signature(F.substring("piece", F.col("at"), F.col("width"))).alias("sig"))
    )


def np_table(grams: list[str], patterns: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams, sorted, as integers; where the patterns of each start; the patterns.

    Texts and grams are ASCII (``normalize_text``): up to GRAM characters fit one integer.
    """
    packed = np.array([int.from_bytes(g.encode("ascii"), "little") for g in grams], dtype=np.uint64)
    order = np.argsort(packed, kind="stable")
    distinct, starts = np.unique(packed[order], return_index=True)
    return distinct, np.append(starts, len(order)), np.asarray(patterns, dtype=np.int64)[order]


def _packed_index(index: DataFrame) -> dict:
    """(dict_id, place) -> width -> table of grams; only for an index of checked size."""
    rows = index.select("dict_id", "place", "width", "gram", "pattern_no").toPandas()
    tables: dict = {}
    for (dict_id, place, width), group in rows.groupby(["dict_id", "place", "width"]):
        tables.setdefault((dict_id, place), {})[int(width)] = np_table(group["gram"], group["pattern_no"])
    return tables


def _looked_up(shared, positions: int = 1 << 20):
    """A function of dict_id, body and zone of a page: the numbers of the patterns filed under its grams."""
    places = (_BODY, _ZONE)

    @F.pandas_udf("array<long>")
    def numbers(dict_ids: pd.Series, bodies: pd.Series, zones: pd.Series) -> pd.Series:
        pages, found = [], []

        def add(rows, starts, stops, patterns):
            counts = stops - starts
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            pages.append(np.repeat(rows, counts))
            found.append(patterns[np.repeat(starts, counts) + within])

        for place, texts in zip(places, (bodies, zones)):
            texts = texts.dropna()
            for dict_id, labels in texts.groupby(dict_ids[texts.index]).groups.items():
                widths = shared.value.get((dict_id, place), {})
                rows, own = labels.to_numpy(), texts[labels]
                if 0 in widths:
                    _, starts, patterns = widths[0]
                    add(rows, np.full(len(rows), starts[0]), np.full(len(rows), starts[1]), patterns)
                ends = np.cumsum(own.str.len().to_numpy(dtype=np.int64))
                data = np.frombuffer("".join(own).encode("ascii"), dtype=np.uint8)
                for at in range(0, len(data), positions):
                    piece = data[at : at + positions + max(widths, default=1) - 1].astype(np.uint64)
                    packed = np.zeros(len(piece), dtype=np.uint64)
                    for width in range(1, max(widths, default=0) + 1):
                        packed = packed[: len(piece) - width + 1]
                        packed = packed | piece[width - 1 :] << np.uint64(8 * (width - 1))
                        if width not in widths:
                            continue
                        grams, starts, patterns = widths[width]
                        # a small table of hashes rules out nearly all places
                        mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 16)
                        maybe = np.zeros(1 << 16, dtype=bool)
                        maybe[(grams * mix) >> shift] = True
                        near = np.flatnonzero(maybe[(packed[:positions] * mix) >> shift])
                        nth = np.minimum(np.searchsorted(grams, packed[near]), len(grams) - 1)
                        sure = grams[nth] == packed[near]
                        near, nth = near[sure] + at, nth[sure]
                        row = np.searchsorted(ends, near, side="right")
                        whole = near + width <= ends[row]
                        both = np.unique(row[whole] * len(grams) + nth[whole])
                        row, nth = both // len(grams), both % len(grams)
                        add(rows[row], starts[nth], starts[nth + 1], patterns)
        result = [[] for _ in range(len(dict_ids))]
        if pages:
            pairs = pd.DataFrame({"page": np.concatenate(pages), "no": np.concatenate(found)}).drop_duplicates()
            for page, group in pairs.groupby("page")["no"]:
                result[page] = group.to_numpy()
        return pd.Series(result)

    return numbers


def _found_in_pages(pages: DataFrame, index: DataFrame, cfg: SplitConfig) -> DataFrame:
    """PAGE_KEY and pattern_no, by looking every gram of a page up in its task."""
    tables = _packed_index(index)
    shared = pages.sparkSession.sparkContext.broadcast(tables)
    owned = F.col("dict_id").isin(*sorted({d for d, _ in tables})) if len(tables) <= 100 else F.lit(True)
    normed = pages.where(owned).select(*PAGE_KEY, text.normalize_text(F.col("text")).alias("_norm"))
    zone = text.header_zone(F.col("_norm"), cfg.header_zone_chars)
    return normed.select(
        *PAGE_KEY, F.explode(_looked_up(shared)("dict_id", "_norm", zone)).alias("pattern_no")
    )


def _meet(rows: DataFrame, table: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Rows of pages with the rows of a table, whose keys may be hot on the pages' side."""
    if small:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64(*PAGE_KEY), F.lit(_SALTS)).cast("int")
    return rows.distinct().withColumn("_salt", salt).join(salted, [*on, "_salt"]).drop("_salt")


def candidate_patterns(pages: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """PAGE_KEY, patterns: those a page may match, prepared and in dictionary order.

    Pages that can match none have no row. Texts are read here, but do not leave their task.
    """
    numbered = numbered_patterns(patterns)
    index = rarest_grams(numbered)
    small_index = index.count() <= BROADCAST_ROWS
    small_dictionary = dic.within_embedding_bounds(patterns, BROADCAST_ROWS, BROADCAST_CHARS)

    if small_index:
        found = _found_in_pages(pages, index, cfg)
    else:
        widths: dict[str, list[int]] = {}
        for place, width in index.select("place", "width").distinct().collect():
            widths.setdefault(place, []).append(width)  # at most GRAM + 1 a place
        grams = page_grams(pages, widths, cfg)
        found = _meet(grams, index.select("sig", "pattern_no"), ["sig"], small=False)
    numbers = found.groupBy(*PAGE_KEY).agg(F.collect_set("pattern_no").alias("numbers"))
    # the dictionary is part of the key: grams of two dictionaries may share a hash
    items = numbered.select("dict_id", "pattern_no", dic.prepared_item().alias("item"))
    return (
        _meet(
            numbers.select(*PAGE_KEY, F.explode("numbers").alias("pattern_no")), items,
            ["dict_id", "pattern_no"], small_dictionary,
        )
        .groupBy(*PAGE_KEY)
        .agg(F.array_sort(F.collect_list("item")).alias("patterns"))
    )
