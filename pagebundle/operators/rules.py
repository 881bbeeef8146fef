"""Scoring pages against a pattern dictionary.

Usual case: one dictionary of ordinary size is compiled into column expressions
(one substring test per distinct term, everything else arithmetic on the test
bits). Dictionaries per tenant, or with more terms, travel as data (a constant, or
broadcast by dict_id after a size check) and are scored by array functions. In both
cases scoring is row-local and nothing shuffles. Dictionaries beyond the size check
are indexed (``term_index``): a page meets only the patterns it may match, which are then
scored exactly. Where a page that matches nothing may still get a type (an unknown
threshold of zero), no pattern can be left out: the dictionary is cut into bounded chunks,
pages meet every chunk over a salted key and the results are reduced per page.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.config import SplitConfig
from pagebundle.functions import text
from pagebundle.functions.bind import bind
from pagebundle.operators import term_index
from pagebundle.sources import dictionary as dic

_WORD_BITS = 62
_BEST = (
    "struct<confidence:double,order_key:int,document_type:string,header:string,"
    "header_match:boolean,hits:int>"
)
_SCORED = (
    "struct<confidence:double,order_key:int,pattern_idx:int,document_type:string,header:string,"
    "header_match:boolean,matched:array<string>>"
)
_CHUNK_ROWS = 500
# pages of one dictionary that meet a copy of it
_PAGES_PER_SALT = 20_000


def match_header(zone: Column, pattern: Column) -> Column:
    return F.contains(zone, pattern["header_fold"])


def match_phrases(norm: Column, pattern: Column) -> Column:
    return F.filter(pattern["phrases"], lambda p: F.contains(norm, p["norm"]))


def is_excluded(norm: Column, pattern: Column) -> Column:
    return F.exists(pattern["excluded"], lambda e: F.contains(norm, e))


def pattern_score(header: Column, hits: Column, weight: Column, cfg: SplitConfig) -> Column:
    from_header = F.when(header, F.lit(cfg.header_weight) * weight).otherwise(F.lit(0.0))
    from_phrases = F.when(hits > 0, F.lit(cfg.phrase_weight) * hits * weight).otherwise(
        F.lit(0.0)
    )
    # a weight that is no number scores nothing
    total = F.nanvl(from_header + from_phrases, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))


def pattern_signals(header: Column, header_text: Column, hits: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(header, F.concat(F.lit(fixed.HEADER_SIGNAL), header_text)),
            F.when(hits > 0, F.concat(F.lit(fixed.PHRASE_SIGNAL), hits.cast("string"))),
        )
    )


def score_patterns(norm: Column, patterns: Column, cfg: SplitConfig) -> Column:
    """One struct per pattern that no exclusion disables, in dictionary order."""

    def score_all(n: Column) -> Column:
        def scored(p: Column, zone: Column) -> Column:
            return bind(
                F.struct(match_header(zone, p).alias("h"), match_phrases(n, p).alias("m")),
                lambda r: F.struct(
                    pattern_score(r["h"], F.size(r["m"]), p["weight"], cfg).alias("confidence"),
                    (-p["pattern_idx"]).alias("order_key"),
                    p["pattern_idx"].alias("pattern_idx"),
                    p["document_type"].alias("document_type"),
                    p["header"].alias("header"),
                    r["h"].alias("header_match"),
                    F.transform(r["m"], lambda x: x["text"]).alias("matched"),
                ),
            )

        live = F.filter(patterns, lambda p: ~is_excluded(n, p))
        zone = text.header_zone(n, cfg.header_zone_chars)
        return bind(zone, lambda z: F.transform(live, lambda p: scored(p, z)))

    return bind(norm, score_all)


def best_pattern(scored: Column) -> Column:
    """Highest confidence; the earliest pattern wins ties."""
    return F.array_max(
        F.transform(
            scored,
            lambda s: F.struct(
                s["confidence"], s["order_key"], s["document_type"], s["header"],
                s["header_match"], F.size(s["matched"]).alias("hits"),
            ),
        )
    )


def phrase_affinities(scored: Column) -> Column:
    """(type, phrase) pairs in first-seen order, without repeats."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                scored,
                lambda s: F.transform(
                    s["matched"],
                    lambda m: F.struct(
                        s["document_type"].alias("document_type"), m.alias("phrase")
                    ),
                ),
            )
        )
    )


def _decide(best: Column, cfg: SplitConfig) -> list[Column]:
    matched = F.coalesce(best["confidence"] >= cfg.unknown_threshold, F.lit(False))
    return [
        (matched & (best["confidence"] >= cfg.first_page_threshold)).alias("is_first"),
        F.when(matched, best["document_type"])
        .otherwise(F.lit(fixed.UNKNOWN_DOCUMENT_TYPE)).alias("document_type"),
        F.when(matched, best["confidence"])
        .otherwise(F.lit(fixed.UNKNOWN_CONFIDENCE)).alias("confidence"),
        F.when(matched, pattern_signals(best["header_match"], best["header"], best["hits"]))
        .otherwise(F.array(F.lit(fixed.NO_MATCH_SIGNAL))).alias("signals"),
    ]


def _prepared(patterns: DataFrame) -> list[dict]:
    """The prepared rows of a dictionary whose size has been checked, in order."""
    rows = dic.normalized_patterns(patterns).orderBy("pattern_idx").drop("dict_id")
    return [r.asDict(recursive=True) for r in rows.collect()]


def _constant(items: list[dict]) -> Column:
    return F.from_json(
        F.lit(json.dumps(items, ensure_ascii=False)), f"array<{dic._PREPARED_STRUCT}>"
    )


def _compilable(items: list[dict], cfg: SplitConfig) -> bool:
    """Few enough terms, and none of the values that array functions treat as unknown."""
    if any(
        i[c] is None for i in items
        for c in ("document_type", "header", "header_fold", "phrases", "excluded", "weight")
    ):
        return False
    if not items:
        return False
    terms = [t for i in items for t in [*[p["norm"] for p in i["phrases"]], *i["excluded"]]]
    return None not in terms and len(terms) + len(items) <= cfg.max_compiled_terms


def _tested(
    pages: DataFrame, items: list[dict], cfg: SplitConfig, generated: bool = False
) -> tuple[DataFrame, list[dict]]:
    """pages + one bit per distinct term, and per pattern the columns that read these bits.

    Bits that are generated, not projected, are not found again by a condition on what follows.
    """
    terms = sorted({t for i in items for t in [p["norm"] for p in i["phrases"]] + i["excluded"]})
    headers = sorted({i["header_fold"] for i in items})
    word = {t: divmod(n, _WORD_BITS) for n, t in enumerate(terms)}
    head = {h: divmod(n, _WORD_BITS) for n, h in enumerate(headers)}

    def words(names: list[str], within: str, prefix: str) -> list[Column]:
        columns = []
        for at in range(0, len(names), _WORD_BITS):
            flags = [
                F.when(F.contains(F.col(within), F.lit(t)), F.lit(1 << bit).cast("long"))
                .otherwise(F.lit(0).cast("long"))
                for bit, t in enumerate(names[at : at + _WORD_BITS])
            ]
            columns.append(reduce(Column.bitwiseOR, flags).alias(f"{prefix}{at // _WORD_BITS}"))
        return columns

    def test(prefix: str, place: tuple[int, int]) -> Column:
        number, bit = place
        return F.col(f"{prefix}{number}").bitwiseAND(F.lit(1 << bit).cast("long")) != 0

    normed = pages.withColumn("_norm", text.normalize_text(F.col("text"))).withColumn(
        "_zone", text.header_zone(F.col("_norm"), cfg.header_zone_chars)
    )
    bits = [*words(terms, "_norm", "_w"), *words(headers, "_zone", "_h")]
    tested = normed.select(*pages.columns, *([F.inline(F.array(F.struct(*bits)))] if generated else bits))
    tests = []
    for item in items:
        phrases = [(p["text"], test("_w", word[p["norm"]])) for p in item["phrases"]]
        hits = reduce(lambda n, p: n + p[1].cast("int"), phrases, F.lit(0))
        header = test("_h", head[item["header_fold"]])
        live = reduce(lambda ok, e: ok & ~test("_w", word[e]), item["excluded"], F.lit(True))
        score = pattern_score(header, hits, F.lit(item["weight"]), cfg)
        tests.append({"live": live, "header": header, "phrases": phrases, "hits": hits, "score": score})
    return tested, tests


def _score_compiled(pages: DataFrame, items: list[dict], cfg: SplitConfig) -> DataFrame:
    """pages + ``scored`` as ``score_patterns`` gives it, from one substring test per distinct term."""
    tested, tests = _tested(pages, items, cfg, generated=True)
    readable = F.col("text").isNotNull()  # whether a missing text has an exclusion is unknown
    scored = [
        F.when(
            (t["live"] & readable) if item["excluded"] else t["live"],
            F.struct(
                t["score"].alias("confidence"), F.lit(-item["pattern_idx"]).alias("order_key"),
                F.lit(item["pattern_idx"]).alias("pattern_idx"),
                F.lit(item["document_type"]).alias("document_type"),
                F.lit(item["header"]).alias("header"),
                F.when(readable, t["header"]).alias("header_match"),
                F.array_compact(
                    F.array(*[F.when(hit, F.lit(phrase)) for phrase, hit in t["phrases"]])
                    .cast("array<string>")
                ).alias("matched"),
            ).cast(_SCORED),
        )
        for item, t in zip(items, tests)
    ]
    return tested.select(
        *pages.columns, F.array_compact(F.array(*scored).cast(f"array<{_SCORED}>")).alias("scored")
    )


def _rank_compiled(pages: DataFrame, items: list[dict], cfg: SplitConfig) -> DataFrame:
    """pages + best and affinities, from one substring test per distinct term."""
    tested, tests = _tested(pages, items, cfg)
    ranked, pairs = [F.lit(None).cast(_BEST)] * 2, []
    for item, t in zip(items, tests):
        ranked.append(
            F.when(
                t["live"],
                F.struct(
                    t["score"].alias("confidence"), F.lit(-item["pattern_idx"]).alias("order_key"),
                    F.lit(item["document_type"]).alias("document_type"),
                    F.lit(item["header"]).alias("header"),
                    t["header"].alias("header_match"), t["hits"].alias("hits"),
                ).cast(_BEST),
            )
        )
        pairs += [
            F.when(t["live"] & hit, F.struct(F.lit(item["document_type"]).alias("document_type"),
                                             F.lit(phrase).alias("phrase")))
            for phrase, hit in t["phrases"]
        ]
    none = F.array().cast("array<struct<document_type:string,phrase:string>>")
    affinities = F.array_distinct(F.array_compact(F.array(*pairs))) if pairs else none
    return tested.select(
        *pages.columns, F.greatest(*ranked).alias("best"), affinities.alias("affinities")
    )


def score_pages(pages: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """pages + ``scored``; pages without dict_id use the only dictionary given."""
    norm = text.normalize_text(F.col("text"))
    if "dict_id" not in pages.columns:
        items = _prepared(patterns)
        if _compilable(items, cfg):
            return _score_compiled(pages, items, cfg)
        return pages.withColumn("scored", score_patterns(norm, _constant(items), cfg))
    return (
        pages.join(F.broadcast(dic.whole_dictionary(patterns)), "dict_id", "left")
        .withColumn("scored", score_patterns(norm, F.coalesce(
            "patterns", F.array().cast(f"array<{dic._PREPARED_STRUCT}>")), cfg))
        .drop("patterns")
    )


def _score_by_chunks(pages: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """best + affinities per page for dictionaries of any size.

    A page is identified with its dictionary: tenants may share bundle ids.
    """
    key = ["bundle_id", "page_number", "dict_id"]
    single = "dict_id" not in pages.columns
    if single:
        pages = pages.withColumn("dict_id", F.lit("default"))
        patterns = patterns.withColumn("dict_id", F.lit("default"))
    salts = max(1, pages.select(*key).count() // _PAGES_PER_SALT)
    salt = F.pmod(F.xxhash64("bundle_id", "page_number"), F.lit(salts))
    chunks = dic.chunked_dictionary(patterns, _CHUNK_ROWS).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    slim = pages.select(
        *key, text.normalize_text(F.col("text")).alias("_norm"), salt.alias("_salt")
    )
    scored = slim.join(chunks, ["dict_id", "_salt"]).select(
        *key, "chunk", score_patterns(F.col("_norm"), F.col("patterns"), cfg).alias("scored")
    )
    reduced = (
        scored.select(
            *key, best_pattern(F.col("scored")).alias("b"),
            F.struct("chunk", phrase_affinities(F.col("scored")).alias("a")).alias("part"),
        )
        .groupBy(*key)
        .agg(F.max("b").alias("best"), F.collect_list("part").alias("parts"))
        .select(
            *key, "best",
            F.array_distinct(
                F.flatten(F.transform(F.array_sort("parts"), lambda p: p["a"]))
            ).alias("affinities"),
        )
    )
    joined = pages.join(reduced, key, "left")
    return joined.drop("dict_id") if single else joined


def _score_by_index(pages: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """best + affinities per page, from the patterns that the index finds for it.

    Right for thresholds above zero: a pattern without header and phrases scores zero.
    Texts are shuffled once at most, to meet their candidates.
    """
    single = "dict_id" not in pages.columns
    if single:
        pages = pages.withColumn("dict_id", F.lit("default"))
        patterns = patterns.withColumn("dict_id", F.lit("default"))
    candidates = term_index.candidate_patterns(pages, patterns, cfg)
    joined = pages.join(candidates, list(term_index.PAGE_KEY), "left")
    few = F.coalesce("patterns", F.array().cast(f"array<{dic._PREPARED_STRUCT}>"))
    scored = joined.withColumn(
        "scored", score_patterns(text.normalize_text(F.col("text")), few, cfg)
    )
    ranked = (
        scored.withColumn("best", best_pattern(F.col("scored")))
        .withColumn("affinities", phrase_affinities(F.col("scored")))
        .drop("scored", "patterns")
    )
    return ranked.drop("dict_id") if single else ranked


def _rank_embedded(pages: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    if "dict_id" in pages.columns:
        scored = score_pages(pages, patterns, cfg)
    else:
        items = _prepared(patterns)
        if sum(len(i["phrases"]) + len(i["excluded"]) + 1 for i in items) <= cfg.max_compiled_terms:
            return _rank_compiled(pages, items, cfg)
        norm = text.normalize_text(F.col("text"))
        scored = pages.withColumn("scored", score_patterns(norm, _constant(items), cfg))
    best, affinities = best_pattern(F.col("scored")), phrase_affinities(F.col("scored"))
    return scored.withColumn("best", best).withColumn("affinities", affinities).drop("scored")


def classify_pages(pages: DataFrame, patterns: DataFrame, cfg: SplitConfig) -> DataFrame:
    """pages + is_first, document_type, confidence, signals, affinities."""
    if dic.within_embedding_bounds(patterns, cfg.max_embedded_patterns, cfg.max_embedded_chars):
        ranked = _rank_embedded(pages, patterns, cfg)
    elif cfg.unknown_threshold > 0:
        ranked = _score_by_index(pages, patterns, cfg)
    else:
        ranked = _score_by_chunks(pages, patterns, cfg)
    none = F.array().cast("array<struct<document_type:string,phrase:string>>")
    return ranked.select(
        *pages.columns,
        *_decide(F.col("best"), cfg),
        F.coalesce("affinities", none).alias("affinities"),
    )


def has_affinity(affinities: Column, document_type: Column) -> Column:
    return F.exists(affinities, lambda a: a["document_type"] == document_type)


def matched_phrases(affinities: Column, document_type: Column) -> Column:
    return F.transform(
        F.filter(affinities, lambda a: a["document_type"] == document_type),
        lambda a: a["phrase"],
    )


def affinity_types(affinities: Column) -> Column:
    return F.array_sort(
        F.array_distinct(F.transform(affinities, lambda a: a["document_type"]))
    )
