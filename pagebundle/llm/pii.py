"""Personal data: patterns for direct identifiers, information theory for what gives them away.

Direct identifiers (email, ip, card, phone) are the leftmost non-overlapping matches of
fixed patterns per kind that pass a check (octets, Luhn, number of digits).

Other words can reveal an identifier without being one: a name that only ever stands
next to one mail address. The corpus tells how strongly. For an identifier's value e and
a term t within ``window`` words of it,

    PMI(e; t) = log2( N * n(e, t) / (n(e) * n(t)) ),     IC(e) = log2( N / n(e) )

with documents counted over the whole corpus (n(e, t): t near e; n(t): t anywhere).
Their ratio, at most 1, is the share of e's information that t gives away; it is 1 if t
occurs nowhere but near e. From ``remove_above`` a term is removed, from
``generalise_above`` it is replaced by its category, wherever it stands. A pair needs
``min_support`` documents and as many different surroundings (hashes of the 400 characters
on each side of an identifier, of the whole side where the window's words are long, over
all its mentions in the document), so that copies of one document or passage are no evidence.

All of it is DataFrame expressions: match positions come from the lengths of the pieces
between matches; statistics are groupings with map-side sums. Patterns are written so
that they need no backtracking over long runs (possessive, starting only at a run's
start), as texts may be long.

Defined cases: a null text counts as empty. Repeated rows get equal results and count
once in the statistics if id and text agree. Spans of different kinds may overlap. Other
columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle.llm.common import fresh, size_checked_broadcast, stage

KINDS = ("email", "ip", "card", "phone")
#: Equal to the plain patterns on every text, but linear: a match starts at the start of a
#: run or right after the match before it, and what a class has taken it keeps.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Java tries the next position by itself; a prefilter skips texts that cannot match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TOKEN = r"[\p{L}\p{M}\p{N}]++"


@dataclass(frozen=True)
class DisclosureConfig:
    window: int = 5
    min_support: int = 3
    generalise_above: float = 0.8
    remove_above: float = 0.95
    max_broadcast_terms: int = 50_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


_SPAN = "array<struct<start: int, rank: int, kind: string, stop: int, value: string>>"


def _located(text: Column, matches: Column, pattern: Column | str, rank: int, kind: str) -> Column:
    """Start and end of each match, from the pieces between the matches."""
    pieces = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["found"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            stop.alias("stop"), x["found"].alias("value"),
        )
        return F.struct(stop.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("found")
    )
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(zipped, start, step)["spans"]


def with_base_spans(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with ``to``: the valid spans of all kinds, sorted by start, then kind as listed."""
    names = {k: fresh(df, f"_{to}_{k}") for k in KINDS}
    value = F.col(text)
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
        may = F.contains(value, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        df = df.withColumn(names[kind], F.when(may, found).otherwise(F.array().cast("array<string>")))
    none = F.array().cast(_SPAN)
    spans = [
        F.when(
            F.size(names[kind]) > 0,
            F.filter(
                _located(value, F.col(names[kind]), PATTERNS[kind], rank, kind),
                _check(kind),
            ),
        ).otherwise(none)
        for rank, kind in enumerate(KINDS)
    ]
    return df.withColumn(to, F.array_sort(F.concat(*spans))).drop(*names.values())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


#: Characters on each side of an identifier that make up its surroundings; the whole side
#: where half of them do not hold the window.
_REACH = 400


def _windows(text: Column, spans: Column, words: int) -> Column:
    """Per span: its value, the tokens near it, a hash of what surrounds it."""

    def tokens(part: Column) -> Column:
        return F.regexp_extract_all(F.lower(part), F.lit(_TOKEN), F.lit(0))

    def one(s: Column) -> Column:
        begin = F.greatest(s["start"] - _REACH, F.lit(0))
        left = F.substr(text, begin + 1, s["start"] - begin)
        right = F.substr(text, s["stop"] + 1, F.lit(_REACH))
        # The half next to the span, without a token that its edge may have parted, holds the
        # window; where its tokens are too few, the whole side is read instead.
        half = F.regexp_replace(F.substr(left, F.lit(-_REACH // 2)), r"^[\p{L}\p{M}\p{N}]++", "")
        whole = F.size(tokens(half)) < words
        left = F.when(whole, F.substr(text, F.lit(1), s["start"])).otherwise(left)
        before = tokens(F.when(whole, left).otherwise(half))
        half = F.regexp_replace(F.substr(right, F.lit(1), F.lit(_REACH // 2)), r"[\p{L}\p{M}\p{N}]+$", "")
        whole = F.size(tokens(half)) < words
        right = F.when(whole, F.substr(text, s["stop"] + 1, F.length(text))).otherwise(right)
        after = tokens(F.when(whole, right).otherwise(half))
        near = F.concat(
            F.slice(before, F.greatest(F.size(before) - words + 1, F.lit(1)), F.lit(words)), F.slice(after, 1, words)
        )
        return F.struct(
            F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"),
            F.array_distinct(near).alias("terms"),
            F.xxhash64(left, right).alias("around"),
        )

    return F.transform(spans, one)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)))


def disclosing_terms(found: DataFrame, docs: DataFrame, config: DisclosureConfig) -> DataFrame:
    """(term, action): ``remove`` or ``generalise``; ``found`` is a table with key and windows."""
    # A document's surroundings of an identifier count as one, so copies with several mentions stay one.
    near = stage(
        found.where(F.size("windows") > 0)
        .select("key", F.explode("windows").alias("w"))
        .groupBy("key", F.col("w.entity").alias("entity"))
        .agg(
            F.array_distinct(F.flatten(F.collect_set("w.terms"))).alias("terms"),
            F.xxhash64(F.array_sort(F.collect_set("w.around"))).alias("around"),
        ),
        "pii-near",
    )
    documents = found.select("key").distinct().count()
    entities = near.groupBy("entity").agg(F.count("*").alias("n_e"))
    by_term = near.select("key", "entity", "around", F.explode("terms").alias("term"))
    pairs = (
        by_term.groupBy("entity", "term")
        .agg(F.count("*").alias("n_et"), F.countDistinct("around").alias("support"))
        .where(F.least("support", "n_et") >= config.min_support)
        .join(entities, "entity")
        .where(F.col("n_e") < documents)
    )
    # A term's documents are at least those with it in some window. A pair for which these
    # are already too many cannot reach the threshold: common words need no count.
    seen = by_term.groupBy("term").agg(F.countDistinct("key").alias("n_near"))
    most = F.col("n_et") * F.pow(F.lit(float(documents)) / F.col("n_e"), F.lit(1 - config.generalise_above + 1e-9))
    pairs = stage(pairs.join(seen, "term").where(F.col("n_near") <= most), "pii-pairs")
    wanted = stage(pairs.select("term").distinct(), "pii-terms")
    counts = (
        docs.select("key", F.explode(_tokens(F.col("text"))).alias("term"))
        .join(size_checked_broadcast(wanted, config.max_broadcast_terms), "term", "left_semi")
        .groupBy("term")
        .agg(F.countDistinct("key").alias("n_t"))
    )
    share = F.log2(F.lit(float(documents)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log2(
        F.lit(float(documents)) / F.col("n_e")
    )
    return (
        pairs.join(counts, "term")
        .withColumn("share", share)
        .groupBy("term")
        .agg(F.max("share").alias("share"))
        .where(F.col("share") >= config.generalise_above)
        .select("term", F.when(F.col("share") >= config.remove_above, "remove").otherwise("generalise").alias("action"))
    )


def _quoted(term: Column) -> Column:
    """A pattern for the whole token, whatever its case (tokens hold letters, marks and numbers only)."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])"), term, F.lit(r"(?![\p{L}\p{M}\p{N}])"))


def _term_spans(docs: DataFrame, terms: DataFrame, config: DisclosureConfig) -> DataFrame:
    """(key, extra): spans of the disclosing terms in each document that has any."""
    hits = (
        docs.select("key", "text", F.explode(_tokens(F.col("text"))).alias("term"))
        .join(size_checked_broadcast(terms, config.max_broadcast_terms), "term")
    )
    pattern = _quoted(F.col("term"))
    located = _located(F.col("text"), F.regexp_extract_all("text", pattern, F.lit(0)), pattern, len(KINDS), "term")
    # value carries the action: what the span's text becomes
    spans = F.transform(
        located,
        lambda s: F.struct(s["start"], s["rank"], s["kind"], s["stop"], F.col("action").alias("value")),
    )
    # Repeated rows give equal spans: a set keeps them once.
    return hits.select("key", spans.alias("s")).groupBy("key").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("extra"))


def term_spans(docs: DataFrame, config: DisclosureConfig = DisclosureConfig()) -> DataFrame | None:
    """A table (key, extra): spans of disclosing terms of the documents with any; None if no
    term discloses anything. ``key`` is ``span_key(doc_id, text)``."""
    texts = docs.select(
        span_key(F.col("doc_id"), F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )
    windows = F.when(F.size("base") > 0, _windows(F.col("text"), F.col("base"), config.window))
    found = stage(with_base_spans(texts, "text", "base").select("key", windows.alias("windows")), "pii-found")
    terms = stage(disclosing_terms(found, texts, config), "pii-disclosing")
    return None if terms.isEmpty() else stage(_term_spans(texts, terms, config), "pii-terms-found")


def span_key(doc_id: Column, text: Column) -> Column:
    """Rows that agree in id and text share a key (128 bits of hash beside the id)."""
    value = F.coalesce(text, F.lit("")).cast("binary")
    return F.concat_ws(":", doc_id.cast("string"), F.md5(value))


def _merged(spans: Column) -> Column:
    """Sorted spans, overlapping ones as one with the kind of the first."""

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(
            last["start"], last["rank"], last["kind"], F.greatest(last["stop"], s["stop"]).alias("stop"), last["value"]
        )
        overlaps = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] > s["start"])
        return F.when(overlaps, F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, s))

    return F.aggregate(spans, F.array().cast(_SPAN), add)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: identifiers by their kind, terms by ``action``."""
    merged = _merged(spans)

    def put(acc: Column, s: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(
            s["value"] == "generalise", F.lit("[TERM]")
        ).otherwise(F.lit(""))
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], kept, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(merged, start, put, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def with_spans(docs: DataFrame, base: str, extra: str, config: DisclosureConfig = DisclosureConfig()) -> DataFrame:
    """``docs`` with its base and extra spans (arrays), one row for each of its rows.

    Base spans are found row by row, once for the statistics and once here, so that no
    text has to be shuffled for them; only spans of disclosing terms are joined, if any.
    """
    none = F.array().cast(_SPAN)
    extras = term_spans(docs, config)
    text, key, found_key = (fresh(docs, n) for n in ("_span_text", "_span_key", "_found_key"))
    based = with_base_spans(docs.withColumn(text, F.coalesce("text", F.lit(""))), text, base).drop(text)
    if extras is None:
        return based.withColumn(extra, none)
    extras = extras.select(F.col("key").alias(found_key), F.col("extra").alias(extra))
    return (
        based.withColumn(key, span_key(F.col("doc_id"), F.col("text")))
        .join(size_checked_broadcast(extras, config.max_broadcast_terms), F.col(key) == F.col(found_key), "left")
        .drop(key, found_key)
        .withColumn(extra, F.coalesce(extra, none))
    )


def pii_digest(docs: DataFrame, config: DisclosureConfig = DisclosureConfig()) -> DataFrame:
    found = with_spans(docs.select("doc_id", "text"), "base", "extra", config).drop("text")
    kinds = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *kinds,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def sanitise(docs: DataFrame, config: DisclosureConfig = DisclosureConfig()) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (and ``n_chars`` counted anew, if present)."""
    base, extra = fresh(docs, "_base"), fresh(docs, "_extra")
    found = with_spans(docs, base, extra, config)
    cleaned = sanitised(F.col("text"), F.array_sort(F.concat(base, extra)))
    changed = found.withColumn("text", F.when(F.col("text").isNotNull(), cleaned))
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.size(base) + F.size(extra) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
