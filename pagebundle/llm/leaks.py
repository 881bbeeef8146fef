"""Benchmark decontamination by winnowing: shared fingerprints are joined and extended to spans.

A document and a benchmark item share a span if ``window`` words (10) in a row are equal.
Every text is cut into grams of ``gram`` words (5); of each ``window - gram + 1`` grams in
a row the one with the least hash is kept, the last of equal ones. Which gram that is
depends on the ``window`` words under it alone, so two texts that share ``window`` words
keep the same gram there: no shared span of that length can be missed. Kept grams carry
the ``window - gram`` words to each side. After the join on the hash the grams and these
words are compared as texts, outwards word by word; a run of ``window`` equal words or
more is a hit. So hash collisions cannot make a hit, and texts never travel.

An item of fewer words than ``window`` is one window as a whole. Winnowing promises
nothing for these: their lengths (fewer than ``window`` different ones) are looked up at
every place of the documents.

Documents drop grams that no item has before anything leaves the task: a bitmap of
``1 << filter_bits`` bits, whatever the size of the benchmark, says which hashes can
occur. Items of equal words are one class until the end, documents of equal texts one
key (MD5 of the text), so a group of copies is one entry on both sides.

Defined cases: A-Z are lower-cased, a word is a run of a-z, 0-9 and all characters from
U+0080. Null and empty texts have no words and no hits; items without words hit nothing.
Repeated rows get their result each. Items that share an id count once; an item without
id hits words but is not counted among the items. Other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagebundle.llm.common import fresh, hash_bitmap, may_hold, short_batches, stage

SEED = 42
#: hashes of words that a worker remembers
REMEMBERED = 500_000

_PRINTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("kinds", T.ArrayType(T.IntegerType())),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("grams", T.ArrayType(T.StringType())),
        T.StructField("lefts", T.ArrayType(T.StringType())),
        T.StructField("rights", T.ArrayType(T.StringType())),
    ]
)


def _spaced() -> bytes:
    """A table for bytes.translate: letters lower-cased, all that parts words a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


def words_of(text: str | None, spaced: bytes = _spaced()) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(spaced).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def gram_hashes(words: np.ndarray, size: int, kind: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, from the words' own hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, 2 * kind + 1, dtype=np.uint64)
    for j in range(size):
        total = (total + words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def winnowed(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of every ``span`` in a row, the last of equal ones."""
    if len(hashes) < span:
        return np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], span)
    places = len(hashes) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1))
    return np.unique(places)


def fingerprints(
    words: list[bytes], known: _Hashes, window: int, gram: int, short: list[int], may_occur: np.ndarray | None, whole: bool
) -> list[tuple[int, int, int, bytes, bytes, bytes]]:
    """(kind, hash, start, gram, words before it from near to far, words after it) of one text.

    Kind 0 is a winnowed gram, kind n all grams of n words for n in ``short``, or with
    ``whole`` a text of n words itself.
    """
    n = len(words)
    values = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    found = []
    sizes = ([n] if 0 < n < window else []) if whole else short
    for kind in [0, *sizes]:
        size = kind or gram
        hashes = gram_hashes(values, size, kind)
        places = np.arange(len(hashes)) if kind else winnowed(hashes, window - gram + 1)
        if may_occur is not None and len(places):
            places = places[may_hold(may_occur, hashes[places])]
        around = 0 if kind else window - gram
        for p in places.tolist():
            found.append(
                (
                    kind, int(hashes[p].view(np.int64)), p, b" ".join(words[p : p + size]),
                    b" ".join(words[max(0, p - around) : p][::-1]), b" ".join(words[p + size : p + size + around]),
                )
            )
    return found


def _printer(window: int, gram: int, short: list[int], filter_bytes, whole: bool):
    @F.pandas_udf(_PRINTS)
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        may_occur = None if filter_bytes is None else np.frombuffer(filter_bytes.value, dtype=np.uint64)
        known = _Hashes()
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                found = fingerprints(words, known, window, gram, short, may_occur, whole)
                columns = list(zip(*found)) if found else [()] * 6
                rows.append((len(words), *map(list, columns[:3]), *([w.decode("utf-8", "replace") for w in c] for c in columns[3:])))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame(rows, columns=_PRINTS.names)

    return prints


def _exploded(prints: DataFrame, *keys: str) -> DataFrame:
    each = F.explode(F.arrays_zip(*[f"p.{c}" for c in _PRINTS.names[1:]])).alias("g")
    return prints.select(*keys, each).select(
        *keys,
        *[F.col(f"g.{c}").alias(n) for c, n in zip(_PRINTS.names[1:], ("kind", "hash", "start", "gram", "before", "after"))],
    )


def text_key(text: Column | str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _equal_words(one: str, two: str) -> Column:
    """How many words two space-joined lists have in common from their start."""
    x, y = (f"filter(split({c}, ' '), w -> w <> '')" for c in (one, two))
    return F.expr(
        f"aggregate(zip_with({x}, {y}, (a, b) -> a <=> b), named_struct('n', 0, 'on', true),"
        " (s, e) -> named_struct('n', s.n + if(s.on and e, 1, 0), 'on', s.on and e), s -> s.n)"
    )


def shared_spans(
    docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, filter_bits: int = 24
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``docs`` (doc_id, text) share with ``items`` (item_id, text), as three tables.

    prints: doc_id, key, n_words for every row of ``docs``; spans: key, start, stop (words of
    the text, stop exclusive, at least a window), item_class; members: item_class, item_id.
    """
    if not 0 < gram < window:
        raise ValueError("a gram must be shorter than the window")
    short_batches(docs.sparkSession)
    item_prints = _printer(window, gram, [], None, True)
    read = stage(
        items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).select("item_id", text_key("text").alias("item_class"), item_prints("text").alias("p")),
        "leak-items",
    )
    grams = stage(_exploded(read.dropDuplicates(["item_class"]), "item_class"), "leak-item-grams")
    short = sorted(r["kind"] for r in grams.where("kind > 0").select("kind").distinct().collect())  # fewer than window
    doc_prints = _printer(window, gram, short, hash_bitmap(grams, "hash", filter_bits), False)
    prints = stage(docs.select("doc_id", text_key("text").alias("key"), doc_prints("text").alias("p")), "leak-prints")
    theirs = grams.select(
        "item_class", "kind", "hash", F.col("gram").alias("_gram"), F.col("before").alias("_before"), F.col("after").alias("_after")
    )
    met = (
        _exploded(prints.where(F.size("p.hashes") > 0), "key")
        .join(theirs, ["kind", "hash"])
        .where("gram = _gram")
        .withColumn("left", _equal_words("before", "_before"))
        .withColumn("right", _equal_words("after", "_after"))
        .where(F.expr(f"kind > 0 or left + {gram} + right >= {window}"))
    )
    size = F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(gram))
    spans = met.select(
        "key", (F.col("start") - F.col("left")).alias("start"), (F.col("start") + size + F.col("right")).alias("stop"), "item_class"
    ).distinct()
    return prints.select("doc_id", "key", F.col("p.n_words").alias("n_words")), stage(spans, "leak-spans"), read.select("item_class", "item_id").distinct()


def leak_digest(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    prints, spans, members = shared_spans(docs.select("doc_id", "text"), items.select("item_id", "text"), window)
    hit = (
        spans.select("key", "start", "stop").distinct()
        .select("key", F.explode(F.sequence("start", F.col("stop") - 1)).alias("word"))
        .distinct()
        .groupBy("key").agg(F.count("*").alias("n_hit"))
    )
    listed = (
        spans.select("key", "item_class").distinct()
        .join(members.where("item_id is not null"), "item_class")
        .groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    found = stage(hit.join(listed, "key", "left"), "leak-found")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return prints.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``max_share`` are hit, with all their columns."""
    prints, spans, _ = shared_spans(docs.select("doc_id", "text"), items, window)
    key = fresh(docs, "key")
    hit = (
        spans.select("key", F.explode(F.sequence("start", F.col("stop") - 1)).alias("word")).distinct()
        .groupBy("key").agg(F.count("*").alias("n_hit"))
    )
    words = prints.groupBy("key").agg(F.min("n_words").alias("n_words"))
    bad = stage(hit.join(words, "key").where(F.col("n_hit") > F.col("n_words") * max_share).select(F.col("key").alias(key)), "leak-bad")
    return docs.join(bad, text_key(docs["text"]) == F.col(key), "left_anti")


_WORDS_SQL = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: ``leak_digest`` in DuckDB, by looking up every window of every item at every word.
LEAKS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, {_WORDS_SQL.format(text="coalesce(text, '')")} AS w FROM documents
),
i AS (SELECT item_id, {_WORDS_SQL.format(text="coalesce(text, '')")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT k, p, size, array_to_string(w[p : p + size - 1], ' ') AS gram
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
),
met AS (SELECT k, p, dw.size AS size, item_id FROM dw JOIN iw USING (gram, size)),
hit AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + size)) AS q FROM met) GROUP BY k),
ids AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM met WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN ids USING (k)
"""
