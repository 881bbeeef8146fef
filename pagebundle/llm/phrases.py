"""Phrase collocations from lossless counts in quotient filters.

Words have 64-bit ids (XXH64 of word and language under a seed). The table of words is
searched for two words with one id; if there are any, the next seed is taken, so ids
stand for words exactly. An n-gram is its ids in a row. A Feistel permutation of these
64, 128 or 192 bits can be undone; its first bits are the quotient, all other bits the
remainder. A filter holds, quotient by quotient, the sorted remainders with their
counts: nothing is approximate. Each task fills filters of at most ``entries`` n-grams
and writes them out by quotient; sorted filters of one quotient are merged where Spark
has brought them together. The permutation spreads n-grams evenly, a frequent one is one
entry of a filter, and the number of quotients follows the number of words, so no merge
grows with the corpus.

A phrase found ``least`` times (10) has only words and shorter phrases found as often.
So words are counted first, then pairs of frequent words, then triples of frequent pairs.
What is frequent reaches the tasks as a bitmap of fixed size; a bit set for nothing costs
an entry, never a count.

A candidate (two or three words, found ``least`` times or more) is cut in two parts in
each way, scored as millionths of a*a / (l*r) and keeps its lowest score (of equal ones
the first cut). Candidates within a longer one found at least half as often are dropped.

Defined cases: A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at space
and tab. Null and empty texts have no words; a null language is ``und``. Repeated rows
count as often as they occur. A language without candidates has no rows. Other columns
do no harm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagebundle.llm.common import hash_bitmap, may_hold, short_batches, size_checked_broadcast, stage

#: word ids that a worker remembers
REMEMBERED = 500_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _pieces() -> bytes:
    """A table for bytes.translate: A-Z lower-cased, a full stop for each end of a piece, tab a space."""
    table = bytearray(range(256))
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    for c in b",;:!?\n\x0b\x0c\r":
        table[c] = ord(".")
    table[ord("\t")] = ord(" ")
    return bytes(table)


def words_of(text: str | None, pieces: bytes = _pieces()) -> list[bytes]:
    """Words in order, with a word ``.`` for the end of a piece."""
    if not text:
        return []
    # Space and the full stop are all that parts words here: \n, \v, \f, \r and tab are gone.
    return text.encode("utf-8", "surrogatepass").translate(pieces).replace(b".", b" . ").split()


def word_id(lang: str, word: bytes, seed: int) -> int:
    """Never 0, which stands for the end of a piece."""
    if word == b".":
        return 0
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)) or 1


class _Ids(dict):
    def __init__(self, lang: str, seed: int) -> None:
        super().__init__()
        self.lang, self.seed = lang, seed

    def __missing__(self, word: bytes) -> int:
        self[word] = value = word_id(self.lang, word, self.seed)
        return value


def _stir(*limbs: np.ndarray) -> np.ndarray:
    total = limbs[0] * _MIX[0]
    for limb in limbs[1:]:
        total = (total ^ (total >> np.uint64(31))) * _MIX[1] + limb
    total ^= total >> np.uint64(27)
    total *= _MIX[1]
    return total ^ (total >> np.uint64(31))


def permuted(limbs: list[np.ndarray]) -> list[np.ndarray]:
    """A permutation of all keys of as many 64-bit limbs (Feistel rounds)."""
    limbs = list(limbs)
    for r in range(2 * len(limbs)):
        i = r % len(limbs)
        rest = limbs[:i] + limbs[i + 1 :]
        limbs[i] = limbs[i] ^ _stir(*rest) if rest else limbs[i]
    return limbs


def restored(limbs: list[np.ndarray]) -> list[np.ndarray]:
    """What ``permuted`` was given."""
    limbs = list(limbs)
    for r in reversed(range(2 * len(limbs))):
        i = r % len(limbs)
        rest = limbs[:i] + limbs[i + 1 :]
        limbs[i] = limbs[i] ^ _stir(*rest) if rest else limbs[i]
    return limbs


def summed(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in ascending order with the sums of their counts."""
    if not len(counts):
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable")
    limbs = [x[order] for x in limbs]
    same_first = limbs[0][1:] == limbs[0][:-1]
    other = np.zeros(len(same_first), dtype=bool)
    for x in limbs[1:]:
        other |= x[1:] != x[:-1]
    if (same_first & other).any():  # different keys with one first limb
        again = np.lexsort(limbs[::-1])
        limbs, order = [x[again] for x in limbs], order[again]
        same_first = limbs[0][1:] == limbs[0][:-1]
        other = np.zeros(len(same_first), dtype=bool)
        for x in limbs[1:]:
            other |= x[1:] != x[:-1]
    starts = np.flatnonzero(np.concatenate(([True], ~same_first | other)))
    return [x[starts] for x in limbs], np.add.reduceat(counts[order], starts)


class QuotientFilter:
    """Counts of keys of several limbs, held permuted and sorted: quotient, then remainder."""

    def __init__(self, limbs: int, quotient_bits: int) -> None:
        self.quotient_bits = quotient_bits
        self.limbs = [np.zeros(0, dtype=np.uint64)] * limbs
        self.counts = np.zeros(0, dtype=np.int64)
        self.runs: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.counts) + self.waiting

    def add(self, keys: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        if len(keys[0]):
            run = summed(permuted(keys), np.ones(len(keys[0]), dtype=np.int64) if counts is None else counts)
            self.runs.append(run)
            self.waiting += len(run[1])
            if self.waiting > max(len(self.counts), 100_000):
                self.merge()

    def merge(self) -> None:
        """Sorted runs become one."""
        runs = [(self.limbs, self.counts), *self.runs]
        self.limbs, self.counts = summed(
            [np.concatenate([r[0][i] for r in runs]) for i in range(len(self.limbs))], np.concatenate([r[1] for r in runs])
        )
        self.runs, self.waiting = [], 0

    def slices(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(quotient, remainders, counts) of every quotient with entries."""
        self.merge()
        if not len(self.counts):
            return
        left = np.uint64(64 - self.quotient_bits)
        quotients = self.limbs[0] >> left if self.quotient_bits else np.zeros(len(self.counts), dtype=np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], quotients[1:] != quotients[:-1])))
        remainder = [self.limbs[0] & np.uint64((1 << (64 - self.quotient_bits)) - 1), *self.limbs[1:]]
        for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(quotients)]):
            yield int(quotients[start]), b"".join(x[start:stop].tobytes() for x in remainder), self.counts[start:stop].tobytes()


def merged_slices(quotient: int, quotient_bits: int, limbs: int, slices: list[tuple[bytes, bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Original keys and total counts of the slices of one quotient."""
    parts = [np.frombuffer(r, dtype=np.uint64).reshape(limbs, -1) for r, _ in slices]
    keys, counts = summed(
        [np.concatenate([p[i] for p in parts]) for i in range(limbs)], np.concatenate([np.frombuffer(c, dtype=np.int64) for _, c in slices])
    )
    keys[0] = keys[0] | np.uint64(quotient << (64 - quotient_bits) if quotient_bits else 0)
    return restored(keys), counts


def _batch_ids(batch: pd.DataFrame, known: dict[str, _Ids]) -> np.ndarray:
    """Ids of all words of a batch; 0 between pieces and texts."""
    if sum(map(len, known.values())) > REMEMBERED:
        known.clear()
    parts = [np.zeros(1, dtype=np.uint64)]
    for lang, text in zip(batch["lang"], batch["text"]):
        if words := words_of(text):
            parts += [np.fromiter(map(known[lang].__getitem__, words), np.uint64, len(words)), parts[0]]
    return np.concatenate(parts)


class _Known(defaultdict):
    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, lang: str) -> _Ids:
        self[lang] = ids = _Ids(lang, self.seed)
        return ids


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, f: how often each word occurs."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, totals = _Known(seed), {}

        def rows() -> pd.DataFrame:
            table = [
                (lang, word.decode("utf-8", "replace"), np.uint64(ids[word]).view(np.int64), n)
                for lang, (ids, counts) in totals.items()
                for word, n in counts.items()
            ]
            totals.clear()
            return pd.DataFrame(table, columns=["lang", "word", "id", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                ids, counts = totals.setdefault(lang, (known[lang], defaultdict(int)))
                for word in words_of(text):
                    counts[word] += 1
            if sum(len(c) for _, c in totals.values()) > REMEMBERED:
                for lang, (ids, counts) in totals.items():
                    counts.pop(b".", None)
                    for word in counts:
                        ids[word]
                yield rows()
                known.clear()
        for lang, (ids, counts) in totals.items():
            counts.pop(b".", None)
            for word in counts:
                ids[word]
        yield rows()

    parts = texts.mapInPandas(counted, "lang string, word string, id long, n long")
    return parts.groupBy("lang", "word", "id").agg(F.sum("n").alias("f"))


def count_phrases(texts: DataFrame, size: int, seed: int, frequent, quotient_bits: int, least: int, entries: int) -> DataFrame:
    """i1 .. i<size>, key (the first permuted limb), f: phrases found ``least`` times or more.

    ``frequent``: bitmaps of what each phrase must consist of: frequent words, then frequent
    shorter phrases by their ``key``.
    """

    def filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmaps = [np.frombuffer(b.value, dtype=np.uint64) for b in frequent]
        known, held = _Known(seed), QuotientFilter(size, quotient_bits)

        def rows() -> Iterator[pd.DataFrame]:
            table = list(held.slices())
            for i in range(0, len(table), 256):
                yield pd.DataFrame(table[i : i + 256], columns=["quotient", "remainders", "counts"])

        for batch in batches:
            ids = _batch_ids(batch, known)
            good = (ids != 0) & may_hold(bitmaps[0], ids)
            for shorter, bitmap in enumerate(bitmaps[1:], 2):
                # A phrase of `shorter` words starts here and is frequent.
                good = good[:-1] & good[1:]
                at = np.flatnonzero(good)
                key = permuted([ids[at + i] for i in range(shorter)])[0]
                good[at] = may_hold(bitmap, key)
            at = np.flatnonzero(good[:-1] & good[1:])
            held.add([ids[at + i] for i in range(size)])
            if len(held) > entries:
                yield from rows()
                held = QuotientFilter(size, quotient_bits)
        yield from rows()

    def merged(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
        ids, counts = merged_slices(key[0], quotient_bits, size, list(zip(slices["remainders"], slices["counts"])))
        often = counts >= least
        ids = [x[often] for x in ids]
        first = permuted(ids)[0]
        return pd.DataFrame({f"i{k + 1}": x.view(np.int64) for k, x in enumerate(ids)} | {"key": first.view(np.int64), "f": counts[often]})

    schema = ", ".join([*[f"i{k + 1} long" for k in range(size)], "key long", "f long"])
    return texts.mapInPandas(filters, "quotient long, remainders binary, counts binary").groupBy("quotient").applyInPandas(merged, schema)


def _score(a: str, left: str, right: str) -> Column:
    wide = "cast({} as decimal(18,0))"
    a, left, right = (wide.format(c) for c in (a, left, right))
    return F.expr(f"(cast({a} * {a} as decimal(31,0)) * 1000000) div cast({left} * {right} as decimal(36,0))")


def collocations(
    docs: DataFrame, least: int = 10, percent: int = 50, entries: int = 2_000_000, filter_bits: int = 26, max_broadcast: int = 500_000
) -> DataFrame:
    """lang, phrase, a, l, r, n, score: every candidate that is not part of a longer one as frequent.

    ``docs``: lang, text; read three times.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    seed = 0
    while True:
        words = stage(count_words(texts, seed), "phrase-words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    quotient_bits = max(4, min(32, (total >> 18).bit_length()))
    often = stage(words.where(F.col("f") >= least), "phrase-often")
    known = [hash_bitmap(often, "id", filter_bits)]
    pairs = stage(count_phrases(texts, 2, seed, known, quotient_bits, least, entries), "phrase-pairs")
    known.append(hash_bitmap(pairs, "key", filter_bits))
    triples = stage(count_phrases(texts, 3, seed, known, quotient_bits, least, entries), "phrase-triples")

    small = size_checked_broadcast(often, max_broadcast)

    def word(i: int) -> DataFrame:
        return small.select(F.col("id").alias(f"i{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))

    def pair(i: int) -> DataFrame:
        return size_checked_broadcast(pairs, max_broadcast).select(F.col("i1").alias(f"i{i}"), F.col("i2").alias(f"i{i + 1}"), F.col("f").alias(f"f{i}{i + 1}"))

    longer = (
        triples.select("i1", "i2", "f").union(triples.select("i2", "i3", "f"))
        .groupBy("i1", "i2").agg(F.max("f").alias("longer"))
    )
    two = (
        pairs.join(longer, ["i1", "i2"], "left")
        .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * percent))
        .join(word(1), "i1").join(word(2), "i2")
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", _score("a", "l", "r"))
    )
    three = (
        triples.join(word(1), "i1").join(word(2), "i2").join(word(3), "i3")
        .join(pair(1), ["i1", "i2"]).join(pair(2), ["i2", "i3"])
        .withColumn("s1", _score("f", "f1", "f23")).withColumn("s2", _score("f", "f12", "f3"))
    )
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
        F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    return two.unionByName(three).join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def phrase_digest(docs: DataFrame, top: int = 2_000) -> DataFrame:
    """The ``top`` collocations of every language by score."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: ``phrase_digest`` in DuckDB, counting every phrase as a text.
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS k,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[p : p + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM split, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size)
),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT *, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : size], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
),
scored AS (
  SELECT cut.*, fx.f AS l, fy.f AS r, ((1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f))::BIGINT AS score
  FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a AS f FROM c WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM c WHERE size = 3
  ) GROUP BY ALL
),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE inside.f IS NULL OR size = 3 OR 100 * inside.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
