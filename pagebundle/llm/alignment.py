"""Alignment of two tokenizers by a monoid of fragments over byte ranges.

Two encodings of one text end in tokens of the same bytes. Where tokens of both end at
the same byte the text is cut; between two cuts lies a group, the smallest stretch that
both spell with whole tokens. A byte range of a text gives a fragment: the tokens up to
its first cut (an open prefix, whose group may have begun earlier), the closed groups
between its cuts, and the tokens after its last cut (an open suffix). ``compose`` joins
two neighbouring fragments: suffix and prefix meet in one group. It is associative, so
ranges may be reduced in any tree. A text of up to ``range_bytes`` is one range and done
in the task that encodes it. The ranges of longer texts become rows, are aligned where
Spark puts them, and are composed ``fan`` at a time, level by level, one shuffle each;
no task ever holds more than ``fan`` fragments of a text at once.

Encoding: neither tokenizer lets a token cross the place between a character that is no
white space and a space after it. So texts are split there, each distinct chunk is
encoded once per task and remembered (up to ``REMEMBERED`` chunks), and long texts are
encoded in their chunks. Whether the second vocabulary keeps this rule is checked on its
pieces; if it does not, texts are encoded as a whole.

Counts of linked id pairs are summed per batch, then by Spark. A text keeps its distinct
pairs with their numbers, which meet the table of pairs by a broadcast up to
``max_pairs`` distinct pairs, beyond that the frequent half-million by a broadcast and
the others by a shuffle.

Defined cases: null and empty texts have no tokens, nor has a text whose bytes either
encoding does not give back. Repeated rows each get their result and count as often as
they occur. Other columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagebundle.llm.common import short_batches, stage

#: chunks that a worker remembers, and characters of texts it encodes together
REMEMBERED = 400_000
TEXTS_CHARS = 2_000_000
#: A space and what follows, up to a space after a character that is no white space.
CHUNKS = re.compile(r"\x20*[^\x20]+(?:(?<=[^\S\x1c-\x1f])\x20+[^\x20]*)*|\x20+")
_NO_IDS = np.zeros(0, dtype=np.int32)


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Numbers(dict):
    """Numbers chunks in the order they come."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


class _Kept:
    """Lists of ids in one array."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes = _NO_IDS, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def extend(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))))
        self.sizes = np.concatenate((self.sizes, sizes))

    def joined(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes[at]
        stops = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - stops + sizes, sizes) + np.arange(stops[-1])]

    def only(self, at: np.ndarray) -> _Kept:
        kept = _Kept()
        kept.sizes = self.sizes[at]
        kept.starts = np.cumsum(kept.sizes) - kept.sizes
        kept.flat = self.joined(at) if len(at) else _NO_IDS
        return kept


class Encoders:
    """Both tokenizers in a worker, with what they made of earlier chunks."""

    def __init__(self, json_text: str, model: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_text)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            # Special tokens are not byte-level; they never occur in an encoding.
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b_bytes = []
        crossing = False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            crossing |= not self.b.is_control(i) and re.search("[^▁]▁", piece) is not None
        self.by_chunk = not crossing
        self.a_len = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_len = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self._mark = self.b.encode("a")
        self.known, self.a_kept, self.b_kept = _Numbers(), _Kept(), _Kept()
        self.good, self.uses = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        """Keeps the chunks that several texts had, if they are not too many."""
        often = np.flatnonzero(self.uses > 1)
        if len(often) > REMEMBERED // 2:
            often = often[:0]
        chunks = list(self.known)
        self.known = _Numbers((chunks[k], i) for i, k in enumerate(often.tolist()))
        self.a_kept, self.b_kept = self.a_kept.only(often), self.b_kept.only(often)
        self.good, self.uses = self.good[often], np.zeros(len(often), dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        encoded = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # The model adds a space of its own; "a" before a single space keeps it.
        pieces = self.b.encode([c[1:] if len(c) > 1 else "a" + c for c in chunks], num_threads=1)
        pieces = [p if len(c) > 1 else p[len(self._mark) :] for c, p in zip(chunks, pieces)]
        one, two = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [
            b"".join(map(one, a)) == c.encode("utf-8", "surrogatepass") == b"".join(map(two, b))
            for c, a, b in zip(chunks, encoded, pieces)
        ]
        self.a_kept.extend(encoded)
        self.b_kept.extend(pieces)
        self.good = np.concatenate((self.good, good))
        self.uses = np.concatenate((self.uses, np.zeros(len(chunks), dtype=np.int64)))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for a space and each text; none if either does not give its bytes back."""
        done = 0
        while done < len(texts):
            if len(self.known) > REMEMBERED:
                self._forget()
            learned, numbers, chars = len(self.known), [], 0
            while done < len(texts) and chars < TEXTS_CHARS:
                text = texts[done] or ""
                chunks = [] if not text else CHUNKS.findall(" " + text) if self.by_chunk else [" " + text]
                numbers.append(np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks)))
                chars += len(text)
                done += 1
            if len(self.known) > learned:
                self._learn(list(islice(self.known, learned, None)))
            for at in numbers:
                self.uses[at] += 1
                ok = len(at) and self.good[at].all()
                yield (self.a_kept.joined(at), self.b_kept.joined(at)) if ok else (_NO_IDS, _NO_IDS)


class Fragment(NamedTuple):
    """A byte range: tokens before its first cut, closed groups, tokens after its last cut.

    Without a cut all tokens are in the prefix and ``cut`` is false.
    """

    cut: bool
    prefix_a: np.ndarray
    prefix_b: np.ndarray
    suffix_a: np.ndarray
    suffix_b: np.ndarray
    n_groups: int
    n_links: int
    groups: str
    pairs: np.ndarray
    times: np.ndarray


EMPTY = Fragment(False, _NO_IDS, _NO_IDS, _NO_IDS, _NO_IDS, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def counted(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(pairs, return_counts=True)
    kinds, at = np.unique(pairs, return_inverse=True)
    totals = np.zeros(len(kinds), dtype=np.int64)
    np.add.at(totals, at, times)
    return kinds, totals


class Aligner:
    """Makes and composes fragments; knows the tokens' lengths and how ids are written."""

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray) -> None:
        self.a_len, self.b_len = a_len, b_len
        a, b = ([str(i) for i in range(len(x))] for x in (a_len, b_len))
        #: an id with what follows it: within its group, and at the end of its group's half
        self.written = [*(x + "," for x in a), *(x + "|" for x in a), *(x + "," for x in b), *(x + ";" for x in b)]

    def closed(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray) -> tuple:
        """(n_groups, n_links, groups, pairs, times) of tokens whose ends are ``cuts`` or lie between."""
        if not len(cuts):
            return EMPTY[5:]
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        # Both halves of a group follow each other: a token moves by those of the other kind before it.
        a_count = np.searchsorted(a_group, np.arange(len(cuts)), side="right")
        b_count = np.searchsorted(b_group, np.arange(len(cuts)), side="right")
        b_before = np.concatenate(([0], b_count))
        code = np.empty(len(a) + len(b), dtype=np.int64)
        na, nb = len(self.a_len), len(self.b_len)
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_count - 1], b_last[b_count - 1] = na, nb
        code[np.arange(len(a)) + b_before[a_group]] = a + a_last
        code[np.arange(len(b)) + a_count[b_group]] = 2 * na + b + b_last
        groups = "".join(map(self.written.__getitem__, code.tolist()))[:-1]
        a_starts, b_starts = a_ends - self.a_len[a], b_ends - self.b_len[b]
        first = np.searchsorted(b_ends, a_starts, side="right")
        last = np.searchsorted(b_starts, a_ends, side="left")
        links = last - first
        total = int(links.sum())
        partner = np.arange(total) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
        pairs = np.repeat(a.astype(np.int64), links) << 32 | b[partner]
        return (len(cuts), total, groups, *counted(pairs))

    def fragment(self, a: np.ndarray, b: np.ndarray, a_from: int, b_from: int) -> Fragment:
        """The fragment of the tokens that end in a range; ``a_from`` and ``b_from``: where their first ones start.

        The start of a text is a cut, so its first range has no open prefix.
        """
        a_ends, b_ends = a_from + np.cumsum(self.a_len[a]), b_from + np.cumsum(self.b_len[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if a_from == b_from == 0:
            cuts = np.concatenate(([0], cuts))
        if not len(cuts):
            return EMPTY._replace(prefix_a=a, prefix_b=b)
        i, j = (int(np.searchsorted(e, cuts[0], side="right")) for e in (a_ends, b_ends))
        k, m = (int(np.searchsorted(e, cuts[-1], side="right")) for e in (a_ends, b_ends))
        return Fragment(
            True, a[:i], b[:j], a[k:], b[m:], *self.closed(a[i:k], b[j:m], a_ends[i:k], b_ends[j:m], cuts[1:])
        )

    def group(self, a: np.ndarray, b: np.ndarray) -> Fragment:
        """One closed group (none without tokens), with a cut on both sides."""
        if not len(a):
            return EMPTY._replace(cut=True)
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        return Fragment(True, _NO_IDS, _NO_IDS, _NO_IDS, _NO_IDS, *self.closed(a, b, a_ends, b_ends, a_ends[-1:]))

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        """The fragment of two neighbouring ranges; associative, EMPTY is neutral."""
        join = lambda one, two: np.concatenate((one, two)).astype(np.int32)
        if not x.cut:
            return y._replace(prefix_a=join(x.prefix_a, y.prefix_a), prefix_b=join(x.prefix_b, y.prefix_b))
        a, b = join(x.suffix_a, y.prefix_a), join(x.suffix_b, y.prefix_b)
        if not y.cut:
            return x._replace(suffix_a=a, suffix_b=b)
        seam = self.group(a, b)
        parts = [p for p in (x, seam, y) if p.n_groups]
        pairs, times = counted(np.concatenate([p.pairs for p in parts]), np.concatenate([p.times for p in parts])) if parts else EMPTY[8:]
        return Fragment(
            True, x.prefix_a, x.prefix_b, y.suffix_a, y.suffix_b, sum(p.n_groups for p in parts),
            sum(p.n_links for p in parts), ";".join(p.groups for p in parts), pairs, times,
        )

    def ranges(self, a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """(number, tokens of a, tokens of b, their first starts) of each ``size`` bytes; tokens belong where they end."""
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        stops = np.arange(size, int(a_ends[-1]) + size, size)
        i, j = np.searchsorted(a_ends, stops, side="right"), np.searchsorted(b_ends, stops, side="right")
        i0, j0 = np.concatenate(([0], i[:-1])), np.concatenate(([0], j[:-1]))
        start = lambda ends, at: int(ends[at - 1]) if at else 0
        return [
            (n, a[p:q], b[r:s], start(a_ends, p), start(b_ends, r))
            for n, (p, q, r, s) in enumerate(zip(i0.tolist(), i.tolist(), j0.tolist(), j.tolist()))
        ]


_IDS = "array<int>"
_FRAGMENT = "n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
_OPEN = f"cut boolean, prefix_a {_IDS}, prefix_b {_IDS}, suffix_a {_IDS}, suffix_b {_IDS}, {_FRAGMENT}"
_ENCODED = f"n_a long, n_b long, {_FRAGMENT}, ranges array<struct<part: int, a: {_IDS}, b: {_IDS}, a_from: long, b_from: long>>"


class _Vocabularies:
    """Both vocabulary files, read on the driver (their size is that of the files) and broadcast."""

    def __init__(self, spark, json_path: str, model_path: str) -> None:
        with open(json_path, encoding="utf-8") as one, open(model_path, "rb") as two:
            self.shared = spark.sparkContext.broadcast((one.read(), two.read()))
        encoders = Encoders(*self.shared.value)
        self.lengths = (encoders.a_len, encoders.b_len)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _encoder(vocabularies: _Vocabularies, range_bytes: int, digests: bool):
    shared = vocabularies.shared

    @F.pandas_udf(_ENCODED)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = Encoders(*shared.value)
        aligner = Aligner(encoders.a_len, encoders.b_len)
        names = ["n_a", "n_b", *Fragment._fields[5:], "ranges"]
        for texts in batches:
            rows = []
            for a, b in encoders.encode(list(texts)):
                if len(a) and int(aligner.a_len[a].sum()) > range_bytes:
                    parts = [dict(zip(("part", "a", "b", "a_from", "b_from"), r)) for r in aligner.ranges(a, b, range_bytes)]
                    rows.append((len(a), len(b), 0, 0, "", [], [], parts))
                else:
                    f = aligner.fragment(a, b, 0, 0) if len(a) else EMPTY
                    rows.append((len(a), len(b), f.n_groups, f.n_links, _digest(f.groups) if digests else f.groups, f.pairs, f.times, []))
            yield pd.DataFrame(rows, columns=names)

    return encoded


def _reduced(long: DataFrame, lengths: tuple, fan: int, digests: bool) -> DataFrame:
    """row and the whole fragment of each text from its ranges (row, r), level by level."""

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(*lengths)
        for batch in batches:
            made = [
                aligner.fragment(np.asarray(a, dtype=np.int32), np.asarray(b, dtype=np.int32), a_from, b_from)
                for a, b, a_from, b_from in zip(batch["a"], batch["b"], batch["a_from"], batch["b_from"])
            ]
            yield pd.concat([batch[["row", "part"]].reset_index(drop=True), pd.DataFrame(made, columns=Fragment._fields)], axis=1)

    def composed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        aligner, total = Aligner(*lengths), EMPTY
        for values in parts.sort_values("part")[list(Fragment._fields)].itertuples(index=False):
            total = aligner.compose(total, Fragment(*(np.asarray(v) if isinstance(v, (list, np.ndarray)) else v for v in values)))
        return pd.DataFrame([(*key, *total)], columns=["row", "part", *Fragment._fields])

    schema = f"row long, part int, {_OPEN}"
    ranges = long.select("row", F.col("r.part").alias("part"), "r.a", "r.b", "r.a_from", "r.b_from")
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = stage(ranges.repartition(tasks, "row", "part").mapInPandas(fragments, schema), "align-fragments")
    most = level.agg(F.max("part")).first()[0]
    while most:
        level = stage(
            level.withColumn("parent", F.floor(F.col("part") / fan).cast("int")).groupBy("row", "parent").applyInPandas(composed, schema),
            "align-level",
        )
        most //= fan

    # Start and end of a text are cuts: nothing is open any more.
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)) if digests else F.col("groups")
    return level.select("row", "n_groups", "n_links", groups.alias("groups"), "pairs", "times")


def aligned(
    docs: DataFrame, json_path: str, model_path: str, range_bytes: int = 65_536, fan: int = 8, digests: bool = False
) -> DataFrame:
    """A table with row (a number), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    groups: decimal ids ``a1,a2|b1;a3|b2,b3`` in order, or with ``digests`` their SHA-256;
    pairs: the distinct linked id pairs (a << 32 | b) with their numbers of links.
    """
    short_batches(docs.sparkSession, 1_000)
    vocabularies = _Vocabularies(docs.sparkSession, json_path, model_path)
    encode = _encoder(vocabularies, range_bytes, digests)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    first = stage(numbered.select("row", "doc_id", encode("text").alias("e")).select("row", "doc_id", "e.*"), "align-encoded")
    names = ["row", "doc_id", "n_a", "n_b", *Fragment._fields[5:]]
    long = first.where(F.size("ranges") > 0)
    ranges = stage(long.select("row", F.explode("ranges").alias("r")), "align-ranges")
    if ranges.isEmpty():
        return first.select(*names)
    done = stage(_reduced(ranges, vocabularies.lengths, fan, digests), "align-reduced")
    short = first.where(F.size("ranges") == 0).select(*names)
    return short.unionByName(long.select("row", "doc_id", "n_a", "n_b").join(done, "row").select(*names))


def pair_table(texts: DataFrame) -> DataFrame:
    """pair, count, best (whether no pair of its b id is more frequent), of a table of ``aligned``."""
    counts = texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    counts = stage(counts, "align-counts").withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digest(docs: DataFrame, json_path: str, model_path: str, range_bytes: int = 65_536, fan: int = 8, max_pairs: int = 1_000_000) -> DataFrame:
    texts = aligned(docs.select("doc_id", "text"), json_path, model_path, range_bytes, fan, digests=True)
    pairs = stage(pair_table(texts), "align-pairs")
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    n = pairs.count()
    if n <= max_pairs:
        met = links.join(F.broadcast(pairs), "pair")
    else:
        # At most half of max_pairs pairs can be as frequent as this: they sum up to all links.
        often = pairs.agg(F.sum("count")).first()[0] // (max_pairs // 2) + 1
        hot = stage(pairs.where(F.col("count") >= often), "align-hot")
        met = links.join(F.broadcast(hot.select("pair", "count", "best")), "pair")
        rare = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(pairs.where(F.col("count") < often), "pair")
        met = met.unionByName(rare)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    return texts.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("groups").alias("groups_sha256"),
    )
