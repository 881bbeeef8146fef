"""Byte-level BPE with a rank queue kept in a hierarchical bitmap.

All new pre-tokens of a chunk of texts lie in one buffer as linked lists of tokens. Each
adjacent pair whose joined bytes are a token waits in the bucket of that token's rank;
a three-level bitmap over the ranks tells which buckets have entries, and find-first-set
on it gives the next rank. A popped bucket's entries are compared with the pair that now
starts at their position; those that no longer match are stale and skipped. The others
are merged together, left to right, and the pairs this creates are queued in turn. Since
pre-tokens are independent, serving all of them from one queue gives each its own merge
order: lowest rank first, then leftmost. A pre-token of n bytes costs O(n) queue steps,
however long it is. Where a merge of rank r can make a pair of lower rank (known from
the vocabulary), a pre-token's entries are taken up to the first that does, and the rest
wait until that lower pair is done.

Pre-tokens repeat, so their ids are remembered during a task, up to ``max_bytes``; beyond
that the memory starts anew (a matter of speed only).

Defined cases: a null text counts as empty and has no tokens. Special tokens are never
recognised, their strings are ordinary text. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagebundle.llm.common import fresh, short_batches

_NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank; the smallest non-empty rank by find-first-set."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[np.ndarray] | None] = [None] * ranks
        self.low = [0] * (ranks // 64 + 1)
        self.middle = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queues positions under their ranks (two arrays of equal length)."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        buckets = self.buckets
        start = 0
        for rank, end in zip(ranks[[0, *cuts]].tolist(), [*cuts, len(ranks)]):
            bucket = buckets[rank]
            if bucket is None:
                buckets[rank] = [positions[start:end]]
                self.low[rank >> 6] |= 1 << (rank & 63)
                self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
                self.top |= 1 << (rank >> 12)
            else:
                bucket.append(positions[start:end])
            start = end

    def pop_bucket(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        word = self.middle[i]
        j = i << 6 | (word & -word).bit_length() - 1
        word = self.low[j]
        rank = j << 6 | (word & -word).bit_length() - 1
        self.low[j] = word & (word - 1)
        if not self.low[j]:
            self.middle[i] &= ~(1 << (j & 63))
            if not self.middle[i]:
                self.top &= ~(1 << i)
        bucket, self.buckets[rank] = self.buckets[rank], None
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merges:
    """The vocabulary as a sorted table of (left token, right token) -> rank of the joined bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.ranks = ranks
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.values = np.array(values, dtype=np.int64)[order]
        #: tokens that take part in a merge of lower rank than their own
        left, right = self.keys // self.size, self.keys % self.size
        self.may_drop = np.zeros(self.size, dtype=bool)
        self.may_drop[left[self.values < left]] = True
        self.may_drop[right[self.values < right]] = True

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined pairs, -1 where the bytes are no token."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)


def _sorted_once(positions: np.ndarray) -> np.ndarray:
    positions = np.sort(positions)
    again = positions[1:] == positions[:-1]
    return positions[np.concatenate(([True], ~again))] if again.any() else positions


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Token ids of each (non-empty) pre-token."""
    known = [merges.ranks.get(p) for p in pieces]
    ids = [[r] if r is not None else [] for r in known]
    rest = [i for i, r in enumerate(known) if r is None]
    if not rest:
        return ids
    data = np.frombuffer(b"".join(pieces[i] for i in rest), dtype=np.uint8)
    lengths = np.array([len(pieces[i]) for i in rest])
    n, stops = len(data), np.cumsum(lengths)
    piece = np.repeat(np.arange(len(rest), dtype=np.int32), lengths)
    token = merges.byte_rank[data].astype(np.int32)
    following = np.arange(1, n + 1, dtype=np.int32)
    following[stops - 1] = _NONE
    previous = np.arange(-1, n - 1, dtype=np.int32)
    previous[stops - lengths] = _NONE
    pair = np.full(n, _NONE, dtype=np.int32)  # rank of the pair that starts here; -1 also once the token is gone
    alive = np.ones(n, dtype=bool)

    queue = RankQueue(merges.size)

    def requeue(at: np.ndarray) -> None:
        after = following[at]
        has = after != _NONE
        rank = np.full(len(at), _NONE)
        rank[has] = merges.joined(token[at[has]], token[after[has]])
        pair[at] = rank
        found = rank != _NONE
        queue.push_all(rank[found], at[found])

    def until_drop(rank: int, at: np.ndarray) -> np.ndarray:
        """Which entries can be merged at once: those up to a pre-token's first lower pair."""
        after, before = following[following[at]], previous[at]
        drops = np.zeros(len(at), dtype=bool)
        for side, left in ((after, False), (before, True)):
            has = side != _NONE
            for other in (token[side[has]], np.full(has.sum(), rank)):
                own = np.full(len(other), rank)
                made = merges.joined(other, own) if left else merges.joined(own, other)
                drops[has] |= (made != _NONE) & (made < rank)
        first = np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))
        earlier = np.cumsum(drops) - drops  # drops before this entry, all pre-tokens together
        return earlier == earlier[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]

    requeue(np.arange(n, dtype=np.int32))
    while (popped := queue.pop_bucket()) is not None:
        rank, entries = popped
        at = _sorted_once(entries)
        at = at[pair[at] == rank]  # the others are stale
        if len(at) > 1:
            waiting = at
            if (chained := following[at[:-1]] == at[1:]).any():
                # Overlapping pairs of a run: the 1st, 3rd, 5th ... are merged.
                index = np.arange(len(at))
                starts = np.concatenate(([True], ~chained))
                at = at[(index - np.maximum.accumulate(np.where(starts, index, 0))) % 2 == 0]
            if merges.may_drop[rank] and (piece[at[1:]] == piece[at[:-1]]).any():
                taken = at[until_drop(rank, at)]
                if len(taken) < len(at):
                    # Overlapping ones wait too: a lower pair may change which of them are next.
                    waiting = np.setdiff1d(waiting, taken, assume_unique=True)
                    queue.push_all(np.full(len(waiting), rank), waiting)
                    at = taken
        if not len(at):
            continue
        gone = following[at]
        after = following[gone]
        alive[gone] = False
        pair[gone] = _NONE
        token[at] = rank
        following[at] = after
        has = after != _NONE
        previous[after[has]] = at[has]
        before = previous[at]
        requeue(_sorted_once(np.concatenate((at, before[before != _NONE]))))

    flat, owner = token[alive].tolist(), piece[alive]
    ends = np.searchsorted(owner, np.arange(len(rest)), side="right").tolist()
    start = 0
    for i, end in zip(rest, ends):
        ids[i] = flat[start:end]
        start = end
    return ids


class _Numbers(dict):
    """Numbers texts in the order they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Tokenizer:
    """Encodes and decodes whole texts; holds what one worker remembers between batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_bytes: int = 64_000_000, chunk_chars: int = 2_000_000) -> None:
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.max_bytes, self.chunk_chars = max_bytes, chunk_chars
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.ids: list[str] = []
        self.counts: list[int] = []
        self.decoded: list[bytes] = []
        self.held = 0

    def _learn(self) -> None:
        new = list(self.number)[len(self.ids) :] if len(self.number) > len(self.ids) else []
        for ids in encode_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.merges):
            self.ids.append(",".join(map(str, ids)))
            self.counts.append(len(ids))
            self.decoded.append(b"".join([self.merges.bytes_of[i] for i in ids]))
            # Objects of about 350 bytes, and what the texts and ids take beyond a few characters.
            self.held += 350 + 2 * len(self.decoded[-1]) + len(self.ids[-1])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """Text by text: number of tokens, decimal ids joined by commas, bytes decoded from the ids."""
        done = 0
        while done < len(texts):
            if self.held > self.max_bytes:
                self.forget()
            chunk, chars = [], 0
            while done < len(texts) and (not chunk or chars < self.chunk_chars):
                text = texts[done] or ""
                chars += len(text)
                pieces = self.split(text)
                chunk.append(np.fromiter(map(self.number.__getitem__, pieces), np.int32, len(pieces)))
                done += 1
            self._learn()
            counts = np.array(self.counts)
            for numbers in chunk:
                total = int(counts[numbers].sum()) if len(numbers) else 0
                order = numbers.tolist()
                yield total, ",".join(map(self.ids.__getitem__, order)), b"".join(map(self.decoded.__getitem__, order))


_CODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
)


def _tokenizer_in_worker(shared, pattern: str):
    """One vocabulary per worker, kept between tasks; what a task remembers goes with it."""
    import builtins

    kept = builtins.__dict__.setdefault("_pagebundle_tokenizers", {})
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Tokenizer(shared.value, pattern)
    return kept[key]


def encoder(spark, ranks_path: str, pattern: str):
    """A column function: text to the token ids as an array of int.

    The vocabulary (bounded by its file) is read once on the driver and broadcast.
    """
    short_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer_in_worker(shared, pattern)
        try:
            for texts in batches:
                yield pd.Series(
                    [np.array(ids.split(","), dtype=np.int32) if n else np.array([], dtype=np.int32) for n, ids, _ in tokenizer.encode(list(texts))]
                )
        finally:
            tokenizer.forget()

    return encoded


def decoder(spark, ranks_path: str):
    """A column function: an array of token ids to bytes (null: null; unknown ids end the task)."""
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(T.BinaryType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = {rank: token for token, rank in shared.value.items()}
        for rows in batches:
            yield pd.Series([None if r is None else b"".join([bytes_of[i] for i in r]) for r in rows])

    return decoded


def digester(spark, ranks_path: str, pattern: str):
    """A column function: text to its token count and the digests of ids and decoded bytes."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(_CODED)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer_in_worker(shared, pattern)
        try:
            for texts in batches:
                rows = [
                    (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    for n, ids, decoded in tokenizer.encode(list(texts))
                ]
                yield pd.DataFrame(rows, columns=_CODED.names)
        finally:
            tokenizer.forget()

    return digests


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    coded = digester(docs.sparkSession, ranks_path, pattern)
    return docs.select("doc_id", coded("text").alias("c")).select("doc_id", *[f"c.{c}" for c in _CODED.names])


def with_token_ids(docs: DataFrame, ranks_path: str, pattern: str, text: Column | str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with the ids in ``to`` (with a leading underscore where a column has that name)."""
    return docs.withColumn(fresh(docs, to), encoder(docs.sparkSession, ranks_path, pattern)(text))
