"""SimHash near-duplicates over one-wildcard segment variants.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes
(seed 42) of the text's 3-word shingles, repeats included. Two fingerprints are linked
if they differ in at most two bits. Cut into two segments of 32 bits, one segment of
such a pair differs in at most one bit. So each distinct fingerprint is indexed under
64 keys: each segment with each of its bits replaced by a wildcard. Linked fingerprints
share a key; an equality join on the keys finds them and a bit count verifies them.

Exact copies meet before that: the index holds distinct fingerprints only, so a group of
equal texts is one entry whatever its size. A key with two fingerprints is a pair at
once (one aggregation gives both). Keys with up to ``max_bucket`` fingerprints are
joined pairwise. Fingerprints of larger buckets (many texts around one template) are
not paired at all: two fingerprints differ in at most two bits if and only if they meet
among the 65 values "the fingerprint itself or with one bit flipped", and all that meet
in one value are linked with its smallest. That is exact, adds 65 rows per fingerprint
of such buckets, and no bucket of it can exceed 65. So no link is lost at any size.

Defined cases: texts are lower-cased in A-Z only; fewer than three words form one
shingle; null, empty and blank texts have fingerprint 0 and are linked like any other.
Repeated rows each get their result. A null doc_id takes part, but a component is named
by its smallest non-null doc_id (null if there is none).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagebundle.llm.common import WORDS_BYTES, fresh, short_batches, size_checked_broadcast, stage
from pagebundle.llm.components import connected_components

SEED = 42
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit value whose bits are set in over half of ``hashes`` (uint64)."""
    n = len(hashes)
    if n == 0:
        return 0
    # Eight counters of eight bits in one word: 255 hashes at a time cannot overflow.
    starts = np.arange(0, n, 255)
    value = 0
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & _LANES
        parts = np.add.reduceat(lanes, starts)
        counts = parts.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.nonzero(2 * counts > n)[0].tolist():
            value |= 1 << (8 * byte + shift)
    return value


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of one whole text in order, repeats included; none without words."""
    words = WORDS_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one whole text."""
    return majority_bits(shingle_hashes(text, shingle))


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
    return pd.Series(values.view(np.int64))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 rows per fingerprint; the key packs segment, wildcard and the other bits."""
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        F.expr(
            "shiftleft(cast(i as bigint), 32) | ("
            "CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
            " & ~shiftleft(1L, i % 32))"
        ).alias("key"),
        "fp",
    )


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def link_fingerprints(fps: DataFrame, max_bucket: int = 32, max_broadcast_keys: int = 100_000) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links among distinct ``fps``.

    ``fps`` has one column fp (distinct longs) and is read three times: pass a table.
    """
    # 64 rows come from each: a small table of few files must not mean few tasks.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = stage(
        _variants(fps)
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "simhash-keys",
    )
    pairs = keys.where("n = 2").where(_close("a", "b")).select("a", "b")

    crowded = stage(keys.where("n > 2").select("key", "n"), "simhash-crowded")
    members = stage(
        _variants(fps).join(size_checked_broadcast(crowded, max_broadcast_keys), "key"), "simhash-members"
    )
    few = members.where(F.col("n") <= max_bucket)
    small = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & _close("a", "b"))
        .select("a", "b")
    )
    near = (
        members.where(F.col("n") > max_bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
        .select(F.expr("CASE WHEN i < 0 THEN fp ELSE fp ^ shiftleft(1L, i) END").alias("middle"), "fp")
    )
    near = stage(near, "simhash-near")
    smallest = near.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    star = (
        near.join(smallest.select("middle", "a"), "middle")
        .where("fp > a")
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.union(small).union(star).distinct()


def text_hash(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def simhash_components(docs: DataFrame, max_bucket: int = 32) -> DataFrame:
    """doc_id, text_hash, fp (long), component_id and root for every row of ``docs`` (doc_id, text)."""
    short_batches(docs.sparkSession)
    prints = stage(docs.select("doc_id", text_hash().alias("text_hash"), fingerprints("text").alias("fp")), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    edges = stage(link_fingerprints(distinct.select("fp"), max_bucket), "simhash-edges")
    return name_components(prints, distinct, edges, "fp")


def name_components(prints: DataFrame, distinct: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``prints`` (with node) with root, the smallest node that ``edges`` (a, b) reach, and
    component_id, the smallest doc_id there. ``distinct``: each node once, with first_id, its
    smallest doc_id.
    """
    roots = connected_components(edges, "a", "b")
    named = distinct.join(roots.withColumnRenamed("node", node), node, "left").withColumn(
        "root", F.coalesce("root", node)
    )
    named = stage(named.select(node, "root", "first_id"), "simhash-roots")
    component = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.select(node, "root").join(component, "root").select(node, "root", "component_id")
    return prints.join(classes, node)


def simhash_digest(docs: DataFrame) -> DataFrame:
    return simhash_components(docs.select("doc_id", "text")).select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one_per_component(
    docs: DataFrame, max_broadcast_ids: int = 1_000_000, components: Callable[[DataFrame], DataFrame] = simhash_components
) -> DataFrame:
    """One row of ``docs`` for each component, one with the doc_id that names it.

    ``components`` gives doc_id, text_hash, root and component_id for every row of (doc_id,
    text). An id may occur with several texts: it stands for a component only with a text of
    that component (the one of the smallest hash, if several have the id). Of rows that
    repeat an id and a text one stays. Rows without id cannot be named and stay.
    """
    found = stage(components(docs.select("doc_id", "text")), "simhash-found").where("doc_id is not null")
    names = found.where("doc_id = component_id").groupBy("root").agg(F.min("text_hash").alias("kept"), F.count("*").alias("n"))
    several = stage(names.where("n > 1"), "simhash-several")
    key, text = fresh(docs, "_id"), fresh(docs, "_text_hash")
    # Ids and hashes only: up to max_broadcast_ids they travel to the texts, beyond that both shuffle.
    losers = found.where("doc_id <> component_id").select("doc_id", "text_hash")
    second = found.where("doc_id = component_id").join(several, "root").where("text_hash <> kept").select("doc_id", "text_hash")
    losers = stage(losers.union(second).distinct().toDF(key, text), "simhash-losers")
    same = (docs["doc_id"] == F.col(key)) & (text_hash(docs["text"]) == F.col(text))
    kept = docs.join(size_checked_broadcast(losers, max_broadcast_ids), same, "left_anti")
    if several.isEmpty():
        return kept
    repeated = stage(
        found.where("doc_id = component_id").join(several.select("root"), "root")
        .groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash").toDF(key, text),
        "simhash-repeated",
    )
    once = kept.join(repeated, same, "left_semi").withColumn(text, text_hash("text")).dropDuplicates(["doc_id", text]).drop(text)
    return kept.join(repeated, same, "left_anti").unionByName(once)
