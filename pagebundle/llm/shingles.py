"""Near-duplicates by shared word shingles: SimHash variants and MinHash bands, verified exactly.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles (XXH64,
seed 42) is 0.8 or more. Two indexes give candidates. One-wildcard variants of the
segments of SimHash fingerprints (``simhash.py``, here of 5-word shingles) find texts
whose fingerprints differ in at most two bits, which are the closest copies. A
similarity of 0.8 is about ten of 64 bits, too far for variants, so texts that agree in
one of 20 bands of 4 MinHash values are candidates too: a pair of similarity 0.8 is
missed by these with probability (1 - 0.8^4)^20 = 0.00003, closer ones more rarely.
Every candidate is verified on its whole sets in integers, so no link is wrong (short of
a collision of 64-bit hashes). Sets travel in pieces of about ``piece_values`` hashes, so
no row grows with the length of a text.

Equal texts are one entry. A bucket of up to ``max_bucket`` texts is compared pairwise.
In a larger one all members first meet three pivots, which links a group of copies in
three comparisons each. What these leave outside the bucket's largest component (strays)
meets the member there whose shingles most texts of such buckets hold, a template where
there is one. The strays that remain are joined with all members of other components on the
shingles that can be the first a linked pair has in common, where the order is one for
all sets and rare shingles come first; a pair for which too few can follow is none. That
is exact: no pair that may be linked is left out. A rare shingle has fewer than
``max_bucket`` holders, so the work grows with the square of a bucket only where very many
of its texts consist of shingles common there almost wholly, and are not linked.

Defined cases: texts are lower-cased in A-Z only; fewer than five words form one shingle;
null, empty and blank texts are linked with each other. A null doc_id takes part, but a
component is named by its smallest non-null doc_id (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagebundle.llm.common import short_batches, size_checked_broadcast, stage
from pagebundle.llm.components import connected_components
from pagebundle.llm.simhash import SEED, link_fingerprints, majority_bits, name_components, shingle_hashes, text_hash

_EMPTY = np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of one whole text, never empty."""
    hashes = shingle_hashes(text, shingle)
    return np.unique(hashes) if len(hashes) else _EMPTY


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit key per band, equal where all MinHash values of the band are."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**64, bands * rows, dtype=np.uint64, endpoint=False)
    least = np.full(bands * rows, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 512):  # bounded memory for texts of any length
        values = factors[:, None] * hashes[None, i : i + 512] + shifts[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    parts = least.reshape(bands, rows)
    keys = [xxhash.xxh64_intdigest(parts[b].tobytes(), b) for b in range(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _prints_of(shingle: int, bands: int, rows: int):
    @F.pandas_udf("fp long, bands array<long>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        table = []
        for text in texts:
            hashes = shingle_hashes(text, shingle)
            keys = band_keys(np.unique(hashes) if len(hashes) else _EMPTY, bands, rows)
            table.append((np.uint64(majority_bits(hashes)).view(np.int64), keys))
        return pd.DataFrame(table, columns=["fp", "bands"])

    return prints


def _pieces_of(shingle: int, piece_values: int):
    """Rows (node, n, level, piece, shingles): whole sets in 1 << level pieces by the hashes' first bits."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, text in zip(batch["node"], batch["text"]):
                values = shingle_set(text, shingle)
                level = max(0, (len(values) - 1) // piece_values).bit_length()
                cuts = np.searchsorted(values, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)) if level else []
                for k, part in enumerate(np.split(values.view(np.int64), cuts)):
                    rows.append((node, len(values), level, k, part))
                if len(rows) > 500:
                    yield pd.DataFrame(rows, columns=["node", "n", "level", "piece", "shingles"])
                    rows = []
            yield pd.DataFrame(rows, columns=["node", "n", "level", "piece", "shingles"])

    return pieces


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``percent`` or more.

    The sizes alone rule many pairs out. The others meet piece by piece, as finely as the
    finer of both sets is cut: the hashes' first bits name the piece of the coarser one. A
    joined row holds two pieces, never whole sets of long texts.
    """
    one, two = (sizes.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("level").alias(f"level{n}")) for n in ("a", "b"))
    level = F.greatest("levela", "levelb")
    met = (
        pairs.join(one, "a").join(two, "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .withColumn("level", level)
        .withColumn("k", F.explode(F.expr("sequence(0, shiftleft(1, level) - 1)")))
        .select("a", "b", "na", "nb", *[F.expr(f"shiftright(k, level - level{n})").alias(f"piece{n}") for n in ("a", "b")])
    )
    for n in ("a", "b"):
        met = met.join(sets.select(F.col("node").alias(n), F.col("piece").alias(f"piece{n}"), F.col("shingles").alias(f"set{n}")), [n, f"piece{n}"])
    common = met.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("seta", "setb"))).alias("common"))
    return common.where((F.col("common") * (100 + percent)) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def variant_pairs(distinct: DataFrame, max_bucket: int) -> DataFrame:
    """Candidates (a, b) from one-wildcard variants of SimHash fingerprints, at most two bits apart.

    ``distinct``: node, fp. Texts of one fingerprint meet its smallest node, and these nodes
    meet where their fingerprints are linked.
    """
    prints = stage(distinct.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "shingle-fingerprints")
    same = distinct.join(prints.where("n > 1"), "fp").where("node <> first").select(*_pair("node", "first"))
    edges = link_fingerprints(prints.select("fp"), max_bucket)
    one, two = (prints.select(F.col("fp").alias(n), F.col("first").alias(f"first{n}")) for n in ("a", "b"))
    return same.union(edges.join(one, "a").join(two, "b").select(*_pair("firsta", "firstb")))


def similar_pairs(
    texts: DataFrame, distinct: DataFrame, entries: DataFrame, variants: DataFrame, shingle: int, percent: int, max_bucket: int,
    max_broadcast: int, piece_values: int,
) -> DataFrame:
    """A table of edges (a, b) whose components are those of all verified candidates.

    ``texts``: doc_id, node, text, read again for candidates only. ``distinct``: node,
    first_id; ``entries``: key, node for every band of every node; tables. ``variants``:
    further candidates (a, b).
    """
    node = F.col("node")
    buckets = stage(
        entries.groupBy("key")
        .agg(
            F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"),
            F.min_by("node", F.xxhash64(F.lit(SEED), node)).alias("c"),
        )
        .where("n > 1"),
        "shingle-buckets",
    )
    crowded = stage(buckets.where("n > 2"), "shingle-crowded")
    members = stage(entries.join(size_checked_broadcast(crowded, max_broadcast), "key"), "shingle-members")
    few = members.where(F.col("n") <= max_bucket)
    small = (
        few.select("key", node.alias("x"))
        .join(few.select("key", node.alias("y")), "key")
        .where("x < y")
        .select(*_pair("x", "y"))
    )
    many = members.where(F.col("n") > max_bucket)
    star = many.select("node", F.explode(F.array("a", "b", "c")).alias("pivot")).where("node <> pivot")
    pairs = buckets.where("n = 2").select("a", "b").union(small).union(star.select(*_pair("node", "pivot")))
    pairs = stage(pairs.union(variants).distinct(), "shingle-pairs")
    candidates = stage(
        pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        .join(distinct.select("node", "first_id"), "node").select(F.col("node").alias("_node"), F.col("first_id").alias("_id")),
        "shingle-candidates",
    )
    # Of copies only the row with the smallest id is read, and of rows that repeat that id too, one.
    first = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    sets = stage(
        texts.join(size_checked_broadcast(candidates, max_broadcast), first, "left_semi")
        .select("node", "text")
        .mapInPandas(_pieces_of(shingle, piece_values), "node long, n int, level int, piece int, shingles array<long>")
        .dropDuplicates(["node", "piece"]),
        "shingle-sets",
    )
    sizes = stage(sets.where("piece = 0").select("node", "n", "level"), "shingle-sizes")
    linked = stage(_verified(pairs, sets, sizes, percent), "shingle-linked")
    if many.isEmpty():
        return linked
    many = many.select("key", "node")
    apart = _apart(linked, many)
    if apart.isEmpty():
        return linked
    # Members left outside meet the member of the largest component that has most in common with all.
    own = sets.join(size_checked_broadcast(stage(apart.select("node").distinct(), "shingle-own"), max_broadcast), "node", "left_semi")
    hot = _hot_shingles(own, max_bucket, max_broadcast)
    ranks = stage(_ranked_pieces(own, hot), "shingle-ranked")
    heat = ranks.groupBy("node").agg((F.sum("heat") / F.first("n")).alias("heat"))
    central = apart.where("root = main").join(heat, "node").groupBy("key").agg(F.max_by("node", F.struct("heat", "node")).alias("pivot"))
    pairs = apart.where("root <> main").join(central, "key").select(*_pair("node", "pivot")).distinct()
    linked = stage(linked.union(_verified(stage(pairs, "shingle-central"), sets, sizes, percent)), "shingle-centred")
    apart = _apart(linked, many)
    if apart.isEmpty():
        return linked
    rest = stage(_prefix_pairs(apart, own, ranks, hot, percent), "shingle-rest")
    return stage(linked.union(_verified(rest, sets, sizes, percent)), "shingle-edges")


def _apart(edges: DataFrame, many: DataFrame) -> DataFrame:
    """A table key, node, root, main (the bucket's largest component) of buckets with several components."""
    roots = connected_components(edges, "a", "b")
    placed = stage(many.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "shingle-placed")
    largest = (
        placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
        .where("roots > 1").drop("roots")
    )
    return stage(placed.join(largest, "key"), "shingle-apart")


def _hot_shingles(sets: DataFrame, least: int, max_rows: int):
    """A broadcast (shingles, counts) of those held by ``least`` or more sets, in order of the signed hashes.

    ``least`` is doubled until at most ``max_rows`` travel: they only order the shingles of a set.
    """
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    counts = stage(counts.where(F.col("n") >= least), "shingle-hot")
    while counts.where(F.col("n") >= least).count() > max_rows:
        least *= 2
    rows = counts.where(F.col("n") >= least).toArrow().sort_by("shingle")
    return counts.sparkSession.sparkContext.broadcast((rows["shingle"].to_numpy(), rows["n"].to_numpy()))


def _counts_of(shingles: np.ndarray, hot) -> np.ndarray:
    """How many sets hold each of ``shingles``, 0 for those that are not hot."""
    known, counts = hot.value
    if not len(known):
        return np.zeros(len(shingles), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, counts[at], 0)


def _ranked_pieces(sets: DataFrame, hot) -> DataFrame:
    """node, n, piece, heat (sum of counts of hot shingles), before and cold: shingles that are
    not hot in the pieces before and in the whole set."""

    @F.pandas_udf("cold long, heat long")
    def facts(pieces: pd.Series) -> pd.DataFrame:
        counts = [_counts_of(np.asarray(p, dtype=np.int64), hot) for p in pieces]
        return pd.DataFrame([(int((c == 0).sum()), int(c.sum())) for c in counts], columns=["cold", "heat"])

    whole = Window.partitionBy("node")
    return sets.select("node", "n", "piece", facts("shingles").alias("f")).select(
        "node", "n", "piece", "f.heat", F.sum("f.cold").over(whole).alias("cold"),
        (F.sum("f.cold").over(whole.orderBy("piece")) - F.col("f.cold")).alias("before"),
    )


def _prefixes_of(percent: int, hot):
    """Rows (node, root, stray, n, place, hot, shingle): the shingles of each set that can be the first it shares."""
    names = ["node", "root", "stray", "n", "place", "hot", "shingle"]

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                shingles = np.asarray(r.shingles, dtype=np.int64)
                counts = _counts_of(shingles, hot)
                order = np.lexsort((shingles.view(np.uint64), counts))
                rare = int((counts == 0).sum())
                # Of hot ones in other pieces it is open which come first: the place is the least it can be.
                place = np.concatenate((r.before + np.arange(rare), r.cold + np.arange(len(order) - rare)))
                least = -(-r.n * percent // 100)  # the smallest set that can be linked with this one
                fits = (r.n - place) * (100 + percent) >= (r.n + least) * percent
                order, place = order[fits], place[fits]
                yield pd.DataFrame(
                    {"node": r.node, "root": r.root, "stray": r.stray, "n": r.n, "place": place, "hot": counts[order] > 0, "shingle": shingles[order]},
                    columns=names,
                )

    return prefixes


def _prefix_pairs(apart: DataFrame, sets: DataFrame, ranks: DataFrame, hot, percent: int) -> DataFrame:
    """All pairs (a, b) of a stray and a node of another component that can be linked.

    All sets have their shingles in one order, rare ones first. A pair shares no more than
    what follows its first common shingle in either set, so this lies near both starts. Rare
    shingles have few holders; with hot ones only sets of fitting sizes meet.
    """
    who = stage(apart.groupBy("node").agg(F.first("root").alias("root"), F.max(F.expr("root <> main")).alias("stray")), "shingle-who")
    rows = stage(
        sets.select("node", "piece", "shingles").join(ranks, ["node", "piece"]).join(who, "node")
        .mapInPandas(_prefixes_of(percent, hot), "node long, root long, stray boolean, n int, place long, hot boolean, shingle long"),
        "shingle-prefixes",
    )

    def size(n: str) -> Column:  # steps of about 5 %
        return F.expr(f"cast(floor(20 * ln({n})) as int)")

    one, other = (rows.select(*[F.col(c).alias(f"{c}{n}") for c in ("node", "root", "n", "place")], "stray", "hot", "shingle") for n in "xy")
    sizes = F.when(
        F.col("hot"),
        F.sequence(size(f"(nx * {percent} + 99) div 100"), size(f"(nx - placex) * {100 + percent} div {percent} - nx")),
    ).otherwise(F.array(F.lit(-1)))
    one = one.where("stray").withColumn("size", F.explode(sizes)).drop("stray", "hot")
    other = other.withColumn("size", F.when(F.col("hot"), size("ny")).otherwise(F.lit(-1))).drop("stray", "hot")
    shared = F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey"))
    return (
        one.join(other, ["shingle", "size"])
        .where((F.col("rootx") != F.col("rooty")) & (shared * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent))
        .select(*_pair("nodex", "nodey"))
        .distinct()
    )


def shingle_components(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 20, rows: int = 4,
    max_bucket: int = 32, max_broadcast: int = 1_000_000, piece_values: int = 2_000,
) -> DataFrame:
    """doc_id, text_hash, node (the same), root, component_id for every row of ``docs`` (doc_id, text)."""
    short_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_hash().alias("node"), "text")
    prints = stage(
        texts.select("doc_id", "node", _prints_of(shingle, bands, rows)("text").alias("p")).select("doc_id", "node", "p.*"), "shingle-prints"
    )
    distinct = stage(
        prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")),
        "shingle-distinct",
    )
    entries = stage(distinct.select(F.explode("bands").alias("key"), "node"), "shingle-entries")
    variants = variant_pairs(distinct.select("node", "fp"), max_bucket)
    edges = similar_pairs(texts, distinct, entries, variants, shingle, percent, max_bucket, max_broadcast, piece_values)
    named = name_components(prints.select("doc_id", "node"), distinct.select("node", "first_id"), edges, "node")
    return named.withColumn("text_hash", F.col("node"))
