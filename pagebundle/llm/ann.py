"""Nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``max_sample`` vectors chosen by a hash of the
id); every row is indexed: it goes down to its nearest leaf. A query walks the tree best
bin first: a priority queue holds nodes by the inner product that their members may
reach (query times centre, plus the query's length times the node's typical radius); the
best node is opened until enough leaves are visited. How many are enough is calibrated:
for a set of queries the exact neighbours are found by brute force over all rows in
blocks, and visits are widened until the share of those neighbours that lie in visited
leaves reaches ``target_recall``.

Equal vectors are one entry that keeps its ``k`` + 1 smallest ids (Spark limits the
groups before the shuffle), which is all that any answer can contain, so a vector that a
third of the rows share is neither a hot key nor a long list. Neighbouring leaves are
stored together in bins of up to ``block_rows`` rows, larger leaves are split into blocks
by a hash. A visit reads the leaf's whole bin: each (bin, block) meets its queries in one
grouped task, where a matrix product picks its best ``k`` + 1 and the pairs are scored again, exactly, in
double precision on the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part, neither do those whose length is not the most common one (ties: the longer).
Queries are the rows whose id is divisible by ``query_every``; a row never finds itself,
but finds others with the same vector. Repeated ids count once. Fewer than k candidates:
all are found. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagebundle.llm.common import stage


@dataclass(frozen=True)
class TreeConfig:
    k: int = 20
    query_every: int = 20
    max_sample: int = 20_000
    branching: int = 16
    leaf_rows: int = 256
    max_leaves: int = 2_000
    block_rows: int = 4_096
    calibration_queries: int = 200
    target_recall: float = 0.98


@dataclass
class Tree:
    """Nodes in breadth-first order; ``leaf`` is the leaf's number or -1."""

    centres: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        result = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                result[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _nearest(vectors[rows], self.centres[kids])
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return result

    def visits(self, query: np.ndarray, count: int) -> list[int]:
        """The first ``count`` leaves, best bin first."""
        length = float(np.linalg.norm(query))
        queue, found = [(0.0, 0)], []
        while queue and len(found) < count:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                continue
            kids = self.children[node]
            hopes = self.centres[kids] @ query + length * self.radius[kids]
            for hope, kid in zip(hopes.tolist(), kids):
                heapq.heappush(queue, (-hope, kid))
        return found


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * vectors @ centres.T, axis=1)


def _kmeans(vectors: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = vectors[random.choice(len(vectors), size=min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = _nearest(vectors, centres)
        centres = np.array([vectors[near == i].mean(axis=0) for i in range(len(centres)) if (near == i).any()])
    return centres


def fit_tree(sample: np.ndarray, rows: int, config: TreeConfig = TreeConfig()) -> Tree:
    """Splits the sample until a node stands for at most ``leaf_rows`` of ``rows`` rows."""
    random = np.random.default_rng(7)
    leaves = max(1, min(config.max_leaves, rows // config.leaf_rows))
    limit = max(len(sample) / leaves, 2)
    centres, radius, children, leaf = [sample.mean(axis=0)], [0.0], [[]], [-1]
    queue, numbered = [(0, np.arange(len(sample)))], 0
    while queue:
        node, members = queue.pop(0)
        points = sample[members]
        radius[node] = float(np.sqrt(((points - centres[node]) ** 2).sum(axis=1).mean()))
        means = _kmeans(points, min(config.branching, int(np.ceil(len(points) / limit))), random) if len(points) > limit else points[:1]
        near = _nearest(points, means)
        if len(np.unique(near)) < 2:
            leaf[node] = numbered
            numbered += 1
            continue
        for i in np.unique(near):
            children[node].append(len(centres))
            queue.append((len(centres), members[near == i]))
            centres.append(means[i])
            radius.append(0.0)
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), np.array(radius), children, leaf)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id long, v array<double>): the rows that take part, each id once."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")
    )
    common = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    valid = valid.where(F.size("v") == (common["n"] if common else 0))
    return valid.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest, and all that rounding may have put below them."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= edge - 1e-9 * max(abs(edge), 1.0))


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products in double precision; equal vectors get equal products."""
    return (vectors * query).sum(axis=1)


_FOUND = "q long, c long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k).drop("_r")


def _block_search(queries: list[tuple[int, np.ndarray]], ids: np.ndarray, vectors: np.ndarray, k: int):
    if not queries or not len(ids):
        return
    products = np.stack([v for _, v in queries]) @ vectors.T
    for (q, v), row in zip(queries, products):
        best = _top(row, k)
        exact = _exact(v, vectors[best])
        order = np.lexsort((ids[best], -exact))[:k]
        yield pd.DataFrame({"q": q, "c": ids[best][order], "score": exact[order]})


def brute_force(entries: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(q, c, score): the k best entries (c, v) for each of a bounded list of queries."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _block_search(queries, batch["c"].to_numpy(), _matrix(batch["v"]), k)

    return _best(entries.select("c", "v").mapInPandas(search, _FOUND), k)


def needed_visits(tree: Tree, queries: dict[int, np.ndarray], leaf_of: list[tuple[int, int]], target: float) -> int:
    """The fewest visits that hold ``target`` of the exact neighbours, given as (query, leaf)."""
    if not leaf_of:
        return 1
    place = {q: {leaf: i + 1 for i, leaf in enumerate(tree.visits(v, tree.leaves))} for q, v in queries.items()}
    ranks = np.sort([place[q][leaf] for q, leaf in leaf_of])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)])


def bins_of(sizes: list, block_rows: int) -> list[tuple[int, int, int]]:
    """(leaf, bin, blocks) of leaves given as (leaf, rows) in order: next ones fill a bin up to
    ``block_rows``; a leaf beyond that is a bin of its own in several blocks."""
    found, number, filled = [], 0, 0
    for leaf, rows in sizes:
        if filled and filled + rows > block_rows:
            number, filled = number + 1, 0
        found.append((leaf, number, max(1, -(-rows // block_rows))))
        filled += rows
    return found


def nearest_neighbours(rows: DataFrame, vec_id: str, vector: str, config: TreeConfig = TreeConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score) as the module text says."""
    spark, k = rows.sparkSession, config.k
    valid = stage(usable(rows, vec_id, vector), "ann-valid")
    # Equal vectors: their k + 1 smallest ids, limited before the shuffle.
    same = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        valid.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
        .groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    entries = stage(entries, "ann-entries")
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def about(wanted: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("c", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30))

    # Bounded by max_sample and calibration_queries (both in expectation of a hash).
    sample = _matrix(entries.where(about(config.max_sample, 1)).select("v").toPandas()["v"])
    if not len(sample):
        sample = _matrix(entries.orderBy("c").limit(100).select("v").toPandas()["v"])
    tree = fit_tree(sample, n, config)
    shared = spark.sparkContext.broadcast(vars(tree))

    @F.pandas_udf(T.LongType())
    def leaf_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(Tree(**shared.value).assign(_matrix(vectors)))

    entries = stage(entries.withColumn("leaf", leaf_of("v")), "ann-indexed")
    queries = valid.where(F.pmod(F.col("vec_id"), F.lit(config.query_every)) == 0)
    queries = stage(
        queries.join(entries.select("c", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("c").alias("q"), "v"),
        "ann-queries",
    )
    asked = stage(queries.groupBy("q").agg(F.first("v").alias("v")), "ann-asked")
    checks = {
        r["q"]: np.array(r["v"])
        for r in asked.orderBy(F.xxhash64("q"), "q").limit(config.calibration_queries).collect()
    }
    exact = brute_force(entries, list(checks.items()), k + 1)
    leaves = exact.join(entries.select("c", "leaf"), "c").select("q", "leaf").collect()
    visits = needed_visits(tree, checks, [(r["q"], r["leaf"]) for r in leaves], config.target_recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(**shared.value)
        for batch in batches:
            for q, v in zip(batch["q"], batch["v"]):
                yield pd.DataFrame({"q": q, "leaf": tree.visits(np.asarray(v), visits)})

    # At most max_leaves rows: neighbouring leaves share a bin, large ones are cut into blocks.
    sizes = sorted(entries.groupBy("leaf").count().collect())
    blocks = stage(
        spark.createDataFrame(bins_of(sizes, config.block_rows), "leaf long, bin long, blocks int"), "ann-bins"
    )
    visited = (
        asked.mapInPandas(walk, "q long, leaf long")
        .join(F.broadcast(blocks), "leaf")
        .select("q", "bin", "blocks")
        .distinct()
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(asked, "q")
        .select("bin", "block", "q", "v")
    )
    placed = entries.join(F.broadcast(blocks), "leaf").select(
        F.col("bin").alias("in_bin"), F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("in_block"), "c", "v"
    )

    def search(asked: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = here["c"].to_numpy(), _matrix(here["v"])
        pairs = list(zip(asked["q"], (np.asarray(v, dtype=np.float64) for v in asked["v"])))
        parts = [p for i in range(0, len(pairs), 256) for p in _block_search(pairs[i : i + 256], ids, vectors, k + 1)]
        return pd.concat(parts) if parts else pd.DataFrame({"q": [], "c": [], "score": []})

    found = visited.groupBy("bin", "block").cogroup(placed.groupBy("in_bin", "in_block")).applyInPandas(search, _FOUND)
    best = stage(_best(found, k + 1), "ann-best").join(entries.select("c", "ids"), "c").groupBy("q").agg(
        F.collect_list(F.struct("score", "ids")).alias("near")
    )
    answers = queries.select("query_id", "q").join(best, "q").select(
        "query_id", F.explode("near").alias("n")
    ).select("query_id", F.explode("n.ids").alias("vec_id"), F.col("n.score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
