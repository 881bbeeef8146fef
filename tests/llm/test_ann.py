import random

import numpy as np
from pyspark.sql import functions as F

from pagebundle.llm.ann import TreeConfig, fit_tree, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    valid = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    ids = np.array(sorted(valid))
    matrix = np.stack([valid[i] for i in ids])
    want = {}
    for q in ids[ids % 20 == 0]:
        s = (matrix * valid[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        want[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return want


def test_ties_copies_and_odd_vectors(spark):
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, vector()) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 700)]  # one vector that many rows share
    rows += [(720, None), (740, [0.0] * 8), (760, [float("nan")] + [1.0] * 7), (780, [float("inf")] * 8), (800, [None] + [1.0] * 7), (820, [1.0, 2.0]), (None, vector())]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("mine"))
    found = nearest_neighbours(df, "vec_id", "embedding", TreeConfig(target_recall=1.0, leaf_rows=32, block_rows=50)).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    assert hits > 0.97
    for q in (400, 420, 680):  # all their neighbours are equal vectors: smallest ids win
        assert got[q] == want[q]
    assert all(len(g) == 20 for g in got.values())


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    matrix = np.array([r["embedding"] for r in rows], dtype=float)
    got = {}
    for r in nearest_neighbours(df, "vec_id", "embedding").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for row in np.flatnonzero(ids % 20 == 0):
        s = (matrix * matrix[row]).sum(axis=1)
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != row][:20]
        recall.append(len(got[ids[row]] & set(best)) / 20)
    assert np.mean(recall) >= 0.9


def test_small_and_empty_tables(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 1.0])], SCHEMA)
    assert [tuple(r) for r in nearest_neighbours(few, "vec_id", "embedding").orderBy("rank").collect()] == [(20, 1, 1, 2.0), (20, 2, 2, -1.0)]
    assert nearest_neighbours(few.limit(0), "vec_id", "embedding").count() == 0
    one = fit_tree(np.ones((50, 3)), 1_000_000)
    assert one.leaves == 1 and one.visits(np.ones(3), 5) == [0]
