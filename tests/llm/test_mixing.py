import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pagebundle.llm.common import stable_number
from pagebundle.llm.mixing import mix, mixed_documents, quanta, schedule_period, tempered_weights


def test_every_prefix_of_a_period_is_within_one_block_of_target():
    rng = random.Random(6)
    for _ in range(60):
        weights = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randrange(1, 30))}
        slots = quanta(weights, 200)
        assert sum(slots.values()) == 200 and min(slots.values()) >= 1
        plan = schedule_period(slots)
        assert [p[4] for p in plan] == list(range(200))
        served = Counter()
        for source, k, release, deadline, slot in plan:
            served[source] += 1
            assert served[source] == k and release <= slot < deadline
            for s, n in slots.items():
                assert abs(served[s] - n * (slot + 1) / 200) < 1


def table(spark, sizes):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string")


def test_rows_follow_the_schedule_and_all_are_there(spark):
    sizes = {"a": 700, "b": 90, None: 33, "c": 5}
    df = table(spark, sizes)
    weights = {"a": 0.4, "b": 0.3, None: 0.2, "c": 0.1}
    rows = mix(df, "source", stable_number(F.col("doc_id")), weights, block_rows=4, period=50).collect()
    assert {r["doc_id"] for r in rows} == set(range(828))
    blocks = defaultdict(set)
    for r in rows:
        blocks[r["slot"]].add((r["source"], r["epoch"], r["block"]))
        assert r["release"] <= r["slot"] < r["deadline"] and 0 <= r["place"] < 4
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    served, order = Counter(), defaultdict(list)
    for slot in range(len(blocks)):
        ((source, epoch, block),) = blocks[slot]
        served[source] += 1
        order[source].append((epoch, block))
        for s, w in weights.items():
            assert abs(served[s] - w * (slot + 1)) < 1
    for s, got in order.items():
        n = -(-sizes[s] // 4)
        assert got == [(i // n, i % n) for i in range(len(got))] and len(got) >= n
    # The last slot is the one in which the slowest source finishes its first pass.
    assert min(len(got) - (-(-sizes[s] // 4)) for s, got in order.items()) == 0


def test_defaults_clashes_and_empty_tables(spark):
    df = table(spark, {"a": 40, "b": 2}).withColumn("slot", F.lit("mine")).withColumn("_k", F.lit(1))
    mixed = mix(df, "source", stable_number(F.col("doc_id")), block_rows=4)
    assert {"slot", "_slot", "epoch"} <= set(mixed.columns) and {r["slot"] for r in mixed.collect()} == {"mine"}
    twice = df.union(df)
    kept = mixed_documents(twice)
    assert kept.columns == df.columns and kept.count() >= 84
    assert mixed_documents(df.limit(0)).count() == 0
    shares = tempered_weights({"a": 1000, "b": 10})
    assert 1 < shares["a"] / shares["b"] < 100
