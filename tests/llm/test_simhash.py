import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagebundle.llm.components import connected_components
from pagebundle.llm.simhash import fingerprint, keep_one_per_component, link_fingerprints, majority_bits, simhash_digest


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: list of (doc_id, value); union of all pairs within two bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(prints))]
    return {d: min(prints[j][0] for j in range(len(prints)) if roots[j] == roots[i]) for i, (d, _) in enumerate(prints)}


def test_fingerprints_match_a_plain_count():
    rng = random.Random(1)
    texts = [None, "", " \n", "A", "a B", "ÄÖ x Y", "a b c"] + [
        " ".join(rng.choice(["Foo", "bar", "é", "X\t", "\ny"]) for _ in range(rng.randrange(400))) for _ in range(60)
    ]
    for text in texts:
        assert fingerprint(text) == slow_fingerprint(text)
    many = np.array([rng.getrandbits(64) for _ in range(1000)], dtype=np.uint64)
    assert majority_bits(many) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in many) > 1000)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_links_equal_brute_force_also_in_crowded_buckets(spark):
    rng = random.Random(2)
    base, values = rng.getrandbits(64), set()
    for _ in range(150):  # many that share the lower half: crowded buckets of the first segment
        values.add(base ^ sum(1 << b for b in rng.sample(range(32, 64), rng.randrange(0, 5))))
    for _ in range(150):
        v = rng.getrandbits(64)
        values |= {v, v ^ (1 << rng.randrange(64)), v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    values = sorted(values)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = slow_components([(i, v) for i, v in enumerate(values)])
    number = {signed(v): i for i, v in enumerate(values)}
    for bucket in (2, 8, 1000):
        edges = link_fingerprints(fps, max_bucket=bucket)
        pairs = edges.collect()
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2 for r in pairs)
        roots = {r["node"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
        classes = {}
        for v in values:
            classes.setdefault(roots.get(signed(v), signed(v)), []).append(number[signed(v)])
        assert {i: min(c) for c in classes.values() for i in c} == want, bucket


def test_components_of_a_long_chain_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_documents_copies_nulls_and_columns(spark):
    rng = random.Random(4)
    text = " ".join(str(rng.random()) for _ in range(200))
    rows = [(5, text), (3, text), (9, text.upper()), (1, None), (2, ""), (8, " \n"), (4, "other words here now"), (4, "other words here now"), (None, "nameless text without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("_id", F.lit(2))
    got = {r["doc_id"]: r for r in simhash_digest(docs).collect()}
    assert {d: got[d]["component_id"] for d in (5, 3, 9, 1, 2, 8, 4)} == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 8: 1, 4: 4}
    assert got[1]["fingerprint"] == "0" * 16 and got[None]["component_id"] is None
    assert got[5]["fingerprint"] == f"{slow_fingerprint(text):016x}"
    assert simhash_digest(docs).count() == len(rows)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4]
    assert simhash_digest(docs.limit(0)).count() == 0 and keep_one_per_component(docs.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash_digest(docs).collect()}
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    assert {d: f for d, (f, _) in got.items()} == dict(prints)
    assert {d: c for d, (_, c) in got.items()} == slow_components(prints)
