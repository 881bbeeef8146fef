import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from pagebundle.llm import shingles
from pagebundle.llm.shingles import shingle_components, variant_pairs
from pagebundle.llm.simhash import fingerprint, keep_one_per_component, simhash_components


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def slow_components(rows):
    """doc_id -> smallest doc_id of all linked by Jaccard 0.8, by comparing every pair."""
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                common = len(a & b)
                if 9 * common >= 4 * (len(a) + len(b)):
                    parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(rows))]
    least = {}
    for (d, _), r in zip(rows, roots):
        least[r] = min(least.get(r, d), d)
    return {d: least[r] for (d, _), r in zip(rows, roots)}


def got(docs, **options):
    return {r["doc_id"]: r["component_id"] for r in shingle_components(docs, **options).collect()}


def test_stage_drops_all_near_copies_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.size(F.split("text", r"\s+")) >= 50)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = slow_components(rows)
    assert len(set(want.values())) < len({t for _, t in rows})  # near copies are there, beside exact ones
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, d).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_crowded_buckets_equal_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(160):  # from copies with a word changed to texts that share less than 0.8
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6])):
            words[at] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, " ".join(f"y{rng.randrange(9999)}" for _ in range(60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows)
    assert len(set(want.values())) > 21
    for bucket in (2, 8, 1000):
        assert got(docs, max_bucket=bucket) == want, bucket


def test_blank_short_and_nameless_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (None, "no id"), (7, "no id"), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"]) for r in shingle_components(docs).collect()]
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 7), (7, 7), (7, 7)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert shingle_components(docs.limit(0)).count() == 0


def test_pieces_of_sets_and_variants_alone(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[:350])), (4, " ".join(words[:300])), (5, " ".join(words[100:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows)
    for values in (3, 64, 170):
        assert got(docs, piece_values=values) == want, values
    distinct = shingle_components(docs).select("doc_id", "text_hash").orderBy("doc_id").collect()
    prints = [fingerprint(t, 5) for _, t in rows]
    table = spark.createDataFrame([(d["text_hash"], p - 2**64 if p >= 2**63 else p) for d, p in zip(distinct, prints)], "node long, fp long")
    near = {tuple(sorted((distinct[i]["text_hash"], distinct[j]["text_hash"]))) for i in range(5) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in variant_pairs(table, 32).collect()} == near


def test_no_text_is_lost_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 7), (5, a, 7), (5, b, 7), (9, b, 7), (3, c, 7), (3, c, 8), (3, c.upper(), 9), (None, a, 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    for components in (shingle_components, simhash_components):
        kept = keep_one_per_component(docs, components=components)
        assert kept.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert (1, a) in got and (5, b) in got and (5, a) not in got and (9, b) not in got
        assert sum(1 for i, t in got if i == 3) == 1 and (None, a) in got and (None, None) in got and len(got) == 5


def crowd():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(360):  # copies of a template, copies at the edge of 0.8, texts that only hold much of it
        words = list(base)
        for at in rng.sample(range(100), (rng.choice([0, 1, 1, 2]), rng.choice([2, 3, 4]), rng.choice([5, 7, 9]))[i % 3]):
            words[at] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(words[: rng.choice([80, 90, 100])] + [f"y{rng.randrange(9999)}" for _ in range(rng.choice([0, 0, 5]))])))
    return rows


def test_strays_of_a_crowded_bucket_are_not_compared_with_all(spark, monkeypatch):
    rows = crowd()
    want = slow_components(rows)
    assert 100 < len(set(want.values())) < 250
    verified, met = shingles._verified, []

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "_verified", counted)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), max_bucket=8) == want
    assert sum(met[1:]) < 20 * len(rows), met


def test_strays_met_by_pieces_and_with_few_hot_shingles(spark):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, max_bucket=8, piece_values=60, max_broadcast=30) == slow_components(rows)
