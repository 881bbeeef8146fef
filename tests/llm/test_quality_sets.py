import math
import random
import re

from pyspark.sql import functions as F

from pagebundle.llm.quality import learn_cutoffs, labelled_metrics, propose_ladder, quality_digest, text_stats


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_default_parameters_certify_a_few_hundred_documents(spark):
    rng = random.Random(3)
    rows = [(i, words(60, rng), "en" if i < 330 else "de") for i in range(660)]
    rows += [(i, re.sub(" ", "### ", words(60, rng)), "en") for i in range(660, 720)]
    rows += [(i, re.sub(" ", "! ", words(60, rng)), "en") for i in range(720, 780)]
    rows += [(i, re.sub(" ", "### ", words(60, rng)), "de") for i in range(780, 840)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 660), 0) for i in range(840)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_digest(docs, labels).collect()}
    assert not any(kept[i] for i in range(660, 840))  # both kinds of junk: the set counts as a whole
    assert sum(kept[i] for i in range(660)) >= 660 * 0.97


def test_given_table_certifies_every_language_and_keeps_the_promise(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    stats = docs.select("doc_id", "lang", text_stats("text").alias("s"))
    cutoffs = {r["stratum"]: r["cutoffs"] for r in learn_cutoffs(labelled_metrics(stats, "s", labels)).collect()}
    certified = {k for k, c in cutoffs.items() if any(x is not None for x in c)}
    print(len(certified), "of", len(cutoffs), "strata certified on", d)
    assert len(certified) == len(cutoffs) == 4
    judged = quality_digest(docs, labels).where("not base_failed").join(labels.where("quality is not null"), "doc_id")
    got = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    print("kept of good, of bad:", got[1], got[0])
    assert got[1] >= 0.97 and got[0] == 0.0


def test_ladders_are_nested_and_start_with_the_best_metric():
    rng = random.Random(1)
    for _ in range(200):
        grids = [sorted({rng.random() for _ in range(6)}) for _ in range(3)]
        down = lambda: [sorted((rng.randrange(40) for _ in g), reverse=True) for g in grids]
        ladder = propose_ladder(grids, down(), down(), 400, 40)
        for mild, strict in zip(ladder, ladder[1:]):
            assert all(b <= a for a, b in zip(mild, strict)) and mild != strict
    inf = math.inf
    assert propose_ladder([[1.0], [2.0]], [[0], [0]], [[3], [9]], 100, 10) == [[inf, 2.0], [1.0, 2.0]]
