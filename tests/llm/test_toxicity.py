import random

import numpy as np
from pyspark.sql import functions as F

from pagebundle.llm.toxicity import Matcher, ToxicityModel, fold, learn_toxicity, toxicity_digest, toxicity_of


def test_folding_undoes_look_alikes_and_digits():
    assert fold("1D10T") == fold("idiot") == fold("ıdіоt") == fold("ＩＤＩＯＴ") == " idiot "
    assert fold("l0ser") == fold("|o$er!") == fold("Loser.")
    assert fold(None) == fold("") == " " and fold("?!") == "  "


def test_longest_entry_counts_and_exceptions_cancel():
    model = ToxicityModel({" abcd": 1.0, " abcde ": 3.0, " foo ": 2.0}, [" foo fighters "], [0.0, 1.0, 1.0])
    matcher = Matcher(model)
    assert sorted(w for _, w in matcher.hits(fold("abcde abcdx xabcd foo")).values()) == [1.0, 2.0, 3.0]
    assert matcher.hits(fold("foo fighters")) == {} and len(matcher.hits(fold("foo bar foo fighters"))) == 1
    # More of it scores higher, the same amount in a longer text lower.
    assert matcher.score("foo foo") > matcher.score("foo") > matcher.score("foo " + "bar " * 50) > matcher.score("bar")
    assert Matcher(ToxicityModel()).score("foo") == 0.0


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_copies_support_a_term_once_and_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bdfgkmnprtv") for _ in range(7))
    text = lambda *more: " ".join([word() for _ in range(30)] + list(more))
    copied = text()
    rows = [(i, text("zzyzx", word())) for i in range(60)] + [(i, copied) for i in range(60, 100)] + [(i, text()) for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(500)] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    assert " zzyz" in model.weights and not any(w in copied for w in (e.strip() for e in model.weights))
    score = toxicity_of(spark, model)
    odd = spark.createDataFrame([("a ZZYZX b",), ("a b",), (None,), ("",)], "text string")
    hit, *rest = [r["s"] for r in odd.select(score("text").alias("s")).collect()]
    assert hit > 0.5 > max(rest) and len(set(rest)) == 1
    assert learn_toxicity(docs, labels.limit(0)) == ToxicityModel()
    assert toxicity_digest(docs.limit(0), labels).count() == 0
    assert toxicity_digest(docs, labels).count() == 500
