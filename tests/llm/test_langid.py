import numpy as np
from pyspark.sql import functions as F

from pagebundle.llm.langid import LanguageConfig, LanguageModel, language_digest, language_of, learn_languages, words_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(joined) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in joined]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in joined)


def test_unseen_words_back_off_to_the_longest_known_grams():
    model = LanguageModel(["a", "b"], np.zeros(2), {}, {"abc": 0, "b": 1, "^ab": 2}, np.array([[-1.0, -5], [-9, -1], [-3, -1]]), 3)
    assert model.unseen("abc").tolist() == [-2.0, -3.0]  # abc and ^ab, not the single b
    assert model.unseen("xbx").tolist() == [-9.0, -1.0]
    assert model.unseen("zzz").tolist() == [0.0, 0.0]


def test_labels_sources_and_ids_are_no_input(spark):
    docs = spark.createDataFrame(
        [(i, t, x, "s") for i, (t, x) in enumerate([("der die das und", "de"), ("the of and to", "en")] * 20)],
        "doc_id long, text string, lang string, source string",
    )
    model = learn_languages(docs)
    predict = language_of(spark, model)
    odd = spark.createDataFrame([("die und das",), ("of the",), (None,), ("12 345 !",), ("²½",), ("",)], "text string")
    got = [r["p"]["lang_pred"] for r in odd.select(predict("text").alias("p")).collect()]
    assert got == ["de", "en", "und", "und", "und", "und"]


def test_edges(spark):
    rows = [(0, "the cat", "en"), (1, None, "en"), (2, "the dog", None), (2, "the dog", None), (None, "x " * 40_000, "fr"), (3, "der Hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine")).withColumn("n", F.lit(1))
    got = language_digest(docs).collect()
    assert len(got) == 6 and [r["lang_pred"] for r in got if r["doc_id"] == 1] == ["und"]
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 2}) == 1
    nothing = language_digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert language_digest(docs.limit(0)).count() == 0
    assert LanguageConfig().max_training_rows > 0 and words_of("Ab1cd é-f") == ["ab", "cd", "é", "f"]
