import random

from pagebundle.llm.pii import pii_digest


def terms(spark, texts):
    """The texts' own pieces that were found to disclose something, lower-cased."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = set()
    for r in pii_digest(docs).where("spans like '%term:%'").collect():
        for span in r["spans"].split(","):
            kind, a, b = span.split(":")
            if kind == "term":
                found.add(texts[r["doc_id"]][int(a) : int(b)].lower())
    return found


def filler(rng, k):
    return " ".join(f"w{rng.randrange(40)}" for _ in range(k))


def test_short_distinct_documents_are_evidence_and_copies_are_not(spark):
    rng = random.Random(6)
    texts = [filler(rng, 40) for _ in range(300)]
    texts += [f"zaphod zb@heart.org w{i} w{i + 1}" for i in range(4)]  # shorter than any window
    texts += ["quux q@r.st w1 w2"] * 4  # copies
    texts += [f"plugh p@l.gh w1 plugh p@l.gh w2 w3 plugh p@l.gh {filler(random.Random(9), 60)}"] * 4  # with several mentions
    assert terms(spark, texts) == {"zaphod"}


def test_windows_hold_five_words_however_long_they_are(spark):
    rng = random.Random(7)
    texts = [filler(rng, 40) for _ in range(300)]
    long_words = " ".join(c * 150 for c in "abcd")
    for i in range(4):
        texts.append(f"{filler(rng, 60)} zaphod {long_words} zb@heart.org {long_words} tricia {filler(rng, 60)}")
    assert {"zaphod", "tricia"} <= terms(spark, texts)
