import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagebundle.llm.quality import (
    METRICS,
    QualityConfig,
    binomial_tail,
    choose_cutoff,
    count_text,
    keep_good,
    quality_digest,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines, dups, seen = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for line in lines:
        dups += line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered))


def test_counts_match_a_plain_count():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a", "x y z x y z", "l1\n\nl1\nl1 \n", "\x1ca b"]
    texts += ["".join(rng.choice("ab# \n\té") for _ in range(rng.randrange(80))) for _ in range(300)]
    for text in texts:
        assert count_text(text)[:5] == slow_counts(text), repr(text)


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 3, 0.2), (50, 0, 0.01), (200, 9, 0.03), (7, 7, 0.5)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert binomial_tail(n, k, p) == pytest.approx(want, rel=1e-9)


def test_a_cutoff_needs_enough_holdout_documents():
    # Ten bad documents above 0.5, no good ones; the holdout decides whether that is proof.
    def cutoff(n):
        return choose_cutoff([0.5, 0.9], [0, 0], [10, 2], [0, 0], 100, 10, n, 0.05, 0.01)

    assert cutoff(50) is None  # 0.95 ** 50 = 0.077
    assert cutoff(100) == 0.5  # 0.95 ** 100 = 0.006
    # False rejections in the holdout end the sequence before the lower cutoff.
    assert choose_cutoff([0.5, 0.9], [0, 0], [10, 2], [30, 0], 100, 10, 100, 0.05, 0.01) == 0.9


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_learned_rules_reject_junk_and_keep_clean_text(spark):
    rng = random.Random(3)
    rows = [(i, words(60, rng), "en", "s", 0) for i in range(1500)]
    rows += [(i, re.sub(" ", "### ", words(60, rng)), "en", "s", 0) for i in range(1500, 1700)]
    rows += [(1800, re.sub(" ", "%%% ", words(60, rng)), "xx", "s", 0), (1801, words(60, rng), None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1700)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_digest(docs, labels, QualityConfig(max_false_rejection=0.14)).collect()}
    assert len(got) == 1702 and not any(r["base_failed"] for r in got.values())
    assert not any(got[i]["kept"] for i in range(1500, 1700))
    assert sum(got[i]["kept"] for i in range(1500)) >= 1500 * 0.86
    assert got[1800]["kept"] and got[1801]["kept"]  # strata without labels certify nothing


def test_edge_rows_and_columns(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, long_text, "en", "s", 0), (3, long_text, "en", "s", 0), (None, "x " * 60, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_stats", F.lit(1)).withColumn("stratum", F.lit(2)).withColumn("good", F.lit(3))
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = keep_good(docs, no_labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3, 3]
    digest = quality_digest(docs, no_labels).collect()
    assert len(digest) == 5 and sum(r["base_failed"] for r in digest) == 3
    assert quality_digest(docs.limit(0), no_labels).count() == 0 and keep_good(docs.limit(0), no_labels).count() == 0
    assert len(METRICS) == 7
