import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagebundle.llm.leaks import _Hashes, drop_contaminated, fingerprints, leak_digest, winnowed, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        words = split(text)
        hit, ids = set(), set()
        for item_id, item in items:
            theirs = split(item)
            size = min(window, len(theirs))
            for i in range(len(theirs) - size + 1) if theirs else ():
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == theirs[i : i + size]:
                        hit.update(range(p, p + size))
                        ids.add(item_id)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "the quick brown fox jumps over the lazy dog and then rests under a tall tree"
ITEMS = [
    (1, PASSAGE), (10, PASSAGE), (2, "Ünï cödé wörds; zählen AUCH mit! Und nöch mehr davon bitte sehr"), (3, "short item here"), (4, "a"), (5, None),
    (6, ""), (7, "?!"), (None, "an item that has no id at all but it does have ten words"), (8, "x y " * 12), (9, "one two three four five six seven eight nine"),
    (1, "another text of item one which is long enough to be a window by itself"),
]
DOCS = [
    (1, f"before {PASSAGE} after"), (2, PASSAGE.upper().replace(" ", " -- ")), (3, " ".join(PASSAGE.split()[3:13])), (4, " ".join(PASSAGE.split()[3:12])),
    (5, None), (6, ""), (7, "   "), (8, "x " + "y x " * 30), (9, "Short item, HERE: short item here"), (None, f"{PASSAGE} {PASSAGE}"), (1, "clean text of a document"),
    (10, "an item that has no id at all but it does have ten words"), (11, "one two three four five six seven eight nine ten"), (12, "filler " * 3000 + PASSAGE),
    (13, "ünï cödé wörds zählen auch mit und nöch mehr davon BITTE"), (14, "another text of item one which is long enough to be a window by itself " + PASSAGE),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, "k", 1) for d in DOCS], "doc_id long, text string, key string, n_words int")
    return docs, spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, hash int")


@pytest.mark.parametrize("window", [10, 6])
def test_digest_equals_brute_force(tables, window):
    got = sorted(map(tuple, leak_digest(*tables, window).collect()), key=str)
    assert got == brute(DOCS, ITEMS, window)


def test_empty_tables(tables):
    docs, items = tables
    assert leak_digest(docs.limit(0), items).collect() == []
    assert not any(r["contaminated"] for r in leak_digest(docs, items.limit(0)).collect())


def test_drop_keeps_all_columns_and_clean_rows(tables):
    docs, items = tables
    kept = drop_contaminated(docs, items.where("item_id is null or item_id <> 4"))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert drop_contaminated(docs, items.where("item_id is null or item_id <> 4"), max_share=0.5).where("doc_id = 12").count() == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=60), st.lists(st.integers(0, 3), min_size=10, max_size=60))
def test_shared_windows_keep_a_common_gram(x, y):
    def grams(words):
        return {(g[1], g[3]): g[2] for g in fingerprints([b"w%d" % w for w in words], _Hashes(), 10, 5, [], None, True)}

    one, two = grams(x), grams(y)
    shared = {tuple(x[i : i + 10]) for i in range(len(x) - 9)} & {tuple(y[i : i + 10]) for i in range(len(y) - 9)}
    for span in shared:
        inside = {b" ".join(b"w%d" % w for w in span[i : i + 5]) for i in range(6)}
        assert inside & {g for _, g in one} & {g for _, g in two}


def test_last_of_equal_grams_is_kept():
    assert winnowed(np.zeros(8, dtype=np.uint64), 6).tolist() == [5, 6, 7]
    assert words_of("A\x7fb-Ç9") == [b"a", b"b", "Ç9".encode()]
