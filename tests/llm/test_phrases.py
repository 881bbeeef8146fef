import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagebundle.llm.phrases import QuotientFilter, collocations, merged_slices, permuted, phrase_digest, restored, summed


def brute(docs, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    rows = []
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, words), a in found.items():
        inside = [b for (other, longer), b in found.items() if other == lang and len(longer) == 3 > len(words) and words in (longer[:2], longer[1:])]
        if any(100 * b >= 50 * a for b in inside):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(words), a, left, right, n[lang], score))
    out = []
    for lang in sorted({r[0] for r in rows}):
        ranked = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(ranked[:top], 1)]
    return out


DOCS = (
    [("de", "der Hund. Der Hund bellt laut, der HUND bellt")] * 9
    + [(None, "New York city is big; new york city")] * 12
    + [("und", "new york\x0bnew\tyork new york")] * 3
    + [("en", "a b c d a b x\x1fy a b")] * 10
    + [("en", "the the the the ünï ünï")] * 11
    + [("en", None), ("en", ""), ("fr", "..."), ("fr", "rare words only"), ("en", "tail " * 4000)]
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*d, 1, 2) for d in DOCS], "lang string, text string, f int, id int").repartition(4)


def test_digest_equals_brute_force(table):
    got = phrase_digest(table)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(DOCS)
    assert sorted(map(tuple, phrase_digest(table, top=2).collect())) == brute(DOCS, top=2)


def test_small_filters_and_bitmaps_give_the_same(table):
    want = sorted(map(tuple, collocations(table).collect()))
    assert sorted(map(tuple, collocations(table, entries=5, filter_bits=6, max_broadcast=0).collect())) == want


def test_empty_table(table):
    assert phrase_digest(table.limit(0)).collect() == []


keys = st.lists(st.tuples(*[st.sampled_from([0, 1, 2, 2**63, 2**64 - 1])] * 3), max_size=60)


@settings(max_examples=100, deadline=None)
@given(keys, st.integers(0, 12), st.integers(1, 3))
def test_filters_of_shards_merge_without_loss(rows, bits, limbs):
    shards = [QuotientFilter(limbs, bits) for _ in range(3)]
    for i, row in enumerate(rows):
        shards[i % 3].add([np.array([x], dtype=np.uint64) for x in row[:limbs]])
    by_quotient = {}
    for shard in shards:
        for quotient, remainders, counts in shard.slices():
            by_quotient.setdefault(quotient, []).append((remainders, counts))
    got = Counter()
    for quotient, slices in by_quotient.items():
        ids, counts = merged_slices(quotient, bits, limbs, slices)
        for *key, n in zip(*[x.tolist() for x in ids], counts.tolist()):
            got[tuple(key)] += n
            assert n > 0
    assert got == Counter(r[:limbs] for r in rows)


@settings(max_examples=50, deadline=None)
@given(keys)
def test_permutation_can_be_undone_and_equal_first_limbs_are_told_apart(rows):
    limbs = [np.array([r[i] for r in rows], dtype=np.uint64) for i in range(3)]
    assert [x.tolist() for x in restored(permuted(limbs))] == [x.tolist() for x in limbs]
    held, counts = summed(limbs, np.ones(len(rows), dtype=np.int64))
    assert dict(zip(zip(*[x.tolist() for x in held]), counts.tolist())) == dict(Counter(rows))
