import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagebundle.llm.alignment import EMPTY, Aligner, aligned, alignment_digest

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """Ids and bytes of both encodings of a whole text, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    from pagebundle.llm.alignment import byte_of_char

    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a = one.encode(" " + text, add_special_tokens=False)
    chars = byte_of_char()
    a_bytes = [bytes(chars[c] for c in t) for t in a.tokens]
    b = two.encode(text)
    b_bytes = []
    for i in b:
        piece = two.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    return (a.ids, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else ([], [], [], [])


def brute(texts):
    rows, counts = [], Counter()
    for text in texts:
        a, a_bytes, b, b_bytes = tokens(text) if text else ([], [], [], [])

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(a_bytes), spans(b_bytes)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for cut in cuts:
            inside = lambda s: low <= s[0] and s[1] <= cut  # noqa: E731, B023
            groups.append(",".join(str(i) for i, s in zip(a, sa) if inside(s)) + "|" + ",".join(str(i) for i, s in zip(b, sb) if inside(s)))
            low = cut
        links = [(i, j) for i, s in zip(a, sa) for j, t in zip(b, sb) if s[0] < t[1] and t[0] < s[1]]
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (n_a, n_b, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, n, links, g in rows
    ]


TEXTS = [
    None, "", " ", "  ", "a", "a ", " a  b ", "a\n b", "a \n\n  b", "tab\tx\r\n y  z  w", "\x1c x\x1f y", "naïve façade 漢字かな 😀😀 ﬁ ½",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "under▁score is not a space", "á é", "it's they'll 12345 ''' --- ...", "\x00\x01 nul",
    "repeated repeated repeated", "repeated repeated repeated", "word " * 60, "x" * 400, "  lead and trail   ", "क्षत्रिय ไทย العربية",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 2), (3, "a second row of id three", "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n_a int").repartition(3)


@pytest.mark.parametrize("range_bytes", [65_536, 16])
def test_digest_equals_brute_force(spark, table, range_bytes):
    rows = table.collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows]))), key=str)
    got = alignment_digest(table, *PATHS, range_bytes=range_bytes, fan=3)
    assert got.columns == ["doc_id", *FIELDS]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_pairs_beyond_the_broadcast_bound(spark, table):
    whole = sorted(map(str, alignment_digest(table, *PATHS).collect()))
    assert sorted(map(str, alignment_digest(table, *PATHS, max_pairs=8).collect())) == whole


def test_empty_table_and_texts_of_groups(spark, table):
    assert alignment_digest(table.limit(0), *PATHS).collect() == []
    long = sorted(str((r["doc_id"], r["groups"])) for r in aligned(table, *PATHS, range_bytes=9, fan=4).collect())
    short = sorted(str((r["doc_id"], r["groups"])) for r in aligned(table, *PATHS).collect())
    assert long == short and "(4, '257|264')" in short


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30), st.data())
def test_any_tree_gives_the_same(a_lens, b_lens, data):
    # Ids are lengths; both sides get the same total.
    total = min(sum(a_lens), sum(b_lens))

    def fit(lens):
        out = []
        for n in lens:
            out.append(min(n, total - sum(out)))
        return np.array([n for n in out if n > 0], dtype=np.int32)

    a, b = fit(a_lens), fit(b_lens)
    aligner = Aligner(np.arange(5), np.arange(5))
    parts = [aligner.fragment(x, y, i, j) for _, x, y, i, j in aligner.ranges(a, b, data.draw(st.integers(1, 9)))]
    while len(parts) > 1:
        i = data.draw(st.integers(0, len(parts) - 2))
        parts[i : i + 2] = [aligner.compose(parts[i], parts[i + 1])]
    got, want = aligner.compose(EMPTY, parts[0]), aligner.fragment(a, b, 0, 0)
    assert got[5:8] == want[5:8]
    assert got.pairs.tolist() == want.pairs.tolist() and got.times.tolist() == want.times.tolist()
    assert len(got.prefix_a) == len(got.suffix_a) == len(got.suffix_b) == 0
