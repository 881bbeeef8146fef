import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagebundle.llm.bpe import Merges, Tokenizer, bpe_digest, decoder, encode_pieces, read_ranks, with_token_ids

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_and_round_trips(ranks, reference):
    rng = random.Random(8)
    texts = ["", None, "<|endoftext|>", "a\x1c\x1d b\x85c  \n\n d", "日本語の文" * 90, "😀" * 200, "I'm we'll  DON'T"]
    texts += ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in
              [("ab", 9000), ("a", 7001), ("theaionr", 20_000), ("0123 ", 3000), ("é ñß.", 2000), ("=-", 2001)]]
    tokenizer = Tokenizer(ranks, public_tokenizers.PATTERN, max_bytes=2_000, chunk_chars=50)
    for text, (n, ids, decoded) in zip(texts, tokenizer.encode(texts), strict=True):
        want = reference.encode_ordinary(text or "")
        assert (n, ids) == (len(want), ",".join(map(str, want)))
        assert decoded.decode() == (text or "")


def test_any_vocabulary_merges_lowest_rank_then_leftmost():
    """Also where a merge makes a pair of lower rank: compared with a plain quadratic loop."""

    def plain(piece, ranks):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if piece in ranks:
                return [ranks[piece]]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(11)
    for _ in range(300):
        vocabulary = {bytes([i]) for i in range(256)}
        longer = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 60))})
        rng.shuffle(longer)
        ranks = {t: i for i, t in enumerate([*sorted(vocabulary), *longer])}
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
        assert encode_pieces(pieces, Merges(ranks)) == [plain(p, ranks) for p in pieces]


def test_columns(spark, reference):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    digest = bpe_digest(docs, PATH, public_tokenizers.PATTERN).collect()
    want = reference.encode_ordinary("Hello world")
    assert len(digest) == 5 and digest[0]["n_tokens"] == len(want)
    assert digest[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert digest[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and digest[2]["n_tokens"] == 0
    coded = with_token_ids(docs, PATH, public_tokenizers.PATTERN)
    back = coded.select("text", "n_tokens", decoder(spark, PATH)("token_ids").alias("b")).collect()
    assert [bytes(r["b"]).decode() for r in back] == [r["text"] or "" for r in back] and back[0]["n_tokens"] == "mine"
    assert bpe_digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
