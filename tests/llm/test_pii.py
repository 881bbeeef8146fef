import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagebundle.llm.pii import KINDS, DisclosureConfig, pii_digest, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_spans(text):
    return sorted(
        (m.start(), i, k, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])
    )


def coded(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_patterns_equal_the_plain_ones(spark):
    rng = random.Random(12)
    texts = [
        None, "", "a@b.c", "a@b.com_x@y.zz", "x@@y.z a@b..c q@r.s.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.4", "4111 1111 1111 1111",
        "4111-1111-1111-1112 4111111111111111", "+1 (555) 123-4567 ext", "+1 2", "😀 é a@b.de ñ 10.0.0.1", "+49 30 1234567 a@b.co 4111111111111111",
        "9" * 20_000, "a" * 20_000, "1." * 5_000, "a@" * 5_000, "+1 " + "2-" * 3_000 + "3", "4111111111111111 " * 50,
    ]
    texts += ["".join(rng.choice("a1@.+- 9(_é") for _ in range(rng.randrange(60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_digest(docs).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(coded(want).encode()).hexdigest(), texts[r["doc_id"]][:80]
        assert r["spans"] == coded(want)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in want) for k in KINDS]


def corpus(n=400):
    rng = random.Random(3)
    filler = lambda k: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(50)) for _ in range(k))
    texts = [filler(80) for _ in range(n)]
    for i in range(6):  # one name only ever near one address
        texts[i] = f"{filler(70)} Zaphod's mail zb@heart.org here {filler(70)}"
    for i in range(6, 16):  # one mostly near another address, once elsewhere
        texts[i] = f"{filler(70)} Tricia mail tm@heart.org here {filler(70)}"
    texts[20] = f"{filler(30)} tricia {filler(30)}"
    texts[21] = f"{filler(30)} ZAPHOD, {filler(30)} ok@x.yz"
    return texts


def test_disclosing_terms_equal_a_brute_force_estimate(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token = re.compile(r"[^\W_]+")
    n_t, n_e, n_et = Counter(), Counter(), Counter()
    for t in texts:
        n_t.update(set(token.findall(t.lower())))
        pairs, found = set(), set()
        for a, _, k, b in plain_spans(t):
            near = token.findall(t[:a].lower())[-5:] + token.findall(t[b:].lower())[:5]
            found.add((k, t[a:b]))
            pairs |= {((k, t[a:b]), w) for w in near}
        n_e.update(found)
        n_et.update(pairs)
    n = len(texts)
    share = {}
    for (e, w), c in n_et.items():
        if c >= 3:
            value = math.log2(n * c / (n_e[e] * n_t[w])) / math.log2(n / n_e[e])
            share[w] = max(share.get(w, -9), value)
    want = {w for w, s in share.items() if s >= 0.8}
    assert {"zaphod", "tricia"} <= want
    for r in pii_digest(docs).collect():
        text = texts[r["doc_id"]]
        spans = plain_spans(text) + [(m.start(), 4, "term", m.end()) for m in token.finditer(text) if m[0].lower() in want]
        assert r["spans"] == coded(sorted(spans)), text
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "heart.org" not in clean[0] and "Zaphod" not in clean[0]
    assert "ZAPHOD" not in clean[21] and clean[30] == texts[30]
    none = pii_digest(docs, DisclosureConfig(generalise_above=1.1, remove_above=1.2)).collect()
    assert not any("term" in r["spans"] for r in none)


def test_copies_are_no_evidence_and_edges(spark):
    text = "quux mail q@r.st " + "word " * 50
    rows = [(i, text, 3) for i in range(20)] + [(50, None, 1), (51, "", 0), (None, "a@b.cd", 6), (52, "x" * 200_000 + " a@b.cd", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("base", F.lit("mine")).withColumn("key", F.lit(1))
    assert {r["spans"] for r in pii_digest(docs).where("doc_id < 20").collect()} == {"email:10:16"}
    cleaned = sanitise(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert got[0]["text"].startswith("quux mail [EMAIL] word") and got[0]["n_chars"] == len(got[0]["text"])
    assert got[50]["text"] is None and got[51]["text"] == "" and got[None]["text"] == "[EMAIL]" and got[50]["n_chars"] == 1
    assert pii_digest(docs.union(docs)).count() == 2 * len(rows)
    assert pii_digest(docs.limit(0)).count() == 0 and sanitise(docs.limit(0)).count() == 0
    overlapping = spark.createDataFrame([(1, "+4111111111111111 x")], "doc_id long, text string")
    assert sanitise(overlapping).first()["text"] in ("[CARD] x", "+[CARD] x", "[PHONE] x")
