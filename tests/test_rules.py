"""The three ways of scoring a dictionary agree with each other and with known scores."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from pagebundle import SplitConfig, fixed
from pagebundle.operators import rules, term_index
from pagebundle.sources import adapters as ad
from pagebundle.sources import dictionary as dic

from conftest import SF_DIR


def rows(df):
    cols = ["bundle_id", "page_number", "is_first", "document_type", "confidence", "signals",
            "affinities"]
    return sorted(map(repr, df.select(cols).collect()))


def test_compiled_array_broadcast_and_indexed_paths_agree(spark, monkeypatch):
    monkeypatch.setattr(rules, "_WORD_BITS", 3)
    pages = ad.document_pages(spark, SF_DIR)
    patterns = ad.trial_dictionary(spark)
    compiled = rows(rules.classify_pages(pages, patterns, SplitConfig()))
    assert compiled == rows(rules.classify_pages(pages, patterns, SplitConfig(max_compiled_terms=0)))
    assert compiled == rows(
        rules.classify_pages(pages.withColumn("dict_id", F.lit("trial")), patterns, SplitConfig())
    )
    big = SplitConfig(max_embedded_patterns=3)
    assert compiled == rows(rules.classify_pages(pages, patterns, big))
    assert compiled == rows(
        rules.classify_pages(pages.withColumn("dict_id", F.lit("trial")), patterns, big)
    )


def test_index_and_chunks_agree(spark, monkeypatch):
    """Also where the index and the dictionary are too large to broadcast."""
    pages = ad.document_pages(spark, SF_DIR)
    patterns = ad.trial_dictionary(spark)
    want = rows(rules.classify_pages(pages, patterns, SplitConfig()))
    monkeypatch.setattr(rules, "_CHUNK_ROWS", 2)
    monkeypatch.setattr(term_index, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(term_index, "_PIECE", 7)
    assert want == rows(rules.classify_pages(pages, patterns, SplitConfig(max_embedded_patterns=3)))
    free = SplitConfig(unknown_threshold=0.0)
    assert rows(rules.classify_pages(pages, patterns, free)) == rows(
        rules.classify_pages(pages, patterns, replace(free, max_embedded_patterns=3))
    )


def brute_force(texts, patterns, cfg):
    """(type, confidence, signals, affinities) of each text, pattern by pattern."""
    got, spaced = [], lambda t: " ".join(t.upper().split())
    patterns = [
        (kind, header, fold(header.upper()), [(p, spaced(p)) for p in phrases],
         [spaced(e) for e in excluded], weight)
        for kind, header, phrases, excluded, weight, _ in patterns
    ]
    for whole in texts:
        norm = spaced(whole)
        zone = fold(norm[: cfg.header_zone_chars])
        best, pairs = None, []
        for kind, header, folded, phrases, excluded, weight in patterns:
            if any(e in norm for e in excluded):
                continue
            head = folded in zone
            hits = [p for p, term in phrases if term in norm]
            pairs += [(kind, p) for p in hits if (kind, p) not in pairs]
            score = (cfg.header_weight * weight if head else 0.0) + (
                cfg.phrase_weight * len(hits) * weight if hits else 0.0)
            score = max(0.0, min(score, 1.0))
            if best is None or score > best[0]:
                best = (score, kind, header, head, len(hits))
        if best is None or best[0] < cfg.unknown_threshold:
            got.append((fixed.UNKNOWN_DOCUMENT_TYPE, fixed.UNKNOWN_CONFIDENCE,
                        [fixed.NO_MATCH_SIGNAL], pairs))
            continue
        score, kind, header, head, n = best
        signals = [fixed.HEADER_SIGNAL + header] * head + [f"{fixed.PHRASE_SIGNAL}{n}"] * (n > 0)
        got.append((kind, score, signals, pairs))
    return got


def fold(word):
    return word.translate(str.maketrans("".join(fixed.OCR_DIGITS), "".join(fixed.OCR_LETTERS)))


def test_thirty_thousand_patterns_against_brute_force(spark):
    rng = random.Random(5)
    syllables = [a + b for a in "BDKLMNRST" for b in "AEIOU"]
    word = lambda n=3: "".join(rng.choices(syllables, k=n))
    words = [word(rng.randint(3, 4)) for _ in range(5000)]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    patterns = []
    for i in range(30_000):
        phrases = [phrase(rng.randint(1, 3)) for _ in range(rng.randint(0, 3))]
        # many patterns share one phrase; a few have an empty or a very short one
        phrases += ["COMMON WORDS"] * (i % 50 == 0) + [""] * (i % 20_000 == 7) + ["Q"] * (i % 9_000 == 1)
        excluded = [phrase(1)] * (i % 5 == 0) + [""] * (i % 10_000 == 3)
        patterns.append((f"T{i % 700}", phrase(rng.randint(1, 4)), phrases, excluded,
                         rng.choice([0.5, 1.0, 1.0, 2.0]), True))
    texts = ["", " ", "Q", "common words"]
    for _ in range(20):
        body = [phrase(40)]
        for _ in range(rng.randint(0, 3)):
            kind, header, phrases, *_ = rng.choice(patterns)
            body += [header, *phrases]
        rng.shuffle(body)
        texts.append(" \n ".join(body))
    texts += [texts[-1], phrase(1500) + " " + patterns[50][1], patterns[50][1] + " " + phrase(1500)]
    cfg = SplitConfig()
    out = classify(spark, patterns, [*texts, None], cfg)
    want = brute_force(texts, patterns, cfg)
    assert len(out) == len(texts) + 1 and out[-1].signals == [fixed.NO_MATCH_SIGNAL]
    for row, (kind, score, signals, pairs) in zip(out, want):
        assert (row.document_type, row.confidence, row.signals) == (kind, score, signals)
        assert [tuple(a) for a in row.affinities] == pairs


def test_index_leaves_most_patterns_alone(spark):
    """A page meets the patterns that share a rare gram with it, not the dictionary."""
    patterns = [("T", f"INVOICE NUMBER {i:05d}", [f"CLAUSE {i:05d} OF"], [], 1.0, True) for i in range(5000)]
    table = spark.createDataFrame([("d", i, *p) for i, p in enumerate(patterns)], dic.PATTERN_SCHEMA)
    pages = spark.createDataFrame(
        [("d", 1, 1, "invoice number 00017 and clause 00400 of"), ("d", 1, 2, "invoice number"),
         ("e", 1, 1, "invoice number 00017")],
        "dict_id string, bundle_id long, page_number int, text string",
    )
    found = term_index.candidate_patterns(pages, table, SplitConfig()).collect()
    assert len(found) == 1 and (found[0].dict_id, found[0].page_number) == ("d", 1)
    assert {17, 400} <= {p.pattern_idx for p in found[0].patterns} and len(found[0].patterns) < 60


def classify(spark, patterns, texts, cfg=SplitConfig()):
    df = spark.createDataFrame(list(enumerate(texts)), "bundle_id long, text string").withColumn(
        "page_number", F.lit(1)
    )
    table = spark.createDataFrame([("d", i, *p) for i, p in enumerate(patterns)],
                                  dic.PATTERN_SCHEMA)
    out = rules.classify_pages(df, table, cfg).orderBy("bundle_id").collect()
    return out


def test_edge_cases(spark):
    patterns = [
        ("A", "UMOWA", ["x1", "x1", "", "y"], [], 1.0, True),
        ("B", "UMOWA", ["x1"], [], 1.0, True),
        ("C", "—", ["umowa"], [], 9.0, True),
        ("D", "SKIP", [], [""], 5.0, True),
        ("E", "OFF", [], [], 1.0, False),
    ]
    for cfg in (SplitConfig(), SplitConfig(max_compiled_terms=0)):
        tie, dup, off, skip, far = classify(
            spark, patterns, ["um0wa x1".replace("0", "O"), "x1", "OFF", "SKIP",
                              "z " * 700 + "UMOWA"], cfg
        )
        # duplicated phrases count twice, an empty phrase always matches
        assert tie.document_type == "A" and tie.confidence == 1.0
        assert tie.signals == ["header_match:UMOWA", "phrase_hits:3"]
        assert [tuple(a) for a in tie.affinities] == [("A", "x1"), ("A", ""), ("B", "x1")]
        assert not dup.is_first and dup.confidence == 0.2
        assert off.confidence == 0.2 and skip.confidence == 0.2
        # a header beyond the zone does not count
        assert far.signals == ["no_pattern_match"]


def test_first_page_by_phrases_alone(spark):
    seven = [("A", "NOWHERE", [f"w{i}" for i in range(7)], [], 1.0, True)]
    (page,) = classify(spark, seven, [" ".join(f"w{i}" for i in range(7))])
    assert page.is_first and page.confidence == 0.1 * 7


def test_no_patterns_and_known_types(spark):
    empty = rules.classify_pages(
        ad.conversation_pages(spark, SF_DIR), dic.empty_dictionary(spark), SplitConfig()
    )
    assert empty.where("is_first OR confidence <> 0.2").count() == 0
    types = {r[0] for r in dic.known_types(ad.trial_dictionary(spark)).select(
        "document_type").collect()}
    assert types == {"Alpha", "Beta", "Gamma", "Void"}
