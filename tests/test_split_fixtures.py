"""Small bundles with known answers."""

import pytest
from pyspark.sql import functions as F

from pagebundle import SplitConfig
from pagebundle.operators import verdicts as vd
from pagebundle.plans.split import split_bundles
from pagebundle.sources import dictionary as dic
from pagebundle.operators import documents as dc
from pagebundle.operators import segments as sg
from pagebundle.operators.tree import SECTION, concatenated
from pagebundle.sources.sinks import write_children

T2 = [
    ("t2", 0, "Karta sprzetu", "KARTA SPRZETU", ["numer seryjny", "stan licznika"], [], 1.2, True),
    ("t2", 1, "Protokol odbioru", "PROTOKOL ODBIORU", ["przekazano lokal"], [], 1.2, True),
]
HEAD0, HEAD1 = "KARTA SPRZETU numer seryjny", "PROTOKOL ODBIORU przekazano lokal"
PHRASE, FOREIGN = "stan licznika wody", "zaproszenie na festyn"
UNKNOWN = "Nieznany typ dokumentu"
CFG = SplitConfig(min_auto_accept_confidence=0.90)


def run(spark, bundles, cfg=CFG, blank=(), replies=None, patterns=T2):
    """bundles: list of page-text lists; blank: {(bundle, page)} without ink."""
    rows = [(b, p + 1, t) for b, pages in enumerate(bundles) for p, t in enumerate(pages)]
    pages = spark.createDataFrame(rows, "bundle_id long, page_number int, text string")
    ink = spark.createDataFrame(
        [(b, p, 0.0 if (b, p) in set(blank) else 0.1) for b, p, _ in rows],
        "bundle_id long, page_number int, ink_ratio double",
    )
    responses = replies and spark.createDataFrame(
        replies, "bundle_id long, page_number int, current_type string, content string"
    )
    return split_bundles(
        pages, spark.createDataFrame(patterns, dic.PATTERN_SCHEMA), cfg, ink, None, responses
    ).staged()


def docs(split, bundle=0):
    rows = split.documents.where(F.col("bundle_id") == bundle).orderBy("document_index").collect()
    return [(r.document_type, r.start_page, r.end_page, r.requires_review) for r in rows]


def texts(df, column, bundle=0):
    rows = df.where(F.col("bundle_id") == bundle).collect()
    key = [c for c in ("document_index", "section", "page_number", "position") if c in df.columns]
    return [r[column] for r in sorted(rows, key=lambda r: [r[k] for k in key])]


def test_rule_cases(spark):
    s = run(spark, [
        [HEAD0, PHRASE, FOREIGN, HEAD1],
        [FOREIGN, FOREIGN, HEAD0],
        [HEAD0, "przekazano lokal od maja"],
        [HEAD0, PHRASE, "PR0TOKOL ODBIORU przekazano lokal"],
        [FOREIGN, FOREIGN],
        [HEAD0, PHRASE, PHRASE, PHRASE],
    ])
    karta, proto = "Karta sprzetu", "Protokol odbioru"
    assert docs(s, 0) == [(karta, 1, 3, True), (proto, 4, 4, False)]
    assert "glued_unknown_page:3" in texts(s.signals, "signal", 0)
    assert texts(s.warnings, "warning", 0) == [
        "Strona 3: brak dopasowania - doklejona do dokumentu 'Karta sprzetu', "
        "wymagana weryfikacja"
    ]
    assert docs(s, 1) == [(UNKNOWN, 1, 2, True), (karta, 3, 3, False)]
    assert docs(s, 2) == [(karta, 1, 2, True)]
    assert texts(s.reasons, "reason", 2) == [
        "strona 2 doklejona bez dopasowania do wzorca (frazy pasuja do: 'Protokol odbioru'; "
        "LLM bez werdyktu)"
    ]
    assert docs(s, 3) == [(karta, 1, 2, False), (proto, 3, 3, False)]
    assert docs(s, 4) == [(UNKNOWN, 1, 2, True)]
    assert texts(s.reasons, "reason", 4) == [
        "nierozpoznany typ dokumentu (zadna regula nie pasowala)",
        "strona 1: zadna fraza nie pasuje; LLM bez werdyktu",
        "strona 2: zadna fraza nie pasuje; LLM bez werdyktu",
        "pewnosc 0.20 ponizej progu auto-akceptacji 0.90",
    ]
    assert docs(s, 5) == [(karta, 1, 4, False)]
    assert texts(s.signals, "signal", 5) == [
        "header_match:KARTA SPRZETU", "phrase_hits:1", "phrase_continuation:stan licznika(2,3,4)"
    ]
    status = {r.bundle_id: r.status for r in s.summary.collect()}
    assert status[0] == "requires_review" and status[5] == "completed"


BLANK_BUNDLES = [
    [HEAD0, "", PHRASE], [HEAD0, "   ", PHRASE], [HEAD0, "", "", ""], ["", ""],
]


@pytest.mark.parametrize("mode", ["remove", "report"])
def test_blank_pages(spark, mode):
    blank = {(0, 2), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2)}
    cfg = SplitConfig(min_auto_accept_confidence=0.90, empty_page_mode=mode)
    s = run(spark, BLANK_BUNDLES, cfg, blank)
    removed = {(r.bundle_id, r.page_number) for r in s.removed.collect()}
    if mode == "remove":
        assert removed == {(0, 2)}
        assert docs(s, 0) == [("Karta sprzetu", 1, 3, False)]
        assert texts(s.warnings, "warning", 0) == ["Usunieto 1 pustych stron: 2 (z 3)"]
        # ink without text stays and needs a look
        assert docs(s, 1) == [("Karta sprzetu", 1, 3, True)]
        assert any(w.startswith("Bezpiecznik: 3 z 4") for w in texts(s.warnings, "warning", 2))
    else:
        assert removed == set()
        assert any(
            w == "Tryb report: 1 stron wyglada na puste (nie usunieto): 2 (z 3)"
            for w in texts(s.warnings, "warning", 0)
        )
    assert docs(s, 3) == [(UNKNOWN, 1, 2, True)]


def test_never_removes_a_whole_bundle(spark):
    cfg = SplitConfig(empty_page_mode="remove", empty_page_max_share=1.0)
    s = run(spark, [["", ""]], cfg, {(0, 1), (0, 2)})
    assert s.removed.count() == 0 and s.documents.count() == 1


def reply(first, kind, known, confidence, codes="[]"):
    kind = "null" if kind is None else f'"{kind}"'
    return (
        f'{{"isFirstPage": {first}, "documentType": {kind}, "isKnownType": {known}, '
        f'"confidence": {confidence}, "reasonCodes": {codes}}}'
    )


def test_verdicts(spark):
    u = "Karta sprzetu"
    bundles = [[HEAD0, FOREIGN]] * 7
    s = run(spark, bundles, replies=[
        (0, 2, u, reply("true", "Aneks", "false", 0.85, '["layout"]')),
        (1, 2, u, reply("false", u, "true", 0.80)),
        (2, 2, u, reply("true", "Aneks", "false", 0.60)),
        (3, 2, u, reply("true", None, "false", 95)),
        (4, 2, u, reply("false", "Aneks", "false", 0.95)),
        (5, 2, u, "no json at all"),
        (6, 2, "", reply("true", "Aneks", "false", 0.95)),  # stored for another state
    ])
    assert docs(s, 0) == [(u, 1, 1, False), ("Aneks", 2, 2, True)]
    assert texts(s.signals, "signal", 0)[-1] == "llm:layout"
    assert docs(s, 1) == [(u, 1, 2, False)]
    for bundle in range(2, 7):
        assert docs(s, bundle) == [(u, 1, 2, True)]
    assert "LLM proponuje nowy typ: 'Aneks' (pewnosc 0.60)" in texts(s.reasons, "reason", 2)[0]
    assert "prawdopodobnie poczatek" in texts(s.reasons, "reason", 3)[0]
    assert "odrzucony jako niespojny (kontynuacja z typem 'Aneks' innym niz biezacy" in texts(
        s.reasons, "reason", 4)[0]
    pending = {(r.bundle_id, r.page_number) for r in vd.pending_verdicts(s.states).collect()}
    assert pending == {(6, 2)}


def test_scores_are_exact(spark):
    pattern = lambda w, i: ("d", i, f"T{i}", f"HEADER{i}", ["aa", "bb", "cc"], ["zz"], w, True)
    patterns = [pattern(1.0, 0), pattern(0.5, 1)]
    s = run(spark, [["HEADER0"], ["HEADER0 aa"], ["HEADER0 aa bb"], ["HEADER0 aa bb cc"],
                    ["HEADER0 zz"], ["HEADER1 aa bb"]], patterns=patterns)
    got = {r.bundle_id: r.confidence for r in s.documents.collect()}
    assert got == {0: 0.8, 1: 0.9, 2: 1.0, 3: 1.0, 4: 0.2, 5: 0.2}


def test_records_do_not_depend_on_blocks(spark, tmp_path):
    pages = [[HEAD0] + [PHRASE, FOREIGN] * 6, [FOREIGN] * 9 + [HEAD1] + [FOREIGN, PHRASE, ""] * 3]
    parents = spark.createDataFrame([(b, b + 100, "c") for b in range(2)], "bundle_id long, parent_id long, company_id string")

    def seen(size):
        split = run(spark, pages, SplitConfig(min_auto_accept_confidence=0.90, block_pages=size))
        children = dc.child_rows(split.records, parents, reasons_in_column=False)
        path = str(tmp_path / f"children-{size}")
        for batch in (0, 0, 1):  # replayed, and sent again
            write_children(children, batch, path)
        tables = (split.records, split.results, children, split.warnings, spark.read.parquet(path).drop("batch_id"))
        return [sorted(str(r.asDict(True)) for r in t.collect()) for t in tables]

    whole = seen(4096)
    assert len(whole[1]) == 2 and len(whole[0]) == len(whole[2]) == len(whole[4]) > 2
    assert seen(4) == whole and seen(1) == whole


def test_tree_keeps_the_order_of_sections_and_blocks(spark):
    rows = [(k, s * SECTION + b, [f"{s}-{b}-{i}" for i in range(b % 3)], b) for k in range(2) for s in range(3) for b in (0, 1, 5, 1023, 1024, 70_000)]
    table = spark.createDataFrame(rows, "k int, block long, items array<string>, n long").repartition(5)
    got = {r.k: r for r in concatenated(table, ["k"], "block", ["items"], sums=("n",)).collect()}
    for k in range(2):
        assert got[k]["items"] == [i for r in sorted(rows) if r[0] == k for i in r[2]]
        assert got[k]["n"] == sum(r[3] for r in rows if r[0] == k)


def test_tenants_may_share_bundle_ids(spark):
    cfg = SplitConfig(block_pages=2)
    texts = {
        "a": [[HEAD0, PHRASE, FOREIGN, FOREIGN, HEAD1], [FOREIGN, PHRASE, HEAD1, FOREIGN]],
        "b": [[FOREIGN, HEAD1, PHRASE, HEAD0, PHRASE], [HEAD0, FOREIGN, FOREIGN, ""]],
    }
    rows = [(d, b, p, f"{t} of {d}{b}{p}") for d, bundles in texts.items() for b, pages in enumerate(bundles) for p, t in enumerate(pages, 1)]
    pages = spark.createDataFrame(rows, "dict_id string, bundle_id long, page_number int, text string")
    pattern = lambda d, i, head: (d, i, f"T{i}{d}", head, [PHRASE], [], 1.0, True)
    schema = (
        "dict_id string, pattern_idx int, document_type string, header string, phrases array<string>,"
        " excluded_phrases array<string>, weight double, active boolean"
    )
    patterns = spark.createDataFrame([pattern("a", 0, HEAD0), pattern("a", 1, HEAD1), pattern("b", 0, HEAD1)], schema)
    reply = '{"isFirstPage": true, "documentType": "T%s", "isKnownType": true, "confidence": 0.9, "reasonCodes": ["x"], "suggestedNewPatterns": []}'
    replies = spark.createDataFrame([("a", 0, 3, "T0a", reply % "1a"), ("b", 1, 2, "", reply % "0b")], "dict_id string, bundle_id long, page_number int, current_type string, content string")

    def seen(tenants):
        own = lambda df: df.where(F.col("dict_id").isin(*tenants))
        split = split_bundles(own(pages), own(patterns), cfg, responses=own(replies)).staged()
        prompts = vd.pending_prompts(own(pages), split.states, own(patterns), cfg)
        tables = (split.documents, split.reasons, split.warnings, split.summary, split.records, split.results, prompts)
        return [{str(sorted(r.asDict(True).items())) for r in t.collect()} for t in tables]

    both, a, b = seen("ab"), seen("a"), seen("b")
    assert both == [x | y for x, y in zip(a, b)] and all(x and y for x, y in zip(both[:2], both[3:]))
    around = sg.page_context(pages, cfg, 99, 99).collect()
    for r in around:
        assert r.previous_text in ("", *(t for d, b_, p, t in rows if (d, b_, p) == (r.dict_id, r.bundle_id, r.page_number - 1)))
        assert (r.previous_text == "") == (r.page_number == 1)
