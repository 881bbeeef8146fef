import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pagebundle import SplitConfig
from pagebundle.operators import evaluation as ev
from pagebundle.operators import reads as rd
from pagebundle.operators import verdicts as vd
from pagebundle.sources import cases, sinks
from pagebundle.sources import dictionary as dic
from pagebundle.sources.pages import read_page_images, read_pages


def test_dictionary_source_requires_columns(spark):
    with pytest.raises(ValueError, match="missing required columns: Header, Weight"):
        dic.read_dictionary(spark.createDataFrame(
            [("a", "b", "c", 1)], "DocumentType string, Phrases string, ExcludedPhrases string, n int"
        ), "n")


def test_pattern_payloads(spark):
    ok = '[{"documentType":"A","header":"H","phrases":["p","q"]},' \
         '{"documentType":"B","header":"","weight":"1.2"}]'
    bad = ["[{", '{"header":"x"}', '[{"header":"x"}]', '[{"documentType":"A","header":"H",'
           '"weight":"heavy"}]', ""]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate([ok, "[]", *bad])],
                               "payload_id string, payload string")
    patterns, rejected = dic.parse_patterns(df)
    rows = patterns.orderBy("pattern_idx").collect()
    assert [(r.document_type, r.phrases, r.weight, r.active) for r in rows] == [
        ("A", ["p", "q"], 1.0, True), ("B", [], 1.2, True)
    ]
    assert {r.payload_id for r in rejected.collect()} == {"2", "3", "4", "5", "6"}


def png(width, height, gray):
    raw = b"".join(b"\0" + bytes(gray(x, y) for x in range(width)) for y in range(height))
    chunk = lambda kind, data: (
        struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    )
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_ink_of_page_images(spark, tmp_path):
    folder = tmp_path / "scans" / "5"
    folder.mkdir(parents=True)
    box = lambda x, y: 0 if 200 <= x < 300 and 200 <= y < 300 else 255
    for page, gray in ((1, lambda x, y: 255), (2, box), (3, lambda x, y: 230),
                       (4, lambda x, y: 0 if x < 10 else 255)):
        (folder / f"{page}.png").write_bytes(png(500, 700, gray))
    (folder / "6.png").write_bytes(b"not an image")
    images = read_page_images(spark, str(tmp_path / "scans"))
    ink = {r.page_number: r.ink_ratio
           for r in rd.image_ink_ratio(images, SplitConfig()).collect()}
    # 4 % off every side of 500 x 700 leaves 460 x 644
    assert ink == {1: 0.0, 2: 10000 / (460 * 644), 3: 0.0, 4: 0.0}


def test_ocr_merge_never_loses_text(spark):
    pages = spark.createDataFrame(
        [(1, 1, "short"), (1, 2, "tiny"), (1, 3, ""), (1, 4, "x" * 30), (1, 5, "")],
        "bundle_id long, page_number int, text string")
    ocr = spark.createDataFrame([(1, 1, "ab"), (1, 2, "longer text"), (1, 3, "ink"), (1, 4, "y" * 99)],
                                "bundle_id long, page_number int, ocr_text string")
    ink = spark.createDataFrame([(1, 3, 0.002), (1, 1, 0.5), (1, 4, 0.0)],
                                "bundle_id long, page_number int, ink_ratio double")
    got = {r.page_number: (r.text, r.blank)
           for r in rd.page_reads(pages, ink, ocr, SplitConfig()).collect()}
    assert got == {1: ("short", False), 2: ("longer text", False), 3: ("", True),
                   4: ("x" * 30, False), 5: ("", False)}
    off = rd.page_reads(pages, ink, ocr, SplitConfig(ocr_enabled=False))
    assert off.where("blank").count() == 0
    assert rd.page_reads(pages, None, ocr, SplitConfig()).count() == 5


def test_read_pages_fills_missing_text(spark, tmp_path):
    spark.createDataFrame([(1, 1, None)], "bundle_id long, page_number int, text string") \
        .write.parquet(str(tmp_path / "p"))
    assert read_pages(spark, str(tmp_path / "p")).first().text == ""


def test_reply_parsing_and_prompts(spark):
    replies = [
        '{"isFirstPage": true, "documentType": null, "isKnownType": false, "confidence": 60}',
        'x {"isFirstPage": "false", "documentType": "A", "isKnownType": true, "confidence": 0.5} y',
        '{"documentType": "A", "isKnownType": true, "confidence": 0.5}', "nothing", "}{",
        '{"isFirstPage": true, "documentType": "A", "isKnownType": true, "confidence": -1}',
        '{"isFirstPage": true, "documentType": "A", "isKnownType": true, "confidence": 250}',
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, c string")
    rows = [r.v for r in df.select("i", vd.parse_verdict(F.col("c")).alias("v")).orderBy("i").collect()]
    assert (rows[0].documentType, rows[0].confidence, rows[0].reasonCodes) == ("", 0.6, [])
    assert (rows[1].isFirstPage, rows[1].documentType, rows[1].confidence) == (False, "A", 0.5)
    assert rows[2:6] == [None] * 4 and rows[6].confidence == 1.0

    def reply(**changed):
        fields = {"isFirstPage": "true", "documentType": '"A"', "isKnownType": "true", "confidence": "0.5"}
        return "{" + ", ".join(f'"{k}": {v}' for k, v in (fields | changed).items()) + "}"

    rejected = [
        reply() + " i jeszcze {x}", reply().replace('"', "'"), reply() + reply(), reply(confidence='"60"'),
        reply(reasonCodes='"a"'), reply(reasonCodes="[1]"), reply(reasonCodes="null"), reply(reasonCodes='["a", null]'),
        reply(suggestedNewPatterns="null"), reply(documentType="7"), reply(documentType='["A"]'), reply(isFirstPage="null"),
        reply(isFirstPage="2"), reply(isKnownType='"maybe"'), reply(confidence="null"), reply(confidence='"nan"'), "{" + reply(),
    ]
    accepted = [
        reply(documentType="false"), reply(documentType="0"), reply(documentType='""'), reply(confidence='"0.25"'),
        reply(isFirstPage="1", isKnownType='"No"'), reply(confidence="true"), reply(reasonCodes='["a"]', suggestedNewPatterns="[]"),
    ]
    odd = spark.createDataFrame(list(enumerate(rejected + accepted)), "i int, c string")
    got = [r.v for r in odd.select("i", vd.parse_verdict(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got[: len(rejected)] == [None] * len(rejected)
    got = got[len(rejected):]
    assert [v.documentType for v in got] == ["", "", "", "A", "A", "A", "A"]
    assert got[3].confidence == 0.25 and got[5].confidence == 1.0 and got[6].reasonCodes == ["a"]
    assert (got[4].isFirstPage, got[4].isKnownType) == (True, False)
    context = spark.createDataFrame([("{aktualna_strona}", "p")],
                                    "aktualna_strona string, poprzednia_strona string")
    for name in vd.CONTEXT_FIELDS:
        if name not in context.columns:
            context = context.withColumn(name, F.lit("?"))
    shown = context.select(
        vd.render_prompt("{{a}} {aktualna_strona}").alias("a"),
        (vd.render_prompt("{nope}") == vd.render_prompt(None)).alias("b"),
        (vd.render_prompt("{") == vd.render_prompt(None)).alias("c"),
    ).first()
    assert tuple(shown) == ("{a} {aktualna_strona}", True, True)


def test_eval_cases_from_files(spark, tmp_path):
    for name, expected in (("b", {"isFirstPage": True, "documentType": "A"}), ("a", {"isKnownType": False})):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "id": name, "opis": "o", "znane_typy": ["A"], "typ_biezacego_dokumentu": "A",
            "poprzednia_strona": "", "aktualna_strona": "x", "nastepna_strona": "",
            "oczekiwane": expected}, indent=1))
    found = cases.read_cases(spark, str(tmp_path))
    assert [r.id for r in found.orderBy("source").collect()] == ["a", "b"]
    assert cases.read_cases(spark, str(tmp_path), ["b"]).count() == 1
    verdicts = spark.createDataFrame(
        [("b", (False, "It's", False, 0.9, [], []), [], 1.26, None)],
        f"id string, verdict {vd.VERDICT_SCHEMA}, guard array<string>, seconds double, error string")
    results = ev.evaluate_verdicts(found.withColumnRenamed("oczekiwane", "expected"), verdicts)
    rows = {r.id: r for r in results.collect()}
    assert rows["b"].mismatches == [
        "isFirstPage: oczekiwano True, otrzymano False",
        "documentType: oczekiwano 'A', otrzymano \"It's\"",
    ]
    assert not rows["a"]["pass"]
    assert tuple(ev.eval_summary(results).first()) == (0, 2, 1.3)
    cases.write_report(results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_children_resume_after_crash(spark, tmp_path):
    docs = spark.createDataFrame([(1, i, "t") for i in range(1, 6)],
                                 "bundle_id long, document_index int, document_type string")
    path = str(tmp_path / "children")
    sinks.write_children(docs.where("document_index <= 2"), 0, path)
    for _ in range(2):  # the second call is a replay of the same batch
        sinks.write_children(docs, 1, path)
    rows = spark.read.parquet(path).collect()
    assert sorted(r.document_index for r in rows) == [1, 2, 3, 4, 5]
    marks = sinks.advanced_marks(docs, spark.createDataFrame([(1, 7)], "bundle_id long, last_created int"))
    assert marks.first().last_created == 7
