"""Costly expressions are found once per row, and faster forms give the same rows."""

from pyspark.sql import functions as F

from pagebundle import SplitConfig
from pagebundle.operators import rules, term_index
from pagebundle.operators import verdicts as vd
from pagebundle.sources import dictionary as dic

PATTERNS = [
    ("t", 3, "A", "Faktura 1", ["ala", "ala", "Żółw"], ["kot"], 1.0, True),
    ("t", 1, "B", "Umowa", ["ma"], [], 0.5, True),
    ("t", 2, "C", "Aneks", [""], [], float("nan"), True),
    ("t", 4, "D", "Nota", ["ala"], [], 1.0, False),
]
PAGES = [
    (1, 1, "faktura l: ala ma zolwia"), (1, 2, "umowa ala ma kota"), (1, 3, ""), (1, 4, None), (1, 5, "aneks"),
    (None, 6, "umowa"), (1, 1, "ma ma"),
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def dictionary(spark, rows=PATTERNS):
    return spark.createDataFrame(rows, dic.PATTERN_SCHEMA)


def texts(spark):
    return spark.createDataFrame(PAGES, "bundle_id long, page_number int, text string")


def test_compiled_scores_equal_array_functions(spark):
    pages, patterns = texts(spark), dictionary(spark)
    few, none = SplitConfig(), SplitConfig(max_compiled_terms=0)
    got, want = (rules.score_pages(pages, patterns, cfg) for cfg in (few, none))
    assert got.schema["scored"].dataType.simpleString() == want.schema["scored"].dataType.simpleString()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want) and len(rows(got)) == len(PAGES)
    found = got.select("bundle_id", F.inline("scored")).where("header_match")
    # twice for the exclusion, once for each other term: no test is repeated per pattern
    assert plan(found).count("contains(") < 10
    unknown = dictionary(spark, [("t", 1, "A", "Umowa", None, None, 1.0, True)])
    assert rows(rules.score_pages(pages, unknown, few)) == rows(rules.score_pages(pages, unknown, none))


def test_json_is_parsed_once(spark):
    replies = spark.createDataFrame([(1, 1, "A", "{}")], "bundle_id long, page_number int, current_type string, content string")
    judged = vd.judged_verdicts(replies, dictionary(spark), SplitConfig())
    shown = plan(judged.where("hint.verdict IS NOT NULL"))
    assert shown.count("parseJson") == 1 and shown.count("schemaOfVariant") < 20
    payloads = spark.createDataFrame([("1", "[]")], "payload_id string, payload string")
    for part in dic.parse_patterns(payloads):
        assert plan(part).count("parseJson") == 1


def test_grams_are_looked_up_in_the_task(spark):
    pages = texts(spark).where("bundle_id IS NOT NULL").withColumn("dict_id", F.explode(F.array(F.lit("t"), F.lit("u"), F.lit(None))))
    patterns = dictionary(spark)
    index = term_index.rarest_grams(term_index.numbered_patterns(patterns))
    found = term_index._found_in_pages(pages, index, SplitConfig())
    widths = {}
    for r in index.select("place", "width").distinct().collect():
        widths.setdefault(r.place, []).append(r.width)
    grams = term_index.page_grams(pages.where("dict_id IS NOT NULL"), widths, SplitConfig())
    want = grams.join(index.select("sig", "pattern_no"), "sig").drop("sig").distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found.distinct()) == rows(want) and rows(want)
    assert found.count() <= len(PAGES) * 3  # no row per gram leaves the task


def test_lookup_across_cuts_of_a_batch(spark):
    pages = spark.createDataFrame(
        [(1, n, "t", "x" * n + text) for n, text in enumerate(("abcdefgh", "abc", "defgh", "", "bcdefg"))],
        "bundle_id long, page_number int, dict_id string, text string",
    ).coalesce(1)
    shared = spark.sparkContext.broadcast({("t", "body"): {
        3: term_index.np_table(["abc"], [1]), 6: term_index.np_table(["bcdefg", "ghabcx"], [2, 3]),
    }})
    for positions in (1, 4, 1000):
        looked = term_index._looked_up(shared, positions)("dict_id", "text", F.lit(""))
        got = {r.page_number: sorted(r.n) for r in pages.select("page_number", looked.alias("n")).collect()}
        assert got == {0: [1, 2], 1: [1], 2: [], 3: [], 4: [2]}
