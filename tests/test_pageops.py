import random

from pyspark.sql import functions as F

from pagebundle.operators import pageops as po

REQUEST = "request_id string, bundle_id long, spec string, page_count long"


def parse(spark, cases):
    df = spark.createDataFrame([(str(i), i, s, n) for i, (s, n) in enumerate(cases)], REQUEST)
    rows = po.parse_page_ranges(df).collect()
    out = {}
    for r in rows:
        pages = r.intervals and [p for i in r.intervals for p in range(i.lo, i.hi + 1)]
        out[int(r.request_id)] = r.error or pages
    return [out[i] for i in range(len(cases))]


def test_examples_and_errors(spark):
    assert parse(spark, [
        ("2-4,7", 10), ("7,2-3,3", 10), ("", 10), (None, 10), (" , ,", 10), ("5-8", 6),
        ("5-2", 10), ("2-x", 10), ("y,3-1", 10), ("3-1,y", 10), ("-3", 10), ("+5, 6 ", 10),
        ("0", 10), ("1-999999999999", 10), ("99999999999999999999999", 5), ("1_0", 10),
    ]) == [
        [2, 3, 4, 7], [2, 3, 7], "Zakres stron jest pusty", "Zakres stron jest pusty",
        "Zakres stron jest pusty", "Strona 7 poza dokumentem (1-6)", "Odwrocony zakres: '5-2'",
        "Nieprawidlowy fragment zakresu: '2-x'", "Nieprawidlowy numer strony: 'y'",
        "Odwrocony zakres: '3-1'", "Nieprawidlowy fragment zakresu: '-3'", [5, 6],
        "Strona 0 poza dokumentem (1-10)", "Strona 11 poza dokumentem (1-10)",
        "Strona 99999999999999999999999 poza dokumentem (1-5)", [10],
    ]


def test_numbers_of_any_length_are_exact(spark):
    long = "9" * 60
    assert parse(spark, [
        ("99999999999999999999-9999999999999999", 10), (f"1-{long}", 10), (f"{long},{long}0", 10),
        (f"{long}0-{long}", 10), ("0" * 50 + "3", 10), (f"+{long}", 10), ("1__0", 10), ("-0", 10),
    ]) == [
        "Odwrocony zakres: '99999999999999999999-9999999999999999'",
        "Strona 11 poza dokumentem (1-10)", f"Strona {long} poza dokumentem (1-10)",
        f"Odwrocony zakres: '{long}0-{long}'", [3], f"Strona {long} poza dokumentem (1-10)",
        "Nieprawidlowy numer strony: '1__0'", "Nieprawidlowy fragment zakresu: '-0'",
    ]


def bundles(spark, rng, n):
    counts = {b: rng.randint(1, 12) for b in range(n)}
    rows = [(b, p, f"t{b}.{p}") for b, c in counts.items() for p in range(1, c + 1)]
    return counts, spark.createDataFrame(rows, "bundle_id long, page_number int, text string")


def test_edits_match_list_operations(spark):
    rng = random.Random(4)
    counts, pages = bundles(spark, rng, 60)
    picks = {b: sorted(rng.sample(range(1, c + 1), rng.randint(1, c))) for b, c in counts.items()}
    requests = spark.createDataFrame(
        [(f"r{b}", b, ",".join(map(str, rng.sample(s, len(s)))), counts[b])
         for b, s in picks.items()], REQUEST,
    )
    for size in (1, 4, 4096):
        got = po.extract_pages(pages, requests, size).collect()
        assert {(r.bundle_id, r.new_page): r.page_number for r in got} == {
            (b, i): p for b, s in picks.items() for i, p in enumerate(s, 1)
        }
        got = po.remove_pages(pages, requests, size).collect()
        want = {}
        for b, s in picks.items():
            for i, p in enumerate([p for p in range(1, counts[b] + 1) if p not in s], 1):
                want[(b, i)] = p
        assert {(r.bundle_id, r.new_page): r.page_number for r in got} == want
    whole = {f"r{b}" for b, s in picks.items() if len(s) == counts[b]}
    errors = po.remove_requests(requests).where("error IS NOT NULL").collect()
    assert {r.request_id for r in errors} == whole
    moved = po.move_pages(
        pages, requests.withColumn("remove_from_source", F.lit(True)), 3
    )
    assert {r.request_id for r in moved.select("request_id").distinct().collect()} == {
        f"r{b}" for b in counts} - whole
    asked = requests.withColumn("replace_in_place", F.lit(False)).withColumn("category", F.lit("c"))
    kept = po.replace_pages(pages, asked, 3).where("output = 'source'")
    assert kept.count() == sum(c for b, c in counts.items() if f"r{b}" not in whole)


def test_merge_and_split(spark):
    rng = random.Random(5)
    counts, pages = bundles(spark, rng, 20)
    members = [(b % 4, rng.random(), b) for b in counts] + [(9, 0.5, 3), (9, 0.7, 3)]
    members.sort()
    rows = [(o, i, b) for i, (o, _, b) in enumerate(members, 1)]
    table = spark.createDataFrame(rows, "output_id long, member_order int, bundle_id long")
    sizes = spark.createDataFrame(list(counts.items()), "bundle_id long, page_count long")
    want = {}
    for o, _, b in rows:
        want.setdefault(o, []).extend((b, p) for p in range(1, counts[b] + 1))
    for size in (2, 4096):
        got = {}
        merged = po.merge_bundles(pages, table, sizes, size)
        for r in sorted(merged.collect(), key=lambda r: (r.output_id, r.new_page)):
            got.setdefault(r.output_id, []).append((r.bundle_id, r.page_number))
            assert r.new_page == len(got[r.output_id])
        assert got == want
    outputs = spark.createDataFrame([(9, None), (77, "x.pdf")],
                                    "output_id long, output_file_name string")
    summary = {r.output_id: r for r in po.merge_summary(outputs, table, sizes).collect()}
    assert summary[9].output_file_name == "merged.pdf" and summary[9].error is None
    assert summary[77].error == "Brak plikow PDF do sklejenia"


def test_document_pages_skip_removed(spark):
    rng = random.Random(6)
    docs, removed, pages, want = [], [], [], {}
    for b in range(30):
        page = 1
        for d in range(1, rng.randint(2, 5)):
            end = page + rng.randint(0, 9)
            gone = {p for p in range(page + 1, end) if rng.random() < 0.4}
            docs.append((b, d, page, end))
            removed += [(b, p) for p in gone]
            for i, p in enumerate([p for p in range(page, end + 1) if p not in gone], 1):
                want[(b, d, i)] = p
            page = end + 1
        removed.append((b, page))  # trails the last document
        pages += [(b, p, f"é{p}") for p in range(1, page + 1)]
    d = spark.createDataFrame(docs, "bundle_id long, document_index int, start_page int, end_page int")
    r = spark.createDataFrame(removed, "bundle_id long, page_number int")
    p = spark.createDataFrame(pages, "bundle_id long, page_number int, text string")
    for size in (1, 3, 4096):
        got = po.document_pages(p, d, r, size).collect()
        assert {(x.bundle_id, x.document_index, x.new_page): x.page_number for x in got} == want
    content = po.document_content(p, d, r, 2)
    assert content.agg(F.sum("pages")).first()[0] == len(want)
    assert content.count() == len(docs)
    first = content.where("bundle_id = 0 AND document_index = 1").first()
    assert bytes_of(first.content).split("\n") == [f"é{v}" for (b, k, _), v in sorted(want.items()) if (b, k) == (0, 1)]


def bytes_of(content):
    import base64

    return base64.b64decode(content, validate=True).decode()
