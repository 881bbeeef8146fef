"""Random bundles against straightforward sequential models, with tiny blocks."""

import random

from pyspark.sql import functions as F

from pagebundle import SplitConfig
from pagebundle.operators import segments as sg
from pagebundle.operators import verdicts as vd
from pagebundle.operators.scan import prefix_scan

FACTS = (
    "bundle_id long, page_number int, is_first boolean, document_type string, "
    "confidence double, signals array<string>, "
    "affinities array<struct<document_type:string,phrase:string>>, is_empty boolean, "
    "confirmed_empty boolean, removable boolean"
)


def random_facts(rng, bundles, longest):
    rows = []
    for b in range(bundles):
        for p in range(1, rng.randint(1, longest) + 1):
            first = rng.random() < 0.15
            aff = [t for t in "AB" if rng.random() < 0.25]
            empty = rng.random() < 0.2
            rows.append((b, p, first, rng.choice("AB") if first else "?", 0.9 if first else 0.2,
                         ["s"], [(t, t.lower()) for t in aff], empty, empty,
                         empty and rng.random() < 0.7))
    return rows


def walk(rows, verdicts):
    """Reference walk: page after page, per bundle."""
    out, state = [], {}
    for b, p, first, kind, _, _, aff, empty, _, removable in rows:
        cur, known, seg = state.get(b, ("", False, 0))
        v = verdicts.get((b, p, cur if known else ""))
        if first:
            cur, known, seg, what = kind, True, seg + 1, "first"
        elif known and cur in {t for t, _ in aff}:
            what = "phrase"
        elif removable:
            what = "removed"
        elif not empty and v and v[0]:
            cur, known, seg, what = v[1], True, seg + 1, "first"
        elif not empty and v and known and v[1] == cur:
            what = "verdict"
        else:
            what, seg = "unmatched", seg if known or seg else 1
        state[b] = (cur, known, seg)
        out.append((b, p, what, seg, cur if known else None))
    return sorted(out, key=repr)


def result(states):
    rows = states.select("bundle_id", "page_number", "kind", "segment_id", "current_type")
    return sorted(map(tuple, rows.collect()), key=repr)


def test_states_equal_sequential_walk(spark):
    rows = random_facts(random.Random(1), 300, 12)
    facts = spark.createDataFrame(rows, FACTS)
    want = walk(rows, {})
    for size in (1, 3, 4096):
        assert result(sg.page_states(facts, SplitConfig(block_pages=size))) == want


def test_verdict_states_equal_sequential_walk(spark):
    rng = random.Random(2)
    rows = random_facts(rng, 150, 25)
    stored, verdicts = [], {}
    for row in rows:
        for current in ("", "A", "B", "C"):
            if rng.random() < 0.5:
                first, kind = rng.random() < 0.6, rng.choice("ABC")
                if not first and kind != current:
                    continue  # the guard would refuse it
                verdicts[(row[0], row[1], current)] = (first, kind)
                stored.append((row[0], row[1], current,
                               ((first, kind, False, 0.9, ["x"], []), [], True)))
    facts = spark.createDataFrame(rows, FACTS)
    judged = spark.createDataFrame(
        stored, f"bundle_id long, page_number int, current_type string, hint {vd.HINT_SCHEMA}"
    )
    want = walk(rows, verdicts)
    # all runs folded; all runs by pointer jumping; a mixture
    for size, limit in ((4096, 1000), (3, 0), (5, 6)):
        cfg = SplitConfig(block_pages=size)
        assert result(vd.verdict_states(facts, judged, cfg, fold_limit=limit)) == want


def test_coverage_of_pages(spark):
    rows = random_facts(random.Random(3), 200, 15)
    from pagebundle.operators import documents as dc

    cfg = SplitConfig(block_pages=2)
    states = sg.no_verdicts(sg.page_states(spark.createDataFrame(rows, FACTS), cfg))
    docs = dc.documents(states, cfg)
    removed = {(r.bundle_id, r.page_number) for r in states.where("kind = 'removed'").collect()}
    covered = {}
    for r in docs.collect():
        for p in range(r.start_page, r.end_page + 1):
            assert (r.bundle_id, p) not in covered
            covered[(r.bundle_id, p)] = r.document_index
    for row in rows:
        assert (row[0], row[1]) in covered or (row[0], row[1]) in removed
    inside = {(r.bundle_id, r.page_number, r.document_index)
              for r in dc.removed_pages(states, docs, cfg).collect()}
    assert inside == {(b, p, covered[(b, p)]) for b, p in removed if (b, p) in covered}


def test_prefix_scan_without_keys(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = prefix_scan(df, [], ["i"], F.floor(F.col("i") / 9).cast("long"),
                      sums={"s": F.col("v")}, priors={"p": F.when(F.col("v") == 3, F.col("i"))})
    total, last = 0, None
    for r in got.orderBy("i").collect():
        total += r.v
        assert (r.s, r.p) == (total, last)
        last = r.i if r.v == 3 else last
