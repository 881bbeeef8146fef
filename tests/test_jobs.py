import random

from pyspark.sql import functions as F

from pagebundle.operators import jobs as jb
from pagebundle.operators import metrics as mt

EVENTS = "seq long, ts timestamp, element_id long, kind string, error string"


def events(spark, rows):
    df = spark.createDataFrame(
        [(s, e, k, f"e{s}") for s, e, k in rows], "seq long, element_id long, kind string, error string"
    )
    return df.select("seq", F.timestamp_seconds("seq").alias("ts"), "element_id", "kind", "error")


def random_rows(rng, kinds, n=3000, elements=25):
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.randint(1, 9)
        element = None if rng.random() < 0.05 else 1 if rng.random() < 0.3 else rng.randrange(elements)
        rows.append((seq, element, rng.choice(kinds)))
    return rows


def test_log_matches_a_sequential_registry(spark):
    rows = random_rows(random.Random(7), ["submit", "submit", "running", "done", "failed", "delete",
                                          "busy"])
    owner, open_, waiting, want = {}, {}, set(), []
    for seq, element, kind in rows:
        if element is None:
            mine = kind == "submit"
            want.append((seq, mine, False, seq if mine else None, False))
            continue
        accepted = kind == "submit" and not open_.get(element)
        if kind == "submit":
            open_[element] = True
        elif kind in ("done", "failed", "delete"):
            open_[element] = False
        leaves = kind == "running" and element in waiting
        if accepted:
            owner[element] = seq
            waiting.add(element)
        elif kind == "running":
            waiting.discard(element)
        want.append((seq, accepted, kind == "submit" and not accepted, owner.get(element), leaves))
    for block in (50, 10**6):
        log = jb.job_log(events(spark, rows), block)
        got = log.select("seq", "accepted", "duplicate", "job_id", "dequeues").collect()
        assert sorted(map(tuple, got)) == want
    depth, expected = 0, []
    for seq, accepted, _, _, leaves in want:
        if accepted or leaves:
            depth += 1 if accepted else -1
            expected.append((seq, depth, accepted and depth - 1 >= 4))
    got = jb.backlog_depth(log, 4, 70).select("seq", "depth", "met_full_queue").collect()
    assert sorted(map(tuple, got)) == expected


def test_attempts_match_a_sequential_element(spark):
    rows = random_rows(random.Random(8), ["enter", "lost", "failed", "done", "busy", "failed"])
    state, want = {}, {}
    for seq, element, kind in rows:
        if element is None:
            continue
        epoch, tries, outcome = state.get(element, (0, 0, None))
        if kind == "enter":
            epoch, tries, outcome = epoch + 1, 0, None
        elif outcome is None and kind in ("lost", "failed"):
            tries += 1
            outcome = "BLAD" if tries >= 3 else None
        elif outcome is None and kind == "done":
            outcome = "GOTOWE"
        state[element] = (epoch, tries, outcome)
        want[(element, epoch)] = (outcome, tries)
    for block in (60, 10**6):
        got = jb.attempts_outcome(events(spark, rows), 3, block).collect()
        assert {(r.element_id, r.epoch): (r.outcome, r.attempts) for r in got} == want


def at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def test_states_positions_stats_expiry(spark):
    log = jb.job_log(events(spark, [
        (1, 1, "submit"), (2, 2, "submit"), (3, 3, "submit"), (4, 1, "running"), (5, 4, "submit"),
        (6, 1, "done"), (7, 2, "running"), (8, 2, "failed"), (9, 4, "delete"), (10, 1, "submit"),
    ]))
    jobs = jb.job_state(log)
    assert {r.job_id: r.status for r in jobs.collect()} == {
        1: "done", 2: "failed", 3: "queued", 10: "queued"
    }
    positions = {r.job_id: r.position for r in jb.queue_position(jobs, 4).collect()}
    assert positions == {1: 0, 2: 0, 3: 1, 10: 2}
    stats = jb.queue_stats(jobs, at(20)).first()
    assert tuple(stats) == (2, 0, 1, 1, 17.0)
    assert {r.job_id for r in jb.expired_jobs(jobs, at(3607), 3600).collect()} == {1}
    empty = jb.queue_stats(jobs.where("false"), at(20)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0)
    lookups = spark.createDataFrame([(1, 1), (2, 3), (3, 77)], "lookup_id long, job_id long")
    codes = {r.lookup_id: r.code for r in jb.result_readiness(lookups, jobs).collect()}
    assert codes == {1: 200, 2: 409, 3: 404}


def test_metrics_totals(spark):
    rows = [(1, 5, 1, 0, 2, 1, 1.0), (2, 7, 0, 2, 2, 0, 2.0)]
    df = spark.createDataFrame(rows, "job long, " + ", ".join(f"{c} long" for c in mt.COUNTERS)
                               + ", duration_seconds double")
    total = mt.metrics_snapshot(df).first()
    assert (total.pages_total, total.documents_total, total.review_rate,
            total.processing_seconds_total) == (12, 4, 0.25, 3.0)
    assert mt.metrics_snapshot(df.where("false")).first().review_rate == 0.0
    running = mt.metrics_running(df, "job", 1).orderBy("job").collect()
    assert [r.pages_total for r in running] == [5, 12] and running[1][1:] == tuple(total)
