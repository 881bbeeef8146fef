"""Stream results equal the batch results on the same data."""

from pyspark.sql import functions as F

from pagebundle import SplitConfig
from pagebundle.operators import jobs as jb
from pagebundle.operators import metrics as mt
from pagebundle.plans.split import split_bundles
from pagebundle.sources import adapters as ad
from pagebundle.streaming import jobs as st

from conftest import SF_DIR


def as_stream(spark, df, path, files, order):
    """Rows of df as a file stream in ``files`` micro-batches, cut along ``order``."""
    n = df.count()
    ranked = df.orderBy(order).collect()
    size = -(-n // files)
    for i in range(files):
        part = spark.createDataFrame(ranked[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    )


def drain(stream, root, mode="update"):
    """Run to the end; all rows ever emitted."""
    out = f"{root}/out"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(keep).outputMode(mode)
        .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_split_stream_equals_batch(spark, tmp_path):
    pages = ad.conversation_pages(spark, SF_DIR)
    counted = pages.join(ad.page_counts(pages), "bundle_id").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    # one page of bundle 3 and a whole middle block of bundle 4 never arrive
    longest = spark.createDataFrame([(4000 + i // 9, i % 9 + 1, "THING") for i in range(18)],
                                    "bundle_id long, page_number int, text string")
    longest = longest.withColumn("page_count", F.lit(9)).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    counted = counted.select(*longest.columns).unionByName(longest)
    missing = counted.where("NOT (bundle_id = 3 AND page_number = 2)").where(
        "NOT (bundle_id = 4001 AND page_number BETWEEN 4 AND 6)"
    )
    late = spark.createDataFrame(
        [(999, 1, "THING", 1, "2024-01-02")],
        "bundle_id long, page_number int, text string, page_count long, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    later = late.withColumn("bundle_id", F.lit(1000).cast("long")).withColumn(
        "ts", F.lit("2024-01-03").cast("timestamp"))
    path = tmp_path / "in"
    for part in (
        missing.where("page_number % 2 = 0"), missing.where("page_number % 2 = 1"),
        missing.where("page_number = 1"), late, later,
    ):
        part.select("bundle_id", "page_number", "text", F.col("page_count").cast("long").alias(
            "page_count"), "ts").coalesce(1).write.mode("append").parquet(str(path))
    cfg = SplitConfig(block_pages=3)  # most bundles span several blocks
    schema = "bundle_id long, page_number int, text string, page_count long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    root = str(tmp_path / "tables")
    st.split_stream(stream, ad.trial_dictionary(spark), cfg, root, 3600).awaitTermination()
    got = spark.read.parquet(f"{root}/documents").where("bundle_id < 900").drop("batch_id")
    want = split_bundles(
        pages.where("bundle_id <> 3"), ad.trial_dictionary(spark), cfg
    ).documents
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    failed = spark.read.parquet(f"{root}/failed").collect()
    assert sorted((r.bundle_id, r.status) for r in failed) == [(3, "failed"), (4001, "failed")]
    assert {r.error for r in failed if r.bundle_id == 4001} == {"block 2: 0 of 3 pages arrived in time"}
    split = spark.read.parquet(f"{root}/documents").where("bundle_id >= 4000").select("bundle_id").distinct()
    assert [r.bundle_id for r in split.collect()] == [4000]


def test_dedup_stream_equals_batch(spark, tmp_path):
    events = ad.job_events(spark, SF_DIR).withColumn(
        "element_id", F.when(F.col("seq") % 7 > 0, F.col("element_id"))
    )
    stream = as_stream(spark, events, tmp_path / "in", 4, "seq")
    got = drain(st.dedup_stream(stream), tmp_path).drop("batch_id")
    want = jb.dedup_submissions(jb.job_log(events))
    cols = ["seq", "element_id", "duplicate", "job_id"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(
        map(tuple, want.select(cols).collect())
    )


def test_job_state_stream_equals_batch_and_expires(spark, tmp_path):
    log = jb.job_log(ad.job_events(spark, SF_DIR)).where("NOT duplicate").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    stream = as_stream(spark, log, tmp_path / "in", 3, "seq")
    emitted = drain(st.job_state_stream(stream, 10**9), tmp_path)
    latest = emitted.groupBy("job_id").agg(F.max_by("status", "batch_id").alias("status"))
    want = jb.job_state(log).select("job_id", "status")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))
    shuffled = as_stream(spark, log, tmp_path / "in3", 4, F.xxhash64("seq"))
    emitted = drain(st.job_state_stream(shuffled, 10**9, "10000 days"), tmp_path / "shuffled")
    latest = emitted.groupBy("job_id").agg(F.max_by("status", "batch_id").alias("status"))
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))
    stream = as_stream(spark, log, tmp_path / "in2", 3, "seq")
    emitted = drain(st.job_state_stream(stream, 3600), tmp_path / "ttl")
    assert emitted.where("status = 'expired'").count() > 0


def test_nothing_brings_a_deleted_job_back(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, 1, "submit"), (4, 1, "delete"), (3, 1, "running"), (5, 1, "done"), (7, 2, "done"), (6, 2, "running")],
        "seq long, job_id long, kind string",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("at", F.monotonically_increasing_id())
    stream = as_stream(spark, events, tmp_path / "in", 6, "at")
    emitted = drain(st.job_state_stream(stream, 10**9, "10000 days"), tmp_path).orderBy("batch_id").collect()
    assert [r.status for r in emitted if r.job_id == 1] == ["queued", "deleted"]
    assert [r.status for r in emitted if r.job_id == 2][-1] == "done"


def test_attempts_stream_equals_batch(spark, tmp_path):
    events = ad.job_events(spark, SF_DIR, signup="enter").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    stream = as_stream(spark, events, tmp_path / "in", 3, "seq")
    emitted = drain(st.attempts_stream(stream, 3, 10**9), tmp_path)
    got = emitted.where("outcome <> 'stalled'").select("element_id", "epoch", "outcome", "attempts")
    want = jb.attempts_outcome(events, 3).where("outcome IS NOT NULL").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stream = as_stream(spark, events, tmp_path / "in2", 3, "seq")
    stalled = drain(st.attempts_stream(stream, 3, 3600), tmp_path / "b")
    assert stalled.where("outcome = 'stalled'").count() > 0


def disordered(spark, events, path):
    """Events shifted by up to three days against each other over micro-batches, then a far later one."""
    jitter = F.pmod(F.xxhash64("seq"), F.lit(3 * 86_400))
    shuffled = events.withColumn("at", F.unix_seconds("ts") + jitter)
    end = spark.createDataFrame([(10**9, "2100-01-01", -1, "busy")], "seq long, ts string, element_id long, kind string")
    stream = as_stream(spark, shuffled, path, 6, "at")
    last = end.select("seq", F.col("ts").cast("timestamp").alias("ts"), "element_id", "kind")
    late = last.withColumn("kind", F.lit("submit")).unionByName(last.withColumn("kind", F.lit("lost")))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in shuffled.schema if f.name not in late.columns]
    late.select("*", *missing).select(shuffled.columns).coalesce(1).write.mode("append").parquet(str(path))
    return stream


def test_dedup_stream_reorders_within_the_delay(spark, tmp_path):
    events = ad.job_events(spark, SF_DIR).withColumn("ts", F.col("ts").cast("timestamp"))
    emitted = drain(st.dedup_stream(disordered(spark, events, tmp_path / "in"), "4 days"), tmp_path)
    got = emitted.where("element_id >= 0").select("seq", "element_id", "duplicate", "job_id")
    want = jb.dedup_submissions(jb.job_log(events.where("element_id IS NOT NULL"))).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert emitted.select("batch_id").distinct().count() > 3  # not only at the end


def test_attempts_stream_reorders_within_the_delay(spark, tmp_path):
    events = ad.job_events(spark, SF_DIR, signup="enter").withColumn("ts", F.col("ts").cast("timestamp"))
    limit = 2 * 86_400
    stream = disordered(spark, events, tmp_path / "in")
    emitted = drain(st.attempts_stream(stream, 3, limit, "4 days", reorder=True), tmp_path)
    got = sorted(tuple(r) for r in emitted.where("element_id >= 0").drop("batch_id").collect())
    state, want = {}, []
    rows = events.where("element_id IS NOT NULL").orderBy("seq")
    for element, kind, t in rows.select("element_id", "kind", F.unix_micros("ts") / 1e6).collect():
        epoch, tries, outcome, deadline = state.get(element, (0, 0, None, None))
        if kind in ("enter", "lost", "failed", "done") and deadline is not None and deadline < t:
            want.append((element, epoch, "stalled", tries))
            deadline = None
        if kind == "enter":
            epoch, tries, outcome, deadline = epoch + 1, 0, None, t + limit
        elif outcome is None and kind in ("lost", "failed", "done"):
            tries += kind != "done"
            outcome = "GOTOWE" if kind == "done" else "BLAD" if tries >= 3 else None
            if outcome:
                want.append((element, epoch, outcome, tries))
                deadline = None
        state[element] = (epoch, tries, outcome, deadline)
    want += [(e, epoch, "stalled", tries) for e, (epoch, tries, _, deadline) in state.items() if deadline is not None]
    assert got == sorted(want) and any(r[2] == "stalled" for r in got)


def test_metrics_stream_equals_batch(spark, tmp_path):
    metrics = ad.table(spark, SF_DIR, "documents").select(
        *[F.col("n_chars").alias(c) for c in mt.COUNTERS],
        (F.col("n_chars") / 8.0).alias("duration_seconds"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("ts"),
    )
    stream = as_stream(spark, metrics, tmp_path / "in", 2, "ts")
    emitted = drain(st.metrics_stream(stream), tmp_path, "complete")
    last = emitted.agg(F.max("batch_id")).first()[0]
    got = emitted.where(F.col("batch_id") == last).drop("batch_id").collect()
    assert [tuple(r) for r in got] == [tuple(mt.metrics_snapshot(metrics).first())]
    stream = as_stream(spark, metrics, tmp_path / "in2", 2, "ts").withWatermark("ts", "1 minute")
    windows = drain(st.metrics_stream(stream, "1 hour"), tmp_path / "w", "append")
    whole = {r["start"]: tuple(r) for r in mt.metrics_by_window(metrics, "1 hour").collect()}
    rows = windows.drop("batch_id").collect()
    assert rows and all(tuple(r) == whole[r["start"]] for r in rows)


def test_children_written_once(spark, tmp_path):
    docs = split_bundles(
        ad.conversation_pages(spark, SF_DIR), ad.trial_dictionary(spark)
    ).documents
    stream = as_stream(spark, docs, tmp_path / "in", 3, F.desc("document_index"))
    path = str(tmp_path / "children")
    st.children_stream(stream, path, str(tmp_path / "ckpt")).awaitTermination()
    # the same input delivered again (as after a lost checkpoint) adds nothing new
    again = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in")
    )
    st.children_stream(again, path, str(tmp_path / "ckpt2")).awaitTermination()
    children = spark.read.parquet(path)
    assert children.count() == docs.count()
    assert children.select("bundle_id", "document_index").distinct().count() == docs.count()
