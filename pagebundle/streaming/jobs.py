"""Streaming counterparts of the batch operators.

Stateful streams need the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = ROCKSDB_PROVIDER.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagebundle import fixed
from pagebundle.config import SplitConfig
from pagebundle.operators import metrics as mt
from pagebundle.operators.scan import page_block
from pagebundle.plans.split import split_bundles
from pagebundle.sources import sinks
from pagebundle.streaming import processors as pr
from pagebundle.staging import staging_scope

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
_BLOCKS = (
    "bundle_id long, block long, page_number int, text string, page_count long, error string"
)


def complete_blocks(
    pages: DataFrame, cfg: SplitConfig, ttl_seconds: int, delay: str = "10 minutes"
) -> DataFrame:
    """pages (bundle_id, page_number, text, page_count, ts) -> pages of complete blocks,
    and an error row per block given up.

    A page also announces the blocks next to its own. If a whole block never arrives, one
    that borders on an arrived block is known by this and gives up in time.
    """
    size = cfg.block_pages
    own, last = page_block("page_number", size), page_block("page_count", size)
    blocks = F.filter(F.array(own, own - 1, own + 1), lambda b: (b >= 0) & (b <= last))
    keyed = (
        pages.withWatermark("ts", delay)
        .withColumn("block", F.explode(blocks))
        .withColumn("page_number", F.when(F.col("block") == own, F.col("page_number")))
        .withColumn("text", F.when(F.col("page_number").isNotNull(), F.col("text")))
    )
    return keyed.groupBy("bundle_id", "block").transformWithStateInPandas(
        pr.BlockAssembler(cfg.block_pages, ttl_seconds), _BLOCKS, "Append", "EventTime"
    )


def _failed(spark, root: str, batch_id: int) -> DataFrame:
    """Bundles given up before this batch."""
    return sinks.written_before(spark, f"{root}/failed", "bundle_id long, batch_id long", batch_id).select("bundle_id")


def _complete_bundles(batch: DataFrame, batch_id: int, root: str, size: int) -> DataFrame:
    """Pages of the bundles whose last missing block is in this batch.

    Bundles of one block are complete at once; blocks of longer ones are kept in a
    table until the others arrive. Writing is by batch id, so replays change nothing.
    """
    spark = batch.sparkSession
    good = batch.where("error IS NULL").drop("error")
    single = good.where(F.col("page_count") <= size).drop("block", "page_count")
    long = good.where(F.col("page_count") > size)
    path = f"{root}/blocks"
    long.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    schema = "bundle_id long, block long, page_number int, text string, page_count long, batch_id long"
    kept = sinks.written_before(spark, path, schema, batch_id + 1)
    kept = kept.join(_failed(spark, root, batch_id + 1), "bundle_id", "left_anti")
    touched = kept.join(long.select("bundle_id").distinct(), "bundle_id", "left_semi")
    finished = (
        touched.select("bundle_id", "page_count", "block").distinct()
        .groupBy("bundle_id", "page_count").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.ceil(F.col("page_count") / F.lit(size)))
    )
    whole = kept.join(finished.select("bundle_id"), "bundle_id", "left_semi")
    return single.unionByName(whole.select("bundle_id", "page_number", "text"))


def split_stream(
    pages: DataFrame,
    patterns: DataFrame,
    cfg: SplitConfig,
    root: str,
    ttl_seconds: int = 3600,
    delay: str = "10 minutes",
) -> StreamingQuery:
    """Split every bundle once, when all its pages arrived; tables under ``root``:
    documents, summaries, and failed (bundles given up)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            given_up = batch.where("error IS NOT NULL").groupBy("bundle_id").agg(F.min("error").alias("error"))
            given_up.join(_failed(batch.sparkSession, root, batch_id), "bundle_id", "left_anti").withColumn(
                "status", F.lit(fixed.STATUS_FAILED)
            ).write.mode("overwrite").parquet(f"{root}/failed/batch_id={batch_id}")
            ready = _complete_bundles(batch, batch_id, root, cfg.block_pages)
            with staging_scope(batch.sparkSession):  # a stream must not fill the shared folder
                split = split_bundles(ready, patterns, cfg).staged()
                split.documents.write.mode("overwrite").parquet(
                    f"{root}/documents/batch_id={batch_id}"
                )
                split.summary.write.mode("overwrite").parquet(
                    f"{root}/summaries/batch_id={batch_id}"
                )
        finally:
            batch.unpersist()

    return (
        complete_blocks(pages, cfg, ttl_seconds, delay).writeStream.foreachBatch(handle)
        .outputMode("append")
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """element_id, seq, kind, ts with its watermark, and at: milliseconds, rounded up."""
    at = F.ceil(F.unix_micros("ts") / 1000).cast("long")
    return events.select("element_id", "seq", "kind", "ts", at.alias("at")).withWatermark("ts", delay)


def dedup_stream(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Submissions with their duplicates; events as in operators.jobs.

    Only kinds that open or close a job reach the state. Submissions without element are
    never duplicates and need none. Without ``delay`` an element's events must arrive in
    order and are answered at once. With it they may arrive in any order within that delay
    (ts is a timestamp, not null); each is answered once the watermark has passed it.
    """
    anonymous = events.where((F.col("kind") == "submit") & F.col("element_id").isNull()).select(
        "seq", "element_id", F.lit(False).alias("duplicate"), F.col("seq").alias("job_id")
    )
    relevant = events.where(
        F.col("kind").isin("submit", "done", "failed", "delete") & F.col("element_id").isNotNull()
    )
    schema = "seq long, element_id long, duplicate boolean, job_id long"
    if delay is None:
        named = relevant.select("element_id", "seq", "kind").groupBy("element_id").transformWithStateInPandas(
            pr.SubmissionDedup(), schema, "Update", "None"
        )
    else:
        named = _timed(relevant, delay).groupBy("element_id").transformWithStateInPandas(
            pr.OrderedSubmissionDedup(), schema, "Update", "EventTime"
        )
    return named.unionByName(anonymous)


def job_state_stream(events: DataFrame, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Every change of a job's state; events carry job_id."""
    relevant = events.where(
        F.col("kind").isin("submit", "running", "done", "failed", "delete")
        & F.col("job_id").isNotNull()
    ).select("job_id", "seq", "kind", "ts")
    return relevant.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        pr.JobState(ttl_seconds), "job_id long, status string", "Update", "EventTime"
    )


def attempts_stream(
    events: DataFrame, max_attempts: int, limit_seconds: int, delay: str = "0 seconds",
    reorder: bool = False,
) -> DataFrame:
    """Outcome of every stay in processing, and ``stalled`` after the limit.

    Events must arrive in order per element, unless ``reorder``: then they may arrive in any
    order within ``delay``, and count once the watermark has passed them.
    """
    relevant = events.where(
        F.col("kind").isin("enter", "lost", "failed", "done") & F.col("element_id").isNotNull()
    )
    processor = pr.OrderedAttemptsOutcome if reorder else pr.AttemptsOutcome
    return _timed(relevant, delay).groupBy("element_id").transformWithStateInPandas(
        processor(max_attempts, limit_seconds, fixed.OUTCOME_DONE, fixed.OUTCOME_ERROR),
        "element_id long, epoch long, outcome string, attempts long", "Update", "EventTime",
    )


def metrics_stream(metrics: DataFrame, window: str | None = None) -> DataFrame:
    """Running totals over job metrics (use output mode complete), or per tumbling window."""
    if window is None:
        return mt.metrics_snapshot(metrics)
    return mt.metrics_by_window(metrics, window)


def children_stream(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Child rows written once each, also across restarts and replays."""
    return (
        documents.writeStream.foreachBatch(lambda b, i: sinks.write_children(b, i, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
