"""Written intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only in local sessions."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="pagebundle-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after an error, the tables that were staged inside.

    For work whose results have been written elsewhere by then, such as a micro-batch:
    results that are still lazy would read deleted files. Scopes may be nested; each
    deletes its own tables. Without a scope tables stay until the checkpoint folder goes.
    """
    mine: list[str] = []
    before = _staged.set(mine)
    try:
        yield
    finally:
        _staged.reset(before)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read many times: cuts lineage and survives lost executors.

    Preferred over checkpoint(), which evaluates its input twice and reads back
    every column; a Parquet table is written in one pass and read pruned.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_root(spark)}/{app}/{label}-{uuid.uuid4().hex}"
    if (mine := _staged.get()) is not None:
        mine.append(path)  # before it is written: a failed write leaves files too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
