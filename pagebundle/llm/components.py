"""Connected components of an edge table by alternating large-star and small-star steps.

After every step each component's edges lie closer to its smallest node; both steps are
one grouping and one equality join, so no component is ever gathered in a task, and a
star with many leaves is a key whose join Spark can split. Every round's edges are
written to the shared checkpoint folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagebundle.llm.common import stage


def _towards_smallest(directed: DataFrame) -> DataFrame:
    """For each u with neighbours v: edges of all v and of u itself to the smallest of them."""
    best = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return directed.join(best, "u")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of ``edges`` with the smallest node reachable from it.

    Edges with a null end or equal ends are ignored; repeated ones count once.
    """
    now = stage(
        edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "components-0",
    )
    state = _state(now)
    for i in count(1):
        if state[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _towards_smallest(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stage(large, f"components-{i}-large")
        small = _towards_smallest(large)
        now = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            f"components-{i}",
        )
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.col("v").cast("decimal(38,0)")).cast("string"),
        ).first()
    )
