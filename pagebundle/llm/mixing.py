"""Mixing sources to target weights as a proportionate-fair schedule.

Each source's rows are cut into blocks. With weight w (its share of all slots), block k
of a source (k = 1, 2, ...) is released at slot floor((k - 1) / w) and due by slot
ceil(k / w). Serving in each slot the released block with the earliest deadline meets all
deadlines, so that after any number t of slots each source has had between floor(w t) and
ceil(w t) blocks: the deviation from its target stays below one block, always.

Weights are rounded to multiples of 1 / ``period`` (largest remainders, at least one
each), so the schedule repeats after ``period`` slots with every source exactly on
target. One period is computed (its size is a parameter, not a matter of the data) and
broadcast; the slot of a block is arithmetic: period number * period + place in the
period. The schedule ends with the slot in which the last source has been through all
its rows once; sources that are short for their weight start again (a new epoch), so the
mix keeps its target to the end and no row is left out.

Rows are numbered within their source without gathering it: rows fall into buckets by a
hash, are numbered inside (source, bucket), and bucket offsets are summed on the small
table of bucket counts. A source with a third of all rows is numbered in as many tasks
as it has buckets.

Defined cases: a null source is a source of its own. Sources without a given weight get
the default of ``tempered_weights``; given sources without rows take no slots. Repeated
rows are rows of their own. Other columns stay; where one has the name of a column to be
added, the added one gets a leading underscore. An empty table gives an empty schedule.
The sources are listed on the driver: up to ``MAX_SOURCES``, more are an error.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagebundle.llm.common import fresh, small_table, stable_number, stage

PERIOD = 1_000
MAX_SOURCES = 100_000
#: hash buckets a source is numbered in; more where the table is large
BUCKETS = 1024
BLOCK_ROWS = 16
TEMPER = 0.85


def tempered_weights(rows: dict[str | None, int], temper: float = TEMPER) -> dict[str | None, float]:
    """Shares of the sources' sizes to a power below one: large sources a little less, small ones more."""
    return {s: n**temper for s, n in rows.items() if n}


def quanta(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Slots of each source in a period: largest remainders, at least one."""
    if not weights:
        return {}
    if len(weights) > period:
        raise ValueError("the period must have a slot for every source")
    total = sum(weights.values())
    order = sorted(weights, key=lambda s: (s is not None, s or ""))
    exact = {s: weights[s] / total * period for s in order}
    got = {s: max(1, int(exact[s])) for s in order}
    while (left := period - sum(got.values())) != 0:
        step = 1 if left > 0 else -1
        able = [s for s in order if step > 0 or got[s] > 1]
        best = max(able, key=lambda s: step * (exact[s] - got[s]))
        got[best] += step
    return got


def schedule_period(slots: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, k, release, deadline, slot) of one period, earliest deadline first; k from 1."""
    period = sum(slots.values())
    waiting: list[list[tuple]] = [[] for _ in range(period + 1)]
    for rank, source in enumerate(sorted(slots, key=lambda s: (s is not None, s or ""))):
        weight = Fraction(slots[source], period)
        for k in range(1, slots[source] + 1):
            release, deadline = (k - 1) / weight, k / weight
            waiting[release.__floor__()].append((deadline.__ceil__(), rank, k, release.__floor__(), source))
    ready: list[tuple] = []
    served = []
    for slot in range(period):
        for block in waiting[slot]:
            heapq.heappush(ready, block)
        deadline, _, k, release, source = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        served.append((source, k, release, deadline, slot))
    return served


def _source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def numbered(df: DataFrame, source: str, order: Column, key: str, number: str) -> DataFrame:
    """``df`` with the source key and a number from 0 inside its source, by bucket and ``order``."""
    bucket, inside, before = (fresh(df, f"_mix_{n}") for n in ("bucket", "inside", "before"))
    buckets = max(BUCKETS, df.count() // 250_000)
    marked = df.withColumn(key, _source_key(source)).withColumn(bucket, F.pmod(order, F.lit(buckets)))
    sizes = marked.groupBy(key, bucket).agg(F.count("*").alias(before))
    # One row per source and bucket, windowed within each source.
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, bucket, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    offsets = stage(offsets, "mixing-offsets")
    within = Window.partitionBy(key, bucket).orderBy(order, *[F.xxhash64(F.col(f"`{c}`")) for c in df.columns])
    return (
        marked.withColumn(inside, F.row_number().over(within) - 1)
        .join(offsets, [key, bucket])
        .withColumn(number, F.col(inside) + F.col(before))
        .drop(bucket, inside, before)
    )


ADDED = ("epoch", "block", "place", "release", "deadline", "slot")


def mix(
    df: DataFrame,
    source: str,
    order: Column,
    weights: dict[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
) -> DataFrame:
    """``df`` with epoch, block, release, deadline, slot and place (row within the block).

    A row appears once per epoch. Sorting by (slot, place) gives the mixed order.
    ``order`` is a long column that shuffles rows inside their source, such as a hash of
    the id. ``df`` is read several times: pass a table.
    """
    spark = df.sparkSession
    key, number, k, per_period, blocks_of, turns_of = (
        fresh(df, f"_mix_{n}") for n in ("source", "number", "k", "per_period", "blocks", "turns")
    )
    names = {n: fresh(df, n) for n in ADDED}
    counted = df.groupBy(_source_key(source).alias("key")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1)
    sizes = {r["key"]: r["n"] for r in counted.collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    slots = quanta(_weights(sizes, weights), max(period, 4 * len(sizes)))
    plan = schedule_period(slots)
    length = len(plan)
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    slot_in_period = {(s, i): slot for s, i, _, _, slot in plan}
    ends = [
        (blocks[s] - 1) // slots[s] * length + slot_in_period[s, (blocks[s] - 1) % slots[s] + 1] + 1 for s in sizes
    ]
    end = max(ends, default=0)
    partly: dict[str, int] = {s: 0 for s in sizes}
    for s, _, _, _, slot in plan:
        partly[s] += slot < end % max(length, 1)

    # Bounded by the period and by MAX_SOURCES, whatever the data.
    table = small_table(
        spark,
        [(s, i - 1, release, deadline, slot) for s, i, release, deadline, slot in plan],
        f"{key} string, {k} int, {names['release']} long, {names['deadline']} long, {names['slot']} long",
    )
    facts = small_table(
        spark,
        [(s, slots[s], blocks[s], end // length * slots[s] + partly[s]) for s in sizes],
        f"{key} string, {per_period} long, {blocks_of} long, {turns_of} long",
    )
    epoch, block, place = (F.col(names[n]) for n in ("epoch", "block", "place"))
    rows = (
        numbered(df, source, order, key, number)
        .join(F.broadcast(facts), key)
        .withColumn(names["block"], F.floor(F.col(number) / block_rows))
        .withColumn(names["place"], (F.col(number) % block_rows).cast("int"))
        .withColumn(
            names["epoch"],
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(turns_of) - 1 - block) / F.col(blocks_of)))),
        )
    )
    turn = epoch * F.col(blocks_of) + block
    mixed = rows.withColumn(k, (turn % F.col(per_period)).cast("int")).join(F.broadcast(table), [key, k])
    shift = F.floor(turn / F.col(per_period)) * F.lit(length)
    return mixed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        epoch, block, place,
        *[(F.col(names[c]) + shift).alias(names[c]) for c in ADDED[3:]],
    )


def _weights(sizes: dict[str, int], weights: dict[str | None, float] | None) -> dict[str, float]:
    shares = tempered_weights(sizes)
    if weights is None:
        return shares
    named = {"null" if s is None else f"={s}": w for s, w in weights.items() if w > 0}
    scale = (sum(named.values()) or 1) / (sum(shares.values()) or 1)
    return {s: named.get(s, shares[s] * scale) for s in sizes}


def mixing_digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source"), "source", stable_number(F.col("doc_id")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in mixed order, with their columns; short sources repeat."""
    slot, place = fresh(docs, "slot"), fresh(docs, "place")
    mixed = mix(docs, "source", stable_number(F.col("doc_id")))
    return mixed.orderBy(slot, place).select(*[F.col(f"`{c}`") for c in docs.columns])


#: ``mixing_digest`` in DuckDB: a recursive query serves one period, slot by slot. It rounds
#: weights as ``quanta`` does where no source needs its guaranteed slot from another one.
MIXING_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS key,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
),
sizes AS (SELECT key, count(*) AS n FROM keyed GROUP BY key),
exact AS (
  SELECT key, n, row_number() OVER (ORDER BY key) - 1 AS i, greatest({PERIOD}, 4 * count(*) OVER ()) AS period,
    pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) OVER () * greatest({PERIOD}, 4 * count(*) OVER ()) AS x
  FROM sizes
),
floors AS (SELECT *, greatest(1, floor(x)::BIGINT) AS got FROM exact),
quanta AS (
  SELECT key, n, i, period, (n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks,
    got + (row_number() OVER (ORDER BY x - got DESC, key) <= period - (SELECT sum(got) FROM floors))::BIGINT AS q
  FROM floors
),
shares AS (SELECT list(q ORDER BY i) AS q, any_value(period) AS period FROM quanta),
served AS (
  SELECT 0::BIGINT AS done, list_transform(q, lambda v: 0::BIGINT) AS used, -1::BIGINT AS turn FROM shares
  UNION ALL
  SELECT done + 1, list_transform(used, lambda u, j: CASE WHEN j = best.i + 1 THEN u + 1 ELSE u END), best.i
  FROM (
    SELECT done, used, list_min(list_filter(list_transform(range(len(q)), lambda j:
      CASE WHEN used[j + 1] < q[j + 1] AND used[j + 1] * period // q[j + 1] <= done
           THEN {{'due': ((used[j + 1] + 1) * period + q[j + 1] - 1) // q[j + 1], 'i': j}} END), lambda s: s IS NOT NULL)) AS best
    FROM served, shares WHERE done < period
  )
),
plan AS (
  SELECT key, q, period, done - 1 AS slot, used[turn + 1] - 1 AS k FROM served JOIN quanta ON turn = i WHERE done > 0
),
ends AS (
  SELECT max((blocks - 1) // u.q * u.period + p.slot + 1) AS stop
  FROM quanta u JOIN plan p ON p.key = u.key AND p.k = (u.blocks - 1) % u.q
),
facts AS (
  SELECT u.key, u.q, u.period, u.blocks,
    stop // u.period * u.q + (SELECT count(*) FROM plan p WHERE p.key = u.key AND p.slot < stop % u.period) AS turns
  FROM quanta u, ends
),
numbered AS (
  SELECT doc_id, source, key,
    row_number() OVER (PARTITION BY key ORDER BY h % greatest({BUCKETS}, (SELECT count(*) FROM keyed) // 250000), h) - 1 AS number
  FROM keyed
),
turns AS (
  SELECT doc_id, source, key, number // {BLOCK_ROWS} AS block, number % {BLOCK_ROWS} AS place, q, period, blocks,
    unnest(range((turns - 1 - number // {BLOCK_ROWS}) // blocks + 1)) AS epoch
  FROM numbered JOIN facts USING (key)
)
SELECT doc_id, source, epoch, block, place,
  k * t.period // t.q + (epoch * blocks + block) // t.q * t.period AS release,
  ((k + 1) * t.period + t.q - 1) // t.q + (epoch * blocks + block) // t.q * t.period AS deadline,
  p.slot + (epoch * blocks + block) // t.q * t.period AS slot
FROM turns t JOIN plan p ON p.key = t.key AND p.k = (epoch * blocks + block) % t.q
"""
