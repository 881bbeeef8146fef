"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size M:
offset + j * skip modulo M, with offset and skip from hashes of its name; as M is prime,
this visits each slot once. The shards take turns; on its turn a shard claims its next
preferred slot that is free, until the table is full. Slots per shard differ by at most
one, and when a shard leaves or joins few slots change hands. A weight of w gives a shard
w turns a round.

The table is small (M rows, a parameter of the layout, not of the data), so it is
broadcast and each row's place is one lookup: slot = hash(key) mod M. No row is shuffled
to be placed, and a hot source or key value spreads as its ids do.

The hash is the number in the first 15 hex digits of the MD5 of the key's text, the same
on any engine. Defined cases: a null key hashes as an empty text; equal keys share a
shard; other columns stay. Shard names must be distinct and M a prime not below the
number of turns in a round.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagebundle.llm.common import fresh, small_table, stable_number

MAX_TABLE = 1_000_003


def _number(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: dict[str, int] | list[str], size: int) -> list[str]:
    """The shard of each of ``size`` slots; ``shards`` are names, or names with turns a round."""
    turns = dict(shards) if isinstance(shards, dict) else {name: 1 for name in shards}
    if not isinstance(shards, dict) and len(turns) != len(shards):
        raise ValueError("shard names must be distinct")
    if not turns or any(n < 1 for n in turns.values()):
        raise ValueError("at least one shard, each with at least one turn")
    if not _is_prime(size) or not sum(turns.values()) <= size <= MAX_TABLE:
        raise ValueError(f"the size must be a prime from the turns in a round to {MAX_TABLE}")
    order = sorted(turns)
    offset = {s: _number(s, "offset") % size for s in order}
    skip = {s: _number(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in order}
    wanted = {s: 0 for s in order}
    table: list[str | None] = [None] * size
    free = size
    while free:
        for shard in order:
            for _ in range(turns[shard]):
                if not free:
                    break
                while table[slot := (offset[shard] + wanted[shard] * skip[shard]) % size] is not None:
                    wanted[shard] += 1
                table[slot] = shard
                wanted[shard] += 1
                free -= 1
    return table


def slot_of(key: Column, size: int) -> Column:
    return stable_number(key) % size


def lookup_table(spark: SparkSession, shards: dict[str, int] | list[str], size: int) -> DataFrame:
    """(slot long, shard string): at most MAX_TABLE rows."""
    return small_table(spark, list(enumerate(fill_table(shards, size))), "slot long, shard string")


def with_shard(
    df: DataFrame, key: Column | str, shards: dict[str, int] | list[str], size: int,
    slot: str = "slot", shard: str = "shard",
) -> DataFrame:
    """``df`` with the slot and the shard of each row.

    Other columns stay; where one has either name, the added one gets a leading underscore.
    """
    slot, shard = fresh(df, slot), fresh(df, shard)
    key = F.col(key) if isinstance(key, str) else key
    at = fresh(df, "_slot_")
    table = lookup_table(df.sparkSession, shards, size).select(F.col("slot").alias(at), F.col("shard").alias(shard))
    # The table's size is bounded by MAX_TABLE rows whatever the data.
    return df.withColumn(slot, slot_of(key, size)).join(F.broadcast(table), F.col(slot) == F.col(at)).drop(at)


#: Production layout of the query: 32 shards, about 128 slots each.
SHARDS = [f"shard-{i:03d}" for i in range(32)]
TABLE_SIZE = 4093


def sharding_digest(docs: DataFrame) -> DataFrame:
    return with_shard(docs.select("doc_id"), "doc_id", SHARDS, TABLE_SIZE).select("doc_id", "slot", "shard")


#: The same placement in DuckDB: one step per slot of a recursive query fills the table.
SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%03d', i) AS shard,
    ('0x' || substr(md5('offset:' || printf('shard-%03d', i)), 1, 15))::BIGINT % {TABLE_SIZE} AS start,
    ('0x' || substr(md5('skip:' || printf('shard-%03d', i)), 1, 15))::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
  FROM range({len(SHARDS)}) t(i)
),
wishes AS (
  SELECT list(list_transform(range({TABLE_SIZE}), lambda j: (start + j * skip) % {TABLE_SIZE}) ORDER BY i) AS wish FROM shards
),
fill AS (
  SELECT 0 AS step, list_transform(range({TABLE_SIZE}), lambda x: NULL::BIGINT) AS owner, list_transform(range({len(SHARDS)}), lambda x: 0::BIGINT) AS used
  UNION ALL
  SELECT step + 1,
    list_transform(owner, lambda o, k: CASE WHEN k = slot + 1 THEN turn ELSE o END),
    list_transform(used, lambda u, k: CASE WHEN k = turn + 1 THEN u + nth ELSE u END)
  FROM (
    SELECT step, owner, used, turn, nth, wish[turn + 1][used[turn + 1] + nth] AS slot
    FROM (
      SELECT step, owner, used, wish, step % {len(SHARDS)} AS turn,
        list_position(list_transform(wish[step % {len(SHARDS)} + 1][used[step % {len(SHARDS)} + 1] + 1:], lambda w: owner[w + 1] IS NULL), true) AS nth
      FROM fill, wishes WHERE step < {TABLE_SIZE}
    )
  )
),
slots AS (
  SELECT unnest(range({TABLE_SIZE})) AS slot, unnest(owner) AS i FROM fill WHERE step = {TABLE_SIZE}
)
SELECT d.doc_id, slots.slot, shards.shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN slots USING (slot) JOIN shards USING (i)
"""
