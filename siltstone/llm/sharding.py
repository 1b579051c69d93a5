"""Shard placement by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a preference order over the slots of a table of prime size: it starts at an offset
and steps by a skip, both hashes of its name. Shards take turns; on its turn a shard claims the
first slot of its order that is still free, until the table is full. Shards therefore hold equal
numbers of slots up to one, and adding or losing a shard moves few slots. Keys are hashed to
slots; the table has a fixed size, so it is broadcast and placement is one map-side lookup with
no shuffle, however skewed the rows are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: 64 shards, a prime of about a hundred slots for each.
SHARDS, SLOTS = 64, 6421


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(names: list[str], slots: int) -> list[int]:
    """Shard index of every slot. ``slots`` must be prime, so that every skip visits all slots."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table size must be prime")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be distinct, at least one and at most the table size")
    offset = [_number(f"{n}/offset") % slots for n in names]
    skip = [_number(f"{n}/skip") % (slots - 1) + 1 for n in names]
    owner, step, free = [-1] * slots, [0] * len(names), slots
    while free:
        for i in range(len(names)):
            while owner[slot := (offset[i] + step[i] * skip[i]) % slots] >= 0:
                step[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, owner: list[int]) -> DataFrame:
    """slot, shard: one row per slot, made by one SQL expression."""
    flat = ",".join(map(str, owner))
    return spark.range(1).select(F.posexplode(F.split(F.lit(flat), ",").cast("array<int>")).alias("slot", "shard"))


def place(df: DataFrame, key: str, names: list[str], slots: int) -> DataFrame:
    """``df`` with columns slot and shard, replacing columns of these names if it has them.

    Equal keys go to one shard; a null key is placed as the empty string. Every row stays.
    """
    df = df.drop("slot", "shard")
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots
    table = lookup_table(df.sparkSession, fill_table(names, slots))
    return df.withColumn("slot", slot.cast("int")).join(F.broadcast(table), "slot", "left")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


#: The fill in SQL: one recursion step a claim; ``nxt`` holds each shard's place in its order.
ORACLE = f"""
WITH RECURSIVE
num(i, off, skip) AS (
  SELECT i, ('0x' || substr(md5('shard-' || i || '/offset'), 1, 8))::BIGINT % {SLOTS},
         ('0x' || substr(md5('shard-' || i || '/skip'), 1, 8))::BIGINT % {SLOTS - 1} + 1 FROM range({SHARDS}) t(i)),
offs AS (SELECT list(off ORDER BY i) AS o, list(skip ORDER BY i) AS s FROM num),
fill(turn, owner) AS (
  SELECT 0::BIGINT, list_transform(range({SLOTS}), lambda x: -1::BIGINT)
  UNION ALL
  SELECT turn + 1, list_concat(owner[1:p], [turn % {SHARDS}], owner[p + 2:])
  FROM (
    SELECT turn, owner,
      (SELECT (o[turn % {SHARDS} + 1] + j * s[turn % {SHARDS} + 1]) % {SLOTS} FROM offs,
        (SELECT list_position(list_transform(range({SLOTS}), lambda k: owner[(o[turn % {SHARDS} + 1] + k * s[turn % {SHARDS} + 1]) % {SLOTS} + 1]), -1) - 1 AS j FROM offs)) AS p
    FROM fill WHERE turn < {SLOTS})),
tab AS (SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS shard FROM fill WHERE turn = {SLOTS})
SELECT doc_id, slot::INTEGER AS slot, shard::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents) JOIN tab USING (slot)
"""
