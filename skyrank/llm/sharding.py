"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard prefers the slots of a prime-sized table in an order of its own; in turns, each claims the
best slot that is still free.  Shares are equal to within one slot, and removing a shard moves few other
slots.  A key's hash picks a slot, and the slot names the shard.

Defined results: a null key is placed like the empty key; equal keys share a shard; every other column
stays as it is, and columns named like a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; at most this many rows are broadcast.
SLOTS = 65_537
MAX_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(text: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:12], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The number of the shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or slots > MAX_SLOTS or len(shards) > slots:
        raise ValueError("shards are distinct, and no more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots is a prime")
    at = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            table[at[s]] = s
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard), one row per slot."""
    flat = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(flat), ",")).alias("slot", "shard")).select(
        F.col("slot").cast("long"), F.col("shard").cast("long"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; the table of slots has a fixed size and is broadcast."""
    table = lookup_table(rows.sparkSession, shards, slots)
    return rows.drop("shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")
