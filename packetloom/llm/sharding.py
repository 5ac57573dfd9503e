"""Sharding by a permutation-filled lookup table (operator 2).

Every shard prefers the slots of a prime-sized table in an order of its own: it starts at one hash of its name and
steps by another, which visits every slot once. Shards take turns claiming the first slot they prefer that is free,
so shares differ by one slot at most, and a changed list of shards moves few slots. The table depends on parameters
alone; rows find their shard by a broadcast join of that fixed size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slots a table may have; its broadcast is bounded by that.
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the index of its shard."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards) or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"needs distinct shards and a prime number of slots from their number up to {MOST_SLOTS}")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        table[at[i]] = i
    return table


def slot(key: Column, slots: int) -> Column:
    """The slot of a key; a null key counts as an empty one."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def _table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    places = F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ","))
    return spark.range(1).select(places.alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def assign(rows: DataFrame, key_col: str, shards: list[str], slots: int = 8191) -> DataFrame:
    """rows with the columns slot and shard (an index into shards) added; columns of these names are replaced.

    Rows with equal keys share a slot; a null key is placed like an empty one. Rows may repeat; none give none. Nothing
    but the table, of `slots` rows, moves: a key that holds most rows lengthens no task.
    """
    placed = rows.drop("slot", "shard").withColumn("slot", slot(F.col(key_col), slots))
    return placed.join(F.broadcast(_table(rows.sparkSession, shards, slots)), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write(rows: DataFrame, key_col: str, shards: list[str], path: str, *, slots: int = 8191, files: int = 4) -> None:
    """Write rows as Parquet under path/shard=N, at most `files` files a shard.

    Each row is salted within its shard by a hash of the whole row, so that a key that holds most rows fills all its shard's
    files alike; rows that are equal in all columns go to one file.
    """
    placed = assign(rows, key_col, shards, slots)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(files))
    placed.repartition("shard", salt).drop("slot").write.partitionBy("shard").parquet(path)
