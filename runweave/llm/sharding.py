"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table. The shards take turns, each claiming
its most preferred free slot, until the table is full: shares differ by one slot at most, and when a shard comes or
goes few other slots change hands. A key is hashed to a slot; the table, whose size is fixed, is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Slots (a prime, over 100 for each shard) and the shards of the query.
SLOTS, SHARDS = 65_537, 64


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that holds each slot; -1 everywhere without shards.

    slots must be prime: then start + skip * k passes through all of them for every skip.
    """
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    owner = np.full(slots, -1, np.int64)
    if not shards:
        return owner
    if len(shards) > slots:
        raise ValueError(f"{len(shards)} shards need as many slots, not {slots}")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "little") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "little") % (slots - 1) + 1 for d in digests]
    free, turn = slots, 0
    while free:
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        owner[at[i]] = i
        free, turn = free - 1, turn + 1
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 48 bits of its MD5; a null key is the empty one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(slots))


def place(spark: SparkSession, rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with the columns slot and shard; columns of these names are replaced. Equal keys go to one shard."""
    table = spark.createDataFrame([(i, shards[s] if s >= 0 else None) for i, s in enumerate(fill(shards, slots).tolist())], "_slot long, _shard string")
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(F.struct(*kept).alias("own"), slot(F.col(key), slots).alias("_slot"))
    return placed.join(F.broadcast(table), "_slot", "left").select("own.*", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def op9_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id")
    return place(spark, docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)]).select("doc_id", "slot", "shard")
