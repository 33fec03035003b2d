"""Sharding by a permutation-filled lookup table (operator 7).

Each shard has its own permutation of the slots of a prime-sized table, from two hashes of its name.
Shards take turns claiming their next free slot until the table is full, so slots differ by at most
one between shards, and removing a shard moves few other keys. The table has a fixed size, is
broadcast, and places a row by one hash and one lookup without a shuffle.

Defined results: a null key is placed like an empty string; repeated rows go to the same shard; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 65_537  # prime; at least a hundred times the number of shards
SHARDS = 256


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> number of its shard."""
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards need distinct names, and a slot each")
    place = [_number("offset:" + s) % slots for s in shards]
    skip = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            slot = place[shard]
            while owner[slot] >= 0:
                slot = (slot + skip[shard]) % slots
            owner[slot], left = shard, left - 1
            place[shard] = (slot + skip[shard]) % slots
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(slots)


def place_rows(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (a shard's number); the broadcast table has ``slots`` rows, however many rows there are."""
    owner = lookup_table(shards, slots)
    spark = rows.sparkSession
    packed = ",".join(map(str, owner))
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("__slot", "__shard"))
    lookup = lookup.select(F.col("__slot").cast("long").alias("__slot"), F.col("__shard").cast("int").alias("__shard"))
    base = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return base.join(F.broadcast(lookup), F.col("slot") == F.col("__slot"), "left").drop("__slot").withColumnRenamed("__shard", "shard")


def op7_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place_rows(docs, "doc_id", [f"shard-{i:04d}" for i in range(SHARDS)])
