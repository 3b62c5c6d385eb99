"""Sharding by a permutation-filled lookup table (DataFrame functions only on the main path).

Every shard has a permutation of the slots of a prime-sized table. Shards take turns; at its turn a shard claims the
first slot of its permutation that is still free, until no slot is free. A row's key hash picks a slot, the slot names
the shard. Adding or removing one shard moves little more than that shard's slots.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Production parameters of the query and of the pipeline's stage.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS_PER_SHARD = 100


def prime_above(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """slot -> index of the shard that claimed it; ``size`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if size < len(shards) or prime_above(size) != size:
        raise ValueError("the table's size must be a prime of at least the number of shards")
    digests = [int(hashlib.md5(name.encode()).hexdigest(), 16) for name in shards]
    offset, skip = [d % size for d in digests], [(d >> 64) % (size - 1) + 1 for d in digests]
    claimed, tried, left = [-1] * size, [0] * len(shards), size
    while left:
        for i in range(len(shards)):
            while claimed[slot := (offset[i] + tried[i] * skip[i]) % size] >= 0:
                tried[i] += 1
            claimed[slot] = i
            left -= 1
            if not left:
                break
    return claimed


def slot_of(key: Column, size: int) -> Column:
    """The first 32 bits of the key's md5, modulo the table's size."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % size).cast("int")


def lookup_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard, shard_name), ``size`` rows: the bound of what is broadcast."""
    claimed = F.from_json(F.lit(json.dumps(fill_table(shards, size))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    return spark.range(1).select(F.posexplode(claimed).alias("slot", "shard")).withColumn("shard_name", F.get(names, F.col("shard")))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int | None = None, spread: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns slot, shard and shard_name (an input column of such a name is replaced).

    The place depends on the key's text alone: repeated rows and equal keys share a shard, in any run and on any
    cluster. A null key is placed by the ``spread`` columns instead, so null keys don't all land in one shard (by the
    empty string if there are none). An empty frame gives an empty frame. No shuffle: one broadcast join with a table
    of ``size`` rows.
    """
    size = size or prime_above(SLOTS_PER_SHARD * len(shards))
    fallback = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in spread]) if spread else F.lit("")
    placed = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(F.coalesce(F.col(f"`{key}`").cast("string"), fallback), size))
    return placed.join(F.broadcast(lookup_frame(df.sparkSession, shards, size)), "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assign_shards(docs, "doc_id", spread=["source", "lang", "n_chars"]).select("doc_id", "slot", "shard", "shard_name")


def oracle() -> str:
    size = prime_above(SLOTS_PER_SHARD * len(SHARDS))
    return f"""
WITH t AS (SELECT {fill_table(SHARDS, size)}::INTEGER[] AS claimed),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), concat_ws('|', source, lang, CAST(n_chars AS VARCHAR)))), 1, 8) AS BIGINT) % {size} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, claimed[slot + 1] AS shard, concat('shard-', lpad(CAST(claimed[slot + 1] AS VARCHAR), 3, '0')) AS shard_name FROM d, t"""
