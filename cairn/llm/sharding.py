"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a skip drawn from its name).
Shards take turns, each claiming its next free slot, until the table is full; the shares differ by one slot at most,
and a changed list of shards moves few slots. The table is broadcast, so a row finds its shard with one hash and one
lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: A prime well above a hundred slots per shard: shares differ by under one per cent.
SLOTS = 8191
#: The table is a constant of the plan; this bounds what is broadcast (about 4 MB).
MOST_SLOTS = 1 << 17


def _draw(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    offset = [_draw(s, "offset") % slots for s in shards]
    skip = [_draw(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    turn, owner, left = [0] * len(shards), [None] * slots, slots
    while left:
        for i, shard in enumerate(shards):
            while owner[at := (offset[i] + turn[i] * skip[i]) % slots] is not None:
                turn[i] += 1
            owner[at] = shard
            left -= 1
            if not left:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table's size; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, shard_col: str = "shard") -> DataFrame:
    """``df`` with the columns slot and shard appended (columns of these names are replaced). No shuffle.

    Rows with equal keys share a shard; null keys all go where the empty key goes. Only the key is looked at, so texts
    of any length pass as they are, and all other columns stay, whatever their names. An empty input stays empty.
    """
    spark, owners = df.sparkSession, lookup_table(shards, slots)
    at, name = free_name("_at", df), free_name("_owner", df)
    owner = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(owners)), "\n")).alias(at, name))
    rest = [f"`{c}`" for c in df.columns if c.lower() not in ("slot", shard_col.lower())]
    keyed = df.select(*rest, slot(F.col(f"`{key}`"), slots).alias("slot"))
    return keyed.join(F.broadcast(owner), F.col("slot") == F.col(at)).select(*rest, "slot", F.col(name).alias(shard_col))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """One folder of Parquet files per shard."""
    place(df, key, shards, slots).write.partitionBy("shard").mode("overwrite").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


SQL = f"""
WITH owner AS (SELECT unnest(range({SLOTS})) AS slot, unnest([{", ".join(f"'{s}'" for s in lookup_table(SHARDS))}]) AS shard),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shard FROM d JOIN owner USING (slot)
"""
