"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table;
the shards take turns, each claiming the first free slot of its preference
order, until the table is full. A key hashes to a slot, the broadcast table
gives its shard. Adding or removing a shard moves few keys.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import id_key

#: Prime; over 1,000 slots a shard keeps shares within a fraction of a per cent.
TABLE_SIZE = 65_537
SHARDS = 64
_HEX = 15


def _hash(name: str, use: str) -> int:
    return int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:_HEX], 16)


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's permutation ``(offset + j * stride) % size``."""
    return _hash(name, "offset") % size, _hash(name, "skip") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Position of the owning shard for every slot; shards take turns in the order given.

    ``size`` must be a prime above the number of shards; repeated or no
    names are refused.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if size <= len(shards) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("table size must be a prime above the number of shards")
    at, stride = map(list, zip(*(preference(s, size) for s in shards)))
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + stride[k]) % size
            table[slot] = k
            at[k] = (slot + stride[k]) % size
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a string key: the first 60 bits of its MD5, modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, _HEX), 16, 10).cast("long"), F.lit(size)).cast("int")


def with_shard(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE,
               out: str = "shard") -> DataFrame:
    """``df`` with a struct column ``out``: slot, shard (position), name.

    A null key counts as an empty string. All rows and columns stay (a
    column named ``out`` is replaced). The broadcast table has exactly
    ``size`` rows, whatever the data; ``df`` is not shuffled.
    """
    table = df.sparkSession.createDataFrame(
        pd.DataFrame({"__slot": range(size), "__shard": lookup_table(shards, size)}), "__slot int, __shard int")
    names = F.array(*[F.lit(s) for s in shards])
    return (df.withColumn("__at", slot_of(F.coalesce(key, F.lit("")), size))
            .join(F.broadcast(table), F.col("__at") == F.col("__slot"))
            .withColumn(out, F.struct(F.col("__at").alias("slot"), F.col("__shard").alias("shard"),
                                      F.element_at(names, F.col("__shard") + 1).alias("name")))
            .drop("__at", "__slot", "__shard"))


def place_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, slot, shard of every row; a row without an id is placed by its text's digest.

    Rows without ids therefore spread over the shards unless their texts are
    equal; repeated ids go together. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), id_key(F.col(doc_id), F.col(text)).alias("key"))
    names = [f"shard-{k:05d}" for k in range(shards)]
    return with_shard(rows, F.col("key"), names, size).select(
        "doc_id", F.col("shard.slot").alias("slot"), F.col("shard.shard").alias("shard"))


def write_shards(df: DataFrame, path: str, key: Column, shards: list[str], size: int = TABLE_SIZE) -> None:
    """Write ``df`` as Parquet below ``path``, one folder per shard (``__shard_name=<name>``)."""
    with_shard(df, key, shards, size, "__place").withColumn("__shard_name", F.col("__place.name")).drop("__place") \
        .write.partitionBy("__shard_name").parquet(path)
