"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, given by an offset and a step hashed from its
name. Shards take turns; each claims the first free slot of its permutation until the table is full. A row's key hashes
to a slot, and a broadcast of the table (its size is a parameter, not the data's) gives its shard in constant time.
When a shard is lost, almost only its own rows move.

Defined results: a null key hashes like an empty text; equal keys share a shard, so repeated rows lie together;
very long keys are hashed whole; two shards never tie for a slot, as they take turns; an empty table gives no rows; the
caller's columns are kept unless they are named slot or shard, which are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over 100 times the number of shards keeps the shards' shares within about one per cent of each other.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: the number (in the order given) of the shard that owns each slot."""
    if not shards or not is_prime(slots) or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("distinct shards, at least one, and a prime number of slots not below theirs are needed")
    at, step = [], []
    for s in shards:
        digest = hashlib.md5(s.encode()).hexdigest()
        at.append(int(digest[:8], 16) % slots)
        step.append(int(digest[8:16], 16) % (slots - 1) + 1 if slots > 2 else 1)
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its text's MD5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots).cast("long"))


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """slot long, ``name`` long: one row a slot, made from one literal."""
    text = ",".join(map(str, fill_table(list(shards), slots)))
    one = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", name))
    return one.select(F.col("slot").cast("long").alias("slot"), F.col(name).cast("long").alias(name))


def place(df: DataFrame, key: Column, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard (its number in ``shards``)."""
    table = F.broadcast(table_frame(df.sparkSession, list(shards), slots))  # ``slots`` rows, whatever the data
    return df.drop("slot", "shard").withColumn("slot", slot_of(key, slots)).join(table, "slot")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard, shard_after (with the last shard lost) of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    placed = place(docs, F.col("doc_id"))
    after = F.broadcast(table_frame(spark, list(SHARDS[:-1]), SLOTS, "shard_after"))
    return placed.join(after, "slot").select("doc_id", "slot", "shard", "shard_after")


def op10_sql() -> str:
    def table(shards: tuple[str, ...]) -> str:
        return "string_split('" + ",".join(map(str, fill_table(list(shards)))) + "', ',')"

    return f"""
WITH tables AS MATERIALIZED (SELECT {table(SHARDS)} AS now_table, {table(SHARDS[:-1])} AS after_table),
slots AS (SELECT unnest(range({SLOTS})) AS slot, unnest(now_table)::BIGINT AS shard, unnest(after_table)::BIGINT AS shard_after FROM tables),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT d.doc_id, d.slot, s.shard, s.shard_after FROM d JOIN slots s USING (slot)
"""
