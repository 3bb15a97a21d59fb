"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size and the shards take turns
claiming the first slot of their order that is still free. A row's key hashes to a slot and the slot names the
shard. Adding or removing a shard moves few rows beside those that must move.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, with_columns

#: Upper bound on the table that is broadcast: 12 bytes a slot, 12 MB.
MAX_SLOTS = 1_000_003
SHARDS, SLOTS = 64, 8191


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int) -> list[int]:
    """The index of the shard that owns each slot.

    names must be distinct and not more than slots; slots must be a prime of at most MAX_SLOTS, so that every step
    width visits every slot. Slots per shard differ by one at most.
    """
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be distinct, at least one and at most one a slot")
    if slots > MAX_SLOTS or not _prime(slots):
        raise ValueError(f"the table size must be a prime of at most {MAX_SLOTS}")
    at = [_hash60(f"offset:{n}") % slots for n in names]
    step = [_hash60(f"skip:{n}") % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(names)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        owner[at[i]] = i
    return owner


def slot_of(keys: list[Column], slots: int) -> Column:
    """The slot of a key: 60 bits of an MD5 over its parts as text, modulo the table size; a null part counts as the character U+0000."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def assign_shards(df: DataFrame, keys: list[str], names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot (int) and shard (int, an index of names); these replace columns so named.

    One projection and a broadcast join with the table of at most MAX_SLOTS rows, so no row is shuffled and a key
    that a third of the rows hold costs nothing more. Equal keys go to one shard: repeated rows stay together; null
    keys are a key of their own. To spread rows that share a key, give more columns in keys. An empty df gives an
    empty result. Texts play no part unless they are a key.
    """
    spark = df.sparkSession
    owner = pd.DataFrame({"slot": range(slots), "shard": lookup_table(names, slots)})
    slotted = with_columns(df, {"slot": slot_of([col(k) for k in keys], slots)})
    rest = [c for c in slotted.columns if c.lower() not in ("slot", "shard")]
    return slotted.select(*map(col, rest), "slot").join(F.broadcast(spark.createDataFrame(owner, "slot int, shard int")), "slot").select(*map(col, rest), "slot", F.col("shard").cast("int").alias("shard"))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes one folder for each value of shard. Spark balances the write by size (a rebalance, not a hash on shard), so a large shard becomes many files."""
    df.hint("rebalance", col("shard")).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"shard-{i}" for i in range(SHARDS)]
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], names, SLOTS)


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('offset:shard-' || i), 1, 15))::BIGINT % {SLOTS} AS off,
         ('0x' || substr(md5('skip:shard-' || i), 1, 15))::BIGINT % ({SLOTS} - 1) + 1 AS skip
  FROM (SELECT unnest(range({SHARDS})) AS i)
), wish AS (
  SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM shards
), fill AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, bitstring('0', {SLOTS}) AS taken
  UNION ALL
  SELECT turn + 1, slot, set_bit(taken, slot::INT, 1) FROM (
    SELECT turn, taken, list_filter(list_transform(range({SLOTS}), lambda k: (offs[turn % {SHARDS} + 1] + k * skips[turn % {SHARDS} + 1]) % {SLOTS}), lambda s: get_bit(taken, s::INT) = 0)[1] AS slot
    FROM fill, wish WHERE turn < {SLOTS})
), owner AS (
  SELECT slot::INT AS slot, ((turn - 1) % {SHARDS})::INT AS shard FROM fill WHERE turn > 0
)
SELECT d.doc_id, o.slot, o.shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents) d
JOIN owner o ON o.slot = d.slot
"""
