"""Starting values of the factors."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import R_MIN

PRIME, FACTOR = 2147483647, 48271


def new_seed() -> int:
    return secrets.randbelow(PRIME - 1) + 1


def uniform(index: Column, k: Column, matrix: int, seed: int) -> Column:
    """Above 0 and to 1, from the position and the seed alone, so that partitions make no difference."""
    step = lambda x: (x * FACTOR) % PRIME
    x = step((index % PRIME + (k + 1) * 7919 + matrix * 104729 + seed % PRIME) % PRIME)
    return step(step((x + (k + 1) * 15485863) % PRIME)).cast("double") / float(PRIME) + F.lit(R_MIN)


def start_factor(spark: SparkSession, n: int, k: int, matrix: int, seed: int, key: str, value: str) -> DataFrame:
    ks = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    kind = "bigint" if key == "i" else "int"
    return spark.range(n).select("id", ks.alias("k")).select(F.col("id").cast(kind).alias(key), F.col("k").cast("int").alias("k"), uniform(F.col("id"), F.col("k").cast("bigint"), matrix, seed).alias(value))


def start_w(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    return start_factor(spark, n, k, 0, seed, "i", "w")


def start_h(spark: SparkSession, m: int, k: int, seed: int) -> DataFrame:
    return start_factor(spark, m, k, 1, seed, "j", "h")
