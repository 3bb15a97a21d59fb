"""Sums of doubles that are exact, so that neither order nor partitions change a bit of them.

A double is a whole number of 53 bits times a power of two. Whole numbers are added up for each power, which loses nothing in any order, and the powers of a key, some two
thousand at most, are put together and rounded once.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In place of a power: what is no number, and the infinities.
NAN, PLUS, MINUS = 5000, 5001, 5002


@F.pandas_udf(T.StructType([T.StructField("e", T.IntegerType()), T.StructField("m", T.LongType())]))
def binary_parts(x: pd.Series) -> pd.DataFrame:
    """The power and the whole number of each double; of one that is not finite the power says which it is."""
    v = x.to_numpy(np.float64)
    ok = np.isfinite(v)
    m, e = np.frexp(np.where(ok, v, 0.0))
    odd = np.where(np.isnan(v), NAN, np.where(v > 0, PLUS, MINUS))
    return pd.DataFrame({"e": np.where(ok, e - 53, odd).astype(np.int32), "m": (m * 2.0**53).astype(np.int64)})


def put_together(parts) -> float:
    """The double nearest to the sum of m * 2^e over (e, m); infinite if an infinity is among them."""
    powers = {int(p["e"]) for p in parts}
    if PLUS in powers or MINUS in powers:
        return float("inf") if PLUS in powers else float("-inf")
    whole = sum((Fraction(int(p["m"])) * Fraction(2) ** int(p["e"]) for p in parts), Fraction(0))
    try:
        return float(whole)
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


@F.pandas_udf(T.DoubleType())
def rounded_once(parts: pd.Series) -> pd.Series:
    return parts.map(put_together).astype(float)


def exact_sums(df: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """keys, and for each of sums (name: column of doubles) the exact sum of the column, rounded to the nearest double once. Nulls count for nothing, a key with nothing else has 0; infinities of both signs, or a NaN, give NaN.

    Partial sums by key, column and power are taken before the shuffle, so a key of any size is some hundred rows from each task. Without keys there is one row.
    """
    column = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).cast("double").alias("x")) for n, c in sums.items()]))
    parts = df.select(*keys, column.alias("c")).select(*keys, "c.n", binary_parts(F.coalesce("c.x", F.lit(0.0))).alias("p"))
    by_power = parts.groupBy(*keys, "n", F.col("p.e").alias("e")).agg(F.sum(F.col("p.m").cast("decimal(38,0)")).alias("m"))
    done = by_power.groupBy(*keys, "n").agg(F.collect_list(F.struct("e", "m")).alias("s"))
    has = lambda power: F.exists("s", lambda x: x["e"] == power)
    number = F.when(has(NAN) | (has(PLUS) & has(MINUS)), F.lit(float("nan"))).otherwise(rounded_once("s"))  # a NaN that pandas gives becomes a null
    lists = done.select(*keys, "n", number.alias("s")).groupBy(*keys)
    return lists.agg(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col("s"))), F.lit(0.0)).alias(n) for n in sums])

