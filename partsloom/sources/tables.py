"""Matrices derived from Parquet tables, with dense row and column numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Matrix
from ..session import checkpointed


def dense_index(keys: DataFrame, key: str, out: str) -> DataFrame:
    """(key, out): distinct keys numbered from 0 in order.

    Sorted by range, numbered within each partition and moved by the counts of the partitions before, of which there is a row
    each. Checkpointed, as the numbers of a partition must not change between the two passes.
    """
    s = keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    s = checkpointed(s.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    counts = s.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.join(F.broadcast(counts.select("p", "first", before.alias("base"))), "p").select(key, (F.col("base") + F.col("m") - F.col("first")).alias(out))


def pivot_sum(rows: DataFrame, row: Column, column: Column, value: Column) -> Matrix:
    """The matrix of sums of value by row and column, tagged with their values; the sums are taken before numbers are looked up."""
    sums = rows.select(row.alias("r"), column.alias("c"), value.cast("double").alias("x")).groupBy("r", "c").agg(F.sum("x").alias("v")).where("r is not null and c is not null")
    ri, ci = dense_index(sums, "r", "i"), dense_index(sums, "c", "j")
    cells = sums.join(ri, "r").join(ci, "c").select("i", F.col("j").cast("int").alias("j"), "v")
    rt, ct = ri.select("i", F.col("r").cast("string").alias("label")), ci.select(F.col("j").cast("int").alias("j"), F.col("c").cast("string").alias("header"))
    return Matrix(cells, ri.count(), ci.count(), None, rt, ct)


def users_by_event(spark: SparkSession, sf_dir: str) -> Matrix:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return pivot_sum(e, F.col("user_id"), F.col("event_type"), F.lit(1.0))


def suppliers_by_month(spark: SparkSession, sf_dir: str) -> Matrix:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return pivot_sum(x, F.col("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM"), F.col("l_quantity"))


def parts_by_status(spark: SparkSession, sf_dir: str) -> Matrix:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return pivot_sum(x, F.col("l_partkey"), F.concat("l_returnflag", "l_linestatus"), F.col("l_quantity"))
