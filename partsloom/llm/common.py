"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: One task takes the spanning stars of about so many edges, or of one shuffle partition where that has more.
EDGES = 250_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file:///tmp/checkpoints/partsloom"
        spark.sparkContext.setCheckpointDir(where)
    return where


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done; else they stay until the driver's JVM happens to collect its garbage. The last job's plan is let go a little after its end."""
    gc.collect()
    for _ in range(2):
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def with_columns(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """All columns of df and then the added ones, which replace columns of the same name (in any case)."""
    taken = {k.lower() for k in added}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in added.items()])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of edges (a, b) that has a smaller one in its component, and the smallest there."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), longs; component is the smallest node reachable.

    First each task replaces its edges by the stars that connect the same nodes: a group that
    many edges hold together keeps fewer edges than it has nodes in a task. Then alternating large-star and small-star
    steps: each sends a node's neighbours to the smallest among them, so no step makes more rows than it has edges, and path
    lengths halve. Each step is checkpointed; only a count and a sum come to the driver.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches]
        if held:
            u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pd.DataFrame({"u": u, "v": v})

    def state(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    every = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    tasks = -(-every.count() // EDGES) or 1
    cur = every.coalesce(tasks).mapInPandas(contract, "u long, v long").distinct().checkpoint()
    before = state(cur) if tasks > 1 else None
    while tasks > 1:  # the stars of one task are the components
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()  # a join of two scans, so that a hub can be split
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        cur = small.checkpoint()
        now = state(cur)
        if now == before:
            break
        before = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
