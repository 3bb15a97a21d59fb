"""The folder that all executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Only where spark.checkpoint.dir is unset, as in tests.
LOCAL = "file:///tmp/checkpoints/partsloom"


def checkpoint_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = LOCAL
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
