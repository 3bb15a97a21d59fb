"""One file out of pieces that tasks have written, in bounded memory."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..session import checkpoint_dir

#: Bytes copied at a time.
COPY = 8_000_000


def file_system(path: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + re.sub(r"^file:/+", "", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path that all executors share."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def compose(path: str, head: Iterable[bytes], pieces: Iterable[str], tail: Iterable[bytes] = (), append: bool = False) -> None:
    """Writes head, the pieces' contents one after the other, and tail; a piece passes through the driver COPY bytes at a time."""
    store, where = file_system(path)
    with (store.open_append_stream if append else store.open_output_stream)(where) as out:
        for b in head:
            out.write(b)
        for p in pieces:
            source, at = file_system(p)
            with source.open_input_stream(at) as f:
                while b := f.read(COPY):
                    out.write(b)
        for b in tail:
            out.write(b)
