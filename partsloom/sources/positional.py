"""Files that tasks write at places known beforehand, in a folder that all executors share as a file system.

A binary matrix has cells of one width, so a cell's place follows from its row and column. The file is made with its size and its head under
another name; tasks put cells where they belong, any try of a task the same bytes at the same places; then it gets its name.
What nobody writes is zero and, where the file system can, takes no space.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MatrixError
from .compose import COPY, file_system

#: Bytes of a tile that is transposed at a time.
TILE_BYTES = 64_000_000


def plain(path: str) -> str | None:
    """The path if it is one of a file system that can write at a place; else none."""
    from pyarrow import fs

    store, where = file_system(path)
    return where if isinstance(store, fs.LocalFileSystem) else None


class Placed:
    """A file in the making."""

    def __init__(self, path: str):
        self.path, self.temporary = path, f"{path}.{uuid.uuid4().hex}.part"

    def begin(self, head: bytes, size: int) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.temporary, "wb") as f:
            f.write(head)
            f.truncate(size)

    def grow(self, size: int) -> int:
        """Makes the file longer by size; returns where that begins."""
        at = os.path.getsize(self.temporary)
        os.truncate(self.temporary, at + size)
        return at

    def append(self, pieces: Iterable[bytes]) -> None:
        with open(self.temporary, "ab") as f:
            for x in pieces:
                f.write(x)

    def finish(self) -> None:
        os.replace(self.temporary, self.path)

    def give_up(self) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


def tag_line(tags: DataFrame | None, key: str, tag: str, n: int) -> Iterator[bytes]:
    """A line of tags, TABs between, streamed in order."""
    if tags is not None:
        at = 0
        for r in tags.select(F.col(key).cast("bigint").alias("k"), tag).where((F.col("k") >= 0) & (F.col("k") < n)).orderBy("k").toLocalIterator():
            yield b"\t" * (r["k"] - at) + (r[tag] or "").encode()
            at = r["k"]
        yield b"\t" * (n - 1 - at)


def put(fd: int, data: bytes, at: int) -> None:
    view = memoryview(data)
    while view:
        n = os.pwrite(fd, view, at)
        view, at = view[n:], at + n


def place_cells(fd: int, base: int, n_cols: int, kind: np.dtype, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
    """Writes cells, each run of neighbours at once."""
    at = i.astype(np.int64) * n_cols + j
    order = np.argsort(at, kind="stable")
    at, v = at[order], v[order].astype(kind)
    cuts = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1, len(at)] if len(at) else [0]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        put(fd, v[a:z].tobytes(), base + int(at[a]) * kind.itemsize)


def write_cells(cells: DataFrame, path: str, base: int, n_cols: int, kind: np.dtype) -> None:
    """Puts cells (i, j, v) into the file by tasks. Rows are dealt out by range, so neighbours are written together; nothing comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                place_cells(fd, base, n_cols, kind, b["i"].to_numpy(), b["j"].to_numpy(), b["v"].to_numpy(np.float64))
        finally:
            os.close(fd)
        yield from ()

    cells.select("i", "j", "v").repartitionByRange("i", "j").sortWithinPartitions("i", "j").mapInPandas(run, "n int").write.format("noop").mode("overwrite").save()


def join_files(spark: SparkSession, pieces: list[str], sizes: list[int], path: str, base: int) -> None:
    """Files one after the other into the file at path, from base on: a task copies a piece to its place, COPY bytes at a time."""
    at = (base + np.cumsum([0, *sizes[:-1]])).tolist() if sizes else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fd = os.open(path, os.O_WRONLY)
        try:
            for b in batches:
                for piece, to in zip(b["piece"], b["at"].tolist(), strict=True):
                    store, where = file_system(piece)
                    with store.open_input_stream(where) as f:
                        while x := f.read(COPY):
                            put(fd, x, to)
                            to += len(x)
        finally:
            os.close(fd)
        yield from ()

    if pieces:
        spark.createDataFrame(list(zip(pieces, at, strict=True)), "piece string, at bigint").repartition(len(pieces), "piece").mapInPandas(run, "n int").write.format("noop").mode("overwrite").save()


def read_block(fd: int, base: int, n_cols: int, kind: np.dtype, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    """A block of a file's cells: a read for each row, or one for all if the rows are whole."""
    (a, z), (p, q) = rows, cols
    if (p, q) == (0, n_cols):
        return np.frombuffer(os.pread(fd, (z - a) * n_cols * kind.itemsize, base + a * n_cols * kind.itemsize), kind).reshape(z - a, n_cols)
    return np.stack([np.frombuffer(os.pread(fd, (q - p) * kind.itemsize, base + (i * n_cols + p) * kind.itemsize), kind) for i in range(a, z)])


def transpose_block(source: int, target: int, base: int, shape: tuple[int, int], kind: np.dtype, rows: tuple[int, int], cols: tuple[int, int]) -> None:
    """One block of a file of shape to its place in the transposed one. Columns without a cell other than zero are not written."""
    x = np.ascontiguousarray(read_block(source, base, shape[1], kind, rows, cols).T)
    for c in np.flatnonzero((x != 0).any(axis=1)).tolist():
        put(target, x[c].tobytes(), base + ((cols[0] + c) * shape[0] + rows[0]) * kind.itemsize)


def blocks_of(shape: tuple[int, int], width: int, most: int) -> tuple[int, int]:
    """Rows and columns of a block of at most that many bytes, as near to a square as the shape lets it be."""
    side = max(1, int((most / width) ** 0.5))
    cols = min(shape[1], max(side, most // width // max(1, shape[0])))
    return max(1, min(shape[0], most // width // cols)), cols


def transpose_cells(spark: SparkSession, source: str, target: str, base: int, shape: tuple[int, int], kind: np.dtype, tile_bytes: int | None = None) -> None:
    """Cells of a binary file into the transposed one, block by block: a task holds a block, never a whole row or column, and places are of 64 bits."""
    rows, cols = blocks_of(shape, kind.itemsize, tile_bytes or TILE_BYTES)
    across = -(-shape[1] // cols)
    n = -(-shape[0] // rows) * across

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = os.open(source, os.O_RDONLY), os.open(target, os.O_WRONLY)
        try:
            for ids in batches:
                for t in ids["id"].tolist():
                    i, j = t // across * rows, t % across * cols
                    transpose_block(a, b, base, shape, kind, (i, min(i + rows, shape[0])), (j, min(j + cols, shape[1])))
        finally:
            os.close(a)
            os.close(b)
        yield from ()

    spark.range(0, n, 1, min(n, 10_000)).mapInPandas(run, "n int").write.format("noop").mode("overwrite").save()


def needs_plain(path: str) -> str:
    where = plain(path)
    if where is None:
        raise MatrixError(f"{path} is in a store that can't be written at a place")
    return where
