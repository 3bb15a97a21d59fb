"""Binary matrix files as a Spark data source: `spark.read.format("tagged_matrix")` and `df.write.format("tagged_matrix")`.

A read gives the stored cells (i, j, v). Rows that a filter on i leaves out are not read from the file; columns that a given schema leaves out are not
made. A write puts cells at their places from all tasks and gives the file its name on commit.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..model import MatrixError
from .binary import head_bytes, read_head
from .compose import file_system
from .positional import Placed, needs_plain, place_cells

NAME = "tagged_matrix"
#: Cells that a task reads, and that it reads at a time.
PART_CELLS, READ_CELLS = 4_000_000, 500_000


@dataclass
class Part(InputPartition):
    first: int
    stop: int


class MatrixSource(DataSource):
    """Options: path; form, binary or native; real and index, types of native files; for a write, rows and cols."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "i bigint, j int, v double"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(dict(self.options), schema, overwrite)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        odd = set(self.names) - {"i", "j", "v"}
        if odd:
            raise MatrixError(f"a matrix has no columns {sorted(odd)}")
        self.schema = schema
        self.head = read_head(self.path, options.get("form", "binary") == "native", options.get("real", "<f4"), options.get("index", "<u4"))
        self.low, self.high = 0, self.head.n
        self.part_cells = int(options.get("partcells", PART_CELLS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on i become the range of rows; all else is Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("i",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or not isinstance(f.value, int):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))

    def partitions(self) -> Sequence[InputPartition]:
        rows = max(1, self.part_cells // self.head.m)
        return [Part(i, min(i + rows, self.high)) for i in range(self.low, self.high, rows)]

    def read(self, partition: Part) -> Iterator:
        import pyarrow as pa

        h, (store, where) = self.head, file_system(self.path)
        rows, types = max(1, READ_CELLS // h.m), {"i": pa.int64(), "j": pa.int32(), "v": pa.float64()}
        if partition is None:
            return
        with store.open_input_file(where) as f:
            for first in range(partition.first, partition.stop, rows):
                k = min(rows, partition.stop - first)
                f.seek(h.at + first * h.m * h.real.itemsize)
                v = np.frombuffer(f.read(k * h.m * h.real.itemsize), h.real)
                full = np.flatnonzero(v != 0)
                made = {"i": lambda: first + full // h.m, "j": lambda: (full % h.m).astype(np.int32), "v": lambda: v[full].astype(np.float64)}  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(made[c](), types[c]) for c in self.names], self.names)


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if schema.fieldNames() != ["i", "j", "v"]:
            raise MatrixError("a matrix is written from columns i, j, v")
        self.n, self.m = int(options["rows"]), int(options["cols"])
        native = options.get("form", "binary") == "native"
        head, self.real = head_bytes(self.n, self.m, native, options.get("real", "<f4"), options.get("index", "<u4"))
        path = needs_plain(options["path"])
        if os.path.exists(path) and not overwrite:
            raise MatrixError(f"{path} is there already")
        self.base, self.file = len(head), Placed(path)
        self.file.begin(head, self.base + self.n * self.m * self.real.itemsize)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fd = os.open(self.file.temporary, os.O_WRONLY)
        try:
            for b in iterator:
                i, j, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "v"))
                if len(i) and (i.min() < 0 or i.max() >= self.n or j.min() < 0 or j.max() >= self.m):
                    raise MatrixError(f"a cell is outside of {self.n} x {self.m}")
                place_cells(fd, self.base, self.m, self.real, i, j, v)
        finally:
            os.close(fd)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        self.file.finish()

    def abort(self, messages: list) -> None:
        self.file.give_up()


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
