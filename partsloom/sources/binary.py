"""Matrices as binary files: the portable form, and the native form without signature and checks.

Portable, little-endian: a 4-byte signature, rows and columns (4 bytes each), cells (doubles, by row), then lines of
row labels and column headers (TABs between) and the name. Native: rows, columns and cells in given types, then the same tags.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Matrix, MatrixError
from ..session import checkpointed
from .compose import compose, delete, file_system, scratch
from .positional import Placed, needs_plain, plain, tag_line, transpose_cells, write_cells
from .validate import check_shape, validate

# Fixed values of the format: signatures of real and of integer matrices.
REAL, INTEGER = 0xEDB10EA1, 0xEDB101DE
#: Cells of a piece of a file that one task decodes.
PIECE = 4_000_000
#: Bytes of the tags that one task reads.
TAG_PIECE = 8_000_000


def _label_pieces(spark: SparkSession, path: str, at: int, size: int, piece: int) -> list:
    """For each piece of the tail: where its first line ends are, and how many TABs and spaces are before the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = file_system(path)
        for b in batches:
            for i in b["id"].tolist():
                with store.open_input_file(where) as f:
                    f.seek(at + i * piece)
                    x = f.read(min(piece, size - at - i * piece))
                ends, p = [], x.find(b"\n")
                while p >= 0 and len(ends) < 4:
                    ends.append(at + i * piece + p)
                    p = x.find(b"\n", p + 1)
                own = x[: ends[0] - at - i * piece] if ends else x
                yield pd.DataFrame({"id": [i], "ends": [ends], "tabs": [own.count(b"\t")], "spaces": [own.count(b" ")]})

    n = -(-(size - at) // piece)
    return spark.range(0, n, 1, n).mapInPandas(run, "id bigint, ends array<bigint>, tabs bigint, spaces bigint").orderBy("id").collect()


def _labels(spark: SparkSession, path: str, at: int, end: int, first: list[int], sep: bytes, piece: int) -> DataFrame:
    """(i, label) from the line of row labels, by pieces; first has the number of separators before each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = file_system(path)
        for b in batches:
            for k, before in zip(b["k"].tolist(), b["first"].tolist(), strict=True):
                start, stop = at + k * piece, min(end, at + (k + 1) * piece)
                with store.open_input_file(where) as f:
                    f.seek(max(at, start - 1))
                    x = f.read(stop - max(at, start - 1))
                    more = b""
                    while f.tell() < end and sep not in more:  # the last label goes on in the next piece
                        more += f.read(min(1 << 16, end - f.tell()))
                if k:
                    begin = x.startswith(sep)  # else the first label here began before and is that piece's
                    x = x[1:]
                tokens = (x + more.split(sep, 1)[0]).split(sep)
                number = before
                if k and not begin:
                    tokens, number = tokens[1:], before + 1
                if x.endswith(sep) and stop < end:
                    tokens = tokens[:-1]  # it begins in the next piece
                if tokens:
                    yield pd.DataFrame({"i": np.arange(number, number + len(tokens)), "label": pd.Series([t.decode() for t in tokens], dtype=object)})

    pieces = spark.createDataFrame(list(enumerate(first)), "k bigint, first bigint").repartition(len(first), "k")
    return pieces.mapInPandas(run, "i bigint, label string")


def _tags(spark: SparkSession, path: str, at: int, size: int, n: int, m: int, piece: int | None = None) -> dict:
    """Row labels, one line, are counted and read by pieces in tasks; the lines of headers and of the name are read here."""
    if size <= at:
        return {}
    piece = piece or TAG_PIECE
    found = _label_pieces(spark, path, at, size, piece)
    ends = [x for r in found for x in r["ends"]][:4]
    lines = list(zip([at, *(x + 1 for x in ends)], [*ends, size], strict=True))  # from, to
    store, where = file_system(path)

    def read(i: int) -> str:
        if i >= len(lines):
            return ""
        with store.open_input_file(where) as f:
            f.seek(lines[i][0])
            return f.read(lines[i][1] - lines[i][0]).decode().rstrip("\r")

    labels = None
    begin, end = lines[0]
    with store.open_input_file(where) as f:
        f.seek(max(begin, end - 1))
        end -= end > begin and f.read(1) == b"\r"
    if end > begin:
        used = found[: -(-(end - begin) // piece)]
        sep = "spaces" if n > 1 and not sum(r["tabs"] for r in used) else "tabs"
        counts = [r[sep] for r in used]
        if sum(counts) + 1 != n:
            raise MatrixError(f"there are {sum(counts) + 1} row labels, not {n}")
        labels = _labels(spark, path, begin, end, [sum(counts[:i]) for i in range(len(counts))], b"\t" if sep == "tabs" else b" ", piece)
    headers = read(1)
    if headers:
        t = headers.split("\t")
        headers = headers.split(" ") if len(t) == 1 < m else t
        if len(headers) != m:
            raise MatrixError(f"there are {len(headers)} column headers, not {m}")
    return {"row_tags": labels, "col_tags": spark.createDataFrame(list(enumerate(headers)), "j int, header string") if headers else None, "name": read(2) or None}


@dataclass(frozen=True)
class Head:
    """What a file's head says: rows, columns, where cells begin and their type, and the file's size."""

    n: int
    m: int
    at: int
    real: np.dtype
    size: int


def kinds(native: bool, real: str, index: str, signature: int) -> tuple[np.dtype, np.dtype]:
    return np.dtype(real) if native else np.dtype("<i4" if signature == INTEGER else "<f8"), np.dtype(index) if native else np.dtype("<u4")


def head_bytes(n: int, m: int, native: bool = False, real: str = "<f4", index: str = "<u4", signature: int = REAL) -> tuple[bytes, np.dtype]:
    """A file's head, and the type of its cells."""
    cells, sizes = kinds(native, real, index, signature)
    return (b"" if native else signature.to_bytes(4, "little")) + np.array([n, m], sizes).tobytes(), cells


def read_head(path: str, native: bool = False, real: str = "<f4", index: str = "<u4", signature: int = REAL) -> Head:
    store, where = file_system(path)
    cells, sizes = kinds(native, real, index, signature)
    with store.open_input_file(where) as f:
        size, at = f.size(), 0
        if not native:
            if size < 12 or int.from_bytes(f.read(4), "little") != signature:
                raise MatrixError("the file has not the signature of a matrix")
            at = 4
        if size < at + 2 * sizes.itemsize:
            raise MatrixError("the file is cut short")
        f.seek(at)
        n, m = (int(x) for x in np.frombuffer(f.read(2 * sizes.itemsize), sizes))
    at += 2 * sizes.itemsize
    check_shape(n, m)
    if size < at + n * m * cells.itemsize:
        raise MatrixError("the file is cut short")
    return Head(n, m, at, cells, size)


def read_binary(spark: SparkSession, path: str, native: bool = False, real: str = "<f4", index: str = "<u4", check: bool = True, shape: tuple[int, int] | None = None, transpose: bool = False, signature: int = REAL) -> Matrix:
    """Only the head, the column headers and the name are read on the driver; cells and row labels are decoded in pieces by tasks that seek to them."""
    h = read_head(path, native, real, index, signature)
    n, m, at, size, real = h.n, h.m, h.at, h.size, h.real
    if shape and shape != (n, m):
        raise MatrixError(f"the matrix is {n} x {m}, not {shape[0]} x {shape[1]}")
    tags = _tags(spark, path, at + n * m * real.itemsize, size, n, m)
    rows = max(1, PIECE // m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = file_system(path)
        for b in batches:
            for first in b["id"] * rows:
                k = min(rows, n - int(first))
                with store.open_input_file(where) as f:
                    f.seek(at + int(first) * m * real.itemsize)
                    v = np.frombuffer(f.read(k * m * real.itemsize), real).astype(np.float64)
                full = np.flatnonzero(v != 0)
                yield pd.DataFrame({"i": first + full // m, "j": (full % m).astype(np.int32), "v": v[full]})

    pieces = -(-n // rows)
    cells = spark.range(0, pieces, 1, pieces).mapInPandas(run, "i bigint, j int, v double")
    out = Matrix(cells, n, m, **tags)
    out = validate(out) if check and not native else out
    return out.transpose() if transpose else out


def _tail(m: Matrix) -> Iterator[bytes]:
    if m.tagged:
        yield from tag_line(m.row_tags, "i", "label", m.n_rows)
        yield b"\n"
        yield from tag_line(m.col_tags, "j", "header", m.n_cols)
        yield f"\n{m.name or ''}\n".encode()


def write_binary(m: Matrix, path: str, native: bool = False, real: str = "<f4", index: str = "<u4", signature: int = REAL) -> None:
    """One file in order of rows. Where the path is of a shared file system, tasks put the stored cells at their places and the driver writes head and tags alone. Other stores
    can't do that: ranges of rows are written as pieces by tasks there, and the file is put together from them. Tags stream through the driver in order."""
    head, cells = head_bytes(m.n_rows, m.n_cols, native, real, index, signature)
    where = plain(path)
    if where is None:
        _write_pieces(m, path, head, cells)
        return
    file = Placed(where)
    try:
        file.begin(head, len(head) + m.n_rows * m.n_cols * cells.itemsize)
        write_cells(m.cells, file.temporary, len(head), m.n_cols, cells)
        file.append(_tail(m))
        file.finish()
    finally:
        file.give_up()


def transpose_binary(spark: SparkSession, path: str, out: str, native: bool = False, real: str = "<f4", index: str = "<u4", signature: int = REAL, tile_bytes: int | None = None) -> None:
    """The transposed file, with tags exchanged, by blocks of cells that go from file to file. Both paths are of a shared file system. Dimensions can be as large as the head's type holds."""
    h = read_head(path, native, real, index, signature)
    head, _ = head_bytes(h.m, h.n, native, real, index, signature)
    tags = _tags(spark, path, h.at + h.n * h.m * h.real.itemsize, h.size, h.n, h.m)
    rows, cols = tags.get("row_tags"), tags.get("col_tags")
    file = Placed(needs_plain(out))
    try:
        file.begin(head, len(head) + h.n * h.m * h.real.itemsize)
        transpose_cells(spark, needs_plain(path), file.temporary, h.at, (h.n, h.m), h.real, tile_bytes)
        if tags:
            file.append(tag_line(cols, "j", "header", h.m))
            file.append([b"\n"])
            file.append(tag_line(rows, "i", "label", h.n))
            file.append([f"\n{tags.get('name') or ''}\n".encode()])
        file.finish()
    finally:
        file.give_up()


def _write_pieces(m: Matrix, path: str, head: bytes, real: np.dtype) -> None:
    spark = m.cells.sparkSession
    folder = scratch(spark, "pieces")
    store, where = file_system(folder)
    store.create_dir(where, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, name = None, f"{uuid.uuid4().hex}.piece"  # each try of a task names its piece anew
        store, where = file_system(folder)
        with store.open_output_stream(f"{where}/{name}") as f:
            for b in batches:
                first = int(b["i"].iloc[0]) if first is None and len(b) else first
                for row in b["row"]:
                    f.write(np.asarray(row).astype(real).tobytes())
        if first is not None:
            yield pd.DataFrame({"first": [first], "name": [name]})

    rows = m.dense_rows().repartitionByRange("i").sortWithinPartitions("i")
    pieces = checkpointed(rows.mapInPandas(run, "first bigint, name string")).orderBy("first").collect()
    compose(path, [head], (f"{folder}/{r['name']}" for r in pieces), _tail(m))
    delete(spark, folder)
