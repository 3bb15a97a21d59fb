"""Positional files, the data source, rows longer than a split."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from partsloom import MatrixError
from partsloom.sources import binary, compose, files, matrix_source, positional, wide
from partsloom.sources.text import read_text
from partsloom.sources.wide import entries, read_wide
from test_matrix import array, matrix, write

RNG = np.random.default_rng(4)


def some(n=30, m=11):
    v = np.where(RNG.random((n, m)) < 0.6, RNG.random((n, m)) + 0.5, 0)
    v[:, 0], v[0] = 1, 2
    return v


def test_no_cell_passes_the_driver(spark, tmp_path, monkeypatch):
    """The driver writes head and tags only; nothing is put together from pieces."""
    said = []
    monkeypatch.setattr(binary, "compose", lambda *a, **b: said.append("compose"))
    begin, append = positional.Placed.begin, positional.Placed.append
    monkeypatch.setattr(positional.Placed, "begin", lambda self, head, size: (said.append(len(head)), begin(self, head, size)))
    monkeypatch.setattr(positional.Placed, "append", lambda self, pieces: append(self, [(said.append(len(x)), x)[1] for x in pieces]))
    v, out = some(), str(tmp_path / "m.dat")
    files.write_matrix(matrix(spark, v), out, "binary")
    assert said == [12] and os.listdir(tmp_path) == ["m.dat"]
    raw = open(out, "rb").read()
    assert (np.frombuffer(raw[12:], "<f8").reshape(v.shape) == v).all() and np.frombuffer(raw[4:12], "<u4").tolist() == list(v.shape)


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    bad = matrix(spark, some()).cells.withColumn("v", F.expr("if(i = 7, raise_error('no'), v)"))
    with pytest.raises(Exception, match="no"):
        files.write_matrix(type(matrix(spark, some()))(bad, 30, 11), str(tmp_path / "m.dat"), "binary")
    assert os.listdir(tmp_path) == []


def test_pieces_where_no_place_can_be_written(spark, tmp_path, monkeypatch):
    v, out = some(), str(tmp_path / "m.dat")
    monkeypatch.setattr(binary, "plain", lambda path: None)
    files.write_matrix(matrix(spark, v), out, "binary")
    assert (array(files.read_matrix(spark, out, "binary").cells, v.shape, "ijv") == v).all()


@pytest.mark.parametrize("tile", [8, 100, 10**6])
@pytest.mark.parametrize("fmt", ["binary", "native"])
def test_transposed_by_blocks(spark, tmp_path, tile, fmt):
    v = some(13, 7)
    tags = {"name": "n", "row_tags": spark.createDataFrame([(i, f"r{i}") for i in range(13)], "i bigint, label string"), "col_tags": spark.createDataFrame([(j, f"c{j}") for j in range(7)], "j int, header string")}
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    types = {"real": "<f8"} if fmt == "native" else {}
    files.write_matrix(matrix(spark, v, **tags), a, fmt, **types)
    binary.transpose_binary(spark, a, b, fmt == "native", tile_bytes=tile, **types)
    m = files.read_matrix(spark, b, fmt, **types)
    assert (array(m.cells, (7, 13), "ijv") == v.T).all() and m.name == "n"
    assert [r["label"] for r in m.row_tags.orderBy("i").collect()] == [f"c{j}" for j in range(7)] and m.col_tags.count() == 13


def test_blocks_past_2_to_the_31_rows(tmp_path):
    """Rows, and so the columns of the transposed file, that 32-bit signed numbers don't hold; the file is sparse."""
    n, at, kind = 2**31 + 50, 12, np.dtype("<i1")
    shape, a, b = (n, 2), tmp_path / "a", tmp_path / "b"
    for p in (a, b):
        with open(p, "wb") as f:
            f.truncate(at + 2 * n)
    x, y = os.open(a, os.O_RDWR), os.open(b, os.O_RDWR)
    rows = np.array([[5, 6], [0, 7]], "<i1")
    positional.put(x, rows.tobytes(), at + (n - 2) * 2)
    positional.transpose_block(x, y, at, shape, kind, (n - 40, n), (0, 2))
    got = [np.frombuffer(os.pread(y, 2, at + j * n + n - 2), "<i1").tolist() for j in range(2)]
    os.close(x), os.close(y)
    assert got == rows.T.tolist()


def test_blocks_fit():
    for shape in ((10**9, 3), (3, 10**9), (10**6, 10**6), (2, 2)):
        r, c = positional.blocks_of(shape, 8, 64_000_000)
        assert 1 <= r <= shape[0] and 1 <= c <= shape[1] and r * c * 8 <= 64_000_000


def test_source_reads_only_the_rows_asked_for(spark, tmp_path):
    """A filter on i becomes a range of bytes: the rest of the file can be garbage of no number, and partitions are fewer."""
    matrix_source.register(spark)
    v, out = some(40, 5), str(tmp_path / "m.dat")
    files.write_matrix(matrix(spark, v), out, "binary")
    read = spark.read.format("tagged_matrix").option("path", out).option("partcells", 25).load()
    assert read.dtypes == [("i", "bigint"), ("j", "int"), ("v", "double")]
    assert (array(read, v.shape, "ijv") == v).all() and read.rdd.getNumPartitions() == 8
    some_rows = read.where("i >= 10 and i < 20 and j > 1")
    assert some_rows.rdd.getNumPartitions() == 2
    want = {(i, j) for i, j in zip(*np.nonzero(v), strict=True) if 10 <= i < 20 and j > 1}
    assert {(r["i"], r["j"]) for r in some_rows.collect()} == want
    with open(out, "r+b") as f:  # rows from 20 on are gone but for the size: only those asked for are read
        f.seek(12 + 20 * 5 * 8)
        f.write(np.full(20 * 5, np.nan).tobytes())
    assert some_rows.where("isnan(v)").count() == 0 and read.where("i = 7").count() == np.count_nonzero(v[7]) and read.where("i > 38 and i <= 5").count() == 0
    narrow = spark.read.format("tagged_matrix").schema("v double, i bigint").option("path", out).load().where("i < 3")
    assert narrow.columns == ["v", "i"] and narrow.count() == np.count_nonzero(v[:3])


def test_source_reads_few_bytes(tmp_path, monkeypatch):
    """Counted at the file: a range of rows takes its own bytes and the head."""
    n, m = 1000, 4
    path = tmp_path / "m.dat"
    path.write_bytes(binary.head_bytes(n, m)[0] + np.ones(n * m).tobytes())
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

    taken = []
    store, where = compose.file_system(str(path))

    class Counting:
        def open_input_file(self, p):
            f = store.open_input_file(p)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    f.close()

                seek = staticmethod(f.seek)

                def read(self, k):
                    taken.append(k)
                    return f.read(k)

            return File()

    r = matrix_source.MatrixReader({"path": str(path)}, StructType().add("i", LongType()).add("j", IntegerType()).add("v", DoubleType()))
    assert list(r.pushFilters([GreaterThanOrEqual(("i",), 100), LessThan(("i",), 110)])) == []
    monkeypatch.setattr(matrix_source, "file_system", lambda p: (Counting(), where))
    got = [b for p in r.partitions() for b in r.read(p)]
    assert sum(b.num_rows for b in got) == 40 and sum(taken) == 10 * m * 8


def test_source_writes(spark, tmp_path):
    matrix_source.register(spark)
    v, out = some(25, 6), str(tmp_path / "w.dat")
    cells = matrix(spark, v).cells.repartition(5)
    write = lambda df, mode: df.write.format("tagged_matrix").option("path", out).option("rows", 25).option("cols", 6).mode(mode).save()
    write(cells, "append")
    assert (array(files.read_matrix(spark, out, "binary").cells, v.shape, "ijv") == v).all()
    with pytest.raises(Exception, match="already"):
        write(cells, "append")
    write(cells.withColumn("v", F.col("v") * 2), "overwrite")
    assert (array(files.read_matrix(spark, out, "binary").cells, v.shape, "ijv") == 2 * v).all()
    with pytest.raises(Exception, match="outside"):
        write(cells.withColumn("i", F.col("i") + 3), "overwrite")
    assert os.listdir(tmp_path) == ["w.dat"]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("text", ["1\t2\n3\t4\n", "1\t2\n3\t4", "a\tbb\r\n\t\r\nccc\t", "\n\n", "x", "\t", "long entry\tand another one\n\n1"])
def test_entries_wherever_ranges_end(spark, tmp_path, text, piece):
    got = sorted(map(tuple, entries(spark, write(tmp_path, text), "\t", piece).collect()))
    lines = text.split("\n")
    lines = lines[:-1] if text.endswith("\n") else lines
    assert got == [(i, j, t) for i, x in enumerate(lines) for j, t in enumerate(x.removesuffix("\r").split("\t"))]


def test_wide_rows_over_many_ranges(spark, tmp_path):
    v = some(4, 300)
    tags = {"name": "n", "row_tags": spark.createDataFrame([(i, f"r{i}") for i in range(4)], "i bigint, label string"), "col_tags": spark.createDataFrame([(j, f"c{j}") for j in range(300)], "j int, header string")}
    out = str(tmp_path / "wide.txt")
    files.write_matrix(matrix(spark, v, **tags), out, "text")
    a, b = read_text(spark, out), read_wide(spark, out, piece=100)
    assert sorted(map(tuple, a.cells.collect())) == sorted(map(tuple, b.cells.collect())) and (a.n_rows, a.n_cols, a.name) == (b.n_rows, b.n_cols, b.name)
    assert [r["label"] for r in b.row_tags.orderBy("i").collect()] == [f"r{i}" for i in range(4)] and b.col_tags.count() == 300


def test_small_ranges_of_a_large_file_are_wider(spark, tmp_path, monkeypatch):
    """As many ranges as RANGES in place of one for some bytes, in few tasks, with the same entries."""
    v, out = some(40, 300), str(tmp_path / "wide.txt")
    files.write_matrix(matrix(spark, v), out, "text")
    size = os.path.getsize(out)
    assert wide.width(size, 10**6) == 10**6 and wide.width(150_000_000, 200) == 150_000 and wide.width(10**12, 200) == wide.RANGE
    want = sorted(map(tuple, entries(spark, out, "\t", 10**6).collect()))
    for most in (1, 7, 500):
        monkeypatch.setattr(wide, "RANGES", most)
        got = entries(spark, out, "\t", 8)
        assert sorted(map(tuple, got.collect())) == want and got.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("text", ["1\t2\n\n3\t4\n", "1\t2\n3\t4\n" + "\n" * 16, "1\t2\n3\t-4\n", "1\t2\n3\t1d\n", "1\t2\n3\n", "1\t2\n3\t4\t5\n", "0\t0\n3\t4\n", ""])
def test_wide_errors(spark, tmp_path, text):
    with pytest.raises(MatrixError):
        read_wide(spark, write(tmp_path, text), piece=3)
