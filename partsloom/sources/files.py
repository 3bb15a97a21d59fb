"""Formats by name, conversion, combination and synthetic matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Matrix, MatrixError
from ..operators.matrix import combine_columns
from ..operators.start import new_seed, uniform
from .binary import read_binary, transpose_binary, write_binary
from .positional import plain
from .text import read_text, write_text
from .wide import read_wide

EXTENSION = {"text": ".txt", "binary": ".dat", "native": ".native.dat"}


def read_matrix(spark: SparkSession, path: str, fmt: str = "text", wide: bool = False, **options) -> Matrix:
    """wide: text of one file whose rows can be longer than a split."""
    if fmt == "text" and wide:
        return read_wide(spark, path, **options)
    if fmt == "text":
        return read_text(spark, path, **options)
    if fmt in ("binary", "native"):
        options = {k: v for k, v in options.items() if k not in ("numeric_headers", "numeric_labels")}
        return read_binary(spark, path, native=fmt == "native", **options)
    raise MatrixError(f"there is no format {fmt}")


def write_matrix(m: Matrix, path: str, fmt: str = "text", transpose: bool = False, **options) -> None:
    """The native form is written as the matrix stands, whatever transpose says."""
    if fmt not in EXTENSION:
        raise MatrixError(f"there is no format {fmt}")
    if transpose and fmt != "native":
        m = m.transpose()
    write_text(m, path, **options) if fmt == "text" else write_binary(m, path, native=fmt == "native", **options)


def convert(spark: SparkSession, path: str, source: str, target: str, **options) -> str:
    """Reads in one format and writes in another beside it; returns the new path."""
    out = path + EXTENSION[target]
    write_matrix(read_matrix(spark, path, source, **options), out, target)
    return out


def transpose_file(spark: SparkSession, path: str, out: str, fmt: str = "text", **options) -> None:
    """Binary files on a shared file system go block by block from file to file; others are read and written."""
    if fmt != "text" and plain(path) and plain(out):
        transpose_binary(spark, path, out, fmt == "native", **options)
        return
    write_matrix(read_matrix(spark, path, fmt, **options).transpose(), out, fmt)


def combine_native(spark: SparkSession, paths: list[str], out: str, **options) -> Matrix:
    """Native files of one shape side by side as text; column headers are repeated for each."""
    parts = [read_matrix(spark, p, "native", **options) for p in paths]
    if len(parts) < 2 or len({(p.n_rows, p.n_cols) for p in parts}) > 1:
        raise MatrixError("at least two matrices of the same shape are needed")
    first, n = parts[0], parts[0].n_cols
    heads = first.col_tags and combine_columns([first.col_tags] * len(parts), n)
    m = Matrix(combine_columns([p.cells for p in parts], n), first.n_rows, n * len(parts), first.name, first.row_tags, heads)
    write_text(m, out)
    return m


def generate(spark: SparkSession, rows: int, cols: int, most: float = 1.0, seed: int | None = None) -> Matrix:
    """Uniform cells up to most, no tags; the same for a seed on any number of partitions."""
    if rows < 2 or cols < 2 or not most > 0:
        raise MatrixError("at least two rows and columns and a positive greatest value are needed")
    seed = new_seed() if seed is None else seed
    js = F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    cells = spark.range(rows).select(F.col("id").alias("i"), js.alias("j")).select("i", F.col("j").cast("int").alias("j"), (uniform(F.col("i"), F.col("j").cast("bigint"), 2, seed) * F.lit(float(most))).alias("v"))
    return Matrix(cells, rows, cols)


def factor_matrices(m: Matrix, w: DataFrame, h: DataFrame, k: int) -> tuple[Matrix, Matrix]:
    """W (rows by factors) and H (factors by columns) with the tags of m; factors are named only if m has any tag."""
    spark = m.cells.sparkSession
    names = spark.range(k).select(F.col("id"), F.concat(F.lit("Factor_"), F.col("id").cast("string")).alias("t")) if m.tagged else None
    heads = names and names.select(F.col("id").cast("int").alias("j"), F.col("t").alias("header"))
    labels = names and names.select(F.col("id").alias("i"), F.col("t").alias("label"))
    return (
        Matrix(w.select("i", F.col("k").cast("int").alias("j"), F.col("w").alias("v")), m.n_rows, k, m.name, m.row_tags, heads),
        Matrix(h.select(F.col("k").cast("bigint").alias("i"), F.col("j").cast("int").alias("j"), F.col("h").alias("v")), k, m.n_cols, m.name, labels, m.col_tags),
    )
