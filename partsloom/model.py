"""The data model: a matrix is a DataFrame of its non-zero cells, a shape and optional tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns are numbered by 32-bit integers.
MOST_COLUMNS = 2**31 - 1


class MatrixError(ValueError):
    """The input is no matrix that can be factorized."""


@dataclass(frozen=True)
class Matrix:
    """cells: (i bigint, j int, v double), zeros left out. row_tags: (i, label); col_tags: (j, header); each tag set can be absent."""

    cells: DataFrame
    n_rows: int
    n_cols: int
    name: str | None = None
    row_tags: DataFrame | None = None
    col_tags: DataFrame | None = None

    @property
    def tagged(self) -> bool:
        return self.name is not None or self.row_tags is not None or self.col_tags is not None

    def transpose(self) -> Matrix:
        """Rows become columns, of which there can be MOST_COLUMNS."""
        if self.n_rows > MOST_COLUMNS:
            raise MatrixError(f"{self.n_rows} rows are too many to become columns: their numbers are of 32 bits")
        cells = self.cells.select(F.col("j").cast("bigint").alias("i"), F.col("i").cast("int").alias("j"), "v")
        rows = self.col_tags and self.col_tags.select(F.col("j").cast("bigint").alias("i"), F.col("header").alias("label"))
        cols = self.row_tags and self.row_tags.select(F.col("i").cast("int").alias("j"), F.col("label").alias("header"))
        return Matrix(cells, self.n_cols, self.n_rows, self.name, rows, cols)

    def dense_rows(self) -> DataFrame:
        """(i, row array<double>) for every row, zeros filled in. A row is one task's value: columns must fit in memory, rows need not."""
        spark = self.cells.sparkSession
        packed = self.cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("p"))
        zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
        before = lambda k: F.coalesce(F.get("p", k - 1)["j"], F.lit(-1))
        each = F.transform("p", lambda x, k: F.concat(zeros(x["j"] - before(k) - 1), F.array(x["v"])))  # one pass over the stored cells, each with the zeros before it
        filled = F.concat(F.flatten(each), zeros(F.lit(self.n_cols - 1) - F.element_at("p", -1)["j"]))
        return spark.range(self.n_rows).withColumnRenamed("id", "i").join(packed, "i", "left").select("i", F.when(F.col("p").isNull(), zeros(F.lit(self.n_cols))).otherwise(filled).alias("row"))

    def preview(self, rows: int = 9, cols: int = 15, vector: int = 225) -> DataFrame:
        """(i, row) of the top left corner; of a single row or column its first vector cells."""
        rows, cols = (vector, 1) if self.n_cols == 1 else (1, vector) if self.n_rows == 1 else (rows, cols)
        corner = self.cells.where((F.col("i") < rows) & (F.col("j") < cols))
        return Matrix(corner, min(rows, self.n_rows), min(cols, self.n_cols)).dense_rows()

    def show(self) -> None:
        """Prints the preview."""
        self.preview().orderBy("i").show(225, truncate=False)
