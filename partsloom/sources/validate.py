"""What a matrix must be to be factorized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import R_MIN, is_valid
from ..model import Matrix, MatrixError

#: Rows and columns that a matrix has at least.
LEAST = 2


def bad_cells(cells: DataFrame) -> DataFrame:
    """Cells that are negative, or neither zero nor a normal number."""
    return cells.where(~is_valid(F.col("v")) | (F.col("v") < 0))


def empty_lines(cells: DataFrame, key: str, n: int) -> DataFrame:
    """Indexes below n of which the cells add up to nothing, those without a stored cell included."""
    full = cells.groupBy(key).agg(F.sum("v").alias("s")).where(F.col("s") >= R_MIN).select(F.col(key).cast("bigint").alias("id"))
    return cells.sparkSession.range(n).join(full, "id", "left_anti").select(F.col("id").alias(key))


def fits(n: Column, m: Column) -> Column:
    """Whether there can be a matrix of n by m."""
    return F.coalesce((n >= LEAST) & (m >= LEAST), F.lit(False))


def check_shape(n: int, m: int) -> None:
    if n < LEAST or m < LEAST:
        raise MatrixError(f"a matrix needs two rows and columns at least, not {n} x {m}")


def validate(m: Matrix) -> Matrix:
    """m, or an error that names the first fault. One pass over the cells sums rows and columns alike and finds bad cells; only the name of an empty line takes another."""
    check_shape(m.n_rows, m.n_cols)
    bad = F.when(~is_valid(F.col("v")) | (F.col("v") < 0), F.struct("i", "j", "v"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("at")), F.struct(F.lit(1).alias("side"), F.col("j").cast("bigint").alias("at"))))
    sums = m.cells.select(sides.alias("x"), "v", bad.alias("bad")).groupBy("x.side", "x.at").agg(F.sum("v").alias("s"), F.min("bad").alias("bad"))
    full = lambda side: F.count(F.when((F.col("side") == side) & (F.col("s") >= R_MIN), 1))
    seen = sums.agg(full(0).alias("rows"), full(1).alias("columns"), F.min("bad").alias("bad")).first()
    if x := seen["bad"]:
        raise MatrixError(f"row {x['i']}, column {x['j']}: {x['v']} is negative or no normal number")
    for key, n, what in (("i", m.n_rows, "row"), ("j", m.n_cols, "column")):
        if seen[f"{what}s"] < n:
            raise MatrixError(f"{what} {empty_lines(m.cells, key, n).agg(F.min(key)).first()[0]} is empty")
    return m


def check_rank(k: int, m: Matrix) -> None:
    if not 2 <= k <= min(m.n_rows, m.n_cols):
        raise MatrixError(f"the rank must be from 2 to {min(m.n_rows, m.n_cols)}, not {k}")
