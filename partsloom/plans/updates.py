"""Multiplicative updates as joins and aggregations over long tables.

Products of the factors are formed at V's non-zero cells alone, as V ./ (W H) is zero elsewhere. (Where W H is also zero there, a dense
computation would meet 0/0 instead.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ieee_divide
from ..operators.matrix import at_cells, multiply_divide, reduce_to_row
from ..session import checkpointed


def _numerators(v: DataFrame, w: DataFrame, h: DataFrame, key: str, other: str) -> DataFrame:
    cells = at_cells(v, w, h).select(key, ieee_divide(F.col("v"), F.col("wh")).alias("r"), F.posexplode(other).alias("k", "x"))
    return cells.groupBy(key, "k").agg(F.sum(F.col("r") * F.col("x")).alias("num"))


def update_h(v: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """H .* (W^T (V ./ (W H))) ./ column sums of W."""
    return multiply_divide(h, _numerators(v, w, h, "j", "w"), reduce_to_row(w, "w"), "j", "h")


def update_w(v: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """W .* ((V ./ (W H)) H^T) ./ row sums of H."""
    return multiply_divide(w, _numerators(v, w, h, "i", "h"), reduce_to_row(h, "h"), "i", "w")


def iterate(v: DataFrame, w: DataFrame, h: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """times rounds of H, then W with the new H; each is checkpointed, else plans would double with every step."""
    for _ in range(times):
        h = checkpointed(update_h(v, w, h))
        w = checkpointed(update_w(v, w, h))
    return w, h
