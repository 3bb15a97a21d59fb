"""Number rules: what a cell may be, division and flooring as floating-point hardware does them, and C's %g."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The smallest and largest normal double.
R_MIN, R_MAX = 2.2250738585072014e-308, 1.7976931348623157e308
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Nothing, or numbers with blanks between, all of them: such a token doesn't make a line a header.
NUMBERS = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?(\s+|$))*$"


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b for a >= 0: x/0 is infinite and 0/0 is NaN, as no ANSI division has it."""
    zero = F.when(a == 0, F.lit(float("nan"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(zero)).otherwise(a / F.when(b != 0, b))


def floored(x: Column) -> Column:
    """Nothing below R_MIN and no NaN; infinity stays."""
    return F.greatest(F.nanvl(x, F.lit(R_MIN)), F.lit(R_MIN))


def is_valid(v: Column) -> Column:
    """Zero or a normal number, which leaves out NaN, infinities and subnormals; null is not valid."""
    return F.coalesce(~F.isnan(v) & ((v == 0) | F.abs(v).between(R_MIN, R_MAX)), F.lit(False))


def parse_cell(token: Column) -> Column:
    """A text cell as double: an empty one is 0, anything but a decimal number is null."""
    return F.when(F.trim(token) == "", F.lit(0.0)).when(token.rlike(NUMBER), F.trim(token).try_cast("double"))


@F.pandas_udf(T.StringType())
def format_g(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rows of numbers as C's %g writes them, TABs between."""
    for s in values:
        yield s.map(lambda row: "\t".join("%g" % x for x in row))
