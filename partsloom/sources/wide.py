"""Text matrices whose rows can be longer than a split, or than a task can hold.

A file is cut into ranges of bytes. Each range counts its line ends, and the delimiters behind the last of them; sums of these, a row a range, say at which row and column each
range begins. Then every range gives the entries that begin in it, reading on past its end for the last one. No task holds a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import is_valid, parse_cell
from ..model import Matrix, MatrixError
from ..session import checkpointed
from .compose import file_system
from .text import MOST_BLANK, first_lines, infer
from .validate import validate

#: Bytes of a range.
RANGE = 16_000_000
#: Small ranges are made wider until a file has no more than so many of them, or they are of RANGE bytes: a range costs some milliseconds, whatever its size.
RANGES = 1_000
#: Bytes read at a time past the end of a range.
MORE = 1 << 16
END = 10


def width(size: int, piece: int) -> int:
    """Bytes of a range: piece, or as many times that as leaves RANGES of them, but not beyond RANGE for that."""
    return piece * max(1, min(-(-size // (piece * RANGES)), RANGE // piece))


def tasks(spark: SparkSession, n: int, size: int) -> int:
    """Tasks for n ranges: some for each core, more only where a task would get more than RANGE bytes."""
    return max(1, min(n, 10_000, max(3 * spark.sparkContext.defaultParallelism, -(-size // RANGE))))


def one_frame(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    if held := list(rows):  # the ranges of a task, a few numbers each
        yield pd.DataFrame(held)


def _counts(spark: SparkSession, path: str, size: int, piece: int, sep: int) -> DataFrame:
    """(id, row, col) of each range: at which row and entry its first byte stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        store, where = file_system(path)
        for b in batches:
            with store.open_input_file(where) as f:
                for r in b["id"].tolist():
                    f.seek(r * piece)
                    x = np.frombuffer(f.read(min(piece, size - r * piece)), np.uint8)
                    ends = np.flatnonzero(x == END)
                    yield {"id": r, "ends": len(ends), "seps": int((x[ends[-1] + 1 if len(ends) else 0 :] == sep).sum())}

    n = -(-size // piece)
    seen = checkpointed(spark.range(0, n, 1, tasks(spark, n, size)).mapInPandas(lambda batches: one_frame(run(batches)), "id long, ends long, seps long"))
    before = Window.orderBy("id")
    rows = seen.withColumn("upto", F.sum("ends").over(before)).withColumn("run", F.sum((F.col("ends") > 0).cast("int")).over(before))
    # from one range with a line end to the next, delimiters go on from range to range
    rows = rows.withColumn("last", F.sum("seps").over(Window.partitionBy("run").orderBy("id")))
    return rows.select("id", (F.col("upto") - F.col("ends")).alias("row"), F.coalesce(F.lag("last").over(before), F.lit(0)).alias("col"))


def entries(spark: SparkSession, path: str, sep: str = "\t", piece: int | None = None) -> DataFrame:
    """(line, at, token) of every entry of a file: line and place from 0. CR LF and LF end lines alike. An empty file has none, and the end of the last line begins no other. piece: bytes of a range
    at least (see width())."""
    store, where = file_system(path)
    with store.open_input_file(where) as f:
        size = f.size()
    piece, mark = width(size, piece or RANGE), ord(sep)
    if not size:
        return spark.createDataFrame([], "line long, at long, token string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, where = file_system(path)
        for b in batches:
            for r, row, col in zip(b["id"].tolist(), b["row"].tolist(), b["col"].tolist(), strict=True):
                start, stop = r * piece, min(size, (r + 1) * piece)
                with store.open_input_file(where) as f:
                    f.seek(max(0, start - 1))
                    x = f.read(stop - max(0, start - 1))
                    begins = not start or x[0] in (mark, END)  # an entry begins where the range does
                    x = x[1:] if start else x
                    own = len(x)
                    while f.tell() < size and not any(c in x[own - 1 :] for c in (sep.encode(), b"\n")):
                        x += f.read(min(MORE, size - f.tell()))
                a = np.frombuffer(x, np.uint8)
                cut = np.flatnonzero((a == mark) | (a == END))
                inner = cut[cut < own]  # these delimiters are the range's own
                first = np.r_[0, inner + 1] if begins else inner + 1
                first = first[first < own] if stop < size else first[first < size - start] if x.endswith(b"\n") else first
                if not len(first):
                    continue
                after = np.searchsorted(cut, first)
                last = np.where(after < len(cut), cut[np.minimum(after, len(cut) - 1)], len(x)) if len(cut) else np.full(len(first), len(x))
                ends = np.flatnonzero(a[:own] == END)
                line = row + np.searchsorted(ends, first)
                passed, here = np.searchsorted(inner, first), np.searchsorted(ends, first)
                reset = np.where(here > 0, np.searchsorted(inner, ends[np.maximum(here - 1, 0)]) + 1 if len(ends) else 0, 0)
                at = np.where(here > 0, passed - reset, col + passed)
                text = [x[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                final = np.array([j >= len(x) or x[j] == END for j in last.tolist()])
                token = [(t.removesuffix(b"\r") if z else t).decode("utf-8", "replace") for t, z in zip(text, final.tolist(), strict=True)]
                yield pd.DataFrame({"line": line, "at": at, "token": pd.Series(token, dtype=object)})

    starts = _counts(spark, path, size, piece, mark)
    n = -(-size // piece)
    return starts.repartition(tasks(spark, n, size), "id").mapInPandas(run, "line long, at long, token string")


def read_wide(spark: SparkSession, path: str, numeric_headers: bool = False, numeric_labels: bool = False, piece: int | None = None, check: bool = True) -> Matrix:
    """A file as read_text reads it, by the same rules, with rows of any length. The first two lines, from which the form is inferred, are looked at on the driver."""
    head = first_lines(spark, path)
    if not head or not head[0]:
        raise MatrixError("the file is empty")
    form = infer(head[0], head[1] if len(head) > 1 else None, numeric_headers, numeric_labels)
    width, labels, first = form["n_cols"] + form["labels"], int(form["labels"]), form["first"]
    every = checkpointed(entries(spark, path, form["sep"], piece).where(F.col("line") >= first).select((F.col("line") - first).alias("i"), (F.col("at") - labels).alias("j"), "token"))
    cell = every.withColumn("v", F.when(F.col("j") >= 0, parse_cell(F.col("token"))))
    wrong = (F.col("j") >= 0) & (F.col("v").isNull() | (~is_valid(F.col("v")) if check else F.lit(False)))
    lines = cell.groupBy("i").agg(F.count("*").alias("n"), F.max(F.trim("token") != "").alias("full"), F.min(F.when(wrong, F.struct("j", "token"))).alias("bad"))
    blank = (F.col("n") == 1) & ~F.col("full")
    lines = lines.select("i", blank.alias("blank"), (~blank & (F.col("n") != width)).alias("odd"), F.when(~blank & (F.col("n") == width), F.col("bad")).alias("bad"))
    least = lambda when, *what: F.min(F.when(when, F.struct("i", *what)))
    seen = lines.agg(F.count(F.when(F.col("blank"), 1)).alias("blanks"), F.min(F.when(F.col("blank"), F.col("i"))).alias("first"), F.max(F.when(~F.col("blank"), F.col("i"))).alias("last"), least(F.col("odd")).alias("odd"), least(F.col("bad").isNotNull(), "bad").alias("bad")).first()
    if seen["last"] is None:
        raise MatrixError("there is no line of data")
    if seen["blanks"] and (seen["first"] < seen["last"] or seen["blanks"] > MOST_BLANK):
        raise MatrixError(f"row {seen['first']} is blank")
    if seen["odd"] is not None:
        raise MatrixError(f"row {seen['odd']['i']} does not have {width} entries")
    if seen["bad"] is not None:
        raise MatrixError(f"row {seen['bad']['i']}, column {seen['bad']['bad']['j']}: {seen['bad']['bad']['token']!r} is no number that a cell can hold")
    data = cell.where(F.col("i") <= seen["last"])
    tags = data.where("j < 0").select("i", F.col("token").alias("label")) if labels else None
    headers = spark.createDataFrame(list(enumerate(form["headers"])), "j int, header string") if form["headers"] else None
    m = Matrix(data.where("v <> 0").select("i", F.col("j").cast("int").alias("j"), "v"), int(seen["last"]) + 1, form["n_cols"], form["name"], tags, headers)
    return validate(m) if check else m
