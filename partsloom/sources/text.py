"""Matrices as lines of cells between TABs (or single spaces), with optional name, column headers and row labels."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import NUMBERS, format_g, is_valid, parse_cell
from ..model import Matrix, MatrixError
from ..session import checkpointed
from .compose import compose, delete, file_system, scratch
from .positional import Placed, join_files, plain, tag_line
from .validate import validate

MOST_BLANK = 15


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at, id): lines of a file, or of the files in a folder, CR LF and LF endings alike, with the file and the place in it where the split begins."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))


DIGITS = 20


def natural(name: str) -> tuple[str, ...]:
    """A file's name as a key that has numbers in it in order of their values: part-99999 before part-100000."""
    return tuple(x.zfill(DIGITS) if x.isdigit() else x for x in re.findall("[0-9]+|[^0-9]+", name))


def natural_key(name: Column) -> Column:
    """The same key in Spark."""
    return F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]+$") & (F.length(x) < DIGITS), F.lpad(x, DIGITS, "0")).otherwise(x))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line bigint, value): lines in order; a folder's files follow each other by name, numbers in names by value.

    Lines are numbered within the splits of the files, which are read apart, and the splits' counts (a row a split) are added up.
    """
    raw = lines_of(spark, path)
    counts = raw.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy(natural_key(F.col("file")), "file", "at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return raw.join(offsets, ["file", "at"]).select((F.col("offset") + F.col("id") - F.col("first")).alias("line"), "value")


def first_lines(spark: SparkSession, path: str, n: int = 2) -> list[str]:
    """The first n lines; reads no further."""
    out: list[str] = []
    for f in sorted(spark.read.text(path).inputFiles(), key=natural):
        out += [r["value"].rstrip("\r") for r in spark.read.option("lineSep", "\n").text(f).head(n - len(out))]
        if len(out) == n:
            break
    return out


def _number(token: str) -> bool:
    return re.match(NUMBERS, token) is not None


def infer(first: str, second: str | None, numeric_headers: bool = False, numeric_labels: bool = False) -> dict:
    """From the first two lines: sep, name, headers, labels (whether there are any), n_cols and the number of the first line of data."""

    def headed(tokens: list[str]) -> bool:
        return numeric_headers or any(not _number(t) for t in tokens[1:]) or (len(tokens) == 1 and not _number(tokens[0]))

    sep, one = "\t", first.split("\t")
    has = headed(one)
    if has:
        if second is None:
            raise MatrixError("there is no line of data")
        data = second.split(sep)
        if len(one) == 1 and len(data) == 1:
            sep, one, data = " ", first.split(" "), second.split(" ")
    else:
        if len(one) == 1:
            sep, one = " ", first.split(" ")
            has = headed(one)
        data = second.split(sep) if has and second is not None else one
    labels = numeric_labels or not _number(data[0])
    n = len(data) - labels
    if n < 2:
        raise MatrixError("there are fewer than two columns")
    name = headers = None
    if has:
        if len(one) == n + 1:
            name, headers = one[0], one[1:]
        elif len(one) == n:
            headers = one
        elif len(one) == 1:
            name = one[0]
        else:
            raise MatrixError(f"line 1 has {len(one)} entries, line 2 has {len(data)}")
    return {"sep": sep, "name": name, "headers": headers, "labels": labels, "n_cols": n, "first": int(has)}


def parsed(lines: DataFrame, sep: str, labels: bool, n_cols: int, check: bool = True) -> DataFrame:
    """lines with i and value, of data; in place of value come blank, odd (another number of entries), label, bad (the first entry that no cell can hold, from 1, or 0), token
    (what it is) and v (the cells; an empty one is 0). Blank and odd lines are not looked into."""
    rest = [c for c in lines.columns if c != "value"]
    tokens = lines.select(*rest, (F.trim("value") == "").alias("blank"), F.split("value", re.escape(sep), -1).alias("t"))
    tokens = tokens.select(*rest, "blank", (F.size("t") != n_cols + labels).alias("odd"), F.get("t", F.lit(0)).alias("label"), F.slice("t", 1 + labels, n_cols).alias("t"))
    values = tokens.withColumn("v", F.transform("t", parse_cell))
    bad = F.array_position(F.transform("v", lambda x: x.isNull() | (~is_valid(x) if check else F.lit(False))), True)
    values = values.withColumn("bad", F.when(~F.col("blank") & ~F.col("odd"), bad).otherwise(0).cast("int"))
    return values.select(*rest, "blank", "odd", "label", "bad", F.get("t", F.col("bad") - 1).alias("token"), "v")


def faults(lines: DataFrame, *by: str) -> DataFrame:
    """For each file (by; none: all lines are of one) of parsed lines: last (its last line of data), blank (a blank line that may not be there: one before data, or the first of more than MOST_BLANK), odd
    and bad (i, bad, token), each the first of its kind; null where there is none."""
    line = lambda when, *what: F.min(F.when(when, F.struct("i", *what) if what else F.col("i")))
    seen = lines.groupBy(*by).agg(
        F.count(F.when(F.col("blank"), 1)).alias("n"), line(F.col("blank")).alias("first"), F.max(F.when(~F.col("blank"), F.col("i"))).alias("last"),
        line(~F.col("blank") & F.col("odd")).alias("odd"), line(F.col("bad") > 0, "bad", "token").alias("bad"),
    )
    return seen.select(*by, "last", F.when((F.col("first") < F.col("last")) | (F.col("n") > MOST_BLANK), F.col("first")).alias("blank"), "odd", "bad")


def read_text(spark: SparkSession, path: str, numeric_headers: bool = False, numeric_labels: bool = False, check: bool = True, shape: tuple[int, int] | None = None, transpose: bool = False) -> Matrix:
    """A file or a folder of part files. An empty cell is 0 and an empty tag stays an empty one. Up to MOST_BLANK blank lines may end the file; a blank line before data is an error.

    shape: rows and columns that the file must have. check=False leaves out the rules of validate(). The lines are numbered and parsed
    once and written down; their faults are found in one pass over that.
    """
    head = first_lines(spark, path)
    if not head or not head[0]:
        raise MatrixError("the file is empty")
    form = infer(head[0], head[1] if len(head) > 1 else None, numeric_headers, numeric_labels)
    lines = numbered_lines(spark, path).where(F.col("line") >= form["first"]).select((F.col("line") - form["first"]).alias("i"), "value")
    rows = checkpointed(parsed(lines, form["sep"], form["labels"], form["n_cols"], check))
    seen = faults(rows).first()
    if seen["last"] is None:
        raise MatrixError("there is no line of data")
    if seen["blank"] is not None:
        raise MatrixError(f"row {seen['blank']} is blank")
    if seen["odd"] is not None:
        raise MatrixError(f"row {seen['odd']} does not have {form['n_cols'] + form['labels']} entries")
    if seen["bad"] is not None:
        raise MatrixError(f"row {seen['bad']['i']}, column {seen['bad']['bad'] - 1}: {seen['bad']['token']!r} is no number that a cell can hold")
    data = rows.where("not blank")
    cells = data.select("i", F.posexplode("v").alias("j", "v")).where("v <> 0").select("i", F.col("j").cast("int").alias("j"), "v")
    labels = data.select("i", "label") if form["labels"] else None
    headers = spark.createDataFrame(list(enumerate(form["headers"])), "j int, header string") if form["headers"] else None
    m = Matrix(cells, int(seen["last"]) + 1, form["n_cols"], form["name"], labels, headers)
    if shape and shape != (m.n_rows, m.n_cols):
        raise MatrixError(f"the matrix is {m.n_rows} x {m.n_cols}, not {shape[0]} x {shape[1]}")
    m = validate(m) if check else m
    return m.transpose() if transpose else m


def text_lines(m: Matrix) -> DataFrame:
    """(i, value): the lines of data."""
    rows = m.dense_rows().select("i", format_g("row").alias("value"))
    if m.row_tags is not None:
        rows = rows.join(m.row_tags, "i", "left").select("i", F.concat(F.coalesce("label", F.lit("")), F.lit("\t"), "value").alias("value"))
    return rows


def header_pieces(m: Matrix) -> Iterator[bytes]:
    """The line of name and headers without its end, streamed in order; nothing if there are neither."""
    if m.col_tags is None:
        if m.name is not None:
            yield m.name.encode()
        return
    yield (m.name or "").encode() + (b"\t" if m.name is not None or m.row_tags is not None else b"")
    yield from tag_line(m.col_tags, "j", "header", m.n_cols)


def write_text(m: Matrix, path: str, single: bool = True, append: bool = False, n: int | None = None) -> None:
    """The lines as one file, or, not single, as a folder of part files which are the lines in order of their names.

    Rows are sorted by range and written in parallel either way; one file is then put together from the parts. append adds them to the end of a file. n: how many parts, if Spark is not to choose.
    """
    spark, where, body = m.cells.sparkSession, plain(path), text_lines(m)
    headed = m.name is not None or m.col_tags is not None
    if headed and not single:
        body = body.unionByName(spark.createDataFrame([(-1, b"".join(header_pieces(m)).decode())], "i bigint, value string"))
    parts = scratch(spark, "text") if single else path
    (body.repartitionByRange(n, "i") if n else body.repartitionByRange("i")).sortWithinPartitions("i").select("value").write.mode("overwrite").text(parts)
    if not single:
        return
    pieces = sorted(spark.read.text(parts).inputFiles(), key=natural)
    head = (x for x in (*header_pieces(m), b"\n")) if headed else ()
    if where is None:
        compose(path, head, pieces, append=append)
    else:
        _place(spark, where, head, pieces, append)
    delete(spark, parts)


def _place(spark: SparkSession, where: str, head: Iterable[bytes], pieces: list[str], append: bool) -> None:
    """The pieces into one file, each by a task at its place; the driver writes the head alone. What an append adds is cut off again if it fails."""
    sizes = [store.get_file_info(at).size for store, at in map(file_system, pieces)]
    if append and os.path.exists(where):
        before, file = os.path.getsize(where), Placed(where)
        file.temporary = where
        try:
            file.append(head)
            join_files(spark, pieces, sizes, where, file.grow(sum(sizes)))
        except BaseException:
            os.truncate(where, before)
            raise
        return
    file = Placed(where)
    try:
        file.begin(b"", 0)
        file.append(head)
        join_files(spark, pieces, sizes, file.temporary, file.grow(sum(sizes)))
        file.finish()
    finally:
        file.give_up()
