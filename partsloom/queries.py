"""A query for each matrix operator and the SQL that checks it. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions.numeric import NUMBERS, R_MIN, ieee_divide
from .model import Matrix
from .operators import matrix as mx
from .operators.start import FACTOR, PRIME, start_h, start_w
from .plans.solver import Options, Result, factorize
from .plans.updates import iterate, update_h, update_w
from .session import checkpoint_dir
from .sources import files, matrix_source, tables, validate, wide
from .sources.binary import INTEGER
from .sources.compose import exists
from .sources.text import faults, numbered_lines, parsed

K, SEED = 2, 3


def _r(df: DataFrame) -> DataFrame:
    """Rounded, with the widths that the SQL has."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _start(m: Matrix) -> tuple[DataFrame, DataFrame]:
    return start_w(m.cells.sparkSession, m.n_rows, K, SEED), start_h(m.cells.sparkSession, m.n_cols, K, SEED)


def _v(spark: SparkSession, sf: str) -> tuple[Matrix, DataFrame, DataFrame]:
    m = tables.users_by_event(spark, sf)
    return m, *_start(m)


def _months(spark: SparkSession, sf: str) -> Matrix:
    return tables.suppliers_by_month(spark, sf)


def _scratch(spark: SparkSession) -> str:
    """A path that all executors share, without a scheme where it is a plain folder."""
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def matrix_scan_coo(spark, sf):
    return _v(spark, sf)[0].cells


def matrix_shape(spark, sf):
    m = _months(spark, sf)
    return m.cells.agg(F.lit(m.n_rows).cast("bigint").alias("n_rows"), F.lit(m.n_cols).cast("bigint").alias("n_cols"), F.count("*").alias("n_stored"))


def row_sums(spark, sf):
    return _r(_months(spark, sf).cells.groupBy("i").agg(F.sum("v").alias("s")))


def col_sums(spark, sf):
    return _r(_months(spark, sf).cells.groupBy("j").agg(F.sum("v").alias("s")))


def _signed(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x"))
    return e.select("i", "j", F.col("x").cast("double").alias("v"))


def validate_cells(spark, sf):
    return _r(validate.bad_cells(_signed(spark, sf)))


def empty_rows_cols(spark, sf):
    """Parts that were never returned, and months in which nothing was: rows and columns of all parts by all months without a cell."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    every = tables.pivot_sum(x, F.col("l_partkey"), F.date_format("l_shipdate", "yyyy-MM"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    some = every.cells.where("v <> 0")
    rows = validate.empty_lines(some, "i", every.n_rows).select(F.lit("row").alias("what"), F.col("i").alias("idx"))
    return rows.union(validate.empty_lines(some, "j", every.n_cols).select(F.lit("column"), F.col("j")))


def transpose(spark, sf):
    return _r(_v(spark, sf)[0].transpose().cells)


def combine_columns(spark, sf):
    m = _v(spark, sf)[0]
    return mx.combine_columns([m.cells, m.cells.withColumn("v", F.col("v") * 2)], m.n_cols)


def dense_rows(spark, sf):
    return _months(spark, sf).dense_rows().select("i", F.posexplode("row").alias("j", "v"))


def column_tags(spark, sf):
    return _months(spark, sf).col_tags


def row_tags(spark, sf):
    return _v(spark, sf)[0].row_tags


def factor_labels(spark, sf):
    """Names of as many factors as there are kinds of events."""
    return mx.factor_labels(spark, _v(spark, sf)[0].n_cols)


def init_w(spark, sf):
    return _r(_v(spark, sf)[1])


def init_h(spark, sf):
    return _r(_v(spark, sf)[2])


def matmul_wh(spark, sf):
    _, w, h = _v(spark, sf)
    return _r(mx.matmul(w, h))


def div_v_wh(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.divide(m.cells, mx.matmul(w, h)))


def sub_v_wh(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.subtract(m.cells, mx.matmul(w, h)))


def mul_div(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.multiply_divide(h, h.select("j", "k", (F.col("h") * 3).alias("num")), mx.reduce_to_row(w, "w"), "j", "h"))


def reduce_to_row(spark, sf):
    return _r(mx.reduce_to_row(_v(spark, sf)[1], "w"))


def adjust(spark, sf):
    """All cells of the vectors, of which every fourth is divided by zero (infinite, or no number where it is zero), and others are made zero by zero or too small to be normal."""
    x, j = F.col("v"), F.col("j") % 4
    odd = F.when(j == 1, ieee_divide(x, F.lit(0.0))).when(j == 2, ieee_divide(x * 0, F.lit(0.0))).when(j == 3, x * 1e-308 * 0.01).otherwise(x)
    w = mx.adjust(_signed(spark, sf).select("i", "j", odd.alias("w")), "w")
    return w.select("i", "j", (F.col("w") == R_MIN).alias("at_floor"), (F.col("w") == float("inf")).alias("infinite"), F.when(F.col("w").between(1e-6, 1e6), F.round("w", 6)).alias("w"))


def exact_sums(spark, sf):
    """Sums of each column of the vectors, signs and all, exact on any partitions."""
    return _r(mx.reduce_to_row(_signed(spark, sf).select("i", F.col("j").alias("k"), "v"), "v", exact=True))


def exact_distance(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.relative_distance(mx.dot_v_vwh(m.cells, w, h, exact=True)))


def update_h_once(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(update_h(m.cells, w, h))


def update_w_once(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(update_w(m.cells, w, h))


def _iters(n):
    def query(spark, sf):
        m, w, h = _v(spark, sf)
        return _r(iterate(m.cells, w, h, n)[1])

    return query


def _classes(spark, sf):
    m = _months(spark, sf)
    w, h = _start(m)
    w2, h2 = iterate(m.cells, w, h, 1)
    return mx.classify(h), mx.classify(h2)


def classification(spark, sf):
    return _classes(spark, sf)[1]


def connectivity_diff(spark, sf):
    return mx.connectivity_difference(*_classes(spark, sf))


def dot_v_vwh(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.dot_v_vwh(m.cells, w, h))


def relative_distance(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.relative_distance(mx.dot_v_vwh(m.cells, w, h)))


def distance_chosen(spark, sf):
    """By the stored cells, or by all of them where V is met too closely for that."""
    m, w, h = _v(spark, sf)
    return _r(mx.relative_distance(mx.dots(m.cells, w, h)))


def distance_gram(spark, sf):
    m, w, h = _v(spark, sf)
    return _r(mx.relative_distance(mx.dot_gram(m.cells, w, h)))


def nmf_converge_trace(spark, sf):
    r = factorize(_v(spark, sf)[0], Options(K, 2000, 10, 40, SEED))
    return spark.createDataFrame(r.trace, "test int, iter int, diff bigint, inc int")


def nmf_factorize(spark, sf):
    return _r(factorize(_months(spark, sf), Options(3, 200, 10, 40, SEED)).h)


def nmf_block(spark, sf):
    """Three iterations by blocks, whatever the size."""
    return _r(factorize(_v(spark, sf)[0], Options(K, 3, 10, 40, SEED), local_cells=0).h)


#: Bytes of a task that make several tiles both ways of the smallest matrix.
SMALL = 20_000


def _by_tiles(m: Matrix, *options, **more) -> Result:
    return factorize(m, Options(*options, local_cells=0, memory=SMALL), **more)


def nmf_tiles(spark, sf):
    """Three iterations on eight by two tiles or more."""
    r = _by_tiles(_v(spark, sf)[0], K, 3, 10, 40, SEED)
    return _r(r.h.select(F.lit("H").alias("factor"), F.col("j").cast("bigint").alias("at"), "k", F.col("h").alias("x")).union(r.w.select(F.lit("W"), "i", "k", "w")))


def nmf_sparse(spark, sf):
    """Three iterations of parts by status at their stored cells."""
    r = factorize(tables.parts_by_status(spark, sf), Options(K, 3, 10, 40, SEED, local_cells=0, memory=2_000_000))
    return _r(r.h)


def nmf_settled(spark, sf):
    """A whole run by tiles, of suppliers by month, until the clustering has settled."""
    r = factorize(_months(spark, sf), Options(K, 200, 1, 2, SEED, local_cells=0, memory=200_000))
    return spark.createDataFrame(r.trace, "test int, iter int, diff bigint, inc int")


def nmf_resumed(spark, sf):
    """A whole run, broken off after its third test, and taken up from what it had written down."""

    class Broken(Exception):
        pass

    def broken(test):
        if test[0] == 3:
            raise Broken

    m, folder = _v(spark, sf)[0], f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    try:
        _by_tiles(m, K, 200, 1, 4, SEED, folder=folder, on_test=broken)
    except Broken:
        pass
    return spark.createDataFrame(_by_tiles(m, K, 200, 1, 4, SEED, folder=folder).trace, "test int, iter int, diff bigint, inc int")


def nmf_steps(spark, sf):
    """What a run of three iterations with a test after the second does: calls, and stored cells that went through."""
    steps = _by_tiles(_v(spark, sf)[0], K, 3, 2, 40, SEED).steps
    return spark.createDataFrame([(name, calls, cells) for name, (calls, _, cells, _) in steps.items()], "step string, calls int, cells bigint")


def text_roundtrip(spark, sf):
    """One file, put together from four parts."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text", n=4)
    return files.read_matrix(spark, path, "text", numeric_labels=True).cells


def text_folder_roundtrip(spark, sf):
    """A folder of four part files, read as it was written."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text", single=False, n=4)
    return files.read_matrix(spark, path, "text", numeric_labels=True).cells


def text_append(spark, sf):
    """The same matrix without tags twice in one file."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    for append in (False, True):
        files.write_matrix(Matrix(m.cells, m.n_rows, m.n_cols), path, "text", append=append)
    return files.read_matrix(spark, path, "text").cells


def text_file_lines(spark, sf):
    """The file's lines as they stand: corner and headers, then label and cells."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text")
    return numbered_lines(spark, path)


def text_known_shape(spark, sf):
    """Without the rules of validation, of a known shape, transposed."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text")
    return files.read_matrix(spark, path, "text", numeric_labels=True, check=False, shape=(m.n_rows, m.n_cols), transpose=True).cells


def transpose_file(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "binary")
    files.transpose_file(spark, path, path + "-t", "binary")
    return files.read_matrix(spark, path + "-t", "binary").cells


def transposed_on_save(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text", transpose=True)
    return files.read_matrix(spark, path, "text", numeric_headers=True).cells


def binary_known_shape(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "binary")
    return files.read_matrix(spark, path, "binary", shape=(m.n_rows, m.n_cols), transpose=True).cells


def integer_roundtrip(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "binary", signature=INTEGER)
    return files.read_matrix(spark, path, "binary", signature=INTEGER).cells


def binary_tags(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(Matrix(m.cells, m.n_rows, m.n_cols, "counts", m.row_tags, m.col_tags), path, "binary")
    return _tags_of(files.read_matrix(spark, path, "binary"))


def _tags_of(m: Matrix) -> DataFrame:
    spark = m.cells.sparkSession
    name = spark.createDataFrame([("name", 0, m.name)], "what string, idx bigint, tag string")
    return name.union(m.row_tags.select(F.lit("row"), "i", "label")).union(m.col_tags.select(F.lit("column"), F.col("j").cast("bigint"), "header"))


def convert_text_binary_text(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text")
    there = files.convert(spark, path, "text", "binary", numeric_labels=True)
    back = files.convert(spark, there, "binary", "text")
    return files.read_matrix(spark, back, "text", numeric_labels=True).cells


def preview(spark, sf):
    return _months(spark, sf).preview().select("i", F.posexplode("row").alias("j", "v"))


def factor_files(spark, sf):
    """What the command line writes beside its input after three iterations: W and H by their names."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text")
    cli.main(["factorize", path, "-R", "-k", str(K), "-i", "3", "-e", "0", "--seed", str(SEED)], spark)
    w, h = (files.read_matrix(spark, f"{path}_{x}.dat", "binary") for x in "WH")
    return _r(w.cells.select(F.lit("W").alias("factor"), "i", "j", "v").union(h.cells.select(F.lit("H"), "i", "j", "v")))


def factor_file_tags(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "text")
    cli.main(["factorize", path, "-r", "-K", str(K), "-I", "1", "--seed", str(SEED)], spark)
    w = files.read_matrix(spark, f"{path}_W.txt", "text", numeric_labels=True)
    h = files.read_matrix(spark, f"{path}_H.txt", "text")
    return _tags_of(w).where("what <> 'name'").withColumn("factor", F.lit("W")).union(_tags_of(h).where("what <> 'name'").withColumn("factor", F.lit("H")))


def block_distance(spark, sf):
    """The relative distance after three iterations, found block by block."""
    r = factorize(_v(spark, sf)[0], Options(K, 3, 10, 40, SEED), local_cells=0)
    return _r(spark.createDataFrame([(r.distance,)], "distance double"))


def text_forms(spark, sf):
    """The matrix written and read with all tags, with a name, headers or labels alone, and with none: the tags that are read."""
    m, out = _v(spark, sf)[0], None
    forms = {"all": ("counts", m.row_tags, m.col_tags), "name": ("counts", None, None), "headers": (None, None, m.col_tags), "labels": (None, m.row_tags, None), "none": (None, None, None)}
    for form, tags in forms.items():
        path = _scratch(spark)
        files.write_matrix(Matrix(m.cells, m.n_rows, m.n_cols, *tags), path, "text")
        got = files.read_matrix(spark, path, "text", numeric_labels=tags[1] is not None)
        what = spark.createDataFrame([("name", 0, got.name)], "what string, idx bigint, tag string").where("tag is not null")
        if got.row_tags is not None:
            what = what.union(got.row_tags.select(F.lit("row"), "i", "label"))
        if got.col_tags is not None:
            what = what.union(got.col_tags.select(F.lit("column"), F.col("j").cast("bigint"), "header"))
        sums = got.cells.agg(F.sum(F.col("v") * (F.col("i") + 1) * (F.col("j") + 1)).cast("bigint").cast("string").alias("tag"))
        what = what.union(sums.select(F.lit("cells"), F.lit(0).cast("bigint"), "tag")).select(F.lit(form).alias("form"), "what", "idx", "tag")
        out = what if out is None else out.union(what)
    return out


def row_parser(spark, sf):
    """A line of a label and three cells of each row of lineitem; many have an entry too few, or one that no cell can hold: what is found wrong, and where."""
    text = lambda c: F.col(c).cast("string")
    third = F.when(F.col("l_returnflag") == "N", text("l_discount")).when(F.col("l_returnflag") == "A", F.concat(text("l_tax"), F.col("l_linestatus")))
    last = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "1e999").when(F.col("l_linenumber") == 3, "nan").otherwise(F.concat(F.lit(" -.5e"), text("l_linenumber")))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("\t", text("l_partkey"), text("l_quantity"), third, last).alias("value"))
    rows = parsed(lines, "\t", True, 3)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "label", F.when(F.col("odd"), "odd").when(F.col("bad") > 0, "bad").otherwise("good").alias("outcome"), "bad", F.when(~F.col("odd") & (F.col("bad") == 0), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6)).alias("total"))


def blank_lines(spark, sf):
    """Every order as a file: a line for each row of lineitem, blank for some, and further blank lines behind large ones: which files may stand so."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    more = F.greatest(F.lit(0), F.col("l_quantity").cast("int") - 30)
    lines = x.select("l_orderkey", (F.col("l_linenumber") * 100).cast("bigint").alias("i"), F.when(F.col("l_discount") < 0.02, "  ").otherwise("1\t2").alias("first"), F.explode(F.sequence(F.lit(0), more)).alias("n"))
    lines = lines.select("l_orderkey", (F.col("i") + F.col("n")).alias("i"), F.when(F.col("n") == 0, F.col("first")).otherwise("").alias("value"))
    return faults(parsed(lines, "\t", False, 2), "l_orderkey").select("l_orderkey", (F.col("last").isNotNull() & F.col("blank").isNull()).alias("good"), F.col("blank").alias("first_blank"))


def numeric_tokens(spark, sf):
    """Words of all documents, and times as they were noted: which of them are numbers, or several."""
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", "[\\n ]")).alias("token"))
    raw = spark.read.parquet(f"{sf}/stamps.parquet").select("raw")
    pieces = raw.select(F.explode(F.split("raw", "[-/:T+.]")).alias("token"))
    spaced = raw.select(F.regexp_replace("raw", "[-/:T]", " "))
    tokens = words.union(raw).union(pieces).union(spaced).where("token is not null").distinct()
    return tokens.select("token", F.col("token").rlike(NUMBERS).alias("number"))


def dimension_check(spark, sf):
    """Users by kinds of events of each day: which days give a matrix."""
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.countDistinct("user_id").alias("n_rows"), F.countDistinct("event_type").alias("n_cols"))
    return e.select(F.col("day").cast("string").alias("day"), "hour", "n_rows", "n_cols", validate.fits(F.col("n_rows"), F.col("n_cols")).alias("fits"))


def command_line(spark, sf):
    """H as the command line leaves it: portable input, a test every second iteration and few to settle; native input by capital letters and an option that there is not; no file at all when help is asked for first."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path + "-p", "binary")
    files.write_matrix(m, path + "-n", "native")
    common = ["-K", str(K), "--seed", str(SEED), "-e", "0"]
    cli.main(["factorize", path + "-p", "-b", "0", "-i", "60", "-j", "2", "-t", "3", "-z", "1", *common], spark)
    cli.main(["factorize", path + "-n", "-B", "2", "-I", "3", "-J", "10", "-T", "40", "-Z", "0", "-q", "--local-cells", "0", *common], spark)
    out = [(x, files.read_matrix(spark, f"{path}-{x}_H.dat", "binary").cells) for x in "pn"]
    files.write_matrix(m, path + "-h", "binary")
    try:
        cli.main(["factorize", "-h", path + "-h", "-i", "0"], spark)
    except SystemExit as e:  # the parser ends the process, with 0 for help
        seen = [("h", e.code or 0, exists(spark, f"{path}-h_H.dat"))]
    rows = out[0][1].select(F.lit("p").alias("run"), "i", "j", "v").union(out[1][1].select(F.lit("n"), "i", "j", "v"))
    return _r(rows.union(spark.createDataFrame(seen, "run string, code int, file boolean").select("run", F.col("code").cast("bigint"), F.col("file").cast("int"), F.lit(0.0))))


def binary_roundtrip(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "binary")
    return files.read_matrix(spark, path, "binary").cells


def native_roundtrip(spark, sf):
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "native")
    return files.read_matrix(spark, path, "native").cells


def source_read(spark, sf):
    """The second half of the rows, through the data source."""
    m, path = _v(spark, sf)[0], _scratch(spark)
    files.write_matrix(m, path, "binary")
    matrix_source.register(spark)
    return spark.read.format(matrix_source.NAME).option("path", path).load().where(F.col("i") >= m.n_rows // 2)


def source_write(spark, sf):
    """Written by the data source and read by the reader."""
    m, path = _months(spark, sf), _scratch(spark)
    matrix_source.register(spark)
    m.cells.write.format(matrix_source.NAME).option("path", path).option("rows", m.n_rows).option("cols", m.n_cols).mode("append").save()
    return files.read_matrix(spark, path, "binary").cells


def text_wide(spark, sf):
    """Suppliers by month turned on its side, read in ranges of 200 bytes, of which a row takes several, or many."""
    m, path = _months(spark, sf).transpose(), _scratch(spark)
    files.write_matrix(m, path, "text")
    return files.read_matrix(spark, path, "text", wide=True, piece=200, numeric_headers=True).cells


def text_wide_entries(spark, sf):
    """Every entry of that file as it stands, tags and all, in ranges of 64 bytes."""
    m, path = _v(spark, sf)[0].transpose(), _scratch(spark)
    files.write_matrix(m, path, "text")
    return wide.entries(spark, path, piece=64)


def generate_matrix(spark, sf):
    """As many rows and columns as there are suppliers and nations."""
    n, m = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("supplier", "nation"))
    return _r(files.generate(spark, n, m, 2.5, SEED).cells)


ALL = [
    matrix_scan_coo, matrix_shape, row_sums, col_sums, validate_cells, empty_rows_cols, transpose, combine_columns, dense_rows, column_tags, row_tags, factor_labels, init_w, init_h, matmul_wh,
    div_v_wh, sub_v_wh, mul_div, reduce_to_row, adjust, update_h_once, update_w_once, classification, connectivity_diff, dot_v_vwh, relative_distance, distance_gram, nmf_converge_trace,
    nmf_factorize, nmf_block, text_roundtrip, binary_roundtrip, native_roundtrip, generate_matrix, text_folder_roundtrip, text_append, text_file_lines, text_known_shape, transpose_file, transposed_on_save,
    binary_known_shape, integer_roundtrip, binary_tags, convert_text_binary_text, preview, factor_files, factor_file_tags, block_distance, text_forms, row_parser, blank_lines, numeric_tokens, dimension_check, command_line,
    nmf_tiles, nmf_sparse, nmf_settled, nmf_resumed, nmf_steps, exact_sums, exact_distance, distance_chosen,
    source_read, source_write, text_wide, text_wide_entries,
]
QUERIES = {f.__name__: f for f in ALL} | {"nmf_1_iter": _iters(1), "nmf_3_iters": _iters(3)}

_EVENTS = "SELECT user_id AS r, event_type AS c, count(*)::DOUBLE AS v FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2"
_MONTHS = "SELECT l_suppkey AS r, strftime(l_shipdate, '%Y-%m') AS c, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2"
_RETURNS = "SELECT l_partkey AS r, strftime(l_shipdate, '%Y-%m') AS c, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS v FROM lineitem WHERE l_partkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2"
_INDEX = """s AS ({}), ri AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i FROM (SELECT DISTINCT r FROM s)),
ci AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS j FROM (SELECT DISTINCT c FROM s)),
V AS (SELECT i, j::INT AS j, v FROM s JOIN ri USING (r) JOIN ci USING (c))"""


def _uniform(index: str, k: str, matrix: int) -> str:
    x = f"((({index} % {PRIME} + ({k} + 1) * 7919 + {matrix} * 104729 + {SEED}) % {PRIME}) * {FACTOR} % {PRIME})"
    return f"((({x} + ({k} + 1) * 15485863) % {PRIME}) * {FACTOR} % {PRIME} * {FACTOR} % {PRIME})::DOUBLE / {float(PRIME)!r}::DOUBLE + 2.2250738585072014e-308::DOUBLE"


_STARTS = f"""W0 AS (SELECT i, k::INT AS k, {_uniform("i", "k", 0)} AS w FROM ri, (SELECT unnest(range({K})) AS k)),
H0 AS (SELECT j::INT AS j, k::INT AS k, {_uniform("j", "k", 1)} AS h FROM ci, (SELECT unnest(range({K})) AS k)),
WH AS (SELECT i, j, sum(w * h) AS wh FROM W0 JOIN H0 USING (k) GROUP BY i, j)"""


def _h_step(t: int, w: str, h: str) -> str:
    return f"""R{t} AS (SELECT V.i, V.j, V.v / sum(w * h) AS r FROM V JOIN {w} x ON x.i = V.i JOIN {h} y ON y.j = V.j AND y.k = x.k GROUP BY V.i, V.j, V.v),
A{t} AS (SELECT k, sum(w) AS acc FROM {w} GROUP BY k), N{t} AS (SELECT j, k, sum(r * w) AS num FROM R{t} JOIN {w} USING (i) GROUP BY j, k),
H{t} AS MATERIALIZED (SELECT y.j, y.k, y.h * coalesce(num, 0) / acc AS h FROM {h} y LEFT JOIN N{t} n ON n.j = y.j AND n.k = y.k JOIN A{t} a ON a.k = y.k)"""


def _w_step(t: int, w: str, h: str) -> str:
    return f"""S{t} AS (SELECT V.i, V.j, V.v / sum(w * h) AS r FROM V JOIN {w} x ON x.i = V.i JOIN {h} y ON y.j = V.j AND y.k = x.k GROUP BY V.i, V.j, V.v),
B{t} AS (SELECT k, sum(h) AS acc FROM {h} GROUP BY k), M{t} AS (SELECT i, k, sum(r * h) AS num FROM S{t} JOIN {h} USING (j) GROUP BY i, k),
W{t} AS MATERIALIZED (SELECT x.i, x.k, x.w * coalesce(num, 0) / acc AS w FROM {w} x LEFT JOIN M{t} m ON m.i = x.i AND m.k = x.k JOIN B{t} b ON b.k = x.k)"""


def _sql(select: str, source: str = _EVENTS, *ctes: str) -> str:
    return "WITH " + ",\n".join([_INDEX.format(source), *ctes]) + "\n" + select


def _chain(n: int, source: str = _EVENTS) -> list[str]:
    out = [_STARTS]
    for t in range(1, n + 1):
        out += [_h_step(t, f"W{t - 1}", f"H{t - 1}"), _w_step(t, f"W{t - 1}", f"H{t}")]
    return out


def _solver(source: str, k: int, most: int, period: int, threshold: int) -> str:
    """A whole run as a recursion over one row that holds W and H as lists: z (iter, w, h, cls, inc, diff, done), one row an iteration."""
    start = lambda index, matrix: f"list({_uniform(index, 'k', matrix)} ORDER BY k)"
    floor = lambda f: f"list_transform({f}, lambda x: list_transform(x, lambda y: CASE WHEN test AND y < 2.2250738585072014e-308::DOUBLE THEN 2.2250738585072014e-308::DOUBLE ELSE y END)) AS {f}"
    return f"""WITH RECURSIVE {_INDEX.format(source)},
b AS (SELECT (SELECT list(r ORDER BY i) FROM (SELECT ri.i, list(coalesce(v, 0) ORDER BY ci.j) AS r FROM ri CROSS JOIN ci LEFT JOIN V ON V.i = ri.i AND V.j = ci.j GROUP BY ri.i)) AS v,
  (SELECT list(w ORDER BY i) FROM (SELECT i, {start("i", 0)} AS w FROM ri, (SELECT unnest(range({k})) AS k) GROUP BY i)) AS w,
  (SELECT list(h ORDER BY j) FROM (SELECT j, {start("j", 1)} AS h FROM ci, (SELECT unnest(range({k})) AS k) GROUP BY j)) AS h),
z AS (
  SELECT 0 AS iter, w, h, list_transform(h, lambda x: 1) AS cls, 0 AS inc, 0::BIGINT AS diff, false AS done FROM b
  UNION ALL
  SELECT iter + 1, w, h, CASE WHEN test THEN now ELSE cls END, CASE WHEN NOT test THEN inc WHEN d > 0 THEN 0 WHEN inc < {threshold} THEN inc + 1 ELSE inc END, d, test AND d = 0 AND inc >= {threshold}
  FROM (
    SELECT *, CASE WHEN test THEN (SELECT count(*) FROM range(1, len(now) + 1) p(x), range(1, len(now) + 1) q(y) WHERE x < y AND (now[x] = now[y]) <> (cls[x] = cls[y])) ELSE 0 END AS d
    FROM (
      SELECT iter, test, cls, inc, w, h, list_transform(h, lambda x: list_position(x, list_max(x))) AS now
      FROM (
        SELECT iter, cls, inc, test, {floor("w")}, {floor("h")}
        FROM (
          SELECT iter, cls, inc, (iter + 1) % {period} = 0 AS test, h,
            list_transform(w, lambda x, i: list_transform(x, lambda y, k: y * list_sum(list_transform(h, lambda g, j: v[i][j] / list_inner_product(x, g) * g[k])) / list_sum(list_transform(h, lambda g: g[k])))) AS w
          FROM (
            SELECT z.iter, z.cls, z.inc, b.v, z.w,
              list_transform(z.h, lambda g, j: list_transform(g, lambda y, k: y * list_sum(list_transform(z.w, lambda x, i: b.v[i][j] / list_inner_product(x, g) * x[k])) / list_sum(list_transform(z.w, lambda x: x[k])))) AS h
            FROM z, b WHERE NOT z.done AND z.iter < {most}
          )
        )
      )
    )
  )
)
"""


_CLS = "SELECT j, arg_max(k, h)::INT AS cls FROM {} GROUP BY j"
SQL = {
    "matrix_scan_coo": _sql("SELECT i, j, v FROM V"),
    "matrix_shape": _sql("SELECT max(i) + 1 AS n_rows, (max(j) + 1)::BIGINT AS n_cols, count(*) AS n_stored FROM V", _MONTHS),
    "row_sums": _sql("SELECT i, round(sum(v), 6) AS s FROM V GROUP BY i", _MONTHS),
    "col_sums": _sql("SELECT j, round(sum(v), 6) AS s FROM V GROUP BY j", _MONTHS),
    "validate_cells": "SELECT i, j, round(v, 6) AS v FROM (SELECT vec_id AS i, (generate_subscripts(embedding, 1) - 1)::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE v < 0 OR (v > 0 AND v < 2.2250738585072014e-308::DOUBLE) OR NOT isfinite(v)",
    "empty_rows_cols": _sql("SELECT 'row' AS what, i AS idx FROM ri WHERE i NOT IN (SELECT i FROM V WHERE v <> 0) UNION ALL SELECT 'column', j FROM ci WHERE j NOT IN (SELECT j FROM V WHERE v <> 0)", _RETURNS),
    "transpose": _sql("SELECT j::BIGINT AS i, i::INT AS j, round(v, 6) AS v FROM V"),
    "combine_columns": _sql("SELECT i, j, v FROM V UNION ALL SELECT i, (j + (SELECT count(*) FROM ci))::INT, v * 2 FROM V"),
    "dense_rows": _sql("SELECT ri.i, ci.j::INT AS j, coalesce(v, 0) AS v FROM ri CROSS JOIN ci LEFT JOIN V ON V.i = ri.i AND V.j = ci.j", _MONTHS),
    "column_tags": _sql("SELECT j::INT AS j, c AS header FROM ci", _MONTHS),
    "row_tags": _sql("SELECT i, r::VARCHAR AS label FROM ri"),
    "factor_labels": "SELECT k::INT AS k, 'Factor_' || k AS label FROM (SELECT unnest(range((SELECT count(DISTINCT event_type) FROM events))) AS k)",
    "init_w": _sql("SELECT i, k, round(w, 6) AS w FROM W0", _EVENTS, _STARTS),
    "init_h": _sql("SELECT j, k, round(h, 6) AS h FROM H0", _EVENTS, _STARTS),
    "matmul_wh": _sql("SELECT i, j, round(wh, 6) AS wh FROM WH", _EVENTS, _STARTS),
    "div_v_wh": _sql("SELECT i, j, round(coalesce(v, 0) / wh, 6) AS r FROM WH LEFT JOIN V USING (i, j)", _EVENTS, _STARTS),
    "sub_v_wh": _sql("SELECT i, j, round(coalesce(v, 0) - wh, 6) AS d FROM WH LEFT JOIN V USING (i, j)", _EVENTS, _STARTS),
    "mul_div": _sql("SELECT j, k, round(h * (h * 3) / acc, 6) AS h FROM H0 JOIN (SELECT k, sum(w) AS acc FROM W0 GROUP BY k) USING (k)", _EVENTS, _STARTS),
    "reduce_to_row": _sql("SELECT k, round(sum(w), 6) AS acc FROM W0 GROUP BY k", _EVENTS, _STARTS),
    "update_h_once": _sql("SELECT j, k, round(h, 6) AS h FROM H1", _EVENTS, _STARTS, _h_step(1, "W0", "H0")),
    "update_w_once": _sql("SELECT i, k, round(w, 6) AS w FROM W1", _EVENTS, _STARTS, _w_step(1, "W0", "H0")),
    "nmf_1_iter": _sql("SELECT j, k, round(h, 6) AS h FROM H1", _EVENTS, *_chain(1)),
    "nmf_3_iters": _sql("SELECT j, k, round(h, 6) AS h FROM H3", _EVENTS, *_chain(3)),
    "nmf_block": _sql("SELECT j, k, round(h, 6) AS h FROM H3", _EVENTS, *_chain(3)),
    "classification": _sql("SELECT j, cls FROM (" + _CLS.format("H1") + ")", _MONTHS, *_chain(1)),
    "connectivity_diff": _sql("SELECT count(*) AS diff FROM p a JOIN p b ON a.j < b.j WHERE (a.x = b.x) <> (a.y = b.y)", _MONTHS, *_chain(1), "p AS (SELECT a.j, a.cls AS x, b.cls AS y FROM (" + _CLS.format("H0") + ") a JOIN (" + _CLS.format("H1") + ") b USING (j))"),
    "dot_v_vwh": _sql("SELECT round(sum(coalesce(v, 0) * coalesce(v, 0)), 6) AS dot_v, round(sum((coalesce(v, 0) - wh) * (coalesce(v, 0) - wh)), 6) AS dot_vwh FROM WH LEFT JOIN V USING (i, j)", _EVENTS, _STARTS),
    "relative_distance": _sql("SELECT round(sqrt(sum((coalesce(v, 0) - wh) * (coalesce(v, 0) - wh))) / sqrt(sum(coalesce(v, 0) * coalesce(v, 0))), 6) AS distance FROM WH LEFT JOIN V USING (i, j)", _EVENTS, _STARTS),
    "text_roundtrip": _sql("SELECT i, j, v FROM V"),
    "binary_roundtrip": _sql("SELECT i, j, v FROM V"),
    "native_roundtrip": _sql("SELECT i, j, v FROM V"),
}
_V = _sql("SELECT i, j, v FROM V")
_TURNED = _sql("SELECT j::BIGINT AS i, i::INT AS j, v FROM V")
SQL |= dict.fromkeys(["text_folder_roundtrip", "integer_roundtrip", "convert_text_binary_text"], _V) | dict.fromkeys(["text_known_shape", "transpose_file", "transposed_on_save", "binary_known_shape"], _TURNED)
_TAGS = "SELECT 'row' AS what, i AS idx, r::VARCHAR AS tag FROM ri UNION ALL SELECT 'column', j::BIGINT, c FROM ci"
SQL |= {
    "text_append": _sql("SELECT i + n * (SELECT count(*) FROM ri) AS i, j, v FROM V, (SELECT unnest(range(2)) AS n)"),
    "text_file_lines": _sql("SELECT 0::BIGINT AS line, chr(9) || (SELECT string_agg(c, chr(9) ORDER BY j) FROM ci) AS value UNION ALL SELECT i + 1, r || chr(9) || cells FROM (SELECT ri.i, r::VARCHAR AS r, string_agg(coalesce(v, 0)::BIGINT::VARCHAR, chr(9) ORDER BY ci.j) AS cells FROM ri CROSS JOIN ci LEFT JOIN V ON V.i = ri.i AND V.j = ci.j GROUP BY ri.i, r)"),
    "binary_tags": _sql(f"SELECT 'name' AS what, 0::BIGINT AS idx, 'counts' AS tag UNION ALL {_TAGS}"),
    "preview": _sql("SELECT ri.i, ci.j::INT AS j, coalesce(v, 0) AS v FROM ri CROSS JOIN ci LEFT JOIN V ON V.i = ri.i AND V.j = ci.j WHERE ri.i::DOUBLE < 9 AND ci.j::DOUBLE < 15", _MONTHS),
    "factor_files": _sql("SELECT 'W' AS factor, i, k::INT AS j, round(w, 6) AS v FROM W3 UNION ALL SELECT 'H', k::BIGINT, j, round(h, 6) FROM H3", _EVENTS, *_chain(3)),
    "factor_file_tags": _sql(f"SELECT 'W' AS factor, 'row' AS what, i AS idx, r::VARCHAR AS tag FROM ri UNION ALL SELECT 'W', 'column', k, 'Factor_' || k FROM (SELECT unnest(range({K})) AS k) UNION ALL SELECT 'H', 'row', k, 'Factor_' || k FROM (SELECT unnest(range({K})) AS k) UNION ALL SELECT 'H', 'column', j, c FROM ci"),
    "block_distance": _sql("SELECT round(sqrt(sum((coalesce(v, 0) - x) * (coalesce(v, 0) - x))) / sqrt(sum(coalesce(v, 0) * coalesce(v, 0))), 6) AS distance FROM (SELECT i, j, sum(w * h) AS x FROM W3 JOIN H3 USING (k) GROUP BY i, j) LEFT JOIN V USING (i, j)", _EVENTS, *_chain(3)),
    "nmf_converge_trace": _solver(_EVENTS, K, 2000, 10, 40) + "SELECT (iter // 10)::INT AS test, iter::INT AS iter, diff, inc::INT AS inc FROM z WHERE iter > 0 AND iter % 10 = 0",
    "nmf_factorize": _solver(_MONTHS, 3, 200, 10, 40) + "SELECT (j - 1)::INT AS j, (k - 1)::INT AS k, round(h[j][k], 6) AS h FROM (SELECT h, unnest(range(1, len(h) + 1)) AS j FROM (SELECT * FROM z ORDER BY iter DESC LIMIT 1)), (SELECT unnest(range(1, 4)) AS k)",
}
SQL["distance_gram"] = SQL["relative_distance"]
_TINY = "2.2250738585072014e-308::DOUBLE"
_CELLS = "SELECT vec_id AS i, (generate_subscripts(embedding, 1) - 1)::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"
_NUMBER = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_ALONE = "SELECT '{0}' AS form, {1}"
_TAG_ROWS = {"name": "'name' AS what, 0::BIGINT AS idx, 'counts' AS tag", "row": "'row' AS what, i AS idx, r::VARCHAR AS tag FROM ri", "column": "'column' AS what, j::BIGINT AS idx, c AS tag FROM ci", "cells": "'cells' AS what, 0::BIGINT AS idx, sum(v * (i + 1) * (j + 1))::BIGINT::VARCHAR AS tag FROM V"}
_FORMS = {"all": ("name", "row", "column"), "name": ("name",), "headers": ("column",), "labels": ("row",), "none": ()}
_ORDERS = """WITH x AS (SELECT l_orderkey, l_linenumber * 100 AS i, l_discount < 0.02 AS blank, unnest(range(0, greatest(0, trunc(l_quantity)::INT - 30) + 1)) AS n FROM lineitem),
y AS (SELECT l_orderkey, count(*) FILTER (WHERE blank OR n > 0) AS n, min(i + n) FILTER (WHERE blank OR n > 0) AS first, max(i) FILTER (WHERE NOT blank AND n = 0) AS last FROM x GROUP BY l_orderkey)
SELECT l_orderkey, last IS NOT NULL AND NOT (coalesce(first < last, false) OR n > 15) AS good, CASE WHEN first < last OR n > 15 THEN first END::BIGINT AS first_blank FROM y"""
_LINES = """WITH x AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'N' THEN l_discount::VARCHAR WHEN 'A' THEN l_tax::VARCHAR || l_linestatus END AS third, l_quantity AS q,
         CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '1e999' WHEN 3 THEN 'nan' ELSE ' -.5e' || l_linenumber END AS last, l_returnflag AS f, l_discount AS d
  FROM lineitem
), y AS (SELECT *, CASE WHEN third IS NULL THEN 'odd' WHEN f = 'A' OR l_linenumber IN (2, 3) THEN 'bad' ELSE 'good' END AS outcome FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey::VARCHAR AS label, outcome, CASE WHEN outcome <> 'bad' THEN 0 WHEN f = 'A' THEN 2 ELSE 3 END::INT AS bad,
       CASE WHEN outcome = 'good' THEN round(q + d + CASE WHEN l_linenumber = 1 THEN 0 ELSE -0.5::DOUBLE * power(10, l_linenumber) END, 6) END AS total
FROM y"""
_TOKENS = f"""WITH w AS (SELECT unnest(string_split_regex(text, '[\n ]')) AS token FROM documents), r AS (SELECT raw AS token FROM stamps),
t AS (SELECT token FROM w UNION SELECT token FROM r UNION SELECT unnest(string_split_regex(token, '[-/:T+.]')) FROM r UNION SELECT regexp_replace(token, '[-/:T]', ' ', 'g') FROM r)
SELECT token, list_bool_and(list_append(list_transform(list_filter(string_split_regex(token, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: regexp_full_match(x, '{_NUMBER}')), true)) AS number FROM t WHERE token IS NOT NULL"""
_RUNS = f"""SELECT 'p' AS run, k::BIGINT AS i, j, h AS v FROM ({{settled}}) UNION ALL SELECT 'n', k, j, h FROM ({{three}}) UNION ALL SELECT 'h', 0, 0, 0"""
_FINAL = "SELECT (j - 1)::INT AS j, (k - 1)::INT AS k, round(h[j][k], 6) AS h FROM (SELECT h, unnest(range(1, len(h) + 1)) AS j FROM (SELECT * FROM z ORDER BY iter DESC LIMIT 1)), (SELECT unnest(range(1, {0})) AS k)"
_TRACE = "SELECT (iter // {0})::INT AS test, iter::INT AS iter, diff, inc::INT AS inc FROM z WHERE iter > 0 AND iter % {0} = 0"
_PARTS = "SELECT l_partkey AS r, l_returnflag || l_linestatus AS c, sum(l_quantity) AS v FROM lineitem WHERE l_partkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2"
SQL |= {
    "adjust": f"SELECT i, j, w = {_TINY} AS at_floor, w = 'inf'::DOUBLE AS infinite, CASE WHEN w BETWEEN 1e-6 AND 1e6 THEN round(w, 6) END AS w FROM (SELECT i, j, CASE WHEN isnan(w) OR w < {_TINY} THEN {_TINY} ELSE w END AS w FROM (SELECT i, j, CASE WHEN j % 4 = 1 THEN CASE WHEN v > 0 THEN 'inf' WHEN v < 0 THEN '-inf' ELSE 'nan' END::DOUBLE WHEN j % 4 = 2 THEN 'nan'::DOUBLE WHEN j % 4 = 3 THEN 0 ELSE v END AS w FROM ({_CELLS})))",
    "exact_sums": f"SELECT j AS k, round(fsum(v), 6) AS acc FROM ({_CELLS}) GROUP BY j",
    "generate_matrix": f"SELECT i, j::INT AS j, round({_uniform('i', 'j', 2).replace(' + 2.2250738585072014e-308::DOUBLE', '')} * 2.5::DOUBLE, 6) AS v FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i), (SELECT unnest(range((SELECT count(*) FROM nation))) AS j)",
    "text_forms": _sql(" UNION ALL ".join(_ALONE.format(form, _TAG_ROWS[x]) for form, tags in _FORMS.items() for x in (*tags, "cells"))),
    "row_parser": _LINES, "blank_lines": _ORDERS, "numeric_tokens": _TOKENS,
    "dimension_check": "SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, count(DISTINCT user_id) AS n_rows, count(DISTINCT event_type) AS n_cols, count(DISTINCT user_id) >= 2 AND count(DISTINCT event_type) >= 2 AS fits FROM events GROUP BY 1, 2",
    "command_line": _RUNS.format(settled=_solver(_EVENTS, K, 60, 2, 3) + _FINAL.format(K + 1), three=_solver(_EVENTS, K, 3, 10, 40) + _FINAL.format(K + 1)),
    "nmf_tiles": _sql("SELECT 'H' AS factor, j::BIGINT AS at, k, round(h, 6) AS x FROM H3 UNION ALL SELECT 'W', i, k, round(w, 6) FROM W3", _EVENTS, *_chain(3)),
    "nmf_sparse": _sql("SELECT j, k, round(h, 6) AS h FROM H3", _PARTS, *_chain(3)),
    "nmf_settled": _solver(_MONTHS, K, 200, 1, 2) + _TRACE.format(1),
    "nmf_resumed": _solver(_EVENTS, K, 200, 1, 4) + _TRACE.format(1),
    "nmf_steps": _sql("SELECT * FROM (VALUES ('spread', 1, 0), ('start', 1, 0), ('H', 3, 3), ('W', 3, 3), ('test', 1, 0), ('distance', 1, 1)) t(step, calls, c)").replace("SELECT * FROM (VALUES", "SELECT step, calls::INT AS calls, c * (SELECT count(*) FROM V) AS cells FROM (VALUES"),
}
SQL |= {
    "source_read": _sql("SELECT i, j, v FROM V WHERE i >= (SELECT count(*) // 2 FROM ri)"),
    "source_write": _sql("SELECT i, j, v FROM V", _MONTHS),
    "text_wide": _sql("SELECT j::BIGINT AS i, i::INT AS j, v FROM V", _MONTHS),
    "text_wide_entries": _sql("SELECT 0::BIGINT AS line, 0::BIGINT AS at, '' AS token UNION ALL SELECT 0, i + 1, r::VARCHAR FROM ri UNION ALL SELECT j + 1, 0, c FROM ci UNION ALL SELECT ci.j + 1, ri.i + 1, coalesce(v, 0)::BIGINT::VARCHAR FROM ri CROSS JOIN ci LEFT JOIN V ON V.i = ri.i AND V.j = ci.j"),
}
SQL |= {"exact_distance": SQL["relative_distance"], "distance_chosen": SQL["relative_distance"]}
