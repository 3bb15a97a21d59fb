"""Matrix operators on long tables: V is (i, j, v), W is (i, k, w), H is (j, k, h)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_sums
from ..functions.numeric import floored, ieee_divide


def packed(factor: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out array<double>): a factor's K values of each row in order of k. K is small by nature."""
    pairs = F.array_sort(F.collect_list(F.struct("k", value)))
    return factor.groupBy(key).agg(F.transform(pairs, lambda s: s[value]).alias(out))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def at_cells(v: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """(i, j, v, wh, w array, h array) at V's stored cells only: the product is never formed where V is zero."""
    return v.join(packed(w, "i", "w", "w"), "i").join(packed(h, "j", "h", "h"), "j").select("i", "j", "v", dot("w", "h").alias("wh"), "w", "h")


#: Columns of H that meet a row of W at a time, and copies of such a block.
COLUMNS, SALTS = 4096, 64


def matmul(w: DataFrame, h: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """W * H at all cells: (i, j, wh).

    A row of W, as an array, meets blocks of H's columns, as arrays too, and gives a dot product a column; nothing is exchanged by k or by cell, and no
    block is larger than columns * K numbers. Blocks that Spark finds small are sent to all tasks; else each is copied SALTS times, and rows are dealt
    out by block and salt, so one block of columns takes many tasks.
    """
    last = h.agg(F.max("j")).first()[0]
    if last is None:
        return w.limit(0).select("i", F.lit(0).alias("j"), F.col("w").alias("wh"))
    blocks = packed(h, "j", "h", "h").withColumn("block", F.expr(f"j div {columns}")).groupBy("block").agg(F.collect_list(F.struct("j", "h")).alias("c"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = packed(w, "i", "w", "w").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last // columns).cast("bigint"))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
    products = F.transform("c", lambda c: F.struct(c["j"].alias("j"), dot(F.col("w"), c["h"]).alias("wh")))
    return rows.join(blocks, ["block", "salt"]).select("i", F.explode(products).alias("x")).select("i", "x.j", "x.wh")


def divide(v: DataFrame, wh: DataFrame) -> DataFrame:
    """V ./ (W H) at all cells of WH, as IEEE has it."""
    x = F.coalesce("v", F.lit(0.0))
    return wh.join(v, ["i", "j"], "left").select("i", "j", ieee_divide(x, F.col("wh")).alias("r"))


def subtract(v: DataFrame, wh: DataFrame) -> DataFrame:
    """V - W H at all cells of WH."""
    return wh.join(v, ["i", "j"], "left").select("i", "j", (F.coalesce("v", F.lit(0.0)) - F.col("wh")).alias("d"))


def reduce_to_row(factor: DataFrame, value: str, exact: bool = False) -> DataFrame:
    """(k, acc): sums of a factor over its long side; exact: the same to the last bit on any partitions."""
    if exact:
        return exact_sums(factor, ["k"], {"acc": value})
    return factor.groupBy("k").agg(F.sum(value).alias("acc"))


def multiply_divide(factor: DataFrame, aux: DataFrame, acc: DataFrame, key: str, value: str) -> DataFrame:
    """factor .* aux ./ acc by column k; aux is (key, k, num), missing ones 0. acc has one row for each k."""
    return factor.join(aux, [key, "k"], "left").join(F.broadcast(acc), "k").select(key, "k", ieee_divide(F.col(value) * F.coalesce("num", F.lit(0.0)), F.col("acc")).alias(value))


def adjust(factor: DataFrame, value: str) -> DataFrame:
    return factor.withColumn(value, floored(F.col(value)))


def classify(h: DataFrame) -> DataFrame:
    """(j, cls): the k of the greatest value in each column of H; among equal ones the lowest."""
    return h.groupBy("j").agg(F.max_by("k", F.struct(F.col("h"), -F.col("k"))).cast("int").alias("cls"))


def connectivity_difference(now: DataFrame, last: DataFrame) -> DataFrame:
    """(diff): pairs of columns that share a class in one of two classifications (j, cls) but not in the other.

    From sizes of classes and of their crossings, so it takes K * K rows instead of all pairs.
    """
    both = now.select("j", F.col("cls").alias("a")).join(last.select("j", F.col("cls").alias("b")), "j").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = lambda d: d.select(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    a, b = (pairs(both.groupBy(c).agg(F.sum("n").alias("n"))) for c in "ab")
    return a.withColumnRenamed("p", "pa").join(b.withColumnRenamed("p", "pb")).join(pairs(both)).select((F.col("pa") + F.col("pb") - 2 * F.col("p")).cast("bigint").alias("diff"))


def dot_v_vwh(v: DataFrame, w: DataFrame, h: DataFrame, exact: bool = False) -> DataFrame:
    """(dot_v, dot_vwh): sums of squares of V and of V - W H, over all cells; exact: of the squares as doubles, the same to the last bit on any partitions."""
    d = matmul(w, h).join(v, ["i", "j"], "left").select(F.coalesce("v", F.lit(0.0)).alias("v"), "wh")
    if exact:
        return exact_sums(d.select((F.col("v") * F.col("v")).alias("a"), ((F.col("v") - F.col("wh")) * (F.col("v") - F.col("wh"))).alias("b")), [], {"dot_v": "a", "dot_vwh": "b"})
    return d.agg(F.sum(F.col("v") * F.col("v")).alias("dot_v"), F.sum((F.col("v") - F.col("wh")) * (F.col("v") - F.col("wh"))).alias("dot_vwh"))


def dot_gram(v: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """The same from V's stored cells and the K * K Gram matrices alone; loses digits if the fit is near exact."""
    gram = lambda f, key, x: f.alias("a").join(f.alias("b"), key).groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("l")).agg(F.sum(F.col(f"a.{x}") * F.col(f"b.{x}")).alias(x))
    whole = gram(w, "i", "w").join(gram(h, "j", "h"), ["k", "l"]).agg(F.sum(F.col("w") * F.col("h")).alias("g"))
    return at_cells(v, w, h).agg(F.sum(F.col("v") * F.col("v")).alias("dot_v"), F.sum(F.col("v") * F.col("wh")).alias("c")).join(whole).select("dot_v", (F.col("dot_v") - 2 * F.col("c") + F.col("g")).alias("dot_vwh"))


#: A squared distance below this part of V's squares is not trusted to differences of sums.
NEAR = 1e-10


def dots(v: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """dot_v and dot_vwh by the stored cells alone, and over all cells only where V is met so closely that the first has no digits left. One row comes to the driver."""
    x = dot_gram(v, w, h).first()
    if not x["dot_vwh"] > NEAR * x["dot_v"]:
        return dot_v_vwh(v, w, h)
    return v.sparkSession.createDataFrame([tuple(x)], "dot_v double, dot_vwh double")


def relative_distance(dots: DataFrame) -> DataFrame:
    return dots.select((F.sqrt("dot_vwh") / F.sqrt("dot_v")).alias("distance"))


def combine_columns(parts: list[DataFrame], n_cols: int) -> DataFrame:
    """Matrices of one shape side by side."""
    out = parts[0]
    for t, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("j", (F.col("j") + t * n_cols).cast("int")))
    return out


def factor_labels(spark, k: int) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("Factor_"), F.col("id").cast("string")).alias("label"))
