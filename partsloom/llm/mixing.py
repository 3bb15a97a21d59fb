"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (its expected number of copies). Among all rates between 0 and the greatest allowed
number that meet every source's word target, those nearest in entropy to one common rate are exponentially
tilted in the document's size, with one multiplier a source; Newton's method finds the multipliers of the convex
dual. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, col, kept, table, with_columns

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
STEPS, TOLERANCE = 60, 1e-6
#: Documents of one source and size are dealt out to so many parts, each ranked by itself.
PARTS = 1024
#: Equal rows that are HOT-th of all, and LEAST_HOT, are dealt out apart.
HOT, LEAST_HOT = 1000, 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes has a row for each source: source, source_size. Adds target (double).

    Sources by code point, null last, have the weights in turn, again and again. They share out share times all
    sizes by weight; a target stops at cap times its source's size and the excess goes by weight to those below,
    until no target is above. That has a closed form: in order of cap * size / weight, the first sources stop and
    the others have one level t with target = t * weight. The window runs over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("open", F.col("most") > F.col("level") * F.col("w"))
    t = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every)
    return s.withColumn("t", t).select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("t") * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, order: Column | None = None) -> DataFrame:
    """docs with size, source_size (bigint), target (double, the source's), rate (double), copies (int) and taken (bigint, copies * size).

    These replace columns so named. docs needs a column source; null is a source of its own. size is a whole
    number, null or negative as 0. A document of size 0 has a copy if its rate, the common one, rounds to it, and takes
    nothing. A source of size 0 has target 0. An empty df gives an empty result. Repeated rows are documents
    of their own.

    Rates depend on source and size alone, so the dual is solved on a table of the sizes in each source, which
    does not grow with the documents once all sizes have been seen. Rounding goes through that table in order of
    size with the running sum of rates rounded to whole copies, which leaves a source's words within about half of its
    largest document of the target; which documents of one size get the odd copy depends on order, a long, or else a hash of the
    whole row, so reruns agree. A source with a third of all rows is dealt out by size and hash. Of equal rows there can be as many: hashes that a HOT-th of all rows have, or more, HOT at most, are
    dealt out by row, as it makes no difference which of equal rows is taken. docs is written down once; hand in ids and sizes, not texts.
    """
    own = ("size", "source_size", "target", "rate", "copies", "taken")
    base = with_columns(docs, {"size": F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0))})
    base = base.withColumn("_pl_hash", F.xxhash64(*[col(c) for c, kind in base.dtypes if "map<" not in kind]) if order is None else order)
    base = kept(base.withColumn("_pl_row", F.monotonically_increasing_id()), "mix-rows")
    equal = kept(base.groupBy(F.col("_pl_hash").alias("_pl_h")).agg(F.count("*").alias("_pl_n")).where(F.col("_pl_n") >= LEAST_HOT), "mix-equal")
    most = equal.where(F.col("_pl_n") >= max(LEAST_HOT, -(-base.count() // HOT)))
    base = base.join(F.broadcast(most), F.col("_pl_hash") == F.col("_pl_h"), "left")
    spread = F.when(F.col("_pl_h").isNull(), F.col("_pl_hash")).otherwise(F.xxhash64("_pl_row"))
    base = base.withColumn("_pl_part", F.pmod(spread, F.lit(PARTS)).cast("int")).drop("_pl_h", "_pl_n")
    cells = kept(base.groupBy(F.col("source"), F.col("size"), F.col("_pl_part").alias("part")).agg(F.count("*").alias("n")), "mix-cells")
    hist = kept(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"), F.max("size").alias("longest"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    state = kept(targets.join(sizes.drop("source_size").withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-sources")
    rates = hist.join(kept(_multipliers(hist, state, share, cap), "mix-multipliers").withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rates = rates.select("source", "size", "n", "source_size", "target", _rate(share, cap).alias("rate"))
    # Whole copies for each size, then for each part of a size, then for each document: each by differences of a rounded running sum.
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    odd = rates.withColumn("base", F.floor("rate").cast("int")).withColumn("sum", F.sum((F.col("rate") - F.floor("rate")) * F.col("n")).over(down))
    odd = odd.withColumn("extra", F.round("sum").cast("bigint") - F.coalesce(F.round(F.lag("sum").over(Window.partitionBy("source").orderBy(F.col("size").desc()))).cast("bigint"), F.lit(0)))
    odd = odd.withColumn("extra", F.least(F.greatest("extra", F.lit(0)), F.col("n")))
    parts = cells.join(odd.withColumnRenamed("source", "s2").withColumnRenamed("size", "z2").withColumnRenamed("n", "n_cell"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    # floor(seen * extra / n_cell) grows by n_part or less from part to part, as extra <= n_cell, and ends at extra
    seen = parts.withColumn("seen", F.sum("n").over(along))
    quota = F.floor(F.col("seen").cast("decimal(38,0)") * F.col("extra") / F.col("n_cell")) - F.floor((F.col("seen") - F.col("n")).cast("decimal(38,0)") * F.col("extra") / F.col("n_cell"))
    new = ("source_size", "target", "rate")
    dealt = seen.select(F.col("source").alias("_pl_s"), F.col("size").alias("_pl_z"), F.col("part").alias("_pl_p"), *[F.col(c).alias(f"_pl_{c}") for c in (*new, "base")], quota.cast("bigint").alias("_pl_quota"))
    ranked = base.join(dealt, F.col("source").eqNullSafe(F.col("_pl_s")) & (F.col("size") == F.col("_pl_z")) & (F.col("_pl_part") == F.col("_pl_p")))
    ranked = ranked.withColumn("_pl_rank", F.row_number().over(Window.partitionBy("_pl_s", "_pl_z", "_pl_p").orderBy("_pl_hash", "_pl_row")))
    copies = (F.col("_pl_base") + F.when(F.col("_pl_rank") <= F.col("_pl_quota"), 1).otherwise(0)).cast("int")
    rest = [c for c in docs.columns if c.lower() not in own]
    return ranked.select(*map(col, rest), "size", *[F.col(f"_pl_{c}").alias(c) for c in new], copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _logit(share: float, cap: int) -> float:
    import math

    r = min(max(share / cap, 1e-6), 1 - 1e-6)
    return math.log(r / (1 - r))


def _rate(share: float, cap: int) -> Column:
    """cap * e^t / (1 + e^t), t the tilted prior; a target at its greatest or at nothing has no finite multiplier."""
    t = F.lit(_logit(share, cap)) + F.col("lam") * F.col("size")
    return F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(float(cap))).otherwise(float(cap) / (1 + F.exp(-t)))


def _multipliers(hist: DataFrame, state: DataFrame, share: float, cap: int) -> DataFrame:
    """Newton's method on the dual, one multiplier lam for each source, all sources in one aggregation a step.

    The sum of rate * size rises with lam, so a step that leaves the bracket found so far is replaced by bisection.
    A step is one job over the table of sizes; only the number of sources that are not yet near comes to the driver.
    """
    cur = kept(state.select("*", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("near")), "mix-newton")
    for _ in range(STEPS):
        at = hist.join(cur.select(F.col("source").alias("s2"), "lam", "target", "source_size"), F.col("source").eqNullSafe(F.col("s2"))).withColumn("r", _rate(share, cap))
        sums = at.groupBy("s2").agg(F.sum(F.col("r") * F.col("size") * F.col("n")).alias("got"), F.sum(F.col("r") * (1 - F.col("r") / cap) * F.col("size") * F.col("size") * F.col("n")).alias("slope"))
        s = cur.join(sums, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        over = F.col("got") - F.col("target")
        s = s.withColumn("done", F.col("near") | (F.abs(over) <= TOLERANCE * F.col("target")) | (F.col("source_size") == 0))
        s = s.withColumn("low", F.when(over < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.col("lam") - F.when(F.col("slope") > 0, over / F.when(F.col("slope") > 0, F.col("slope"))).otherwise(F.lit(None))
        wide = 4.0 / F.greatest(F.col("longest").cast("double"), F.lit(1.0))
        # outside the bracket, or with no slope: the middle, or further out while one end is open
        inside = (F.coalesce(step > F.col("low"), F.lit(True))) & (F.coalesce(step < F.col("high"), F.lit(True))) & step.isNotNull()
        far = F.greatest(2 * F.abs(F.col("lam")), wide)
        other = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).when(F.col("low").isNotNull(), F.col("lam") + far).otherwise(F.col("lam") - far)
        reach = F.greatest(4 * F.abs(F.col("lam")), 8 * wide, 64.0 * F.col("n_docs") / F.greatest(F.col("source_size").cast("double"), F.lit(1.0)))
        bound = F.when(F.abs(step - F.col("lam")) <= reach, step).otherwise(F.col("lam") + F.signum(step - F.col("lam")) * reach)
        nxt = F.when(F.col("done"), F.col("lam")).when(inside, bound).otherwise(other)
        cur = kept(s.select(*[c for c in cur.columns if c not in ("lam", "near")], nxt.alias("lam"), F.col("done").alias("near")), "mix-newton")
        if not cur.where("not near").limit(1).count():
            break
    return cur.select("source", "source_size", "target", "lam")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kept(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-words")
    return mix(docs, F.col("words")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
