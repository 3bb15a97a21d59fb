"""Quarantine and cascading release: turns wait for their parents, faulty ones are tried again until they deliver or are dead.

The frontier goes level by level: turns without a parent are resolved first, then every resolved level is joined to its children by conversation
and the parent's position, and written down, until no level has any. Windows then rank what was delivered and add up its state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, kept, shared_dir, table

ATTEMPTS, BACKOFF = 6, 10


def numbered(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """df and nth (long): each row's place in its key by order, from 1; and for each of sums (name: a value of the row, long) the
    sum of nth * value up to the row, decimal(38,0). Rows that order does not tell apart stand in the order of a hash; equal ones make no difference.

    Rows are dealt out by range of (key, order, hash of the row, number in the scan), so a key, or one row that is repeated, that has a third of all rows takes a third of the tasks. Windows
    number the rows of a key within each range; what the ranges before it hold of the key, a row for each range and key, is added.
    """
    spark, sums = df.sparkSession, sums or {}
    tie = F.xxhash64(*map(col, df.columns))
    keyed = df.select(*map(col, df.columns), tie.alias("_pl_tie"), F.monotonically_increasing_id().alias("_pl_row"), *[v.cast("decimal(38,0)").alias(f"_pl_v{i}") for i, v in enumerate(sums.values())])
    dealt = keyed.repartitionByRange(F.col(key).asc_nulls_first(), *order, "_pl_tie", "_pl_row").withColumn("_pl_range", F.spark_partition_id())
    dealt = kept(dealt, "ranges")
    within = Window.partitionBy("_pl_range", key).orderBy(*order, "_pl_tie", "_pl_row")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("_pl_n", F.row_number().over(within).cast("bigint"))
    for i in range(len(sums)):
        local = local.withColumn(f"_pl_c{i}", F.sum(f"_pl_v{i}").over(upto)).withColumn(f"_pl_l{i}", F.sum(F.col("_pl_n") * F.col(f"_pl_v{i}")).over(upto))
    local = kept(local, "ranked") if sums else local
    ends = local.groupBy("_pl_range", key).agg(F.max("_pl_n").alias("n"), *[F.max_by(f"_pl_{x}{i}", "_pl_n").alias(f"{x}{i}") for i in range(len(sums)) for x in "cl"])
    # A key that lies in one range only, as nearly all do, has nothing before it.
    before = Window.partitionBy(key).orderBy("_pl_range").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    ends = ends.withColumn("_pl_off", none(F.sum("n").over(before)).cast("bigint"))
    for i in range(len(sums)):
        ends = ends.withColumn(f"_pl_t{i}", none(F.sum(F.col("_pl_off") * F.col(f"c{i}") + F.col(f"l{i}")).over(before)).cast("decimal(38,0)"))
    ends = ends.select(F.col("_pl_range").alias("_pl_r"), F.col(key).alias("_pl_k"), "_pl_off", *[f"_pl_t{i}" for i in range(len(sums))]).where("_pl_off > 0")
    both = local.join(ends.hint("merge"), (F.col("_pl_range") == F.col("_pl_r")) & F.col(key).eqNullSafe(F.col("_pl_k")), "left")
    off = none(F.col("_pl_off"))
    out = [(none(F.col(f"_pl_t{i}")) + off * F.col(f"_pl_c{i}") + F.col(f"_pl_l{i}")).cast("decimal(38,0)").alias(name) for i, name in enumerate(sums)]
    return both.select(*map(col, df.columns), (off + F.col("_pl_n")).alias("nth"), *out)


def outcome(start: Column, repaired_at: Column, fails: Column, attempts: int = ATTEMPTS, backoff: int = BACKOFF) -> Column:
    """struct(status, attempts, first_at, last_at) of a turn whose first attempt comes at start.

    Attempt a comes backoff * (2^(a-1) - 1) seconds after the first. A turn without a repaired_at is delivered by the first; else one delivers at repaired_at
    or later unless fails[a-1]. The turn is dead if none does.
    """
    wait = [backoff * (2**a - 1) for a in range(attempts)]
    good = F.lit(attempts + 1)
    for a in reversed(range(attempts)):
        good = F.when((start + wait[a] >= repaired_at) & ~F.get(fails, F.lit(a)), a + 1).otherwise(good)
    good = F.when(repaired_at.isNull(), 1).otherwise(good)
    n = F.least(good, F.lit(attempts))
    return F.struct(
        F.when(good <= attempts, "delivered").otherwise("dead").alias("status"), n.cast("int").alias("attempts"),
        start.alias("first_at"), (start + F.element_at(F.array(*map(F.lit, wait)), n)).cast("bigint").alias("last_at"),
    )


def cascade(turns: DataFrame, attempts: int = ATTEMPTS, backoff: int = BACKOFF) -> DataFrame:
    """turns and status, attempts, first_at, last_at. turns has conv, pos and parent (both long; parent is an earlier position of the conversation or
    null), arrives_at, repaired_at (long; null: not faulty) and fails (booleans, one for each attempt); (conv, pos) is unique; conv may be null. Other columns stay, unless named as the new ones.

    The first attempt comes at arrival or when the parent is delivered, if that is later. A turn whose parent is dead or blocked is blocked: no attempts, no times.
    A level is a join of those still unresolved to the turns that the level before resolved, dealt out by (conversation, position), so a
    conversation of any size is spread. Unresolved turns are written anew each level. Only two counts a level come to the driver. A parent that does not exist leaves its turns out of the frontier: an error.
    """
    spark = turns.sparkSession
    folder = f"{shared_dir(spark)}/cascade-{uuid.uuid4().hex}"
    added = ("status", "attempts", "first_at", "last_at")
    base = turns.select(*[col(c) for c in turns.columns if c not in added])
    names = base.columns
    done = lambda d: d.select(*map(col, names), *[F.col(f"_pl_o.{x}").alias(x) for x in added])

    def level(n: int, d: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        new = F.col("status").isNotNull()
        d.observe(seen, F.count(F.when(new, 1)).alias("new"), F.count(F.when(~new, 1)).alias("rest")).write.parquet(f"{folder}/{n}")
        return spark.read.schema(d.schema).parquet(f"{folder}/{n}"), seen.get["new"], seen.get["rest"]

    nothing = F.struct(F.lit("blocked").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("bigint").alias("first_at"), F.lit(None).cast("bigint").alias("last_at"))
    held, new, rest = level(0, done(base.withColumn("_pl_o", F.when(F.col("parent").isNull(), outcome(F.col("arrives_at"), F.col("repaired_at"), F.col("fails"), attempts, backoff)))))
    n = 0
    while rest:
        if not new:
            raise ValueError(f"{rest} turns have a parent that is not there")
        n += 1
        front = held.where("status is not null").select(F.col("conv").alias("_pl_conv"), F.col("pos").alias("_pl_pos"), F.col("status").alias("_pl_status"), F.col("last_at").alias("_pl_at"))
        wait = held.where("status is null").select(*map(col, names))
        met = wait.join(front.hint("merge"), F.col("conv").eqNullSafe(F.col("_pl_conv")) & (F.col("parent") == F.col("_pl_pos")), "left")
        start = F.greatest("arrives_at", "_pl_at")
        here = F.when(F.col("_pl_status") == "delivered", outcome(start, F.col("repaired_at"), F.col("fails"), attempts, backoff)).when(F.col("_pl_status").isNotNull(), nothing)
        held, new, rest = level(n, done(met.withColumn("_pl_o", here)))
    return spark.read.schema(held.schema).parquet(*[f"{folder}/{i}" for i in range(n + 1)]).where("status is not null")


def release(resolved: DataFrame, weight: Column) -> DataFrame:
    """resolved and release_no (long: delivered turns from 1 by last_at, then pos, in each conv) and state (decimal(38,0): sum of release_no * weight through
    this release, exact); both null unless delivered. weight is a long of the row."""
    drop = ("release_no", "state")
    own = resolved.select(*[col(c) for c in resolved.columns if c not in drop])
    ok = numbered(own.where("status = 'delivered'"), "conv", [F.col("last_at"), F.col("pos")], {"state": weight}).withColumnRenamed("nth", "release_no")
    null = [F.lit(None).cast("bigint").alias("release_no"), F.lit(None).cast("decimal(38,0)").alias("state")]
    return ok.unionByName(own.where("status <> 'delivered'").select(*map(col, own.columns), *null))


def drawn(k: int, conv: Column, turn: Column) -> Column:
    """crc32 of `k:conv:turn`; a null is written as nothing."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.crc32(F.concat(F.lit(f"{k}:"), text(conv), F.lit(":"), text(turn)))


def replayed(conversations: DataFrame) -> DataFrame:
    """What cascade needs, from conv_id and turn (nulls first; among equal turns in the order of a hash), and crc (that of the text)."""
    own = conversations.select(col("conv_id").cast("bigint").alias("conv"), col("turn").cast("bigint").alias("turn"), F.crc32(F.coalesce(col("text").cast("string"), F.lit(""))).alias("crc"))
    own = numbered(own, "conv", [F.col("turn").asc_nulls_first()]).withColumn("pos", F.col("nth") - 1)
    h = lambda k: drawn(k, F.col("conv"), F.col("turn"))
    back = h(0) % 5
    faulty = h(1) % 101 < 50
    own = own.withColumn("parent", F.when((back > 0) & (F.col("pos") >= back), F.col("pos") - back)).withColumn("arrives_at", 7 * F.col("pos"))
    own = own.withColumn("repaired_at", F.when(faulty, F.col("arrives_at") + h(2) % 101))
    fails = F.when(faulty, F.array(*[h(a + 2) % 3 == 0 for a in range(1, ATTEMPTS + 1)]))
    return kept(own.withColumn("fails", fails).drop("nth"), "replayed")


def op11_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null conv_id is a conversation of its own. Of repeated (conv_id, turn) each row is a turn. A state beyond a long is null here; the operator gives it whole."""
    done = release(cascade(replayed(table(spark, sf_dir, "conversations"))), F.col("crc"))
    return done.select(F.col("conv").alias("conv_id"), "turn", "status", "attempts", "first_at", "last_at", "release_no", F.col("state").try_cast("bigint").alias("state"))


def _crc(text: str) -> str:
    """SQL for the crc32 of a string's UTF-8 bytes, by the table of a byte each in t."""
    digits = f"hex(encode({text}))"
    seq = f"list_transform(range(octet_length(encode({text}))), lambda x: ('0x' || substr({digits}, 2 * x + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {seq}), lambda c, b: xor(c >> 8, t.byte[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_BITS = "list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_WAIT = f"{BACKOFF} * ((1 << (a - 1)) - 1)"


def _tried(start: str) -> str:
    """The first attempt that delivers a turn of q, or null."""
    return f"list_filter(range(1, {ATTEMPTS + 1}), lambda a: q.repaired IS NULL OR ({start} + {_WAIT} >= q.repaired AND q.h[a + 3] % 3 <> 0))[1]"


SQL = f"""
WITH RECURSIVE t AS (SELECT list({_BITS} ORDER BY i) AS byte FROM (SELECT unnest(range(256)) AS i)),
c AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations),
k AS (SELECT conv_id, turn, p, text, k, k || ':' || coalesce(conv_id::VARCHAR, '') || ':' || coalesce(turn::VARCHAR, '') AS drawn FROM c, (SELECT unnest(range({ATTEMPTS + 3})) AS k)),
h AS (SELECT conv_id, turn, p, any_value(text) AS text, list({_crc("drawn")} ORDER BY k) AS h FROM k, t GROUP BY conv_id, turn, p),
q AS (
  SELECT conv_id, turn, p, h, {_crc("text")} AS crc, 7 * p AS arrives, CASE WHEN h[1] % 5 > 0 AND p >= h[1] % 5 THEN p - h[1] % 5 END AS parent,
         CASE WHEN h[2] % 101 < 50 THEN 7 * p + h[3] % 101 END AS repaired
  FROM h, t
), z AS (
  SELECT conv_id, p, arrives AS start, {_tried("arrives")} AS tried, false AS blocked, CASE WHEN tried IS NOT NULL THEN arrives + 10 * ((1 << (tried - 1)) - 1) END AS delivered
  FROM q WHERE parent IS NULL
  UNION ALL
  SELECT conv_id, p, start, CASE WHEN NOT blocked THEN tried END, blocked, CASE WHEN NOT blocked AND tried IS NOT NULL THEN start + 10 * ((1 << (tried - 1)) - 1) END
  FROM (
    SELECT q.conv_id, q.p, z.delivered IS NULL AS blocked, greatest(q.arrives, z.delivered) AS start, {_tried("greatest(q.arrives, z.delivered)")} AS tried
    FROM q JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id AND z.p = q.parent
  )
), s AS (
  SELECT q.conv_id, turn, q.p, crc, CASE WHEN blocked THEN 'blocked' WHEN tried IS NULL THEN 'dead' ELSE 'delivered' END AS status,
         CASE WHEN blocked THEN 0 ELSE coalesce(tried, {ATTEMPTS}) END::INT AS attempts, CASE WHEN NOT blocked THEN start END AS first_at,
         CASE WHEN NOT blocked THEN coalesce(delivered, start + {BACKOFF * (2 ** (ATTEMPTS - 1) - 1)}) END AS last_at
  FROM q JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id AND z.p = q.p
), n AS (SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn) END AS release_no FROM s)
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no,
       CASE WHEN status = 'delivered' THEN sum(release_no * crc) OVER (PARTITION BY conv_id, status ORDER BY release_no) END::BIGINT AS state
FROM n
"""
