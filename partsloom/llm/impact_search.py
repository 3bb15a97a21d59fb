"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Rows are dealt into blocks. A block's index has posting lists: for each component the rows that hold it, in segments by quantised
impact, greatest first. All lists' segments of one impact are added to the scores, then those of the next, and what the segments to come can add at most is known for
every row. Once the k-th best lower bound is above the upper bounds of all but a few rows, that is the proof to stop; those few are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, kept, table

K, QUERY_STEP, SCALE = 5, 50, 256.0
#: Least and most rows of a block of candidates, rows of a block of queries, and queries scored at a time.
ROWS, MOST_ROWS, QUERIES, STEP = 8192, 65_536, 1024, 128
#: Rows of an index; a block holds several, each small enough for its scores to stay in a processor's cache.
INDEX_ROWS = 512
#: A query's rows are scored exactly once no more than this part of an index can be among its best.
FEW = 8
#: Impacts are quantised to so many levels: the greatest magnitude of a block, halved again and again.
LEVELS = 4
#: Scores below these are exact in floats, doubles and longs.
FLOAT, DOUBLE, LONG = 2.0**24, 2.0**53, 2.0**63


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """Components as floor(scale * x), x as double (a whole number, kept as double); null for a vector that is null or holds null or non-finite components. An empty vector stays one."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = lambda x: x.cast("double") * F.lit(scale) - F.pmod(x.cast("double") * F.lit(scale), F.lit(1.0))  # noqa: E731  floor() gives longs, which end at 2^63
    return F.when(good, F.transform(vector, whole))


class Postings:
    """The index of some vectors of whole numbers: posting lists by level of impact and component, greatest impacts first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors).astype(np.float64)
        top = size.max(initial=0)
        level = np.full(size.shape, LEVELS - 1, np.int8)
        for e in range(LEVELS - 2, -1, -1):
            level[size > top / 2 ** (e + 1)] = e
        self.lists, self.rest = [], []
        for e in range(LEVELS):
            part = []
            for d in range(vectors.shape[1]):
                rows = np.flatnonzero((level[:, d] == e) & (size[:, d] > 0))
                if len(rows):
                    part.append((d, rows, vectors[rows, d][:, None].copy()))
            self.lists.append(part)
            left = np.where(level > e, size, 0)
            self.rest.append((np.sqrt((left * left).sum(axis=1)), left.max(axis=1, initial=0)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the k best of the index for each query; rows that cannot reach the query's floor need not be among them."""
        kind = queries.dtype if queries.dtype.kind == "f" else np.float64
        over = 1 + 16 * np.finfo(kind).eps  # bounds are rounded up
        score = np.zeros((len(self.ids), len(queries)), queries.dtype)
        q = queries.astype(np.float64)
        norm, total = np.sqrt((q * q).sum(axis=1)) * over, np.abs(q).sum(axis=1) * over
        norm, total = norm.astype(kind), total.astype(kind)
        open_ = np.arange(len(queries))
        out = []
        for part, (length, most) in zip(self.lists, self.rest, strict=True):
            asked = queries[open_].T.copy()
            for d, rows, impact in part:
                score[rows] += impact * asked[d]
            # what is left adds at most the product of norms, or the greatest component times the query's sum
            slack = np.minimum(length.astype(kind)[:, None] * norm[open_] * kind_one(over, kind), most.astype(kind)[:, None] * total[open_] * kind_one(over, kind))
            least = floor[open_].astype(kind)
            if not np.isfinite(least).all() and len(self.ids) > k:
                low = np.where(self.ids[:, None] == query_ids[open_][None, :], -np.inf, score - slack).astype(kind)
                least = np.maximum(least, np.partition(low, len(low) - k, axis=0)[len(low) - k])
            alive = score + slack >= np.where(np.isfinite(least), least - np.abs(least) * kind_one(over - 1, kind), least)
            few = alive.sum(axis=0) <= len(self.ids) // FEW
            if part is self.lists[-1]:
                few[:] = True
            for i in np.flatnonzero(few):
                rows = np.flatnonzero(alive[:, i])
                rows = rows[self.ids[rows] != query_ids[open_[i]]]
                exact = self.vectors[rows] @ queries[open_[i]]
                if len(rows) > k:
                    best = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
                    rows, exact = rows[best], exact[best]
                    order = np.lexsort((self.ids[rows], -exact))[:k]
                    rows, exact = rows[order], exact[order]
                out.append((np.full(len(rows), open_[i]), self.ids[rows], exact))
            open_, score = open_[~few], score[:, ~few]
            if not len(open_):
                break
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def kind_one(x: float, kind) -> np.floating:
    """x as a scalar of that kind, so that it doesn't widen arrays."""
    return np.dtype(kind).type(x)


class Block:
    """The indexes of a block of vectors. Each is searched with the scores that the ones before have proved."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.parts = [Postings(ids[i : i + INDEX_ROWS], vectors[i : i + INDEX_ROWS]) for i in range(0, len(ids), INDEX_ROWS)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the k best of the block for each query."""
        floor = np.full(len(queries), -np.inf)
        q, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, queries.dtype)
        for part in self.parts:
            more = part.search(query_ids, queries, k, floor)
            q, ids, score = (np.concatenate([a, b.astype(a.dtype)]) for a, b in zip((q, ids, score), more, strict=True))
            order = np.lexsort((ids, -score, q))
            q, ids, score = q[order], ids[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            floor[q[rank == k - 1]] = score[rank == k - 1]
            q, ids, score = q[rank < k], ids[rank < k], score[rank < k]
        return q, ids, score


def narrowest(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them."""
    most = np.abs(v).max(initial=0)
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _blocks(rows: DataFrame, per_block: int, wide: int) -> DataFrame:
    """rows (id, v) as blocks (block, ids, vs, kind): vectors filled up with zeros to one length, packed; dealt by the number of the row in its scan, so equal rows spread too."""
    n = max(1, -(-rows.count() // per_block))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((len(g), wide))
        for i, x in enumerate(g["v"]):
            v[i, : len(x)] = x
        v = narrowest(v)
        return pd.DataFrame({"block": [int(g["b"].iloc[0])], "ids": [g["id"].to_numpy("<i8").tobytes()], "vs": [v.tobytes()], "kind": [v.dtype.str]})

    at = rows.withColumn("b", F.pmod(F.xxhash64("at"), F.lit(n)).cast("int"))
    return kept(at.groupBy("b").applyInPandas(run, "block int, ids binary, vs binary, kind string"), "search-blocks")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for each distinct query.

    rows and queries are (id bigint, v array of whole numbers). A row is a candidate for each query of other id; of vectors of
    unequal length the shorter counts as filled up with zeros, so an empty one has score 0 with all. Rows of a null id or vector take no part. Repeated rows of rows are candidates each, repeated queries are answered
    once (of two vectors under one id, each is answered and the k best of both together are kept). Equal scores rank by smaller id. An empty table gives an empty result.
    Scores are computed in floats or doubles while these are exact for the greatest components there are, else in longs; where a score could leave a long, that is an error.

    Each block of rows meets each block of queries, which is what the stated query set asks for: the queries, the few, are sent
    to the blocks of rows, stream past each one's index, which is built once, and send on k rows a query.
    """
    spark = rows.sparkSession
    good = lambda d: d.where("id is not null and v is not null").select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    numbered = lambda d: d.withColumn("at", F.monotonically_increasing_id())
    rows, queries = kept(numbered(good(rows)), "search-rows"), kept(numbered(good(queries).distinct()), "search-queries")
    most = lambda d: d.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0))).first()
    (wide, top), (wide_q, top_q) = most(rows), most(queries)
    wide = max(1, wide, wide_q)
    reach = wide * max(top, 1.0) * max(top_q, 1.0)
    if reach >= LONG:
        raise ValueError(f"scores of {wide} components up to {top:g} and {top_q:g} do not fit in 64 bits")
    kind = np.float32 if reach < FLOAT else np.float64 if reach < DOUBLE else np.int64
    per_block = min(MOST_ROWS, max(ROWS, -(-rows.count() // (2 * spark.sparkContext.defaultParallelism))))  # large blocks mean few copies of the queries, small ones many tasks
    cand, asked = _blocks(rows, per_block, wide), _blocks(queries, QUERIES, wide)
    n = int(cand.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]) + 1
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at"), F.col("block").alias("seq"), "ids", "vs", "kind")
    every = cand.select(F.col("block").alias("at"), F.lit(-1).alias("seq"), "ids", "vs", "kind").unionByName(sent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, at = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                ids = np.frombuffer(r.ids, "<i8")
                v = np.frombuffer(r.vs, r.kind).reshape(len(ids), -1).astype(kind)
                if r.seq < 0:
                    index, at = Block(ids, v), r.at
                elif r.at == at:  # a block that got no rows has no index
                    for i in range(0, len(ids), STEP):
                        q, found, s = index.search(ids[i : i + STEP], v[i : i + STEP], k)
                        yield pd.DataFrame({"query_id": ids[i : i + STEP][q], "vec_id": found, "score": s.astype(np.int64)})

    dealt = every.repartitionByRange(n, "at").sortWithinPartitions("at", "seq")
    found = dealt.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(col("embedding")).alias("v"))
    return top_k(rows, rows.where(F.col("id") % QUERY_STEP == 0))


SQL = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), f AS (SELECT vec_id, list_resize(v, (SELECT greatest(1, max(len(v))) FROM e), 0) AS v FROM e),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM f q JOIN f c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
