"""V as tiles of compressed rows, spread once: what the solver's steps share.

A tile is a block of rows by a block of columns. Its stored cells stand as compressed rows (row numbers, where each begins, columns, values), and a product of the
factors is taken at those cells alone, so work and memory follow the stored cells. Factors are tables of blocks too; no
factor is ever whole in a task or on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import R_MIN
from ..model import MatrixError
from ..session import checkpoint_dir, checkpointed

#: What a stored cell takes in a task (as stored, decoded, and products), and copies of a factor's block.
CELL_BYTES, COPIES = 80, 4
#: So many blocks are added up at a time, always the same ones in the same order, so sums do not depend on partitions.
FAN_IN = 32
#: Most cells of a row of the table.
PIECE = 500_000
#: Cells of V that a bucket of its table holds. A task goes through its bucket tile by tile, so small tiles need no more buckets.
BUCKET = 4_000_000
#: A matrix is cut into so many tiles if each has LEAST cells or more, so that there is work for that many tasks, whatever one of them could hold. These numbers do not depend on the cluster, so the tiles, and the bits of the results, do not either.
SPREAD, LEAST = 64, 200_000
#: Bytes of rows that make a frame.
FRAME = 8_000_000
#: Bytes of both factors up to which they are sent to all tasks instead of being copied for each tile.
SENT = 8_000_000
TILE = ["rb", "cb", "s"]


@dataclass(frozen=True)
class Tiling:
    """Blocks of rows by cols; the last ones can be smaller."""

    n_rows: int
    n_cols: int
    rows: int
    cols: int

    @property
    def row_blocks(self) -> int:
        return -(-self.n_rows // self.rows)

    @property
    def col_blocks(self) -> int:
        return -(-self.n_cols // self.cols)

    def rows_of(self, block: int) -> int:
        return min(self.rows, self.n_rows - block * self.rows)

    def cols_of(self, block: int) -> int:
        return min(self.cols, self.n_cols - block * self.cols)


def tile_bytes(rows: int, cols: int, density: float, k: int) -> int:
    """What a task takes for a tile of average density, and for adding up FAN_IN blocks of a factor."""
    blocks = max(COPIES * (rows + cols), FAN_IN * max(rows, cols))
    return int(rows * cols * min(1.0, density) * CELL_BYTES) + blocks * k * 8


def plan(n_rows: int, n_cols: int, cells: int, k: int, memory: int) -> Tiling:
    """The largest tiles that fit in memory and leave enough of them for many tasks: the side whose half saves more is halved until they do."""
    rows, cols, density = n_rows, n_cols, cells / (n_rows * n_cols)
    most = max(LEAST, cells // SPREAD)
    while tile_bytes(rows, cols, density, k) > memory or (rows * cols * density > most and rows * cols > 1):
        if rows == cols == 1:
            raise MatrixError(f"{memory} bytes do not hold a tile of one cell at rank {k}")
        fewer_rows = tile_bytes(-(-rows // 2), cols, density, k) if rows > 1 else memory << 20
        fewer_cols = tile_bytes(rows, -(-cols // 2), density, k) if cols > 1 else memory << 20
        if fewer_rows < fewer_cols or (fewer_rows == fewer_cols and rows >= cols):
            rows = -(-rows // 2)
        else:
            cols = -(-cols // 2)
    return Tiling(n_rows, n_cols, -(-n_rows // -(-n_rows // rows)), -(-n_cols // -(-n_cols // cols)))


@dataclass(frozen=True)
class Rows:
    """Compressed rows: the numbers of rows that have cells, where each begins in cols and v (and an end), columns, values."""

    ids: np.ndarray
    ptr: np.ndarray
    cols: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> Rows:
        """From cells in order of rows."""
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
        return cls(r[first].astype("<i4"), np.r_[first, len(r)].astype("<i4"), c.astype("<i4"), v.astype("<f8"))

    @classmethod
    def read(cls, ids: bytes, ptr: bytes, cols: bytes, v: bytes) -> Rows:
        return cls(np.frombuffer(ids, "<i4"), np.frombuffer(ptr, "<i4"), np.frombuffer(cols, "<i4"), np.frombuffer(v, "<f8"))

    def fields(self) -> dict[str, bytes]:
        return {x: getattr(self, x).tobytes() for x in ("ids", "ptr", "cols", "v")}

    def product(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """W H at the stored cells, a factor at a time."""
        at, out = np.repeat(self.ids, np.diff(self.ptr)), np.zeros(len(self.v))
        for k in range(w.shape[1]):
            out += w[at, k] * h[self.cols, k]
        return out

    def full(self, w: np.ndarray, h: np.ndarray) -> bool:
        """Whether half of the cells or more are stored, so that products of whole blocks cost less, in time and in memory, than products at the stored cells."""
        return 0 < len(w) * len(h) <= 2 * len(self.v) and bool(np.isfinite(w).all() and np.isfinite(h).all())

    def ratios(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """V ./ (W H) as a whole block, zero where V is."""
        out = np.zeros((len(w), len(h)))
        out.ravel()[np.repeat(self.ids.astype(np.int64) * len(h), np.diff(self.ptr)) + self.cols] = self.v
        none = out == 0
        out /= w @ h.T
        out[none] = 0
        return out

    def for_h(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """W^T (V ./ (W H)), columns by K."""
        if self.full(w, h):
            return self.ratios(w, h).T @ w
        r, at = self.v / self.product(w, h), np.repeat(self.ids, np.diff(self.ptr))
        return np.stack([np.bincount(self.cols, r * w[at, k], len(h)) for k in range(w.shape[1])], axis=1)

    def for_w(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(V ./ (W H)) H^T, rows by K."""
        if self.full(w, h):
            return self.ratios(w, h) @ h
        r, out = self.v / self.product(w, h), np.zeros_like(w)
        if len(r):
            for k in range(w.shape[1]):
                out[self.ids, k] = np.add.reduceat(r * h[self.cols, k], self.ptr[:-1])
        return out

    def dots(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums at the stored cells of V^2, (V - W H)^2 and (W H)^2."""
        x = self.product(w, h)
        return np.array([(self.v * self.v).sum(), ((self.v - x) ** 2).sum(), (x * x).sum()])


CELLS = "rb long, cb long, s int, piece int, ids binary, ptr binary, cols binary, v binary"


@dataclass(frozen=True)
class Tiles:
    """table: CELLS, written in buckets of (rb, cb, s); index: rb, cb, s, nh and nw, which number the tiles of a block of columns and of rows from 0; most: the largest of these and one.
    tall: there is one block of columns, and one tile for each block of rows."""

    tiling: Tiling
    table: DataFrame
    index: DataFrame
    most_h: int
    most_w: int
    tall: bool


def frames(rows: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """Rows as frames of some FRAME bytes, since a frame for each small row would cost far more than the row."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(x) for x in r.values() if isinstance(x, bytes))
        if size >= FRAME:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def bucketed(df: DataFrame, n: int, keys: list[str], order: list[str], what: str) -> DataFrame:
    """df as a table in n buckets, a file each, so that joins by keys don't move it. Its name leaves the catalog at once, its files stay."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*order).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def spread(cells: DataFrame, tiling: Tiling, tile_cells: int) -> Tiles:
    """Deals V out by tile, once. A tile of more than twice tile_cells is split by rows into as many as that takes, so a hot block is spread too; the list of such
    tiles, which has no more than cells / (2 * tile_cells) rows, goes to all tasks."""
    spark = cells.sparkSession
    placed = cells.select(F.expr(f"i div {tiling.rows}").alias("rb"), F.expr(f"cast(j as bigint) div {tiling.cols}").alias("cb"), F.expr(f"i % {tiling.rows}").cast("int").alias("r"), F.expr(f"j % {tiling.cols}").cast("int").alias("c"), "v")
    sizes = checkpointed(placed.groupBy("rb", "cb").agg(F.count("*").alias("n")))
    splits = F.greatest(F.lit(1), F.when(F.col("n") > 2 * tile_cells, F.ceil(F.col("n") / tile_cells)).otherwise(1)).cast("int")
    sizes = sizes.withColumn("splits", splits)
    hot = sizes.where("splits > 1").select("rb", "cb", "splits")
    s = F.pmod(F.xxhash64("r"), F.coalesce("splits", F.lit(1))).cast("int")
    own = placed.join(F.broadcast(hot), ["rb", "cb"], "left").select("rb", "cb", s.alias("s"), "r", "c", "v")
    seen = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.coalesce(F.sum("splits"), F.lit(0)).alias("tiles")).first()
    n = min(100_000, max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), seen["tiles"]), seen["cells"] // BUCKET))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        """Cells of a task by tile and row, cut where the tile changes and after PIECE cells."""
        tile, held, count, piece = None, [], 0, 0

        def row() -> dict:
            r, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
            return {"rb": tile[0], "cb": tile[1], "s": tile[2], "piece": piece, **Rows.of(r, c, v).fields()}

        for b in batches:
            keys, cells = b[TILE].to_numpy(), [b[x].to_numpy() for x in "rcv"]
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(b)] if len(b) else [0]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(keys[a].tolist())
                if held and (now != tile or count >= PIECE):
                    yield row()
                    piece, held, count = piece + 1 if now == tile else 0, [], 0
                tile = now
                held.append(tuple(x[a:z] for x in cells))
                count += z - a
        if held:
            yield row()

    dealt = own.repartition(n, *TILE).sortWithinPartitions(*TILE, "r", "c").mapInPandas(lambda batches: frames(packed(batches)), CELLS)
    table = bucketed(dealt, n, TILE, [*TILE, "piece"], "tiles")
    tiles = table.select(*TILE).distinct()
    number = lambda by, *order: (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("bigint")
    index = checkpointed(tiles.select(*TILE, number("cb", "rb", "s").alias("nh"), number("rb", "cb", "s").alias("nw")))
    most = index.agg(F.max("nh"), F.max("nw"), F.count("*")).first()
    return Tiles(tiling, table, index, (most[0] or 0) + 1, (most[1] or 0) + 1, tiling.col_blocks == 1 and (most[1] or 0) == 0 and most[2] == tiling.row_blocks)


def met(t: Tiles, w: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """Tiles with their blocks of W (rb, w) and of H (cb, h). Only the factors move: to all tasks if both take SENT bytes or less; else they are copied for each tile and dealt out as the tiles are."""
    w, h = w.select("rb", "w"), h.select("cb", "h")
    if (t.tiling.n_rows + t.tiling.n_cols) * k * 8 <= SENT:
        return t.table.join(F.broadcast(t.index), TILE).join(F.broadcast(w), "rb").join(F.broadcast(h), "cb")
    both = t.index.join(w, "rb").join(h, "cb")
    return t.table.join(both.hint("shuffle_hash"), TILE)


def partial(joined: DataFrame, k: int, side: str) -> DataFrame:
    """(block, n, x, cells): of each tile its part of the numerators of H (side h), of W (side w), or the three dots (side d)."""
    block, order = {"h": ("cb", "nh"), "w": ("rb", "nw"), "d": ("cb", "nh")}[side]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        tile, x, cells, at = None, None, 0, None

        def row() -> dict:
            return {"block": at[0], "n": at[1], "x": x.tobytes(), "cells": cells}

        for b in batches:
            for r in b.itertuples(index=False):
                a, w, h = Rows.read(r.ids, r.ptr, r.cols, r.v), np.frombuffer(r.w).reshape(-1, k), np.frombuffer(r.h).reshape(-1, k)
                with np.errstate(all="ignore"):
                    y = {"h": a.for_h, "w": a.for_w, "d": a.dots}[side](w, h)
                if tile == (r.rb, r.cb, r.s):
                    x, cells = x + y, cells + len(a.v)
                    continue
                if tile:
                    yield row()
                tile, at, x, cells = (r.rb, r.cb, r.s), (getattr(r, block), getattr(r, order)), y, len(a.v)
        if tile:
            yield row()

    return joined.mapInPandas(lambda batches: frames(run(batches)), "block long, n long, x binary, cells long")


def passed(joined: DataFrame, k: int, update: bool, floor: bool, numerators: bool) -> DataFrame:
    """(rb, w, acc, x, cells) of tall tiles in one pass over V: the block of W, with update the next one by H, its sums by factor, and, with numerators, x: H's numerators at the tile by that W, and
    these sums behind them. floor: both factors are floored at the end of this iteration."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        held: list = []

        def row() -> dict:
            r = held[0]
            pieces, w, h = [Rows.read(p.ids, p.ptr, p.cols, p.v) for p in held], np.frombuffer(r.w).reshape(-1, k), np.frombuffer(r.h).reshape(-1, k)
            with np.errstate(all="ignore"):
                if update:
                    w = w * sum((a.for_w(w, h) for a in pieces[1:]), pieces[0].for_w(w, h)) / h.sum(axis=0)
                    w = floored(w) if floor else w
                h = floored(h) if floor else h
                x = sum((a.for_h(w, h) for a in pieces[1:]), pieces[0].for_h(w, h)) if numerators else None
            acc = w.sum(axis=0)
            return {"rb": r.rb, "w": w.tobytes(), "acc": acc, "x": np.r_[x.ravel(), acc].tobytes() if numerators else None, "cells": sum(len(a.v) for a in pieces)}

        for r in (r for b in batches for r in b.itertuples(index=False)):
            if held and held[0].rb != r.rb:
                yield row()
                held.clear()
            held.append(r)
        if held:
            yield row()

    return joined.mapInPandas(lambda batches: frames(run(batches)), "rb long, w binary, acc array<double>, x binary, cells long")


def floored(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x) | (x < R_MIN), R_MIN, x)


def ordered_sum(arrays: Iterable[bytes]) -> np.ndarray | None:
    """The sum of arrays, first to last; none of none."""
    out = None
    for x in arrays:
        out = np.frombuffer(x) if out is None else out + np.frombuffer(x)
    return out


def listed(parts: DataFrame, *by: Column | str) -> DataFrame:
    """by, and xs: the arrays of parts (n, x) in order of n."""
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda p: p["x"]).alias("xs"))


def in_order(parts: DataFrame, most: int, last: bool = True) -> DataFrame:
    """(block, n, x): sums of arrays (block, n, x) in order of n, FAN_IN at a time, so that neither partitions nor arrival change a bit, and no task adds up more than FAN_IN of
    them at once: one of each block, or, not last, FAN_IN at most, which are still to be added up."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from frames({"block": r.block, "n": r.n, "x": ordered_sum(r.xs).tobytes()} for b in batches for r in b.itertuples(index=False))

    out = parts.select("block", "n", "x")
    while most > (1 if last else FAN_IN):
        out = listed(out.withColumn("g", F.expr(f"n div {FAN_IN}")), "block", "g").withColumnRenamed("g", "n").mapInPandas(add, "block long, n long, x binary")
        most = -(-most // FAN_IN)
    return out


def total(blocks: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """One row (total): the sum of arrays of doubles of all blocks, likewise in a fixed order, by SQL. A block's array has K, or K * K, numbers."""

    def added(c: Column) -> Column:
        items = F.array_sort(c)
        rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
        return F.aggregate(rest, F.get(items, F.lit(0))["a"], lambda s, x: F.zip_with(s, x["a"], lambda p, q: p + q))

    out = blocks.select(F.col(key).cast("bigint").alias("n"), F.col(value).alias("a"))
    while most > 1:
        most = -(-most // FAN_IN)
        grouped = out.groupBy(F.expr(f"n div {FAN_IN}").alias("g")) if most > 1 else out.groupBy()
        out = grouped.agg(added(F.collect_list(F.struct("n", "a"))).alias("a"), F.expr(f"min(n) div {FAN_IN}").alias("n")).select("n", "a")
    return out.select(F.col("a").alias("total"))


def matrix_of(blocks: DataFrame, k: int, key: str, value: str, out: str, size: int) -> DataFrame:
    """(out, k, value) long, of a factor's blocks of size rows each: out is i (long) or j (int)."""
    kind = "long" if out == "i" else "int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = np.cumsum([len(x) for x in b[value]]) // FRAME
            for _, g in b.groupby(ends):  # some blocks at a time
                at = np.concatenate([block * size + np.arange(len(x) // (8 * k)) for block, x in zip(g[key], g[value], strict=True)])
                yield pd.DataFrame({out: np.repeat(at, k), "k": np.tile(np.arange(k, dtype=np.int32), len(at)), value: np.frombuffer(b"".join(g[value]))})

    return blocks.select(key, value).mapInPandas(run, f"{out} {kind}, k int, {value} double")
