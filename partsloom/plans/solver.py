"""The factorization: updates until the columns' clustering stays the same.

V is dealt out as tiles once and stays where it is. A half-step sends blocks of both factors to the tiles, adds their numerators up by block in a fixed order, and writes the
new factor, in blocks, to the shared folder; tests count classes block by block. Neither V nor a factor is ever whole in a task or on the driver. A
matrix of few cells can be solved in one task instead, as a job a step would cost more than the step; the results are the same, to rounding.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import R_MIN
from ..model import Matrix, MatrixError
from ..operators import matrix as mx
from ..operators.start import FACTOR, PRIME, new_seed
from ..session import checkpoint_dir
from ..sources.compose import delete, exists
from ..sources.validate import check_rank
from .tiles import CELL_BYTES, SENT, Tiling, floored, frames, in_order, listed, matrix_of, met, ordered_sum, partial, passed, plan, spread, total

#: Cells of V up to which one task solves all, and bytes that a task may take for a tile and its factors' blocks.
LOCAL_CELLS, MEMORY = 4_000_000, 256_000_000


@dataclass(frozen=True)
class Options:
    k: int = 2
    iterations: int = 2000
    period: int = 10
    threshold: int = 40
    seed: int | None = None
    #: Cells up to which one task solves all; the results are the same, to rounding, either way.
    local_cells: int = LOCAL_CELLS
    #: Bytes of a task beyond that; tiles are planned for it.
    memory: int = MEMORY

    def __post_init__(self):
        for what in ("iterations", "period", "threshold"):
            if getattr(self, what) < 1:
                raise ValueError(f"{what} must be positive")
        if self.k < 2:
            raise ValueError("k must be 2 at least")


@dataclass(frozen=True)
class Result:
    """w (i, k, w), h (j, k, h), the number of iterations, whether the clustering settled, the relative distance, the tests: (test, iter, diff, inc),
    and, of a run by tiles, what was done: {step: [calls, tiles, stored cells, seconds]} for the steps spread, start, H, W, floor, test and distance."""

    w: DataFrame
    h: DataFrame
    iterations: int
    converged: bool
    distance: float
    trace: list[tuple[int, int, int, int]]
    steps: dict[str, list] = field(default_factory=dict)


def start_values(index: np.ndarray, k: int, matrix: int, seed: int) -> np.ndarray:
    """The same numbers as operators.start gives."""
    step = lambda x: (x * FACTOR) % PRIME
    col = np.arange(1, k + 1, dtype=np.int64)[None, :]
    x = step((index.astype(np.int64)[:, None] % PRIME + col * 7919 + matrix * 104729 + seed % PRIME) % PRIME)
    return step(step((x + col * 15485863) % PRIME)) / float(PRIME) + R_MIN


def ratios(v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """V / (W H); where V is zero that is zero, even if W H has become so small that it is zero too, as in the updates on long tables."""
    return np.where(v == 0, 0.0, v / (w @ h.T))


def next_h(h: np.ndarray, num: np.ndarray, acc: np.ndarray) -> np.ndarray:
    return h * num / acc


def next_w(v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return w * (ratios(v, w, h) @ h) / h.sum(axis=0)


def difference(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Pairs that share a class in one of two classifications only."""
    pairs = lambda n: int((n.astype(np.int64) * (n.astype(np.int64) - 1) // 2).sum())
    return pairs(np.bincount(a, minlength=k)) + pairs(np.bincount(b, minlength=k)) - 2 * pairs(np.bincount(a * k + b, minlength=k * k))


class Watch:
    """The stopping rule: the first test is against one class for all, and threshold + 1 tests without a change in a row end the run."""

    def __init__(self, columns: int, options: Options):
        self.last, self.inc, self.options = np.zeros(columns, np.int64), 0, options
        self.trace: list[tuple[int, int, int, int]] = []

    def settled(self, h: np.ndarray) -> bool:
        cls = h.argmax(axis=1)
        diff, self.last = difference(cls, self.last, self.options.k), cls
        return self.counted(diff)

    def counted(self, diff: int) -> bool:
        """A test at which diff pairs had joined or parted."""
        done = False
        if diff:
            self.inc = 0
        elif self.inc < self.options.threshold:
            self.inc += 1
        else:
            done = True
        n = len(self.trace) + 1
        self.trace.append((n, n * self.options.period, diff, self.inc))
        return done


def solve_array(v: np.ndarray, o: Options, seed: int) -> tuple[np.ndarray, np.ndarray, int, bool, float, list]:
    """All in memory; h is columns by K."""
    with np.errstate(all="ignore"):
        w, h = start_values(np.arange(v.shape[0]), o.k, 0, seed), start_values(np.arange(v.shape[1]), o.k, 1, seed)
        watch, done = Watch(v.shape[1], o), False
        once = lambda w, h: (next_w(v, w, g := next_h(h, ratios(v, w, h).T @ w, w.sum(axis=0))), g)
        for _ in range(o.iterations // o.period):
            for _ in range(o.period):
                w, h = once(w, h)
            w, h = floored(w), floored(h)
            if done := watch.settled(h):
                break
        if not done:
            for _ in range(o.iterations % o.period):
                w, h = once(w, h)
        distance = float(np.sqrt(((v - w @ h.T) ** 2).sum()) / np.sqrt((v * v).sum()))
    return w, h, len(watch.trace) * o.period if done else o.iterations, done, distance, watch.trace


def factorize(m: Matrix, options: Options = Options(), local_cells: int | None = None, folder: str | None = None, on_test: Callable[[tuple[int, int, int, int]], None] | None = None) -> Result:
    """folder: where a run by tiles writes its state after each test; if it holds one, of the same matrix and options, the run goes on from there. on_test is told each line of the trace."""
    check_rank(options.k, m)
    alone = m.n_rows * m.n_cols <= (options.local_cells if local_cells is None else local_cells)
    seed = new_seed() if options.seed is None else options.seed
    return _in_one_task(m, options, seed) if alone and not folder else _by_tiles(m, options, seed, folder, on_test)


def _long(spark: SparkSession, factor: np.ndarray, key: str, value: str) -> DataFrame:
    kind = "bigint" if key == "i" else "int"
    n, k = factor.shape
    data = pd.DataFrame({key: np.repeat(np.arange(n), k), "k": np.tile(np.arange(k), n), value: factor.ravel()})
    return spark.createDataFrame(data, f"{key} {kind}, k int, {value} double")


def _in_one_task(m: Matrix, o: Options, seed: int) -> Result:
    spark, shape = m.cells.sparkSession, (m.n_rows, m.n_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = np.zeros(shape)
        for b in batches:
            v[b["i"], b["j"]] = b["v"]
        w, h, n, done, distance, trace = solve_array(v, o, seed)
        yield pd.DataFrame({"w": [w.tobytes()], "h": [h.tobytes()], "n": [n], "done": [done], "distance": [distance], "trace": [np.array(trace, "<i8").tobytes()]})

    r = m.cells.coalesce(1).mapInPandas(run, "w binary, h binary, n int, done boolean, distance double, trace binary").first()
    w, h = (np.frombuffer(bytes(r[c])).reshape(-1, o.k) for c in "wh")
    trace = [tuple(x) for x in np.frombuffer(bytes(r["trace"]), "<i8").reshape(-1, 4).tolist()]
    return Result(_long(spark, w, "i", "w"), _long(spark, h, "j", "h"), r["n"], r["done"], r["distance"], trace)


def cross(now: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """How many columns are of each pair of classes, now and at the test before."""
    return np.bincount(now * k + last, minlength=k * k).reshape(k, k)


def crossed_difference(n: np.ndarray) -> int:
    """difference(), from the counts of cross()."""
    pairs = lambda x: sum(int(y) * (int(y) - 1) // 2 for y in x.ravel())
    return pairs(n.sum(axis=0)) + pairs(n.sum(axis=1)) - 2 * pairs(n)


@dataclass
class State:
    """What a run needs to go on: which tables of the folder hold the factors after so many iterations, and the tests so far."""

    shape: list[int]
    options: dict
    seed: int
    tile: list[int]
    iteration: int
    w: int
    h: int
    inc: int
    done: bool
    trace: list[list[int]]
    steps: dict[str, list]


class Run:
    """A factorization by tiles. Factors are tables of blocks: (rb, w, acc) and (cb, h, acc, cls), with acc the block's sums by factor and cls the classes at the last test."""

    W, H = "rb long, w binary, acc array<double>", "cb long, h binary, acc array<double>, cls binary"

    def __init__(self, m: Matrix, o: Options, seed: int, folder: str | None):
        self.spark, self.m, self.o, self.kept = m.cells.sparkSession, m, o, folder is not None
        self.folder = folder or f"{checkpoint_dir(self.spark)}/factors-{uuid.uuid4().hex}"
        self.steps: dict[str, list] = {}
        self.turn, self.watch, self.iteration, self.done = 0, Watch(0, o), 0, False
        self.numerators: tuple[int, int, int] | None = None  # the table of tall tiles that holds H's next ones, and the tiles and cells that gave them
        old = self._load()
        if old:
            if old.shape != [m.n_rows, m.n_cols] or old.options != self._options() or (o.seed is not None and seed != old.seed):
                raise MatrixError(f"{self.folder} holds the state of another run")
            self.tiling, self.seed = Tiling(m.n_rows, m.n_cols, *old.tile), old.seed
        else:
            cells = m.cells.count()
            self.tiling, self.seed = plan(m.n_rows, m.n_cols, cells, o.k, o.memory), seed
        with self._step("spread"):
            self.tiles = spread(m.cells, self.tiling, max(1, o.memory // (2 * CELL_BYTES)))
        if old:
            self.turn, self.iteration, self.done, self.steps = max(old.w, old.h), old.iteration, old.done, old.steps
            self.watch.inc, self.watch.trace = old.inc, [tuple(x) for x in old.trace]
            self.w_at, self.h_at = old.w, old.h
        else:
            with self._step("start"):
                self.w_at, self.h_at = self._start(0), self._start(1)

    def _options(self) -> dict:
        return {k: v for k, v in asdict(self.o).items() if k not in ("seed", "local_cells")}

    # tables of the folder

    def _save(self, df: DataFrame) -> int:
        self.turn += 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{self.turn}")
        return self.turn

    def _read(self, at: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}")

    @property
    def w(self) -> DataFrame:
        return self._read(self.w_at, self.W)

    @property
    def h(self) -> DataFrame:
        return self._read(self.h_at, self.H)

    def _drop(self, *turns: int) -> None:
        for t in turns:
            delete(self.spark, f"{self.folder}/{t}")

    def _load(self) -> State | None:
        path = f"{self.folder}/state"
        if not self.kept or not exists(self.spark, path):
            return None
        return State(**json.loads(max(self.spark.read.text(path).collect(), key=lambda r: json.loads(r["value"])["iteration"])["value"]))

    def store(self) -> None:
        """The state is added under its own name before the one before is deleted, so there is always a whole one."""
        if self.kept:
            s = State([self.m.n_rows, self.m.n_cols], self._options(), self.seed, [self.tiling.rows, self.tiling.cols], self.iteration, self.w_at, self.h_at, self.watch.inc, self.done, [list(x) for x in self.watch.trace], self.steps)
            self.spark.createDataFrame([(json.dumps(asdict(s)),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/state")

    # steps

    def _step(self, name: str):
        return Step(self.steps, name)

    def _start(self, which: int) -> int:
        t, k, seed = self.tiling, self.o.k, self.seed
        size, count, of = (t.rows, t.row_blocks, t.rows_of) if which == 0 else (t.cols, t.col_blocks, t.cols_of)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
            for b in batches:
                for block in b["id"].tolist():
                    x = start_values(block * size + np.arange(of(block)), k, which, seed)
                    yield {"rb": block, "w": x.tobytes(), "acc": x.sum(axis=0)} if which == 0 else {"cb": block, "h": x.tobytes(), "acc": x.sum(axis=0), "cls": np.zeros(len(x), "<i4").tobytes()}

        return self._save(self.spark.range(count).mapInPandas(lambda batches: frames(run(batches)), self.H if which else self.W))

    def update(self, side: str, floor: bool = False) -> None:
        """One half-step: the factor of that side from the numerators at the tiles and the other factor's sums."""
        t, k = self.tiles, self.o.k
        seen = Observation()
        with self._step(side.upper()) as step:
            parts = partial(met(t, self.w, self.h, k), k, side).observe(seen, F.count("*").alias("tiles"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"))
            own, key, most, other, other_key, n = (self.h, "cb", t.most_h, self.w, "rb", t.tiling.row_blocks) if side == "h" else (self.w, "rb", t.most_w, self.h, "cb", t.tiling.col_blocks)
            acc = total(other, other_key, "acc", n)
            sums = listed(in_order(parts, most, last=False), F.col("block").alias(key))
            own = own.join(sums, key, "left").join(F.broadcast(acc))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
                for r in (r for b in batches for r in b.itertuples(index=False)):
                    num, x = ordered_sum(() if r.xs is None else r.xs), np.frombuffer(getattr(r, side)).reshape(-1, k)
                    with np.errstate(all="ignore"):
                        x = x * (np.zeros_like(x) if num is None else num.reshape(-1, k)) / np.asarray(r.total)
                    x = floored(x) if floor else x
                    yield {key: getattr(r, key), side: x.tobytes(), "acc": x.sum(axis=0), **({"cls": r.cls} if side == "h" else {})}

            new = own.mapInPandas(lambda batches: frames(run(batches)), self.H if side == "h" else self.W)
            at, old = self._save(new), self.h_at if side == "h" else self.w_at
            got = seen.get
            step.done(got["tiles"], got["cells"])
        if side == "h":
            self.h_at = at
        else:
            self.w_at = at
        self._retire(old)

    def iterate(self, floor: bool, last: bool) -> None:
        """Both half-steps. Tall tiles take one pass over V for them: the rows of a tile need all of H, which is one block, and no other rows, so the task that has made them gives H's numerators for the next iteration as well."""
        if not self.tiles.tall:
            self.update("h")
            self.update("w", floor=floor)
            return
        if self.numerators is None:
            with self._step("H"):
                self._pass(False, False, True)
            self.steps["H"][0] -= 1  # it belongs to the call that follows
        with self._step("H") as step:
            old, self.h_at = self.h_at, self._next_h()
            step.done(*self.numerators[1:])
        self._retire(old)
        with self._step("W") as step:
            old = self.w_at
            self._pass(True, floor, not last)
            step.done(*self.numerators[1:])
        self._retire(old)

    def _pass(self, update: bool, floor: bool, numerators: bool) -> None:
        seen = Observation()
        rows = passed(met(self.tiles, self.w, self.h, self.o.k), self.o.k, update, floor, numerators).observe(seen, F.count("*").alias("tiles"), F.sum("cells").alias("cells"))
        at = self._save(rows if update else rows.select("rb", "x"))
        if update:
            self.w_at = at
        self.numerators = at, seen.get["tiles"], seen.get["cells"]

    def _next_h(self) -> int:
        """H's one block from the numerators of all tiles, which one task adds up in order, one at a time, behind H; if they take more than SENT bytes, they are added up by FAN_IN first."""
        k, n = self.o.k, self.tiling.row_blocks
        at = self.numerators[0]
        parts = self._read(at, "rb long, x binary").select(F.lit(0).cast("bigint").alias("block"), F.col("rb").alias("n"), "x")
        if n * (self.m.n_cols + 1) * k * 8 > SENT:
            parts = in_order(parts, n, last=False)
        every = self.h.select(F.lit(-1).cast("bigint").alias("n"), F.col("h").alias("x"), "cls").unionByName(parts.select("n", "x", F.lit(None).cast("binary").alias("cls")))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (r for b in batches for r in b.itertuples(index=False))
            own = next(rows, None)
            if own is None:
                return
            x, num = np.frombuffer(own.x).reshape(-1, k), ordered_sum(r.x for r in rows)
            with np.errstate(all="ignore"):
                x = x * num[:-k].reshape(-1, k) / num[-k:]
            yield pd.DataFrame({"cb": [0], "h": [x.tobytes()], "acc": [x.sum(axis=0)], "cls": [own.cls]})

        new = self._save(every.coalesce(1).sortWithinPartitions("n").mapInPandas(run, self.H))
        if at != self.w_at:
            self._drop(at)
        return new

    def _retire(self, old: int) -> None:
        """Tables that the last stored state names stay until there is a newer state."""
        if self.kept:
            self.old = [*getattr(self, "old", []), old]
        else:
            self._drop(old)

    def test(self) -> bool:
        """Floors H, classes its columns and counts what has changed since the test before; only K * K counts come to the driver."""
        k = self.o.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
            for b in batches:
                for r in b.itertuples(index=False):
                    x = floored(np.frombuffer(r.h).reshape(-1, k))
                    now = x.argmax(axis=1)
                    yield {"cb": r.cb, "h": x.tobytes(), "acc": x.sum(axis=0), "cls": now.astype("<i4").tobytes(), "n": cross(now, np.frombuffer(r.cls, "<i4").astype(np.int64), k).ravel()}

        with self._step("test"):
            path, old = self._save(self.h.mapInPandas(lambda batches: frames(run(batches)), f"{self.H}, n array<long>")), self.h_at
            counts = self._read(path, f"{self.H}, n array<long>").select(F.posexplode("n").alias("p", "n")).groupBy("p").agg(F.sum("n").alias("n"))
            n = np.zeros(k * k, np.int64)
            for r in counts.collect():
                n[r["p"]] = r["n"]
            self.h_at = path
        self._retire(old)
        return self.watch.counted(crossed_difference(n.reshape(k, k)))

    def distance(self) -> float:
        """From sums at the stored cells and K * K Gram matrices; if V is met so closely that their difference has no digits left, from all cells."""
        k = self.o.k

        def gram(blocks: DataFrame, key: str, value: str, n: int) -> np.ndarray:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
                for b in batches:
                    for at, x in zip(b[key], b[value], strict=True):
                        a = np.frombuffer(x).reshape(-1, k)
                        yield {key: at, "g": (a.T @ a).ravel()}

            return np.array(total(blocks.select(key, value).mapInPandas(lambda batches: frames(run(batches)), f"{key} long, g array<double>"), key, "g", n).first()[0]).reshape(k, k)

        seen = Observation()
        with self._step("distance") as step:
            parts = partial(met(self.tiles, self.w, self.h, k), k, "d").observe(seen, F.count("*").alias("tiles"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"))
            unpacked = in_order(parts, self.tiles.most_h).mapInPandas(lambda bs: (pd.DataFrame({"cb": b["block"], "a": [np.frombuffer(x) for x in b["x"]]}) for b in bs), "cb long, a array<double>")
            dot_v, stored, products = total(unpacked, "cb", "a", self.tiling.col_blocks).first()[0]
            step.done(seen.get["tiles"], seen.get["cells"])
            every = float((gram(self.w, "rb", "w", self.tiling.row_blocks) * gram(self.h, "cb", "h", self.tiling.col_blocks)).sum())
            square = stored + max(0.0, every - products)  # and the cells of V that are zero
            if not square > mx.NEAR * dot_v:
                square = mx.dot_v_vwh(self.m.cells, *self.factors()).first()["dot_vwh"]
        return float(np.sqrt(square) / np.sqrt(dot_v))

    def factors(self) -> tuple[DataFrame, DataFrame]:
        return matrix_of(self.w, self.o.k, "rb", "w", "i", self.tiling.rows), matrix_of(self.h, self.o.k, "cb", "h", "j", self.tiling.cols)


class Step:
    """Counts a step's calls, tiles, stored cells and seconds."""

    def __init__(self, steps: dict[str, list], name: str):
        self.row = steps.setdefault(name, [0, 0, 0, 0.0])

    def __enter__(self) -> Step:
        self.began = time.monotonic()
        return self

    def done(self, tiles: int, cells: int) -> None:
        self.row[1] += tiles
        self.row[2] += cells

    def __exit__(self, *_) -> None:
        self.row[0] += 1
        self.row[3] += time.monotonic() - self.began


def _by_tiles(m: Matrix, o: Options, seed: int, folder: str | None = None, on_test: Callable | None = None) -> Result:
    run = Run(m, o, seed, folder)
    while run.iteration < o.iterations and not run.done:
        n = run.iteration + 1
        test = n % o.period == 0
        run.iterate(floor=test, last=n == o.iterations)
        if test:
            run.done = run.test()
        run.iteration = n
        if test:
            run.store()
            run._drop(*getattr(run, "old", []))
            run.old = []
            if on_test:
                on_test(run.watch.trace[-1])
    w, h = run.factors()
    return Result(w, h, run.iteration, run.done, run.distance(), run.watch.trace, run.steps)
