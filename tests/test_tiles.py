"""The solver by tiles: against one task, on any partitions, with hot tiles, broken off and taken up again; plans; exact sums."""

import io
import math
import tracemalloc
from contextlib import redirect_stdout
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from partsloom import MatrixError
from partsloom.functions.exact import exact_sums
from partsloom.operators import matrix as mx
from partsloom.plans import solver, tiles
from partsloom.plans.solver import Options, Run, factorize
from test_matrix import array, matrix

RNG = np.random.default_rng(9)


def sparse(n, m, share):
    v = np.where(RNG.random((n, m)) < share, RNG.random((n, m)) + 0.1, 0)
    v[np.arange(n), np.arange(n) % m] = 1
    v[np.arange(m) % n, np.arange(m)] = 2
    return v


def same(a, b, shape, k):
    n, m = shape
    assert (a.iterations, a.converged, a.trace) == (b.iterations, b.converged, b.trace)
    assert math.isclose(a.distance, b.distance, rel_tol=1e-9)
    assert np.allclose(array(a.w, (n, k), "ikw"), array(b.w, (n, k), "ikw"), rtol=1e-9)
    assert np.allclose(array(a.h, (m, k), "jkh"), array(b.h, (m, k), "jkh"), rtol=1e-9)


@pytest.mark.parametrize(("memory", "sent"), [(8_000, 0), (8_000, tiles.SENT), (10_000_000, tiles.SENT)])
def test_tiles_match_one_task(spark, monkeypatch, memory, sent):
    monkeypatch.setattr(tiles, "SENT", sent)
    v = sparse(31, 13, 0.3)
    o = Options(2, 5, 2, 40, 3, memory=memory)
    assert (tiles.plan(31, 13, 100, 2, 8_000).row_blocks > 2) and tiles.plan(31, 13, 100, 2, 8_000).col_blocks > 1
    b = factorize(matrix(spark, v), o, local_cells=0)
    same(factorize(matrix(spark, v), o), b, v.shape, 2)
    assert b.steps["H"][0] == b.steps["W"][0] == 5 and b.steps["test"][0] == 2 and b.steps["H"][2] == 5 * np.count_nonzero(v) and b.steps["distance"][2] == np.count_nonzero(v)


def test_sums_of_more_blocks_than_are_added_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FAN_IN", 2)
    v, o = sparse(40, 9, 0.4), Options(2, 2, 2, 40, 3, memory=4_000)
    same(factorize(matrix(spark, v), o), factorize(matrix(spark, v), o, local_cells=0), v.shape, 2)


def test_a_whole_run_to_the_end(spark):
    v = np.kron(np.eye(2), np.ones((6, 4))) + 0.01
    o = Options(2, 100, 1, 2, 5, memory=6_000)
    b = factorize(matrix(spark, v), o, local_cells=0)
    assert b.converged and b.iterations < 100
    same(factorize(matrix(spark, v), o), b, v.shape, 2)


def test_the_same_bits_on_any_partitions(spark):
    v, o, out = sparse(40, 12, 0.4), Options(3, 2, 2, 40, 3, memory=9_000, local_cells=0), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            m = matrix(spark, v)
            r = factorize(type(m)(m.cells.repartition(n), *v.shape), o)
            out.append((sorted(map(tuple, r.w.collect())), sorted(map(tuple, r.h.collect())), r.distance))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] == out[2]


def test_a_hot_tile_is_split(spark):
    """A third of all cells in one tile: it is dealt out in parts of about the size asked for, and results are the same."""
    v = np.zeros((400, 40))
    v[:40, :10] = RNG.random((40, 10)) + 0.1
    at = RNG.integers(0, 400 * 40, 800)
    v.ravel()[at] = 1
    v[np.arange(400), np.arange(400) % 40] = 1
    m = matrix(spark, v)
    t = tiles.spread(m.cells, tiles.Tiling(400, 40, 40, 10), 40)
    sizes = [r["n"] for r in t.table.groupBy(*tiles.TILE).agg(F.sum(F.length("v") / 8).alias("n")).collect()]
    assert sum(sizes) == np.count_nonzero(v) and max(sizes) <= 130 and t.index.where("s > 0").count() >= 8
    o = Options(2, 2, 1, 40, 3, memory=20_000, local_cells=0)
    same(factorize(m, o, local_cells=10**9), factorize(m, o), v.shape, 2)


def test_v_is_not_moved(spark, monkeypatch):
    """The plan of a half-step has no exchange above the tiles, whatever the factors' sizes."""
    run = Run(matrix(spark, sparse(60, 20, 0.3)), Options(2, 1, 2, 40, 3, memory=9_000), 3, None)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size, sent in ((old, tiles.SENT), (old, 0), ("-1", 0)):
        monkeypatch.setattr(tiles, "SENT", sent)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            said = io.StringIO()
            with redirect_stdout(said):
                tiles.partial(tiles.met(run.tiles, run.w, run.h, 2), 2, "h").explain()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        lines = said.getvalue().splitlines()
        at = next(i for i, x in enumerate(lines) if "FileScan parquet spark_catalog.default.tiles_" in x)
        depth = lines[at].index("FileScan")
        above = [x for x in lines[:at] if len(x) - len(x.lstrip(" :+-*()0123456789")) < depth and "Exchange" in x]
        assert not above, said.getvalue()


def test_broken_off_and_taken_up(spark, tmp_path):
    v = sparse(24, 9, 0.4)
    o = Options(2, 9, 2, 40, 3, memory=8_000, local_cells=0)

    class Broken(Exception):
        pass

    def broken(test):
        if test[0] == 2:
            raise Broken

    folder = f"file://{tmp_path}/run"
    with pytest.raises(Broken):
        factorize(matrix(spark, v), o, folder=folder, on_test=broken)
    seen = []
    r = factorize(matrix(spark, v), o, folder=folder, on_test=seen.append)
    assert [x[0] for x in seen] == [3, 4] and r.steps["H"][0] == 9
    whole = factorize(matrix(spark, v), o)
    same(whole, r, v.shape, 2)
    assert sorted(map(tuple, whole.h.collect())) == sorted(map(tuple, r.h.collect()))
    with pytest.raises(MatrixError, match="another run"):
        factorize(matrix(spark, v), Options(2, 9, 3, 40, 3, memory=8_000, local_cells=0), folder=folder)


def test_only_the_last_factors_are_left(spark, tmp_path):
    made, run = [], Run(matrix(spark, sparse(20, 7, 0.5)), Options(2, 3, 4, 40, 3), 3, None)
    run._drop = lambda *t: made.extend(t)
    for _ in range(2):
        run.update("h")
        run.update("w")
    assert made == [2, 1, 3, 4] and (run.h_at, run.w_at) == (5, 6)


def test_an_exact_fit_has_no_distance_from_rounding(spark):
    """Where the fit is near exact the stored cells' sums have no digits left; all cells are looked at then."""
    w, h = RNG.random((12, 2)) + 0.5, RNG.random((9, 2)) + 0.5
    v = w @ h.T
    frame = lambda a, n: spark.createDataFrame([(i, k, float(a[i, k])) for i in range(len(a)) for k in range(2)], n)
    got = mx.dots(matrix(spark, v).cells, frame(w, "i bigint, k int, w double"), frame(h, "j int, k int, h double")).first()
    assert 0 <= got["dot_vwh"] < 1e-28 * got["dot_v"] * 100


def test_plans_shrink_both_sides():
    for n, m, cells, k, memory in ((10**6, 10**6, 10**9, 10, 256_000_000), (10**9, 50, 10**10, 5, 256_000_000), (50, 10**9, 10**9, 5, 64_000_000), (10, 10, 100, 2, 10**9)):
        t = tiles.plan(n, m, cells, k, memory)
        assert tiles.tile_bytes(t.rows, t.cols, cells / (n * m), k) <= memory
        assert t.row_blocks * t.rows >= n > (t.row_blocks - 1) * t.rows and t.col_blocks * t.cols >= m > (t.col_blocks - 1) * t.cols
    assert tiles.plan(10**6, 10**6, 10**9, 10, 256_000_000).row_blocks > 1 < tiles.plan(10**6, 10**6, 10**9, 10, 256_000_000).col_blocks
    assert (tiles.plan(10, 10, 100, 2, 10**9).rows, tiles.plan(10, 10, 100, 2, 10**9).cols) == (10, 10)
    with pytest.raises(MatrixError):
        tiles.plan(10, 10, 100, 2, 10)


def test_kernels_and_what_they_take():
    """At 1 % of stored cells the sparse kernel takes under a tenth of what dense products take, and gives the same."""
    n, k = 1500, 3
    v = np.where(RNG.random((n, n)) < 0.01, RNG.random((n, n)) + 0.1, 0)
    w, h = RNG.random((n, k)) + 0.1, RNG.random((n, k)) + 0.1
    a = tiles.Rows.of(*np.nonzero(v), v[np.nonzero(v)])
    assert np.allclose(a.for_h(w, h), solver.ratios(v, w, h).T @ w) and np.allclose(a.for_w(w, h), solver.ratios(v, w, h) @ h)
    assert np.allclose(a.dots(w, h), [(v * v).sum(), ((v - w @ h.T)[v > 0] ** 2).sum(), ((w @ h.T)[v > 0] ** 2).sum()])

    def most(f):
        tracemalloc.start()
        f()
        return (tracemalloc.get_traced_memory()[1], tracemalloc.stop())[0]

    for f, g in ((lambda: a.for_h(w, h), lambda: solver.ratios(v, w, h).T @ w), (lambda: a.for_w(w, h), lambda: solver.ratios(v, w, h) @ h)):
        assert most(f) < most(g) / 10
    empty = tiles.Rows.of(*(np.zeros(0, int),) * 2, np.zeros(0))
    assert (empty.for_w(w, h) == 0).all() and (empty.for_h(w, h) == 0).all()


def test_class_counts_give_the_difference():
    for _ in range(30):
        a, b = RNG.integers(0, 4, (2, 50))
        assert solver.crossed_difference(solver.cross(a, b, 4)) == solver.difference(a, b, 4)


def test_exact_sums(spark):
    """The nearest double to the true sum, on any partitions; cancelling, tiny and huge values, infinities, nulls."""
    x = np.concatenate([RNG.normal(size=300) * 10.0 ** RNG.integers(-300, 300, 300), [1e308, -1e308, 5e-324, -5e-324, 1e16, 1.0, -1e16]])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)] + [(3, float("inf")), (3, 1.0), (4, float("inf")), (4, float("-inf")), (5, None), (6, float("nan")), (7, 1.7e308), (7, 1.7e308)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = [{r["g"]: r["s"] for r in exact_sums(df.repartition(n), ["g"], {"s": "x"}).collect()} for n in (1, 4, 16)]
    for g in range(3):
        want = float(sum((Fraction(v) for h, v in rows if h == g), Fraction(0)))
        assert all(y[g] == want for y in got)
    assert got[0][3] == math.inf and math.isnan(got[0][4]) and got[0][5] == 0 and math.isnan(got[0][6]) and got[0][7] == math.inf
    assert exact_sums(df.limit(0), [], {"s": "x"}).collect()[0]["s"] == 0
    two = exact_sums(df.where("g < 3"), [], {"a": "x", "b": "x"}).first()
    assert two["a"] == two["b"] == float(sum((Fraction(v) for g, v in rows if g < 3), Fraction(0)))


def test_tall_tiles_take_one_pass(spark, tmp_path, monkeypatch):
    """With one block of columns V is read once an iteration, and once before the first; results are those of one task, also by FAN_IN, in few buckets and after a break."""
    v, passes = sparse(60, 5, 0.8), []
    o = Options(2, 5, 2, 40, 3, memory=9_000, local_cells=0)
    assert tiles.plan(60, 5, np.count_nonzero(v), 2, 9_000).row_blocks > 4
    met = solver.met
    monkeypatch.setattr(solver, "met", lambda *a: (passes.append(1), met(*a))[1])
    a = factorize(matrix(spark, v), o)
    assert len(passes) == 7 and a.steps["H"][:1] + a.steps["W"][:1] == [5, 5] and a.steps["H"][2] == a.steps["W"][2] == 5 * np.count_nonzero(v)
    same(factorize(matrix(spark, v), o, local_cells=10**9), a, v.shape, 2)
    monkeypatch.setattr(solver, "SENT", 0)
    monkeypatch.setattr(tiles, "FAN_IN", 2)

    def broken(test):
        raise InterruptedError

    with pytest.raises(InterruptedError):
        factorize(matrix(spark, v), o, folder=f"file://{tmp_path}/run", on_test=broken)
    same(a, factorize(matrix(spark, v), o, folder=f"file://{tmp_path}/run"), v.shape, 2)


def test_small_tiles_need_no_more_buckets(spark):
    v = sparse(300, 4, 0.9)
    t = tiles.spread(matrix(spark, v).cells, tiles.Tiling(300, 4, 2, 4), 1)
    assert t.index.count() >= 150 and t.table.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_tiles_where_one_would_do_for_the_memory():
    t = tiles.plan(60_000, 83, 4_951_860, 3, 256_000_000)
    assert t.row_blocks >= 16 and t.col_blocks == 1 and tiles.plan(360_000, 83, 29_711_160, 3, 256_000_000).row_blocks >= 64


def test_whole_blocks_where_most_cells_are_stored():
    v = sparse(30, 7, 0.9)
    w, h = RNG.random((30, 3)) + 0.1, RNG.random((7, 3)) + 0.1
    a = tiles.Rows.of(*np.nonzero(v), v[np.nonzero(v)])
    assert a.full(w, h) and not a.full(w, np.where(h > 1, np.inf, h) + [np.inf, 0, 0])
    assert np.allclose(a.for_h(w, h), solver.ratios(v, w, h).T @ w) and np.allclose(a.for_w(w, h), solver.ratios(v, w, h) @ h)
