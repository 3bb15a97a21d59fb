"""Operators and solver against numpy, readers and writers against small files, queries against SQL."""

import math
import os

import duckdb
import numpy as np
import pytest

from partsloom import MatrixError
from partsloom.cli import main, parser
from partsloom.functions.numeric import R_MIN
from partsloom.model import Matrix
from partsloom.operators import matrix as mx
from partsloom.operators.start import start_h, start_w
from partsloom.plans import solver
from partsloom.plans.solver import Options, Watch, difference, factorize, solve_array, start_values
from partsloom.plans.updates import iterate, update_h
from partsloom.queries import QUERIES, SQL
from partsloom.sources import binary, files
from partsloom.sources.text import infer, read_text

RNG = np.random.default_rng(5)


def matrix(spark, v, **tags):
    cells = [(int(i), int(j), float(v[i, j])) for i, j in zip(*np.nonzero(v), strict=True)]
    return Matrix(spark.createDataFrame(cells, "i bigint, j int, v double"), *v.shape, **tags)


def array(df, shape, cols):
    out = np.zeros(shape)
    for r in df.select(*cols).collect():
        out[r[0], r[1]] = r[2]
    return out


def write(tmp_path, text, name="m.txt"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_updates_match_numpy(spark):
    v = RNG.integers(0, 9, (12, 7)).astype(float) + np.eye(12, 7)
    m = matrix(spark, v)
    w, h = start_w(spark, 12, 3, 8), start_h(spark, 7, 3, 8)
    assert np.allclose(array(w, (12, 3), "ikw"), start_values(np.arange(12), 3, 0, 8))
    w2, h2 = iterate(m.cells, w, h, 2)
    wn, hn, n, done, distance, trace = solve_array(v, Options(3, 2, 5), 8)
    assert (n, done, trace) == (2, False, [])
    assert np.allclose(array(w2, (12, 3), "ikw"), wn, rtol=1e-12) and np.allclose(array(h2, (7, 3), "jkh"), hn, rtol=1e-12)
    got = mx.relative_distance(mx.dot_v_vwh(m.cells, w2, h2)).first()[0]
    assert math.isclose(got, distance, rel_tol=1e-12)
    assert math.isclose(mx.relative_distance(mx.dot_gram(m.cells, w2, h2)).first()[0], distance, rel_tol=1e-9)


def test_divergence_never_rises():
    v = RNG.random((15, 9)) + 0.01
    last = np.inf
    for n in (1, 2, 4, 8, 16):
        w, h, *_ = solve_array(v, Options(3, n, 100), 1)
        x = w @ h.T
        now = (v * np.log(v / x) - v + x).sum()
        assert now <= last * (1 + 1e-12)
        last = now


def test_stop_needs_one_test_more_than_the_threshold():
    o = Options(2, 100, 5, 3)
    watch, h = Watch(4, o), np.array([[0.0, 1], [1, 0], [1, 0], [0, 1]])
    assert [watch.settled(h) for _ in range(5)] == [False] * 4 + [True]
    assert watch.trace == [(1, 5, 4, 0), (2, 10, 0, 1), (3, 15, 0, 2), (4, 20, 0, 3), (5, 25, 0, 3)]
    one = Watch(4, o)  # all in one class at first counts as no change
    assert [one.settled(np.ones((4, 2))) for _ in range(4)] == [False] * 3 + [True]


def test_more_between_tests_than_iterations_means_no_test():
    *_, trace = solve_array(RNG.random((5, 4)) + 0.1, Options(2, 3, 10), 1)
    assert trace == []


def test_difference_against_all_pairs():
    for _ in range(50):
        a, b = RNG.integers(0, 4, (2, 17))
        pairs = sum((a[i] == a[j]) != (b[i] == b[j]) for i in range(17) for j in range(i))
        assert difference(a, b, 4) == pairs
    assert difference(np.array([0, 0, 1]), np.array([1, 1, 0]), 2) == 0


def test_ties_go_to_the_lowest_class(spark):
    h = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 2.0), (1, 0, 5.0), (1, 1, 5.0), (1, 2, 0.0)], "j int, k int, h double")
    assert sorted(map(tuple, mx.classify(h).collect())) == [(0, 1), (1, 0)]


def test_adjust_and_division(spark):
    odd = spark.createDataFrame([(0, float("nan")), (1, 0.0), (2, -1.0), (3, R_MIN), (4, 1.0), (5, float("inf"))], "i int, w double")
    assert [r["w"] for r in mx.adjust(odd, "w").orderBy("i").collect()] == [R_MIN] * 4 + [1.0, float("inf")]
    wh = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 4.0)], "i bigint, j int, wh double")
    v = spark.createDataFrame([(0, 1, 3.0), (1, 1, 3.0)], "i bigint, j int, v double")
    r = array(mx.divide(v, wh), (2, 2), "ijr")
    assert math.isnan(r[0, 0]) and r[0, 1] == np.inf and r[1, 0] == 0 and r[1, 1] == 0.75


@pytest.mark.parametrize(
    ("text", "options", "name", "headers", "labels", "v"),
    [
        ("name\th1\th2\nr1\t1\t2\nr2\t3\t4\n", {}, "name", ["h1", "h2"], ["r1", "r2"], [[1, 2], [3, 4]]),
        ("h1\th2\n1\t2\n3\t4\n", {}, None, ["h1", "h2"], None, [[1, 2], [3, 4]]),
        ("my matrix\n1\t2\n3\t4\n", {}, "my matrix", None, None, [[1, 2], [3, 4]]),
        ("1\t2\n3\t4", {}, None, None, None, [[1, 2], [3, 4]]),
        ("7\t1\t2\n8\t3\t4\n", {"numeric_labels": True}, None, None, ["7", "8"], [[1, 2], [3, 4]]),
        ("7\t1\t2\n8\t3\t4\n", {}, None, None, None, [[7, 1, 2], [8, 3, 4]]),
        ("5\t6\n1\t2\n3\t4\n", {"numeric_headers": True}, None, ["5", "6"], None, [[1, 2], [3, 4]]),
        ("5\t6\n1\t2\n3\t4\n", {}, None, None, None, [[5, 6], [1, 2], [3, 4]]),
        ("name h1 h2\nr1 1 2\nr2 3 4\n", {}, "name", ["h1", "h2"], ["r1", "r2"], [[1, 2], [3, 4]]),
        ("1 2\n3 4\n", {}, None, None, None, [[1, 2], [3, 4]]),
        ("r1\t\t2\nr2\t3\t\n", {}, None, None, ["r1", "r2"], [[0, 2], [3, 0]]),
        ("1\t2\r\n3\t4e1\r\n\r\n\n", {}, None, None, None, [[1, 2], [3, 40]]),
    ],
)
def test_text_forms(spark, tmp_path, text, options, name, headers, labels, v):
    m = read_text(spark, write(tmp_path, text), **options)
    assert array(m.cells, np.shape(v), "ijv").tolist() == v and (m.n_rows, m.n_cols) == np.shape(v) and m.name == name
    tags = lambda d, k: [r[1] for r in d.orderBy(k).collect()] if d is not None else None
    assert tags(m.col_tags, "j") == headers and tags(m.row_tags, "i") == labels


@pytest.mark.parametrize("text", ["1\t2\n\n3\t4\n", "1\t2\n3\t4\n" + "\n" * 16, *(f"1\t2\n3\t{x}\n" for x in ("-4", "nan", "inf", "1e-310", "1,5", "1d", "1e999")), "0\t0\n3\t4\n", "0\t2\n0\t4\n", "1\t2\n3\n", "1\t2\n3\t4\t5\n", "1\n2\n", "", "1\t2\n", "a\tb\tc\td\nr\t1\t2\n"])
def test_text_errors(spark, tmp_path, text):
    with pytest.raises(MatrixError):
        read_text(spark, write(tmp_path, text))


def test_infer_keeps_empty_tags():
    assert infer("\th1\t", "r\t1\t2")["headers"] == ["h1", ""]


@pytest.mark.parametrize("fmt", ["text", "binary", "native"])
def test_round_trip_and_transpose(spark, tmp_path, fmt):
    v = np.array([[1.5, 0, 2], [0, 4, 1e-5]])
    tags = {"name": "n", "row_tags": spark.createDataFrame([(0, "a"), (1, "")], "i bigint, label string"), "col_tags": spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "j int, header string")}
    options = {"real": "<f8"} if fmt == "native" else {}
    out = str(tmp_path / "out")
    files.write_matrix(matrix(spark, v, **tags), out, fmt, **options)
    if fmt == "text":
        assert open(out).read() == "n\tx\ty\tz\na\t1.5\t0\t2\n\t0\t4\t1e-05\n"
        options = {"numeric_labels": True}
    m = files.read_matrix(spark, out, fmt, **options)
    assert np.allclose(array(m.cells, v.shape, "ijv"), v) and m.name == "n"
    assert [r["label"] for r in m.row_tags.orderBy("i").collect()] == ["a", ""]
    t = files.read_matrix(spark, out, fmt, transpose=True, **options)
    assert np.allclose(array(t.cells, v.T.shape, "ijv"), v.T) and [r["label"] for r in t.row_tags.orderBy("i").collect()] == ["x", "y", "z"]


def test_folder_of_parts_is_read_in_order(spark, tmp_path):
    v = RNG.integers(1, 99, (500, 3)).astype(float)
    out = str(tmp_path / "parts")
    files.write_matrix(matrix(spark, v), out, "text", single=False, n=5)
    assert sum(p.startswith("part") for p in os.listdir(out)) == 5
    assert (array(files.read_matrix(spark, out).cells, v.shape, "ijv") == v).all()


def test_parts_of_six_digits_come_after_those_of_five(spark, tmp_path):
    """Names are in order of the numbers in them, where they are read and where they are put together."""
    for n in (99_998, 99_999, 100_000, 100_001):
        write(tmp_path, f"{n}\t1\n{n}\t2\n", f"part-{n}-abc.txt")
    m = read_text(spark, str(tmp_path))
    assert [int(r["v"]) for r in m.cells.where("j = 0").orderBy("i").collect()] == [n for n in (99_998, 99_999, 100_000, 100_001) for _ in range(2)]
    names = [f"part-{n}-x" for n in (100_000, 7, 99_999, 10**25)] + ["part-a", "part-"]
    keyed = spark.createDataFrame([(n,) for n in names], "n string")
    from partsloom.sources.text import natural, natural_key

    assert [r["n"] for r in keyed.orderBy(natural_key(keyed["n"])).collect()] == sorted(names, key=natural)


def test_too_many_rows_to_become_columns(spark):
    cells = spark.createDataFrame([(2**31 + 5, 0, 1.0)], "i bigint, j int, v double")
    with pytest.raises(MatrixError, match="32 bits"):
        Matrix(cells, 2**31 + 6, 2).transpose()


def test_dense_rows_of_sparse_ones(spark):
    v = np.where(RNG.random((30, 40)) < 0.1, RNG.random((30, 40)) + 1, 0)
    v[7] = 0
    v[8] = 1
    got = {r["i"]: r["row"] for r in matrix(spark, v).dense_rows().collect()}
    assert len(got) == 30 and all(got[i] == v[i].tolist() for i in range(30))


def test_product_by_blocks_of_columns(spark):
    w, h = start_w(spark, 9, 3, 1), start_h(spark, 11, 3, 1)
    want = array(w, (9, 3), "ikw") @ array(h, (11, 3), "jkh").T
    for columns in (1, 4, 100):
        p = mx.matmul(w, h, columns)
        assert np.allclose(array(p, (9, 11), "i j wh".split()), want) and p.count() == 99
    assert mx.matmul(w, h.limit(0)).count() == 0


def test_preview_of_a_vector(spark):
    cells = spark.createDataFrame([(i, 0, float(i)) for i in range(1, 300)], "i bigint, j int, v double")
    assert [r["row"] for r in Matrix(cells, 300, 1).preview().orderBy("i").collect()] == [[float(i)] for i in range(225)]
    wide = cells.selectExpr("j as i", "cast(i as int) as j", "v").selectExpr("cast(i as bigint) as i", "j", "v")
    assert Matrix(wide, 1, 300).preview().first()["row"] == [float(i) for i in range(225)]


def test_zero_over_zero_is_zero_in_all_forms(spark):
    """W H that has become zero: where V is zero too, the forms agree that the cell adds nothing."""
    v = np.array([[1.0, 0], [0, 2]])
    w, h = np.array([[1.0, 0], [1e-300, 1]]), np.array([[1.0, 0], [1e-300, 1e-320]])
    with np.errstate(all="ignore"):
        assert np.array_equal(solver.ratios(v, w, np.array([[1.0, 0], [0, 0]])), [[1.0, 0], [0, np.inf]])
    frame = lambda a, names: spark.createDataFrame([(i, k, float(a[i, k])) for i in range(2) for k in range(2)], names)
    got = update_h(matrix(spark, v).cells, frame(w, "i bigint, k int, w double"), frame(h, "j int, k int, h double"))
    with np.errstate(all="ignore"):
        want = solver.next_h(h, solver.ratios(v, w, h).T @ w, w.sum(axis=0))
    assert np.allclose(array(got, (2, 2), "jkh"), want)


@pytest.mark.parametrize(("labels", "sep"), [(["a", "bb", "", "ccc dd", "é", "", "zzzzzzzz"], "\t"), (["a", "b", "cc", "d", "eeeee", "f", "g"], " "), (["", "", "", "", "", "", ""], "\t")])
def test_labels_are_read_in_pieces(spark, tmp_path, labels, sep):
    p = tmp_path / "t.dat"
    line = sep.join(labels)
    for tail, headers, name in ((f"{line}\nx\ty\nthe name\n", ["x", "y"], "the name"), (f"{line}\r\n\r\n\r\n", None, None), (line, None, None), (f"{line}\nx y\n", ["x", "y"], None)):
        p.write_bytes(b"head" + tail.encode())
        for piece in (1, 3, 1000):
            t = binary._tags(spark, str(p), 4, 4 + len(tail.encode()), 7, 2, piece)
            assert [tuple(r) for r in t["row_tags"].orderBy("i").collect()] == list(enumerate(labels)), (tail, piece)
            assert ([r["header"] for r in t["col_tags"].orderBy("j").collect()] if t["col_tags"] else None, t["name"]) == (headers, name)
    for n in (6, 8):
        with pytest.raises(MatrixError):
            binary._tags(spark, str(p), 4, 4 + len(tail.encode()), n, 2, 3)


def test_binary_errors(spark, tmp_path):
    p, out = tmp_path / "bad", str(tmp_path / "ok")
    files.write_matrix(matrix(spark, np.ones((2, 3))), out, "binary")
    good = open(out, "rb").read()
    assert good[:4] == (0xEDB10EA1).to_bytes(4, "little") and len(good) == 12 + 48
    for b in (b"x" + good[1:], good[:-9], good[:4] + (1).to_bytes(4, "little") + good[8:], good + b"a\tb\tc\n\n\n"):
        p.write_bytes(b)
        with pytest.raises(MatrixError):
            files.read_matrix(spark, str(p), "binary")
    with pytest.raises(MatrixError):
        files.read_matrix(spark, out, "binary", shape=(3, 2))


def test_combined_and_generated(spark, tmp_path):
    m = files.generate(spark, 4, 3, 2.0, 9)
    again = files.generate(spark, 4, 3, 2.0, 9).cells.repartition(3)
    assert sorted(m.cells.collect()) == sorted(again.collect()) and m.cells.where("v < 0 or v > 2").count() == 0
    for n in "ab":
        files.write_matrix(m, str(tmp_path / n), "native", real="<f8")
    both = files.combine_native(spark, [str(tmp_path / n) for n in "ab"], str(tmp_path / "c"), real="<f8")
    x = array(both.cells, (4, 6), "ijv")
    assert (x[:, :3] == x[:, 3:]).all() and os.path.exists(tmp_path / "c")


def test_command_line(spark, tmp_path):
    path = write(tmp_path, "n\tx\ty\tz\n" + "".join(f"r{i}\t{i + 1}\t{i % 3 + 1}\t2\n" for i in range(6)))
    assert main(["factorize", path, "-K", "2", "-i", "30", "-E", "0", "--seed", "4", "-q"], spark) == 0
    h = files.read_matrix(spark, path + "_H.dat", "binary")
    assert (h.n_rows, h.n_cols) == (2, 3) and [r["label"] for r in h.row_tags.orderBy("i").collect()] == ["Factor_0", "Factor_1"]
    a = parser().parse(["factorize", "f"])
    assert (a.k, a.iterations, a.period, a.threshold) == (2, 2000, 10, 40)
    with pytest.raises(SystemExit):
        parser().parse(["factorize", "f", "-i", "0"])
    with pytest.raises(MatrixError):
        main(["factorize", path, "-k", "4"], spark)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "documents", "stamps", "supplier", "nation"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.query("x", f"SELECT {cols} FROM x").fetchall(), key=str)
