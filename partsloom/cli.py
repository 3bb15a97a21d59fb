"""Command line: factorize, convert, generate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.solver import LOCAL_CELLS, MEMORY, Options, factorize
from .sources.files import EXTENSION, convert, factor_matrices, generate, read_matrix, write_matrix


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def binary_form(text: str) -> str:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must be 0 or more")
    return "native" if n else "binary"


def device(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must be 0 or more")
    return n


class Lenient(argparse.ArgumentParser):
    """Upper-case options are the lower-case ones."""

    def parse(self, args: list[str] | None) -> argparse.Namespace:
        import sys

        args = [a.lower() if len(a) == 2 and a[0] == "-" and a[1].isalpha() else a for a in (sys.argv[1:] if args is None else args)]
        return self.parse_known_args(args)[0]


def parser() -> Lenient:
    p = Lenient(prog="partsloom", description="Non-negative matrix factorization. Unknown options are ignored.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("factorize", "convert"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("-b", type=binary_form, dest="source", help="binary input: 0 portable, above native")
        c.add_argument("-e", type=binary_form, dest="target", help="binary output, alike")
        c.add_argument("-c", action="store_true", dest="numeric_headers", help="column headers are numbers")
        c.add_argument("-r", action="store_true", dest="numeric_labels", help="row labels are numbers")
        c.add_argument("--wide", action="store_true", help="rows of text can be longer than a task holds")
        if name == "factorize":
            c.add_argument("-k", type=positive, default=2, help="rank, at least 2")
            c.add_argument("-i", type=positive, default=2000, dest="iterations", help="most iterations")
            c.add_argument("-j", type=positive, default=10, dest="period", help="iterations between tests")
            c.add_argument("-t", type=positive, default=40, dest="threshold", help="unchanged tests before the last")
            c.add_argument("-z", type=device, default=0, help="0 or more; ignored")
            c.add_argument("--seed", type=int)
            c.add_argument("--local-cells", type=int, default=LOCAL_CELLS, help="matrices of more cells than this are solved by tiles, 0: all")
            c.add_argument("--memory", type=positive, default=MEMORY, help="bytes that a task may take for a tile")
            c.add_argument("--state", help="a shared folder: the run is written there at each test, and goes on from there")
            c.add_argument("--times", action="store_true", help="calls, tiles, cells and seconds by step, of a run by tiles")
    g = sub.add_parser("generate")
    g.add_argument("path")
    g.add_argument("rows", type=positive)
    g.add_argument("cols", type=positive)
    g.add_argument("-e", type=binary_form, dest="target")
    g.add_argument("most", type=float, nargs="?", default=1.0)
    g.add_argument("--seed", type=int)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse(args)
    a.source, a.target = getattr(a, "source", None) or "text", a.target or "text"
    spark = spark or SparkSession.builder.appName("partsloom").getOrCreate()
    if a.command == "generate":
        write_matrix(generate(spark, a.rows, a.cols, a.most, a.seed), a.path, a.target)
        return 0
    options = {"numeric_headers": a.numeric_headers, "numeric_labels": a.numeric_labels, "wide": a.wide}
    if a.command == "convert":
        print(convert(spark, a.path, a.source, a.target, **options))
        return 0
    m = read_matrix(spark, a.path, a.source, **options)
    r = factorize(m, Options(a.k, a.iterations, a.period, a.threshold, a.seed, a.local_cells, a.memory), folder=a.state)
    w, h = factor_matrices(m, r.w, r.h, a.k)
    write_matrix(w, f"{a.path}_W{EXTENSION[a.target]}", a.target)
    write_matrix(h.transpose() if a.target == "native" else h, f"{a.path}_H{EXTENSION[a.target]}", a.target)
    print(f"iterations: {r.iterations}, {'settled' if r.converged else 'not settled'}, relative distance: {r.distance:g}")
    if a.times:
        for name, (calls, tiles, cells, seconds) in r.steps.items():
            print(f"{name}: {calls} calls, {tiles} tiles, {cells} cells, {seconds:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
