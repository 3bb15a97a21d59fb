"""The cascade against a replay by hand, turn by turn, and its edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from partsloom.llm import release

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")


def h(k, conv, turn):
    return zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())


def replay(rows):
    """Brute force over (conv_id, turn, text) with turns that are unique in a conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        seen = []
        for p, (_, turn, text) in enumerate(own):
            d = h(0, conv, turn) % 5
            at, parent = 7 * p, seen[p - d] if 0 < d <= p else None
            if parent and parent["status"] != "delivered":
                seen.append({"turn": turn, "p": p, "status": "blocked", "attempts": 0, "first": None, "last": None, "text": text})
                continue
            t = max(at, parent["last"]) if parent else at
            first, faulty, repaired = t, h(1, conv, turn) % 101 < 50, at + h(2, conv, turn) % 101
            for a in range(1, 7):
                last = t
                if not faulty or (t >= repaired and h(a + 2, conv, turn) % 3):
                    status = "delivered"
                    break
                t, status = t + 10 * 2 ** (a - 1), "dead"
            seen.append({"turn": turn, "p": p, "status": status, "attempts": a, "first": first, "last": last, "text": text})
        state, no = 0, 0
        rank = {}
        for x in sorted((x for x in seen if x["status"] == "delivered"), key=lambda x: (x["last"], x["p"])):
            no += 1
            state += no * zlib.crc32((x["text"] or "").encode())
            rank[x["p"]] = (no, state)
        out += [(conv, x["turn"], x["status"], x["attempts"], x["first"], x["last"], *rank.get(x["p"], (None, None))) for x in seen]
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    """Through the query, from a table with extra columns that clash."""
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], SCHEMA)
    df = df.withColumn("status", F.lit("old")).withColumn("pos", F.lit(3)).withColumn("conv", F.lit(4)).withColumn("nth", F.lit(5)).withColumn("a.b", F.lit(6))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = release.op11_release(spark, str(tmp_path))
    assert got.columns == list(OUT)
    return sorted(map(tuple, got.collect()), key=str)


def test_against_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t * rng.randint(1, 3) if c % 2 else t, f"text {c} {t} é" if rng.random() < 0.9 else rng.choice([None, ""])) for c in range(30) for t in range(rng.randint(1, 14))]
    rows = list({(c, t): (c, t, x) for c, t, x in rows}.values())
    got = run(spark, tmp_path, rows)
    assert got == replay(rows)
    assert {r[2] for r in got} == {"delivered", "dead", "blocked"}


def test_one_conversation_over_many_ranges(spark, tmp_path):
    """A conversation that no task holds whole: numbers and sums go on from range to range."""
    rows = [(7, t, f"x{t}") for t in range(0, 800, 2)] + [(None, t, "y") for t in range(50)] + [(c, None, None) for c in range(20)]
    assert run(spark, tmp_path, rows) == replay(rows)
    df = spark.createDataFrame([(1, i) for i in range(1000)], "k long, x long").repartition(7)
    dealt = release.numbered(df, "k", [F.col("x")], {"s": F.col("x") * 3})
    assert all(r["nth"] == r["x"] + 1 and int(r["s"]) == 3 * sum((i + 1) * i for i in range(r["x"] + 1)) for r in dealt.collect())


def test_repeated_rows_and_nothing(spark, tmp_path):
    rows = [(1, 0, "a")] * 6 + [(1, None, "b")] * 2
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], SCHEMA)
    pos = release.replayed(df).select("pos", "turn").collect()
    assert sorted(r["pos"] for r in pos) == list(range(8)) and {r["pos"] for r in pos if r["turn"] is None} == {0, 1}
    assert release.release(release.cascade(release.replayed(df)), F.col("crc")).count() == 8
    assert run(spark, tmp_path, []) == []


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv long, pos long, parent long, arrives_at long, repaired_at long, fails array<boolean>, w long")


def test_attempts_by_hand(spark):
    no, yes = [False] * 6, [True] * 6
    rows = [
        (1, 0, None, 0, None, None, 1), (1, 1, 0, 7, 25, no, 1), (1, 2, 1, 14, None, None, 1),  # 7, 17, 37: delivered by the third; its child waits for it
        (1, 3, None, 21, 21, yes, 1), (1, 4, 3, 28, None, None, 1), (1, 5, 4, 35, 35, no, 1),  # dead after six; its child and theirs are blocked
        (1, 6, None, 42, 42, [True, False, *[True] * 4], 1), (1, 7, 6, 60, None, None, 1),
    ]
    got = {r["pos"]: (r["status"], r["attempts"], r["first_at"], r["last_at"], r["release_no"], r["state"] and int(r["state"])) for r in release.release(release.cascade(turns(spark, rows)), F.col("w") * 10).collect()}
    assert got == {
        0: ("delivered", 1, 0, 0, 1, 10), 1: ("delivered", 3, 7, 37, 2, 30), 2: ("delivered", 1, 37, 37, 3, 60), 3: ("dead", 6, 21, 331, None, None), 4: ("blocked", 0, None, None, None, None),
        5: ("blocked", 0, None, None, None, None), 6: ("delivered", 2, 42, 52, 4, 100), 7: ("delivered", 1, 60, 60, 5, 150),
    }


def test_state_beyond_a_long_is_whole(spark):
    rows = [(1, i, None, i, None, None, 2**61) for i in range(9)]
    got = release.release(release.cascade(turns(spark, rows)), F.col("w")).agg(F.max("state")).first()[0]
    assert int(got) == 45 * 2**61


def test_a_parent_that_is_not_there(spark):
    with pytest.raises(ValueError, match="not there"):
        release.cascade(turns(spark, [(1, 0, None, 0, None, None, 1), (1, 2, 1, 7, None, None, 1)]))
