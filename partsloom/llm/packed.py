"""Documents in large batches and the exchange of 64-bit keys between batches.

A batch sends each of its distinct keys once, whatever a document or key repeats, as one binary value for each range of
keys; a range meets in one task, is sorted there and answers every batch in the order in which it sent its keys. Ranges are as many as
batches, so both ends hold a few tens of MB at any input size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, shared_dir

BATCH_BYTES = 8_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed one-to-one function of 64-bit numbers (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, ids, none, sizes, blob): whole texts (null: empty) in batches of about batch_bytes, in the order of the scan, nothing shuffled. A longer text is a batch of its own or ends one.

    ids are longs with a byte each in none that says which are null, as both would else meet in floats and lose digits. The batches
    are written as a table bucketed by batch, so that joins with what comes back to a batch don't shuffle texts; its name
    leaves the catalog at once. Buckets are as many as the scan has tasks, so they don't grow with the input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, ids, none, texts, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pd.DataFrame:
            sizes = np.fromiter(map(len, texts), "<i8", len(texts)).tobytes()
            return pd.DataFrame({"batch": [part << 32 | seq], "ids": [np.array(ids, "<i8").tobytes()], "none": [bytes(none)], "sizes": [sizes], "blob": [zstandard.compress(b"".join(texts), 3)]})

        for b in batches:
            for i, no, t in zip(b["i"].tolist(), b["none"].tolist(), b["t"].tolist(), strict=True):
                ids.append(i)
                none.append(no)
                texts.append(t.encode("utf-8", "replace"))
                total += len(texts[-1])
                if total >= batch_bytes:
                    yield row()
                    seq, ids, none, texts, total = seq + 1, [], [], [], 0
        if ids:
            yield row()

    i = col(id_col).cast("bigint")
    src = docs.select(F.coalesce(i, F.lit(0).cast("bigint")).alias("i"), i.isNull().cast("int").alias("none"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    spark = docs.sparkSession
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), src.rdd.getNumPartitions()))
    out, name = src.mapInPandas(run, "batch long, ids binary, none binary, sizes binary, blob binary"), f"packed_{uuid.uuid4().hex}"
    out.write.bucketBy(buckets, "batch").sortBy("batch").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return held


def unpack(sizes: bytes, blob: bytes) -> tuple[bytes, np.ndarray]:
    """All texts of a batch, one after the other, and their sizes."""
    return zstandard.decompress(blob), np.frombuffer(sizes, "<i8")


def doc_ids(ids: bytes, none: bytes) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.frombuffer(ids, "<i8").astype(np.int64), np.frombuffer(none, np.uint8) > 0)


def ranges(packed: DataFrame) -> int:
    """Into how many bits' worth of ranges keys are dealt: about as many as there are batches."""
    return max(3, int(packed.count() - 1).bit_length())


def cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of sorted keys and where each begins, with an end; takes time and memory by the keys, not by the ranges."""
    r = (keys >> np.uint64(64 - bits)).astype(np.int32)
    at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    return r[at], np.r_[at, len(r)]


def dealt(batch: int, keys: np.ndarray, vals: np.ndarray, bits: int, piece: int = 0) -> pd.DataFrame:
    """A batch's sorted distinct keys (or those of a piece of it) and a value for each, by range."""
    full, at = cuts(keys, bits)
    cut = lambda a: [a[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pd.DataFrame({"range": full, "batch": batch, "piece": np.int32(piece), "keys": cut(keys), "vals": cut(vals)})


DEALT = "range int, batch long, piece int, keys binary, vals binary"


def meet(sent: DataFrame, kind: str, answer: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict]], more: str) -> DataFrame:
    """answer(keys, values of one range) gives something for each key and some totals; the result has (range, batch, piece, ans, *more), the totals in one row of a range."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["batch", "piece"])
        keys = np.frombuffer(b"".join(g["keys"]), np.uint64)
        ans, totals = answer(keys, np.frombuffer(b"".join(g["vals"]), kind))
        ends = np.cumsum(g["keys"].str.len().to_numpy() // 8)
        out = pd.DataFrame({"range": g["range"], "batch": g["batch"], "piece": g["piece"], "ans": [x.tobytes() for x in np.split(ans, ends[:-1])]})
        for k, v in totals.items():
            out[k] = [v] + [None] * (len(out) - 1) if isinstance(v, bytes) else [v] + [0] * (len(out) - 1)
        return out

    return sent.groupBy("range").applyInPandas(run, f"{ANSWERED}{more}")


ANSWERED = "range int, batch long, piece int, ans binary"


def returned(answers: DataFrame, name: str) -> DataFrame:
    """(batch, name): a batch's answers in the order of its sorted keys, piece by piece."""
    return answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("piece", "range", "ans"))).alias("a")).select("batch", F.col("a.ans").alias(name))
