"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, col, connected_components, kept, table
from .packed import mix

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints are cut into so many blocks; DISTANCE differing bits spoil DISTANCE blocks at most.
BLOCKS = 7
#: Shingles hashed at a time.
CHUNK = 200_000
#: Buckets of more fingerprints are not searched for a first near pair before they are linked.
LARGE = 1000
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Bit i of a byte as a counter in lane i of eight one-byte lanes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 of each k-word shingle of a text, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return []
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= k:
        return [digest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = end - size
    return [digest(joined[a:b], SEED) for a, b in zip(start[: n - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]


def fingerprint(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of sizes[i] hashes: a bit is set if it is in over half of the run; an empty run gives zero.

    Bits are counted eight lanes at a time in pieces of 255 hashes, which a one-byte lane can hold.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pieces = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(sizes[full]) - sizes[full])[owner] + 255 * nth
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    bits = counts * 2 > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of docs, repeated rows too; fp is the fingerprint's 64 bits as a bigint. A null text counts as an empty one: fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            done, hashes, sizes = [np.zeros(0, np.uint64)], [], []

            def flush():
                done.append(fingerprint(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
                hashes.clear()
                sizes.clear()

            for t in b.column("t"):
                h = shingle_hashes(t.as_py(), shingle)
                hashes += h
                sizes.append(len(h))
                if len(hashes) >= CHUNK:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(done).view(np.int64))], ["doc_id", "fp"])

    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]))


def links_within(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect distinct fingerprints as all pairs at distance or less would, without listing the pairs.

    Only fingerprints outside the largest component found so far are compared with all others: a pair of which both ends are in
    one component adds nothing. A dense group of m so takes about m comparisons.
    """
    n, out = len(fps), []
    comp, scanned = np.arange(n), np.zeros(n, bool)
    i = 0
    while True:
        scanned[i] = True
        near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= distance) & (comp != comp[i]))
        if len(near):
            ids, first = np.unique(comp[near], return_index=True)
            out += [(int(fps[i]), int(fps[near[j]])) for j in first]
            comp[np.isin(comp, ids)] = comp[i]
        todo = np.flatnonzero(~scanned & (comp != np.bincount(comp).argmax()))
        if not len(todo):
            return out
        i = todo[0]


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) links among distinct fp that connect what all pairs within distance connect.

    Pigeonhole: of blocks blocks at most distance can differ, so a near pair agrees on some blocks - distance of
    them. Each fingerprint goes to one bucket for each such choice of blocks, and buckets are checked bit by bit, one at a
    time as a sorted partition streams by. Each is in order of fp, so that the same few fingerprints gather the links of a dense group in all its buckets. With 7 blocks a bucket's key has about 27 bits, so chance meetings are rare until there are hundreds of millions of fingerprints.
    """
    if blocks <= distance:
        raise ValueError("there must be more blocks than differing bits")
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    width = [b - a for a, b in zip(cut, cut[1:], strict=False)]
    choices = list(combinations(range(blocks), blocks - distance))
    if max(sum(width[i] for i in c) for c in choices) + len(choices).bit_length() > 63:
        raise ValueError("too few differing bits for these blocks: a bucket's key has over 63 bits")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = b["fp"].to_numpy(np.int64).view(np.uint64)
            part = [(f >> np.uint64(c)) & np.uint64((1 << w) - 1) for c, w in zip(cut, width, strict=False)]
            for n, chosen in enumerate(choices):
                key = np.full(len(f), n, np.uint64)
                for i in chosen:
                    key = (key << np.uint64(width[i])) | part[i]
                yield pd.DataFrame({"fp": b["fp"], "key": key.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            k = np.concatenate([rest_k, b["key"].to_numpy(np.int64)])
            f = np.concatenate([rest_f, b["fp"].to_numpy(np.int64).view(np.uint64)])
            last = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1]) if len(k) else 0  # the last key may go on
            yield found(k[:last], f[:last])
            rest_k, rest_f = k[last:], f[last:]
        yield found(rest_k, rest_f)

    def found(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[begin, len(k)])
        bucket, left = np.repeat(np.arange(len(size)), size), np.repeat(begin + size, size) - np.arange(len(k)) - 1
        near, apart = size > LARGE, 0
        two: list[np.ndarray] = []
        at = np.flatnonzero((left > 0) & ~near[bucket])
        while len(at):  # each with the next, the one after and so on, all buckets together: most have no pair that is near
            apart += 1
            hit = at[np.bitwise_count(f[at] ^ f[at + apart]) <= distance]
            two.append(hit[size[bucket[hit]] == 2])
            near[bucket[hit]] = True
            at = at[left[at] > apart]
        two_at = np.concatenate([np.zeros(0, np.int64), *two])
        a, b = f[two_at], f[two_at + 1]
        many = near & (size > 2)
        more = [x for s, n in zip(begin[many], size[many], strict=True) for x in links_within(f[s : s + n], distance)]
        pairs = np.array(more, np.uint64).reshape(-1, 2)
        return pd.DataFrame({"a": np.r_[a, pairs[:, 0]].view(np.int64), "b": np.r_[b, pairs[:, 1]].view(np.int64)})

    dealt = fps.select("fp").distinct().mapInPandas(deal, "fp long, key long").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; other columns are not read.

    component_id is the smallest id among documents reachable over fingerprints at distance or less; ids that are
    null count only if all of a component are. Texts without words, null and empty ones have fingerprint 0 and link
    like any other. Repeated rows come back as often as they came. An empty df gives an empty result.

    Copies share a fingerprint and from there on only distinct fingerprints are dealt out, so thousands of copies cost
    one row; documents meet their fingerprint's component again in a join that Spark can split where one fingerprint is hot.
    """
    fps = kept(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = kept(links(fps, distance, blocks), "simhash-links")
    label = kept(named(each, "fp", kept(connected_components(edges), "simhash-components")), "simhash-label")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def named(each: DataFrame, node: str, comp: DataFrame) -> DataFrame:
    """(node, component, component_id): a node's component and its least id. each has (node, least): a node and its least id; comp the (node, component) of those that are linked at all.

    The least ids of a component are found with partial sums before the shuffle; a component that a third of all nodes are in is split in the joins, which both read what is written down.
    """
    linked = kept(comp.join(each.withColumnRenamed(node, "node"), "node"), "simhash-linked")
    least = kept(linked.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    both = linked.select("node", "component").join(least, "component").select(F.col("node").alias(node), "component", "component_id")
    alone = each.join(comp.select(F.col("node").alias(node)), node, "left_anti").select(node, F.col(node).alias("component"), F.col("least").alias("component_id"))
    return alone.unionByName(both)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
