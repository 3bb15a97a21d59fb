"""SimHash near copies that are confirmed by the similarity of their shingles.

A pair near the least similarity differs in too many bits of a 64-bit fingerprint for pigeonhole blocks of a useful width. So
fingerprints are long here, WORDS times 64 bits, and cut into blocks of 16 bits. Pairs that share a block are proposed, the Hamming distance over the two words
about the block sorts chance meetings out, and the exact Jaccard similarity of the sets of shingles decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, connected_components, kept, release
from .packed import GOLDEN, mix
from .simhash import CHUNK, fingerprint, named, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A similarity of 0.8 flips 15 % of the bits (the arc cosine of 8 / 9 over pi): one of 64 blocks of 16 bits is then shared by 99.2 % of pairs, and surely if 63 bits differ or fewer.
WORDS, BLOCK_BITS = 16, 16
#: Of the 112 bits of the two words beside the block such a pair differs in 17, with a standard deviation of 3.8.
DISTANCE = 31
#: Buckets of more rows are not searched for a first near pair.
LARGE = 1000
#: Larger groups are compared in parts of so many, each with one and the same member.
PART = 300
#: Blocks are taken in rounds; what the first ones have joined isn't compared again in the others.
ROUNDS = (16, 48)


def long_fingerprint(hashes: np.ndarray, sizes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A fingerprint of words 64-bit words for each run of sizes[i] hashes, each word from the hashes mixed anew."""
    return np.stack([fingerprint(mix(hashes + np.uint64(i * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)), sizes) for i in range(words)], axis=1)


def keyed(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """(more, key, t): texts (null: empty) and a hash of each."""
    t = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(*more, F.xxhash64(t).alias("key"), t.alias("t"))


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, node, fp) for each row of docs: hashes of its text and of its set of shingles, and the set's long fingerprint. Texts without words have an empty one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column("t")]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            fps = [b""] * len(sets)
            full = np.flatnonzero(size)
            for part in np.split(full, np.flatnonzero(np.diff(np.cumsum(size[full]) // CHUNK)) + 1) if len(full) else []:
                for i, k in zip(part.tolist(), long_fingerprint(np.concatenate([sets[i] for i in part]), size[part]), strict=True):
                    fps[i] = k.tobytes()
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(node), pa.array(fps, pa.binary())], ["doc_id", "key", "node", "fp"])

    src = keyed(docs, text_col, col(id_col).alias("doc_id"))
    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType())]))


def joined_up(comp: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that connect items as all near pairs would, without listing the pairs; near(i) says for every item whether it is near item i.

    comp holds numbers of components that are known, and is brought up to date. Only items outside the largest component so far are compared with all others.
    """
    out, scanned, i = [], np.zeros(len(comp), bool), 0
    while True:
        scanned[i] = True
        hit = np.flatnonzero(near(i) & (comp != comp[i]))
        if len(hit):
            ids, first = np.unique(comp[hit], return_index=True)
            out += [(i, int(hit[j])) for j in first]
            comp[np.isin(comp, ids)] = comp[i]
        todo = np.flatnonzero(~scanned & (comp != np.bincount(comp).argmax()))
        if not len(todo):
            return out
        i = int(todo[0])


def similar(sets: list[np.ndarray], least: float = SIMILARITY, comp: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect sets as all pairs of a Jaccard similarity of least or more would, without listing the pairs. Each link is such a pair. comp: labels of what is connected already."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    comp = np.arange(len(sets)) if comp is None else np.unique(comp, return_inverse=True)[1]
    alike = lambda both, i, j: both >= least * (size[i] + size[j] - both) - 1e-9
    if len(sets) == 2:
        return [(0, 1)] if comp[0] != comp[1] and alike(len(np.intersect1d(*sets, assume_unique=True)), 0, 1) else []
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin, held = np.cumsum(size) - size, np.zeros(len(names), np.int32)

    def near(i: int) -> np.ndarray:
        own = code[begin[i] : begin[i] + size[i]]
        held[own] = 1
        both = np.add.reduceat(held[code], begin)
        held[own] = 0
        return alike(both, i, np.arange(len(sets)))

    return joined_up(comp, near)


def runs(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by a column in pieces that end where its value changes."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = int(starts(b[by].to_numpy())[-1])  # the last value may go on
        if rest and (last or rest[-1][by].iloc[-1] != b[by].iloc[0]):
            if last and rest[-1][by].iloc[-1] == b[by].iloc[0]:
                rest.append(b.iloc[:last])
                yield pd.concat(rest)
            else:
                yield pd.concat(rest)
                if last:
                    yield b.iloc[:last]
            rest = []
        elif last:
            yield b.iloc[:last]
        rest.append(b.iloc[last:])
    if rest:
        yield pd.concat(rest)


def starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, k[1:] != k[:-1]])


def groups_of(key: np.ndarray, one: np.ndarray, two: np.ndarray, label: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Of rows sorted by bucket: the groups (numbers of rows) that near pairs hold together and that have several labels. No pair of one label is looked at."""
    begin = starts(key)
    size = np.diff(np.r_[begin, len(key)])
    bucket, left = np.repeat(np.arange(len(size)), size), np.repeat(begin + size, size) - np.arange(len(key)) - 1
    near = lambda a, b: (np.bitwise_count(one[a] ^ one[b]).astype(np.int16) + np.bitwise_count(two[a] ^ two[b])) <= distance
    several = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin) if len(key) else np.zeros(0, bool)
    found, apart = several & (size > LARGE), 0
    at = np.flatnonzero((left > 0) & (several & ~found)[bucket])
    while len(at):  # each with the next, the one after and so on, all buckets together: most have no pair that is near
        apart += 1
        hit = at[label[at] != label[at + apart]]
        found[bucket[hit[near(hit, hit + apart)]]] = True
        at = at[(left[at] > apart) & ~found[bucket[at]]]
    for s, n in zip(begin[found].tolist(), size[found].tolist(), strict=True):
        rows = np.arange(s, s + n)
        if n == 2:
            yield rows
            continue
        comp = np.arange(n)
        joined_up(comp, lambda i, rows=rows: near(rows[i], rows))
        for c in np.flatnonzero(np.bincount(comp) > 1):
            own = rows[comp == c]
            names, code, count = np.unique(label[own], return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            rest = code != count.argmax()
            if 2 * rest.sum() < len(own):  # of what is joined already, only what is near to something else
                for i in own[rest]:
                    rest |= near(i, own)
                own = own[rest]
            if len(np.unique(label[own])) > 1:
                yield own


def groups(nodes: DataFrame, label: DataFrame | None, blocks: range, distance: int = DISTANCE) -> DataFrame:
    """(group, node, label, whole): nodes (node, key, fp) that are in one bucket of the blocks and held together by near pairs there; label: (node, component) of what is connected already.

    Buckets of the same nodes make one group, so near copies meet once and not in most of their blocks. A large group comes in parts, each with its first node; whole then names it, else it is 0.
    """
    per_word, most, part = 64 // BLOCK_BITS, (1 << BLOCK_BITS) - 1, PART

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.frombuffer(b"".join(b["fp"]), np.uint64).reshape(-1, WORDS)
            for j in blocks:
                own = fp[:, j // per_word]
                bits = (own >> np.uint64(BLOCK_BITS * (j % per_word))) & np.uint64(most)
                yield pd.DataFrame({"key": (bits + np.uint64(j << BLOCK_BITS)).view(np.int64), "node": b["node"], "label": b["label"], "one": own.view(np.int64), "two": fp[:, (j // per_word + 1) % WORDS].copy().view(np.int64)})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in runs(batches, "key"):
            key, node, name, one, two = (b[c].to_numpy(np.int64) for c in ("key", "node", "label", "one", "two"))
            rows, group, whole = [], [], []
            for own in groups_of(key, one.view(np.uint64), two.view(np.uint64), name, distance):
                id_ = mix(mix(node[own].view(np.uint64)).sum(keepdims=True) + np.uint64(len(own)))
                large = len(own) > part
                for i in range(0, len(own), part if large else len(own)):
                    at = own[i : i + part] if large else own
                    at = np.r_[own[0], at] if i else at
                    rows.append(at)
                    group.append(np.full(len(at), mix(id_ + np.uint64(i))[0]))
                    whole.append(np.full(len(at), id_[0] if large else 0, np.uint64))
            if rows:
                at = np.concatenate(rows)
                yield pd.DataFrame({"group": np.concatenate(group).view(np.int64), "node": node[at], "label": name[at], "whole": np.concatenate(whole).view(np.int64)})

    full = nodes.where(F.length("fp") > 0).select("node", "fp")
    full = full.withColumn("label", F.col("node")) if label is None else full.join(label, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("label"))
    buckets = full.mapInPandas(deal, "key long, node long, label long, one long, two long").repartition("key").sortWithinPartitions("key", "node")
    return kept(buckets.mapInPandas(gather, "group long, node long, label long, whole long").distinct(), "simhash-groups")


def again(large: DataFrame, label: DataFrame) -> DataFrame:
    """(group, node, label) for large groups (whole, node) that their first nodes have not joined up: each node that is in another component than the first meets all nodes, which are dealt into parts. Empty if there is none."""
    held = large.join(label, "node", "left").select("whole", "node", F.coalesce("component", "node").alias("label"))
    held = kept(held.join(held.groupBy("whole").agg(F.min_by("label", "node").alias("main"), F.ceil(F.count("*") / PART).alias("parts")), "whole"), "simhash-large")
    out = held.where("label <> main")
    every = held.join(out.select("whole").distinct(), "whole").select("whole", "node", "label", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    every = every.union(out.select("whole", "node", "label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))))
    return every.select(F.xxhash64("whole", "part").alias("group"), "node", "label").distinct()


def links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(a, b) links among the nodes of each group that connect what the pairs at least or more connect; texts has (key, t).

    Texts are sent to groups only and cut into shingles there once more, as they take less room than sets.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in runs(batches, "group"):
            node, name, held = b["node"].to_numpy(np.int64), b["label"].to_numpy(np.int64), [shingles(t, shingle) for t in b["t"]]
            begin = starts(b["group"].to_numpy()).tolist()
            at = [(s + i, s + j) for s, e in zip(begin, [*begin[1:], len(b)], strict=True) for i, j in similar(held[s:e], least, name[s:e])]
            pairs = np.array(at, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    both = texts.dropDuplicates(["key"]).join(groups.join(nodes.select("node", "key"), "node"), "key").select("group", "node", "label", "t")
    return both.repartition("group").sortWithinPartitions("group").mapInPandas(check, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, node, component, component_id) for each row of docs; other columns are not read. key is the hash of the text, component names the component by one of its nodes.

    component_id is the smallest id among documents reachable over pairs of a Jaccard similarity of least or more; ids that are
    null count only if all of a component are. Texts of the same shingles are one node; so are all without words. Repeated
    rows come back as often as they came. An empty df gives an empty result.
    """
    sets = kept(sketches(docs, id_col, text_col, shingle), "simhash-sketches")
    nodes = kept(sets.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "simhash-nodes")
    texts, label, found, large, first = keyed(docs, text_col), None, None, None, 0

    def join_up(some: DataFrame) -> None:
        nonlocal found, label
        new = kept(links(some, nodes, texts, shingle, least), "simhash-links")
        release(docs.sparkSession)
        found = new if found is None else found.unionByName(new)
        label = kept(connected_components(found), "simhash-components")

    for n in ROUNDS:
        some = groups(nodes, label, range(first, first + n))
        release(docs.sparkSession)
        more = some.where("whole <> 0").select("whole", "node").distinct()
        large, first = more if large is None else large.union(more), first + n
        join_up(some.select("group", "node", "label"))
    rest = kept(again(large.distinct(), label), "simhash-again")
    if rest.limit(1).count():
        join_up(rest)
    ids = kept(named(nodes.select("node", "least"), "node", label), "simhash-label")
    return sets.select("doc_id", "key", "node").join(ids, "node").select("doc_id", "key", "node", "component", "component_id")
