"""Language-model scores from a log-frequency Bloom filter.

The filter holds runs of two and of three tokens with quantised counts: a run of quantised count q is entered q times, as (run, 1) to (run, q), so
its count is found by probing until a probe fails. A run's share of its context is interpolated with the share of the run shorter by one, down to an exactly counted unigram base.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, release, table
from .packed import DEALT, GOLDEN, dealt, doc_ids, meet, mix, pack, ranges, returned, unpack
from .simhash import LOWER

#: Counts are quantised to powers of QUANTUM, rounded down; probes for each entry.
QUANTUM, PROBES = 1.25, 4
#: Bits for each entry; least bits of the whole filter.
ENTRY_BITS, LEAST_BITS = 12, 1 << 20
#: Least count of a run that score_texts enters if not told otherwise: all are. A stray run has to pass all probes up to that count.
LEAST_COUNT = 1
#: Weights of the share of runs of two and of three tokens, where their contexts are known: the best of a grid for the texts to learn from whose crc32 leaves 2, learning from the others.
WEIGHT, WEIGHT_3 = 0.2, 0.5
LEVELS = 256
#: Bytes of text in a batch; smaller ones need less memory and send more.
BATCH_BYTES = 4_000_000
END, BEGIN = np.uint64(1), np.uint64(2)


def level(count: np.ndarray) -> np.ndarray:
    """1 + the whole part of log(count) to QUANTUM."""
    return (np.log(count) / math.log(QUANTUM) + 1e-9).astype(np.int64) + 1


def counted_as(q: np.ndarray) -> np.ndarray:
    """The quantised count of a level; none at 0."""
    return np.where(q > 0, QUANTUM ** (q - 1.0), 0.0)


class Filter:
    """A Bloom filter in 2**cut parts, each for a range of keys, so that parts can be filled apart."""

    def __init__(self, size: int, cut: int, least: int, data: np.ndarray | None = None):
        self.size, self.cut, self.least, self.data = size, cut, least, data

    def bits(self, keys: np.ndarray, j: int, i: int) -> np.ndarray:
        """Where probe i of entry (key, j) looks in its part."""
        return mix(keys + np.uint64(int(GOLDEN) * (j * PROBES + i + 1) & 0xFFFFFFFFFFFFFFFF)) & np.uint64((self.size >> self.cut) - 1)

    def part(self, keys: np.ndarray, q: np.ndarray) -> bytes:
        """The bytes of the part that all keys belong to."""
        out = np.zeros(self.size >> self.cut, np.uint8)
        for j in range(1, int(q.max(initial=0)) + 1):
            keys = keys[q >= j]
            q = q[q >= j]
            for i in range(PROBES):
                out[self.bits(keys, j, i)] = 1
        return np.packbits(out, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of counts; below that of the least count that was entered, 0."""
        q, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for j in range(1, LEVELS):
            for i in range(PROBES):
                k = keys[alive]
                at = (k >> np.uint64(64 - self.cut)) * np.uint64(self.size >> self.cut) + self.bits(k, j, i)
                alive = alive[(self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            if not len(alive):
                break
            q[alive] = j
        return np.where(q >= level(np.array([self.least]))[0], q, 0)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts; below the least count that was entered, none."""
        return counted_as(self.levels(keys))


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


class Tokens:
    """The tokens of a batch: for each text its lower-cased words and one end."""

    def __init__(self, ids: bytes, none: bytes, sizes: bytes, blob: bytes):
        import pyarrow as pa
        import pyarrow.compute as pc

        text, size = unpack(sizes, blob)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        column = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text.translate(LOWER)))
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        own = words.dictionary.to_pylist()
        code, ends = words.indices.to_numpy().astype(np.int64) + 1, np.asarray(split.offsets)
        if "" in own:  # what splitting leaves at a text's edges
            good = code != own.index("") + 1
            code, ends = code[good], np.concatenate([np.zeros(1, np.int64), np.cumsum(good)])[ends]
        self.code, self.size = np.insert(code, ends[1:], 0), np.diff(ends) + 1
        self.hash = np.array([int(END), *(xxhash.xxh64_intdigest(w) for w in own)], np.uint64)
        self.begin = np.cumsum(self.size) - self.size
        self.train = np.array([in_training(None if no else i) for i, no in zip(np.frombuffer(ids, "<i8").tolist(), none, strict=True)], bool)
        self.learned = np.repeat(self.train, self.size)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct token hashes, sorted, and how often each was in texts to learn from."""
        keys, to = np.unique(self.hash, return_inverse=True)
        return keys, np.bincount(to[self.code[self.learned]], minlength=len(keys)).astype(np.uint64)

    def runs(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """A key for each run of that many tokens, the text's beginning counted as one, and at which token each ends."""
        last, own = np.empty(len(self.code), np.uint64), GOLDEN * self.hash[self.code]
        last[1:] = self.hash[self.code[:-1]]
        last[self.begin] = BEGIN
        pairs, at = mix(mix(last) + own), np.arange(len(self.code))
        if order == 2:
            return pairs, at
        at = np.delete(at, self.begin)
        return mix(pairs[at - 1] + own[at]), at


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; other columns are not read.

    base_score: log10 of the unigram estimates (c + 0.5) / (N + 0.5 * (V + 1)), summed. score: with a bigram's quantised
    count over its context's count at WEIGHT, where that context was learned, and the rest from the base; a trigram's count over its
    bigram's, both quantised, at WEIGHT_3, where the bigram was learned, and the rest from that. All counts come
    from every row that in_training picks; a null id counts as an empty text there. A null or empty text is its end
    token alone. Repeated rows are learned from and scored as often as they come; an empty df gives an empty result. A text is
    never cut: its task needs some twenty times its size.

    The filter has ENTRY_BITS for each entry and as many parts as keys have ranges: a part is filled where its range of pairs meets,
    answers the batches there and is gone. So it grows with the input and no task holds more than one part. Runs of a count below
    least are not entered and score as unseen ones; with least 1 all are. Runs of two and of three are sent one after the other.
    """
    packed = pack(docs, id_col, text_col, BATCH_BYTES)
    cut = ranges(packed)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield dealt(row.batch, *Tokens(row.ids, row.none, row.sizes, row.blob).words(), cut)

    def runs(order: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.itertuples(index=False):
                    t = Tokens(row.ids, row.none, row.sizes, row.blob)
                    own, at = t.runs(order)
                    keys, to = np.unique(own, return_inverse=True)
                    yield dealt(row.batch, keys, np.bincount(to[t.learned[at]], minlength=len(keys)).astype(np.uint32), cut)

        return run

    def count(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, dict]:
        _, to = np.unique(keys, return_inverse=True)
        total = np.zeros(to.max(initial=-1) + 1, np.uint64)
        np.add.at(total, to, vals)
        return total[to], {"n_distinct": int((total > 0).sum()), "n_all": int(total.sum())}

    counted = kept(meet(packed.mapInPandas(words, DEALT), "u8", count, ", n_distinct long, n_all long"), "lm-words")
    v, n = counted.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()

    def probe(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, dict]:
        """Fills the filter's part of these keys and looks all of them up."""
        keys, to = np.unique(keys, return_inverse=True)
        total = np.bincount(to, vals, len(keys)).astype(np.int64)
        entered = total >= least
        q = level(total[entered])
        size = max(LEAST_BITS >> cut, 64, 1 << int(max(1, q.sum() * ENTRY_BITS) - 1).bit_length())
        part = Filter(size, 0, least)
        part.data = np.frombuffer(part.part(keys[entered], q), np.uint8)
        return part.levels(keys).astype(np.uint8)[to], {}

    def found(order: int) -> DataFrame:
        out = kept(meet(packed.mapInPandas(runs(order), DEALT), "u4", probe, ""), f"lm-runs-{order}")
        release(docs.sparkSession)
        return out

    two, three = found(2), found(3)

    def seen(t: Tokens, order: int, levels) -> tuple[np.ndarray, np.ndarray]:
        """The quantised count of each run, and at which token it ends."""
        own, at = t.runs(order)
        counts = counted_as(np.frombuffer(b"".join(levels if levels is not None else []), np.uint8))
        return counts[np.unique(own, return_inverse=True)[1]], at

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                t = Tokens(row.ids, row.none, row.sizes, row.blob)
                keys, to = np.unique(t.hash, return_inverse=True)
                c = np.frombuffer(b"".join(row.counts), np.uint64).astype(np.float64)[to]
                token, base = c[t.code], (c[t.code] + 0.5) / (n + 0.5 * (v + 1))
                context = np.empty(len(token))
                context[1:] = token[:-1]
                context[t.begin] = c[0]  # as many texts began as ended
                pair, _ = seen(t, 2, row.two)
                p = np.where(context > 0, WEIGHT * np.minimum(pair / np.maximum(context, 1), 1) + (1 - WEIGHT) * base, base)
                run, at = seen(t, 3, row.three)
                before = pair[at - 1]
                p[at] = np.where(before > 0, WEIGHT_3 * np.minimum(run / np.maximum(before, 1), 1) + (1 - WEIGHT_3) * p[at], p[at])
                sums = lambda x: np.add.reduceat(x, t.begin)
                yield pd.DataFrame({"doc_id": doc_ids(row.ids, row.none), "held_out": ~t.train, "n_tokens": t.size, "n_known": sums((token > 0).astype(np.int64)), "train_tokens": n, "base_score": sums(np.log10(base)), "score": sums(np.log10(p))})

    every = packed.join(returned(counted, "counts"), "batch").join(returned(two, "two"), "batch").join(returned(three, "three"), "batch", "left")
    return every.select("batch", "ids", "none", "sizes", "blob", "counts", "two", "three").mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
