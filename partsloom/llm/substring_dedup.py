"""Removal of long repeated byte strings by blockwise suffix sorting on a difference-cover sample.

Positions of a difference cover modulo PERIOD are sampled in every text: any two positions share an offset below PERIOD
at which both are sampled, so equal strings of PERIOD + SHORT - 1 bytes have equal SHORT-byte strings at sampled positions. Sampled
suffixes are dealt into buckets and each bucket is sorted by bytes, one at a time, to SHORT bytes: that is their rank. A suffix
that begins before a sampled one with a shared rank is sorted in that one's bucket: the rank stands for the SHORT bytes
in the middle, and only what is before and after is compared. So no bucket needs a text, and no suffix is compared twice over its whole length.

Fingerprints only say beforehand which suffixes cannot have company, for different fingerprints mean different strings;
that two strings are equal is found on their bytes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, release, table
from .packed import ANSWERED, DEALT, cuts, dealt, doc_ids, meet, mix, pack, ranges, returned, unpack

LENGTH, SHORT = 400, 220
BATCH_BYTES = 4_000_000
BASE = 0x9E3779B97F4A7C15
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: Bytes fingerprinted at a time, positions fingerprinted at a time, and suffixes sent at a time.
WINDOW, PIECE, SENT = 1 << 16, 400_000, 20_000
#: Bits of a fingerprint that are used; fewer only let more suffixes through to the sorting.
FINGERPRINT_BITS = 64


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """A period v = 24 r^2 + 36 r + 13 and 6 r + 4 residues of which the differences are all residues (Colbourn and Ling)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


def cover_for(room: int) -> tuple[int, np.ndarray]:
    """The longest such cover of a period up to room, at least 13."""
    r = 0
    while difference_cover(r + 1)[0] <= room:
        r += 1
    return difference_cover(r)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n + 1 powers of BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def void(a: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that compare as byte strings."""
    a = np.ascontiguousarray(a)
    return a.view(f"V{a.shape[1]}")[:, 0]


class Batch:
    """The texts of a batch; taking part are those of length or more bytes, one of each group of equal ones in all batches."""

    def __init__(self, sizes: bytes, blob: bytes, length: int = LENGTH, short: int = SHORT, used: int = FINGERPRINT_BITS):
        self.mask = np.uint64((1 << 64) - (1 << 64 - used))
        text, self.size = unpack(sizes, blob)
        self.raw, self.text = text, np.frombuffer(text, np.uint8)
        self.begin, self.length, self.short = np.cumsum(self.size) - self.size, length, short
        self.period, self.cover = cover_for(length - short + 1)
        self.long = np.flatnonzero(self.size >= length)

    def wholes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of the long texts (sorted, distinct), 64 more bits and a count for each, and the number of each long text's digest."""
        both = np.frombuffer(b"".join(hashlib.sha256(self.raw[b : b + n]).digest()[:16] for b, n in zip(self.begin[self.long].tolist(), self.size[self.long].tolist(), strict=True)), np.uint64).reshape(-1, 2)
        keys, first, to, n = np.unique(both[:, 0], return_index=True, return_inverse=True, return_counts=True)
        return keys, np.c_[both[first, 1], n.astype(np.uint64)], to

    def take(self, flags: np.ndarray) -> None:
        """flags of the digests: 1, the text is elsewhere too; 2, it is here that it takes part."""
        _, _, to = self.wholes()
        self.repeated = np.zeros(len(self.size), bool)
        self.repeated[self.long] = flags[to] & 1 > 0
        first = np.zeros(len(to), bool)
        first[np.unique(to, return_index=True)[1]] = True
        self.part = self.long[first & ((flags[to] & 2 > 0) | (flags[to] & 1 == 0))]

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n bytes at each of ascending positions."""
        out = np.empty(len(at), np.uint64)
        up, down = powers(WINDOW + n)
        first = np.flatnonzero(np.r_[True, at[1:] // WINDOW != at[:-1] // WINDOW]) if len(at) else np.zeros(0, np.int64)
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            s = int(at[i]) // WINDOW * WINDOW
            x = BYTE[self.text[s : int(at[j - 1]) + n]]
            prefix = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * down[: len(x)], out=prefix[1:])
            here = at[i:j] - s
            out[i:j] = mix((prefix[here + n] - prefix[here]) * up[here])
        return out & self.mask

    def pieces(self, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
        for i in range(0, len(at), PIECE):
            yield self.hashes(at[i : i + PIECE], n)

    def among(self, at: np.ndarray, n: int, answers: np.ndarray) -> np.ndarray:
        """Those positions of which the fingerprints were answered with more than 0; answers are for the distinct fingerprints of each piece."""
        some, begin = [], 0
        for h in self.pieces(at, n):
            keys, to = np.unique(h, return_inverse=True)
            some.append(answers[begin : begin + len(keys)][to] > 0)
            begin += len(keys)
        return at[np.concatenate(some)] if some else at

    def sampled(self) -> np.ndarray:
        """Sampled positions of the texts that take part, ascending."""
        most = int(self.size[self.part].max(initial=0))
        own = (np.arange(0, most, self.period)[:, None] + self.cover).ravel()
        ends = np.searchsorted(own, self.size[self.part] - self.short, side="right")
        return np.concatenate([np.zeros(0, np.int64), *[own[:e] + b for e, b in zip(ends, self.begin[self.part], strict=True)]])

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that holds each position; empty texts hold none."""
        return np.searchsorted(self.begin, at, side="right") - 1

    def starts(self, at: np.ndarray) -> np.ndarray:
        """Positions where a string of full length begins with one of the sampled suffixes within its reach."""
        d = self.doc(at)
        low, high = np.maximum(at - (self.length - self.short), self.begin[d]), np.minimum(at, self.begin[d] + self.size[d] - self.length)
        low, high = low[low <= high], high[low <= high]
        low = np.maximum(low, np.r_[0, high[:-1] + 1]) if len(low) else low  # what the one before has is not repeated
        n = np.maximum(high - low + 1, 0)
        return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())

    def around(self, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sampled positions those that strings with these beginnings reach over, and how many bytes before and after the SHORT ones such strings reach."""
        reach = self.length - self.short
        i, j = np.searchsorted(begin, at - reach), np.searchsorted(begin, at, side="right") - 1
        over = i <= j
        at, i, j = at[over], i[over], j[over]
        return at, at - begin[i], reach - (at - begin[j])

    def suffixes(self, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A row for each sampled position: the SHORT bytes there, those before from right to left, those after, and how many count; the rest is 0."""
        reach = self.length - self.short
        step = np.arange(reach)
        take = lambda p, n: np.where(step < n[:, None], self.text[np.clip(p, 0, len(self.text) - 1)], 0).astype(np.uint8)
        counts = np.c_[before, after].astype(">u2").view(np.uint8).reshape(-1, 4)
        return np.c_[self.text[at[:, None] + np.arange(self.short)], take(at[:, None] - 1 - step, before), take(at[:, None] + self.short + step, after), counts]

    def sent(self, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """In pieces: sorted fingerprints of the SHORT bytes and the distinct suffixes with each, which of them each position has, how often it has it here, and the positions."""
        for i in range(0, len(at), SENT):
            p = at[i : i + SENT]
            rows = np.c_[self.hashes(p, self.short).astype(">u8").view(np.uint8).reshape(-1, 8), self.suffixes(p, before[i : i + SENT], after[i : i + SENT])]
            one, to, n = np.unique(void(rows), return_inverse=True, return_counts=True)
            one = one.view(np.uint8).reshape(len(one), -1)
            yield one[:, :8].copy().view(">u8")[:, 0].astype(np.uint64), one[:, 8:], to, n[to], p


def company(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, dict]:
    """1 for keys that came more than once; vals are counts."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.bincount(group, vals[order])[group] > 1
    return out, {}


def copies(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, dict]:
    """For whole texts: 1 if the text came more than once, 2 for the first batch that has it."""
    rest, n = vals.reshape(-1, 2).T
    order = np.lexsort((np.arange(len(keys)), rest, keys))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (rest[order][1:] != rest[order][:-1])] if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    out = np.zeros(len(keys), np.uint8)
    out[order] = (np.bincount(group, n[order])[group] > 1) + 2 * new
    return out, {}


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(keys, return_counts=True)
    return keys, np.minimum(n, 2).astype(np.uint8)


def common_prefix(a: np.ndarray) -> np.ndarray:
    """Of sorted rows: how many bytes each shares with the row before; -1 for the first."""
    out = np.full(len(a), -1, np.int64)
    for i in range(1, len(a), 1 << 14):
        j = min(len(a), i + (1 << 14))
        differ = a[i:j] != a[i - 1 : j - 1]
        out[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return out


def ties(rows: np.ndarray, short: int, reach: int) -> np.ndarray:
    """Of one bucket's suffixes (as Batch.suffixes gives them): row by row, for 0 to reach bytes before the SHORT ones, whether a string that begins there and ends reach - so many bytes after them is in another row too."""
    out = np.zeros((len(rows), reach + 1), bool)
    order = np.argsort(void(rows[:, : short + reach]), kind="stable")
    share = common_prefix(rows[order, : short + reach])
    rank = np.cumsum(share < short)  # of the SHORT bytes
    many = np.bincount(rank)[rank] > 1
    order, share, rank = order[many], share[many], rank[many]
    if not len(order):
        return out
    left = share - short  # bytes to the left that a suffix shares with the one before in this order; negative: another rank
    right_key = np.c_[rank.astype(">u4").view(np.uint8).reshape(-1, 4), rows[order, short + reach : short + 2 * reach]]
    by_right = np.argsort(void(right_key), kind="stable")
    right = common_prefix(right_key[by_right]) - 4
    counts = rows[order, short + 2 * reach :].copy().view(">u2").astype(np.int64)
    most = lambda x: np.maximum(x, np.r_[x[1:], -1])
    most_left, most_right = most(left), np.empty(len(order), np.int64)
    most_right[by_right] = most(right)
    most_left, most_right = np.minimum(most_left, counts[:, 0]), np.minimum(most_right, counts[:, 1])
    group = np.empty(len(order), np.int64)
    for n in range(reach + 1):
        at = np.flatnonzero((most_left >= n) & (most_right >= reach - n))
        if not len(at):
            continue
        group[by_right] = np.cumsum(right < reach - n)
        _, to, c = np.unique(np.cumsum(left < n)[at] * (len(order) + 1) + group[at], return_inverse=True, return_counts=True)
        out[order[at], n] = c[to] > 1
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = SHORT, used: int = FINGERPRINT_BITS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs; other columns are not read.

    Every byte goes that is covered by a string of length bytes which begins anywhere else too, in any row, repeated rows
    included. Null and empty texts have nothing to remove. kept is what is left, binary, as it need not be whole characters.
    An empty df gives an empty result. used: bits of a fingerprint that count; the result is the same with any. A text is never cut: its task needs some five times its size.

    Whole texts are compared first (by 128 bits of SHA-256), so that of a group of copies one takes part. Then fingerprints of
    a difference cover's share (16 of 181) of all positions, and of the strings about those that are left, are dealt out, each
    batch of texts sending a distinct one once. What has company by them is sorted by bytes. A batch sends a suffix there only as far as
    such strings reach, and equal ones once, so a passage that a third of all documents share comes once from each batch.
    """
    reach = length - short
    packed = pack(docs, id_col, text_col, BATCH_BYTES)
    bits = ranges(packed)

    def each(f):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    yield from f(r, Batch(r.sizes, r.blob, length, short, used))

        return run

    def joined(parts, kind=np.uint8) -> np.ndarray:
        return np.frombuffer(b"".join(parts) if parts is not None else b"", kind)

    def wholes(r, b: Batch) -> Iterator[pd.DataFrame]:
        yield dealt(r.batch, *b.wholes()[:2], bits)

    def samples(r, b: Batch) -> Iterator[pd.DataFrame]:
        b.take(joined(r.whole))
        for i, h in enumerate(b.pieces(b.sampled(), short)):
            yield dealt(r.batch, *counted(h), bits, i)

    def left(r, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions that can have company, and where strings with them begin."""
        b.take(joined(r.whole))
        at = b.among(b.sampled(), short, joined(r.sample))
        return at, b.starts(at)

    def strings(r, b: Batch) -> Iterator[pd.DataFrame]:
        for i, h in enumerate(b.pieces(left(r, b)[1], length)):
            yield dealt(r.batch, *counted(h), bits, i)

    def chosen(r, b: Batch) -> Iterator[pd.DataFrame]:
        at, begin = left(r, b)
        at, before, after = b.around(at, b.among(begin, length, joined(r.string)))
        yield pd.DataFrame({"batch": [r.batch], "at": [np.diff(at, prepend=0).astype("<u4").tobytes()], "before": [before.astype("<u2").tobytes()], "after": [after.astype("<u2").tobytes()]})

    def again(r, b: Batch):
        at, before, after = (np.frombuffer(x if x is not None else b"", kind).astype(np.int64) for x, kind in ((r.at, "<u4"), (r.before, "<u2"), (r.after, "<u2")))
        return b.sent(np.cumsum(at), before, after)

    def suffixes(r, b: Batch) -> Iterator[pd.DataFrame]:
        for i, (keys, rows, _, _, _) in enumerate(again(r, b)):
            full, cut = cuts(keys, bits)
            yield pd.DataFrame({"range": full, "batch": r.batch, "piece": np.int32(i), "rows": [zstandard.compress(rows[x:y].tobytes(), 3) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]})

    def sort(g: pd.DataFrame) -> pd.DataFrame:
        """A bucket: its suffixes sorted, and for each the strings it shares, as bits."""
        g = g.sort_values(["batch", "piece"])
        rows = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, short + 2 * reach + 4) for x in g["rows"]]
        ends = np.cumsum([len(x) for x in rows])
        out = np.packbits(ties(np.concatenate(rows), short, reach), axis=1, bitorder="little")
        return pd.DataFrame({"range": g["range"], "batch": g["batch"], "piece": g["piece"], "ans": [x.tobytes() for x in np.split(out, ends[:-1])]})

    def cut(r, b: Batch) -> Iterator[pd.DataFrame]:
        b.take(joined(r.whole))
        answers, width, begin, found = joined(r.tie), reach // 8 + 1, 0, [np.zeros(0, np.int64)]
        for keys, rows, to, n, p in again(r, b):
            tie = np.unpackbits(answers[begin : begin + width * len(keys)].reshape(-1, width), axis=1, count=reach + 1, bitorder="little")[to].astype(bool)
            begin += width * len(keys)
            counts = rows[:, short + 2 * reach :].copy().view(">u2").astype(np.int64)[to]
            step = np.arange(reach + 1)
            tie |= (n > 1)[:, None] & (step <= counts[:, :1]) & (reach - step <= counts[:, 1:])
            i, j = np.nonzero(tie)
            found.append(np.unique(p[i] - j))
        at = np.unique(np.concatenate(found))
        d = b.doc(at)
        new = np.flatnonzero(np.r_[True, (at[1:] > at[:-1] + length) | (d[1:] != d[:-1])]) if len(at) else np.zeros(0, np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, i, j in zip(d[new].tolist(), at[new].tolist(), (at[np.r_[new[1:], len(at)] - 1] + length).tolist() if len(at) else [], strict=True):
            spans.setdefault(k, []).append((i, j))
        out = []
        for k, (a, n, whole) in enumerate(zip(b.begin.tolist(), b.size.tolist(), b.repeated.tolist(), strict=True)):
            own = [(a, a + n)] if whole else spans.get(k, [])
            rest = b"".join(b.raw[x:y] for x, y in zip([a, *(y for _, y in own)], [*(x for x, _ in own), a + n], strict=True))
            out.append((n, n - len(rest), len(own), hashlib.sha256(rest).hexdigest(), rest))
        out = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out.insert(0, "doc_id", doc_ids(r.ids, r.none))
        yield out

    def answered(out: DataFrame, name: str) -> DataFrame:
        """What comes back to each batch, written down; the shuffles before it are given up."""
        out = returned(kept(out, f"repeats-{name}"), name)
        release(out.sparkSession)
        return out

    whole = answered(meet(packed.mapInPandas(each(wholes), DEALT), "u8", copies, ""), "whole")
    first = packed.join(whole, "batch", "left")
    sample = answered(meet(first.mapInPandas(each(samples), DEALT), "u1", company, ""), "sample")
    second = first.join(sample, "batch", "left")
    string = answered(meet(second.mapInPandas(each(strings), DEALT), "u1", company, ""), "string")
    third = second.join(string, "batch", "left")
    at = kept(third.mapInPandas(each(chosen), "batch long, at binary, before binary, after binary"), "repeats-at")
    fourth = first.join(at, "batch", "left")
    tie = answered(fourth.mapInPandas(each(suffixes), "range int, batch long, piece int, rows binary").groupBy("range").applyInPandas(sort, ANSWERED), "tie")
    return fourth.join(tie, "batch", "left").mapInPandas(each(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
