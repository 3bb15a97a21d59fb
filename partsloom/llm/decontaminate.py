"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index is impact-scaled so that an item's own threshold is 1, posting lists are cut into blocks with their greatest impact, and
block-max WAND finds all items that a passage lifts to their threshold. What it finds is verified by shared shingles of the whole item, of five words, or of two if it is
short, and by the words of its question and of its answer. The thresholds are low enough that an item which can pass the verification is always found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, kept, table
from .simhash import LOWER

K1, B = 1.2, 0.75
SHINGLE = 5
#: Items of fewer words can have shingles of PAIR words instead: one word changed takes five shingles, more than the fifth that may be lacking.
SHORT_WORDS, PAIR = 29, 2
#: Least share of an item's shingles, and of the words of its question and of its answer, that one passage must hold.
OVERLAP, PART_OVERLAP = 0.8, 0.5
COMMON = 0.6
BLOCK = 16
#: Bytes of benchmark text that go into one index, which takes some 90 times as much memory in a worker; more take several passes over the documents.
INDEX_BYTES = 2_000_000
#: Words looked up at a time.
CHUNK = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    """Distinct shingles, joined by spaces; the whole sequence if it has fewer words; none without words."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def question_answer(text: str | None) -> tuple[str, str]:
    """An item's question and answer: what stands before and after its last line break; without one the whole text is both."""
    text = (text or "").strip()
    q, _, a = text.rpartition("\n")
    return (q, a) if q.strip() and a.strip() else (text, text)


@dataclass(frozen=True)
class Counts:
    """Of all items with words: how many there are, their words, and in how many of them each word is."""

    items: int
    words: int
    held: dict[bytes, int]


class Index:
    """Items of which question and answer hold no words are left out, as nothing could match them. Frequencies of words and the mean length are those of counts, or of these items."""

    def __init__(self, items: list[tuple[int | None, str | None]], counts: Counts | None = None):
        parts = [(i, *question_answer(t)) for i, t in items]
        self.items = [(i, words_of(q), words_of(a), words_of(q) if q is a else words_of(f"{q} {a}")) for i, q, a in parts]
        self.items = [x for x in self.items if x[3]]
        self.ids = [x[0] for x in self.items]
        forms = [(SHINGLE, PAIR) if len(x[3]) < SHORT_WORDS else (SHINGLE,) for x in self.items]
        #: For each item, by length of shingles: those of the question, of the answer and of both.
        self.sets = [{k: (shingles(q, k), shingles(a, k), shingles(q, k) | shingles(a, k)) for k in form} for form, (_, q, a, _) in zip(forms, self.items, strict=True)]
        n, sizes = len(self.items), [len(x[3]) for x in self.items]
        every = counts.items if counts else n
        mean = (counts.words if counts else sum(sizes)) / max(1, every)
        found: dict[bytes, dict[int, int]] = {}
        for k, x in enumerate(self.items):
            for w in x[3]:
                at = found.setdefault(w, {})
                at[k] = at.get(k, 0) + 1
        self.term = {w: t for t, w in enumerate(found)}
        gain: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        for w, at in found.items():
            df = counts.held[w] if counts else len(at)
            idf = math.log(1 + (every - df + 0.5) / (df + 0.5))
            for k, tf in at.items():
                gain[k].append((idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[k] / mean)), self.term[w]))
        self.own = np.array([sum(g for g, _ in x) for x in gain])
        # A passage with OVERLAP of the shingles lacks at most the others. Lacking words costs at least as many shingles, unless all of a part are gone.
        self.least = np.empty(n)
        for k, x in enumerate(gain):
            lack = 0
            for size, (q, a, both) in self.sets[k].items():
                spare = math.floor((1 - OVERLAP) * len(both) + 1e-9)
                lack = max(lack, spare + sum(size - 1 for part in (q, a) if len(part) <= spare + size - 1))  # a short part can lose all its words with few shingles
            self.least[k] = sum(sorted(g for g, _ in x)[: max(1, len(x) - lack)])
        postings: list[list[tuple[int, float]]] = [[] for _ in found]
        for k, x in enumerate(gain):
            for g, t in x:
                postings[t].append((k, g / self.least[k] * (1 + 1e-9)))
        self.docs = [[k for k, _ in p] for p in postings]
        self.impact = [[g for _, g in p] for p in postings]
        self.block = [[max(g for _, g in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in postings]
        self.top = [max(g) for g in self.impact]
        self._essential(n)
        #: A passage is two steps long and starts at every step, so that any run of words up to the longest item and a quarter more is in one.
        self.step = max(64, math.ceil(1.25 * max(sizes, default=1)))

    def _essential(self, n: int) -> None:
        """Splits each item's terms: the most common ones, while they add up to less than COMMON, may all be in a passage; the rest, the essential ones, must make up what is missing to 1."""
        common, self.needed = np.zeros(n), np.ones(n)
        lists: list[list[tuple[int, float]]] = [[] for _ in self.docs]
        for t in sorted(range(len(self.docs)), key=lambda t: -len(self.docs[t])):
            for k, g in zip(self.docs[t], self.impact[t], strict=True):
                if common[k] + g < COMMON:
                    common[k] += g
                else:
                    lists[t].append((k, g))
        self.needed = 1 - common
        self.first = np.cumsum([0] + [len(x) for x in lists])
        self.item = np.array([k for x in lists for k, _ in x], np.int64)
        self.gain = np.array([g for x in lists for _, g in x])

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose scaled score for the distinct terms is 1 or more: block-max WAND with a fixed threshold."""
        cursor = [[self.docs[t][0], 0, t] for t in terms]
        out = []
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, -1
            for j, (_, _, t) in enumerate(cursor):
                bound += self.top[t]
                if bound >= 1:
                    pivot = j
                    break
            if pivot < 0:
                break
            k = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == k:
                pivot += 1
            head = cursor[: pivot + 1]
            blocks, until = 0.0, len(self.items)  # the greatest impacts of the blocks that hold k, and where the first of these ends
            for c in head:
                self._forward(c, k, shallow=True)
                if c[1] < len(self.docs[c[2]]):
                    b = c[1] // BLOCK
                    blocks += self.block[c[2]][b]
                    until = min(until, self.docs[c[2]][min((b + 1) * BLOCK, len(self.docs[c[2]])) - 1] + 1)
            if blocks >= 1:
                if cursor[0][0] == k:
                    score = 0.0
                    for c in head:
                        score += self.impact[c[2]][c[1]]
                        c[1] += 1
                        c[0] = self.docs[c[2]][c[1]] if c[1] < len(self.docs[c[2]]) else -1
                    if score >= 1:
                        out.append((k, score))
                else:
                    for c in head:
                        self._forward(c, k)
            else:
                to = max(k + 1, min(until, cursor[pivot + 1][0] if pivot + 1 < len(cursor) else until))
                for c in head:
                    self._forward(c, to)
            cursor = [c for c in cursor if c[0] >= 0]
        return out

    def _forward(self, c: list[int], k: int, shallow: bool = False) -> None:
        """Moves a cursor on to item k or the first after it; shallow: only on to the block where that is."""
        docs, at = self.docs[c[2]], c[1]
        while at < len(docs) and docs[min((at // BLOCK + 1) * BLOCK, len(docs)) - 1] < k:
            at = (at // BLOCK + 1) * BLOCK
        if shallow:
            c[1] = at
            return
        while at < len(docs) and docs[at] < k:
            at += 1
        c[1], c[0] = at, docs[at] if at < len(docs) else -1

    def verify(self, words: list[bytes], k: int) -> tuple[float, float, float]:
        """The share of item k's shingles that the words hold, of the length that gives the larger one, and the shares of its question's and its answer's words."""
        text = b" " + b" ".join(words) + b" "

        def share(size: int, s: set[bytes]) -> float:
            here = shingles(words, size) if len(words) >= size else set()
            return sum(x in here or (x.count(b" ") < size - 1 and b" " + x + b" " in text) for x in s) / len(s)

        held = lambda part: len(set(part) & set(words)) / len(set(part))
        return max(share(size, x[2]) for size, x in self.sets[k].items()), held(self.items[k][1]), held(self.items[k][2])

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(number of the text, item, score, question's share, answer's share), once for each text and item, of the passage that holds most of it.

        A passage is searched only if, for some item, its distinct essential terms reach what that item needs of them. That
        bound is found for all passages of many texts at a time and loses nothing.
        """
        if not self.items:
            return []
        split = [words_of(t) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((i for w in split for i in map(self.term.get, w, repeat(-1))), np.int64, int(size.sum()))
        owner, place = np.repeat(np.arange(len(split)), size), np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(at >= 0)
        at, owner, place = at[hit], owner[hit], place[hit]
        order = np.lexsort((place, at, owner))
        before = np.full(len(at), -1)
        same = (at[order][1:] == at[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        before[order[1:][same]] = place[order[:-1][same]]
        steps = np.maximum(1, -(-size // self.step))
        base = np.cumsum(steps) - steps
        use = np.flatnonzero(self.first[at + 1] > self.first[at])
        at, owner, place, before = at[use], owner[use], place[use], before[use]
        keys, gains = [], []
        for back in (0, 1):  # a word is in the passage that starts at its own step and in the one before
            begin = (place // self.step - back) * self.step
            new = np.flatnonzero((begin >= 0) & (before < begin))
            n = self.first[at[new] + 1] - self.first[at[new]]
            p = np.repeat(self.first[at[new]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            keys.append(np.repeat(base[owner[new]] + place[new] // self.step - back, n) * len(self.items) + self.item[p])
            gains.append(self.gain[p])
        cell, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(gains), len(cell))
        found = np.unique(cell[total >= self.needed[cell % len(self.items)] - 1e-9] // len(self.items))
        best: dict[tuple[int, int], tuple] = {}
        for p in found:
            d = int(np.searchsorted(base, p, side="right")) - 1
            begin = int(p - base[d]) * self.step
            words = split[d][begin : begin + 2 * self.step]
            terms = {t for t in map(self.term.get, words) if t is not None}
            for k, score in self.search(sorted(terms)):
                both, q, a = self.verify(words, k)
                if both >= OVERLAP and q >= PART_OVERLAP and a >= PART_OVERLAP:
                    best[d, k] = max(best.get((d, k), ()), (both, score * self.least[k] / self.own[k], q, a))
        return [(d, k, s, q, a) for (d, k), (_, s, q, a) in best.items()]


def counted(src: DataFrame) -> DataFrame:
    """(word, n, total) of items (t): in how many items with words each word is; one row of a null word has the number of such items and of all their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["t"].tolist():
                q, a = question_answer(t)
                w = words_of(q) if q is a else words_of(f"{q} {a}")
                if w:
                    yield pd.DataFrame({"word": pd.Series([None, *set(w)], dtype=object), "total": [len(w)] + [0] * len(set(w))})

    return src.select("t").mapInPandas(run, "word binary, total long").groupBy("word").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """An index for each INDEX_BYTES of items or so, dealt by hash of the text; most benchmarks need one. One is built at a time, with the counts of all items, so that scores do not depend on the parts."""
    src = items.select(col(id_col).cast("bigint").alias("i"), col(text_col).cast("string").alias("t"))
    n = -(-int(src.agg(F.coalesce(F.sum(F.octet_length("t") + 100), F.lit(0))).first()[0]) // INDEX_BYTES)
    every = kept(counted(src), "benchmark-words") if n > 1 else None
    for k in range(n):
        part = src.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        rows, counts = part.collect(), None
        if every is not None:
            own = every.join(counted(part).select("word"), "word").collect()  # the words of this part alone
            whole = every.where("word is null").first()
            counts = Counts(whole["n"] if whole else 0, whole["total"] if whole else 0, {bytes(r["word"]): r["n"] for r in own})
        yield Index(sorted(((r["i"], r["t"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), counts)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each row of docs and each item that it gives away; other columns are not read.

    score is the BM25 score of the best passage as a share of the item's score for itself. Null or empty
    texts match nothing, nor do items without words; equal items match each. A long document is cut into passages and
    stays in its task, which takes some thirty times its size. An empty docs or items gives an empty result. The broadcast index is bounded by INDEX_BYTES.
    """
    spark = docs.sparkSession
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType)] + [T.StructField("item_id", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")])
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for b in batches:
                texts = b.column("t").to_pylist()
                size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts)).cumsum() // (6 * CHUNK)
                for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1):
                    hits = sent.value.matches([texts[i] for i in part.tolist()])
                    ids = b.column("doc_id").take(pa.array([int(part[h[0]]) for h in hits], pa.int64()))  # ids as they are; pandas would make floats of them beside a null
                    yield pa.RecordBatch.from_arrays([ids, pa.array([sent.value.ids[h[1]] for h in hits], pa.int64()), *(pa.array([float(h[j]) for h in hits], pa.float64()) for j in (2, 3, 4))], schema.names)

        out = out.unionByName(src.where(F.length("t") > 0).mapInArrow(run, schema))
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
