"""Token ids in binary files with Elias-Fano document boundaries."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, kept, shared_dir, table

END_ID = 1
#: Ids a file holds before the next one is begun; a longer document has a file of its own.
FILE_IDS = 16_000_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_500_000
#: Bytes of text encoded at a time; runs of words encoded in one go.
CHUNK, JOINED = 4_000_000, 200
MAGIC = b"PLTOK1\0\0"
#: One position is kept for so many documents.
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of n numbers up to u in about n * (2 + log2(u / n)) bits.

    The low bits of each number are packed; the high parts stand in unary in a bit vector, so the i-th number is found where
    the i-th one bit is. Every SAMPLE-th one's position is kept in four bytes (eight if the vector is that long), and
    select counts bits from there on.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low, self.lows, self.high, self.sample = n, low, lows, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little")
        at = (v >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        vector = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        vector[at.astype(np.int64)] = 1
        sample = at[::SAMPLE]
        return cls(n, low, lows, np.packbits(vector, bitorder="little"), sample.astype("<u8" if n and at[-1] >> np.uint64(32) else "<u4"))

    def tobytes(self) -> bytes:
        parts = [self.lows.tobytes(), self.high.tobytes(), self.sample.tobytes()]
        return struct.pack("<QBB", self.n, self.low, self.sample.dtype.itemsize) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def frombytes(cls, b: bytes) -> tuple[EliasFano, int]:
        """The sequence at the start of b, and how many bytes it takes."""
        n, low, wide = struct.unpack_from("<QBB", b)
        sizes, at, parts = struct.unpack_from("<3Q", b, 10), 34, []
        for s, kind in zip(sizes, ("u1", "u1", f"<u{wide}"), strict=True):
            parts.append(np.frombuffer(b[at : at + s], kind))
            at += s
        return cls(n, low, *parts), at

    def _lows(self, i: int, j: int) -> np.ndarray:
        a, b = i * self.low, j * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low) if self.low else np.zeros((j - i, 0), np.uint8)
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int, j: int) -> np.ndarray:
        """Numbers i up to j (left out)."""
        if i >= j:
            return np.zeros(0, np.int64)
        first, stop = i // SAMPLE, -(-j // SAMPLE)
        a = int(self.sample[first])
        b = int(self.sample[stop]) if stop < len(self.sample) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : -(-b // 8)], bitorder="little")) + a // 8 * 8
        ones = ones[np.searchsorted(ones, a) :][i - first * SAMPLE : j - first * SAMPLE]
        return (((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)) | self._lows(i, j)).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])


# How a tokenizer file must prepare texts to be encoded word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words of small Latin-1 letters and of printable ASCII but capitals, apostrophes and what begins special tokens, and their runs, each of which the tokenizer above takes by itself.
PLAIN, RUNS = re.compile(r"[!-&(-;=-@\[-~ß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def suited(path: str) -> bool:
    """Whether encoding a text is the same as encoding its words between ASCII white space, lower-cased, one after the other."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model = d["model"]
    same = d["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS} and d["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not (model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"])
    return same and plain and not (d["truncation"] or d["padding"]) and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"]) for x in d["added_tokens"])


class Encoder:
    """Encodes texts, each followed by the end id.

    For a suited tokenizer a column of texts is lower-cased, split and reduced to its distinct words in Arrow; ids are looked up
    for those, and remembered. New words of plain characters are cut into their runs, and new runs are encoded many at a
    time without the steps that do nothing to them. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.by_words = suited(path)
        if self.by_words:
            self.runs = Tokenizer(self.tokenizer.model)
            self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)  # ids that end a run
            self.ends[[i for t, i in self.runs.get_vocab().items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {" ": 0, "": 1}  # no words: the end of a text, and what splitting leaves at its edges
        self.offset, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.size[0], self.flat[0], self.used = 1, END_ID, 1

    def raw(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remembers words; ids are theirs, one word after the other."""
        n, m = len(self.known), len(ids)
        if n + len(words) > len(self.size):
            self.offset, self.size = (np.resize(a, 2 * (n + len(words))) for a in (self.offset, self.size))
        if self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + m))
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.size[n : n + len(words)] = size
        self.offset[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + m] = ids
        self.used += m

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered words, one after the other, and where each word ends in them."""
        size = self.size[at]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.offset[at] - end + size, size) + np.arange(end[-1] if len(end) else 0)], end

    def learn(self, words: list[str]) -> None:
        """words are distinct and not known."""
        cut = [RUNS.findall(w) if PLAIN.fullmatch(w) else [] for w in words]
        new = list(dict.fromkeys(r for c in cut for r in c if r not in self.known))
        encode = getattr(self.runs, "encode_batch_fast", self.runs.encode_batch)
        got = [e.ids for e in encode([" ".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED)], add_special_tokens=False)]
        got = np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in got)])
        at = np.flatnonzero(self.ends[got]) + 1
        if len(at) != len(new):
            raise ValueError("the tokenizer does not end each run with an id of its own")
        self.keep(new, got, np.diff(at, prepend=0))
        several = [i for i, c in enumerate(cut) if len(c) > 1]
        count = np.fromiter((len(cut[i]) for i in several), np.int64, len(several))
        ids, end = self.ids(np.fromiter((self.known[r] for i in several for r in cut[i]), np.int64, int(count.sum())))
        self.keep([words[i] for i in several], ids, np.diff(end[np.cumsum(count) - 1], prepend=0) if several else count)
        whole = [w for w, c in zip(words, cut, strict=True) if not c]
        ids = self.raw(whole)
        self.keep(whole, np.fromiter((x for y in ids for x in y), np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For an Arrow column of texts: all ids, one text after the other, and where each text ends in them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_words:
            ids = [[*x, END_ID] for x in self.raw(texts.to_pylist())]
            return np.fromiter((x for y in ids for x in y), np.uint32), np.cumsum([len(x) for x in ids])
        if len(self.known) > CACHE_WORDS:
            self.reset()
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # the strings of special tokens stand as they are
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        own = words.dictionary.to_pylist()
        code = np.fromiter(map(self.known.get, own, repeat(-1)), np.int64, len(own))
        miss = np.flatnonzero(code < 0)
        if len(miss):
            new = [own[i] for i in miss.tolist()]
            self.learn(new)
            code[miss] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ends = np.asarray(split.offsets)[1:] - np.asarray(split.offsets)[0]
        ids, end = self.ids(np.insert(code[words.indices.to_numpy()], ends, 0))
        return ids, end[ends + np.arange(len(ends))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def file_system(uri: str):
    """Arrow's file system for a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def file_bytes(doc_ids: np.ndarray, missing: np.ndarray, ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """Layout, little-endian: magic, bytes an id (1), count of documents (8); ids of documents (8 each), a bit each for a null one; Elias-Fano ends; ids."""
    head = MAGIC + struct.pack("<BQ", width, len(doc_ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), np.packbits(missing, bitorder="little").tobytes(), EliasFano.encode(ends).tobytes(), ids.astype(f"<u{width}").tobytes()])


def parse(b: bytes) -> tuple[np.ndarray, np.ndarray, EliasFano, np.ndarray]:
    if b[:8] != MAGIC:
        raise ValueError("not a token file")
    width, n = struct.unpack_from("<BQ", b, 8)
    at = 17 + 8 * n
    doc_ids, missing = np.frombuffer(b, "<i8", n, 17), np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), at), count=n, bitorder="little").astype(bool)
    at += -(-n // 8)
    ends, took = EliasFano.frombytes(memoryview(b)[at:])
    return doc_ids, missing, ends, np.frombuffer(b, f"<u{width}", offset=at + took)


def pc_size(texts) -> np.ndarray:
    """Bytes of each text of an Arrow column."""
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, id_col: str, text_col: str, folder: str, tokenizer: str) -> DataFrame:
    """Writes the ids of all texts in ascending order of id and returns the list of files: part, seq, path, n_docs, n_ids, start.

    Documents are dealt out by range of (id, hash of the text), so equal or null ids (first) may take several parts, and their
    order is by hash and text. Each part is encoded as it streams by and cut into files of about FILE_IDS ids. Each try of
    a task names its files anew and only those of the tries that succeeded are listed, so lost executors do no
    harm. start is the count of ids in all files before. A text is never cut: its task needs some twenty times its size.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = file_system(folder)
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            nonlocal held, seq
            path = f"{part:06d}-{seq:05d}-{uuid.uuid4().hex}.ids"
            doc_ids, missing, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            with store.open_output_stream(f"{root}/{path}") as out:
                out.write(file_bytes(doc_ids, missing, np.cumsum(sizes), ids, enc.width))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})
            held, seq = [], seq + 1
            return row

        for b in batches:
            size = pc_size(b.column("t"))
            for p in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
                if not len(p):
                    continue
                here = b.slice(int(p[0]), len(p))
                ids, ends = enc.encode(here.column("t"))
                held.append((here.column("id").to_numpy(), here.column("none").to_numpy(zero_copy_only=False), np.diff(ends, prepend=0), ids.astype(f"<u{enc.width}")))
                if sum(len(x[3]) for x in held) >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    spark = docs.sparkSession
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    src = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t"))
    src = src.withColumn("h", F.xxhash64("t")).repartitionByRange(F.col("id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "t")
    files = kept(src.select(F.coalesce("id", F.lit(0).cast("bigint")).alias("id"), F.col("id").isNull().alias("none"), "t").mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, a file a task at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                with store.open_input_stream(f"{root}/{path}") as f:
                    doc_ids, missing, ef, ids = parse(f.read())
                ends = ef.select(0, ef.n)
                begins = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": start + begins, "n_tokens": ends - begins, "ids_crc32": np.array(crc, np.int64)})
                out.loc[missing, "doc_id"] = pd.NA
                yield out

    n = max(1, files.count())
    return files.repartition(n, "path").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is encoded as an empty one: the end id alone. Repeated rows are written as often as they come; an empty table gives no files."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(kept(files, "token-list"), folder)
