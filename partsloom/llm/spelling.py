"""Groups of spelling variants: words one edit apart, found by generating the whole neighbourhood of each word.

Every distinct deletion, replacement and insertion over the alphabet that the vocabulary shows is a candidate, and candidates are hash-joined to the
vocabulary by the whole string: what meets is one edit apart, with no distance to verify. Candidates are made as 64-bit numbers, many at a
time; a Bloom filter of the vocabulary, in parts of bounded size, lets nearly none but words become strings and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, col, kept, table

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence of so many loses a letter.
EVERY = 31
#: Bits of the filter for each word and probes; most bytes of a part, and of the parts that are sent to tasks at a time.
BITS, PROBES, PART_BYTES, SENT_BYTES = 24, 5, 4_000_000, 64_000_000
#: Words of a task, and candidates made at a time.
TASK_WORDS, CHUNK = 40_000, 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
#: Odd factors, one to choose the part and one for each probe.
FACTORS = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(PROBES + 1)]


def letter_values(codes: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each code point."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def code_points(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each of words, which have the same length."""
    return np.array(words, f"<U{length}").view("<u4").reshape(len(words), length)


def strings(codes: np.ndarray) -> list[str]:
    return np.ascontiguousarray(codes, "<u4").view(f"<U{codes.shape[1]}").ravel().tolist()


def numbers(words: pd.Series) -> np.ndarray:
    """The number of each word: the sum of its letters' values by powers of BASE."""
    out = np.zeros(len(words), np.uint64)
    for length, at in words.groupby(words.str.len()).indices.items():
        codes = code_points(words.iloc[at].tolist(), length)
        out[at] = (letter_values(codes) * powers(length)).sum(axis=1, dtype=np.uint64)
    return out


def places(x: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where a probe looks, below 2**bits."""
    return (x * FACTORS[probe]) >> np.uint64(64 - bits) if bits else np.zeros(len(x), np.uint64)


class Filter:
    """Parts first to last of a filter of 2**parts_bits parts of 2**bits bits."""

    def __init__(self, parts_bits: int, bits: int, first: int, parts: list[bytes]):
        self.parts_bits, self.bits, self.first = parts_bits, bits, first
        self.held = np.frombuffer(b"".join(parts), np.uint8)
        self.n = len(parts)

    def look(self, x: np.ndarray) -> np.ndarray:
        """The indexes of numbers that may be words of these parts; each probe looks at what the ones before let through."""
        at = None
        base = np.uint64(0)
        if self.parts_bits:
            part = places(x, 0, self.parts_bits)
            at = np.flatnonzero((part >= np.uint64(self.first)) & (part < np.uint64(self.first + self.n)))
            x, base = x[at], (part[at] - np.uint64(self.first)) << np.uint64(self.bits)
        for probe in range(1, PROBES + 1):
            p = base + places(x, probe, self.bits)
            hit = np.flatnonzero((self.held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            at = hit if at is None else at[hit]
            x = x[hit]
            base = base[hit] if self.parts_bits else base
        return at


def part_of(words: pd.Series, parts_bits: int, bits: int) -> bytes:
    """The part of the filter that holds words."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    x = numbers(words)
    for probe in range(1, PROBES + 1):
        p = places(x, probe, bits)
        np.bitwise_or.at(out, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def edits(words: list[str], length: int, alphabet: np.ndarray, look) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(index of the word, candidate) for all distinct deletions, replacements and insertions of words of one length that look lets through, CHUNK numbers at a time.

    Equal results of one word are made once: of equal letters in a row the first is deleted, a letter is not replaced by itself, and none is inserted after its like.
    """
    codes, n, a = code_points(words, length), len(words), len(alphabet)
    by, values = powers(length + 2), letter_values(alphabet)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    own = letter_values(codes) * by[:length]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(own, axis=1, dtype=np.uint64)], axis=1)  # of the first i letters
    after = before[:, -1:] - before  # of the letters from i on
    step = max(1, CHUNK // (n * a))
    columns = np.arange(length + 1)
    for i in range(0, length + 1, step):
        at = np.arange(i, min(i + step, length))  # positions of letters
        if len(at):
            w, p = np.nonzero(np.concatenate([np.ones((n, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)[:, at])
            p = at[p]
            found = look(before[w, p] + after[w, p + 1] * inverse)
            if len(found) and length > 1:
                w, p = w[found], p[found]
                c = columns[None, : length - 1]
                yield w, strings(np.take_along_axis(codes[w], c + (c >= p[:, None]), axis=1))
            x = (before[:, at] + after[:, at + 1])[:, :, None] + by[at][None, :, None] * values[None, None, :]
            for w, p, c in _found(x, look, at):
                keep = codes[w, p] != alphabet[c]
                w, p, c = w[keep], p[keep], c[keep]
                new = codes[w]
                new[np.arange(len(w)), p] = alphabet[c]
                yield w, strings(new)
        at = np.arange(i, min(i + step, length + 1))  # positions between them
        x = (before[:, at] + after[:, at] * np.uint64(BASE))[:, :, None] + by[at][None, :, None] * values[None, None, :]
        for w, p, c in _found(x, look, at):
            keep = (p == 0) | (codes[w, p - 1] != alphabet[c])
            w, p, c = w[keep], p[keep], c[keep]
            new = np.take_along_axis(codes[w], np.minimum(columns[None, :] - (columns[None, :] > p[:, None]), length - 1), axis=1)
            new[np.arange(len(w)), p] = alphabet[c]
            yield w, strings(new)


def _found(x: np.ndarray, look, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found = look(x.ravel())
    if len(found):
        w, p, c = np.unravel_index(found, x.shape)
        yield w, at[p], c


def words_of(docs: DataFrame, id_col: str, text_col: str, letters: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the words that whole texts hold and how often. Maximal runs of letters are lower-cased (A-Z alone); where every divides the crc32 of `id:run` (a null id is nothing), the
    letter at crc32 % length goes. Words have least_length code points and least_count occurrences at least. A null text has none; a text's runs are held by its task, some ten times its size.

    Runs shorter than least_length can't become words and are never made. Sums are taken before the shuffle, so a frequent word is one row from each task.
    """
    run = F.explode(F.regexp_extract_all(col(text_col).cast("string"), F.lit(f"[{letters}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best: struct(n, word)) for each word of vocabulary (word, n; distinct, n positive) that has one: the number of words one insertion, deletion or replacement away, and
    the one of them with the largest n (ties: the smallest in code-point order).

    Nearness goes both ways, so the words that make a candidate are the ones near it: one exchange by candidate counts them. A filter of the vocabulary takes BITS bits a word in parts of PART_BYTES; SENT_BYTES
    of parts are sent to the tasks at a time, and a larger vocabulary makes several rounds with the same result. A candidate has at most (2 * length + 1) * letters sources.
    """
    spark = vocabulary.sparkSession
    v = kept(vocabulary.select("word", F.col("n").cast("bigint").alias("n")).where("length(word) > 0"), "spelling-words")
    count = v.count()
    letters = v.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect() if r["c"]), "<u4")  # bounded by the code points there are
    parts_bits = max(0, (-(-count * BITS // 8 // PART_BYTES) - 1).bit_length()) if count else 0
    bits = max(10, (-(-count * BITS >> parts_bits) - 1).bit_length() if count else 0)
    made = "cand string, n long, word string"

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"part": places(numbers(b["word"]), 0, parts_bits).astype(np.int64), "word": b["word"].astype(object)})

    def built(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": g["part"].iloc[:1], "bits": [part_of(g["word"], parts_bits, bits)]})

    parts = kept(v.select("word").mapInPandas(dealt, "part long, word string").groupBy("part").applyInPandas(built, "part long, bits binary"), "spelling-filter")
    work = v.repartition(max(1, -(-count // TASK_WORDS)), "word")
    per, out = max(1, SENT_BYTES * 8 >> bits), None
    for first in range(0, 1 << parts_bits, per):
        got = {r["part"]: bytes(r["bits"]) for r in parts.where(F.col("part").between(first, first + per - 1)).collect()}
        every = [got.get(i, bytes(1 << bits >> 3)) for i in range(first, min(first + per, 1 << parts_bits))]
        sent = spark.sparkContext.broadcast((first, every))

        def generate(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            held = Filter(parts_bits, bits, *sent.value)
            for b in batches:
                for length, at in b.groupby(b["word"].str.len()).indices.items():
                    step = max(1, CHUNK // ((length + 1) * max(1, len(alphabet))))
                    for i in range(0, len(at), step):
                        rows = b.iloc[at[i : i + step]]
                        words, n = rows["word"].to_numpy(object), rows["n"].to_numpy()
                        for w, cand in edits(words.tolist(), int(length), alphabet, held.look):
                            yield pd.DataFrame({"cand": pd.Series(cand, dtype=object), "n": n[w], "word": pd.Series(words[w], dtype=object)})

        more = work.mapInPandas(generate, made)
        out = more if out is None else out.union(more)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))).alias("x")
    met = out.groupBy("cand").agg(F.count("*").alias("n_near"), best)
    return v.select("word").join(met.withColumnRenamed("cand", "word"), "word").select("word", "n_near", F.struct((-F.col("x.n")).alias("n"), F.col("x.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which lead to ever more frequent words and so end: form after form to the last. A step for each link of the longest chain, which has as many as the largest count has digits at most, when each form is ten times as frequent."""
    forms = kept(forms.select("word", "form"), "spelling-forms")
    cur, moved = forms.withColumnRenamed("form", "root"), 1
    while moved:
        seen = Observation()
        step = cur.join(forms.select(F.col("word").alias("_pl_w"), F.col("form").alias("_pl_f")), F.col("root") == F.col("_pl_w"), "left")
        step = step.observe(seen, F.count("_pl_f").alias("moved")).select("word", F.coalesce("_pl_f", "root").alias("root"))
        cur = kept(step, "spelling-roots")
        moved = seen.get["moved"]
    return cur


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of vocabulary (word, n): its form is the most frequent near word (ties: the smallest in code-point
    order) if that is ratio times as frequent, or more; root follows forms to the last."""
    v = kept(vocabulary.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    all_ = v.join(near(v), "word", "left")
    form: Column = F.col("best.n") >= ratio * F.col("n")
    all_ = kept(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, F.col("best.n")).alias("form_n")), "spelling-near")
    last = roots(all_.where("form is not null"))
    return all_.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long texts: as words_of has it. Repeated rows count as often as they come; an empty table gives no words."""
    return variants(words_of(table(spark, sf_dir, "documents"), "doc_id", "text"))


_BITS = "list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_DIGITS = "hex(encode(id || ':' || run))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len({_DIGITS}) // 2), lambda x: ('0x' || substr({_DIGITS}, 2 * x + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t.byte[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
#: Near words by patterns: words that agree but for one position share the pattern that leaves it out, and a word with a letter less is what is left of the longer one.
SQL = f"""
WITH RECURSIVE t AS (SELECT list({_BITS} ORDER BY i) AS byte FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents),
h AS (SELECT run, n, {_CRC} AS h FROM (SELECT id, run, count(*) AS n FROM r GROUP BY id, run), t),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS MATERIALIZED (SELECT word, left(word, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
d AS (SELECT DISTINCT x.word AS long, v.word AS short FROM x JOIN v ON v.word = x.a || x.z),
p AS (SELECT x.word, y.word AS other FROM x JOIN x y ON x.a || '*' || x.z = y.a || '*' || y.z AND x.word <> y.word UNION ALL SELECT long, short FROM d UNION ALL SELECT short, long FROM d),
b AS (SELECT p.word, count(*) AS n_near, list(struct_pack(n := -v.n, word := other) ORDER BY -v.n, other)[1] AS best FROM p JOIN v ON v.word = other GROUP BY p.word),
f AS MATERIALIZED (SELECT b.word, best.word AS form, -best.n AS form_n FROM b JOIN v ON v.word = b.word WHERE -best.n >= {RATIO} * v.n),
c AS (SELECT word, form AS root, 1 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root),
l AS (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM v LEFT JOIN b ON b.word = v.word LEFT JOIN f ON f.word = v.word LEFT JOIN l ON l.word = v.word
"""
