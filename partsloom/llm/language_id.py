"""Language identification by string kernels.

The kernel of two texts is the number of distinct byte n-grams (n = 1, 2, 3 blended, A-Z lowered) that both hold, divided by
the geometric mean of how many each holds. Nystroem landmarks turn
it into features, on which one ridge regression a language is solved against the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, kept, table
from .simhash import LOWER

#: Bounds on the labelled rows that the classifier is fitted on: rows and landmarks for each language.
TRAIN_PER_LANG, LANDMARKS_PER_LANG = 400, 32
RIDGE = 1e-3
BINS = 4096
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: A word between blanks that is of letters, with marks at its ends or within.
WORDLIKE = regex.compile(r"[\p{P}\p{M}]*(?:\p{L}[\p{L}\p{M}'’.,;:!?)\"-]*)")
#: Cells of the presence matrix of a batch.
CELLS = 2_000_000
#: Codes of 1-, 2- and 3-grams are numbers below this.
CODES = 256 + (1 << 16) + (1 << 24)


def codes(text: str) -> list[np.ndarray]:
    a = np.frombuffer(text.encode("utf-8", "replace").translate(LOWER), np.uint8).astype(np.int32)
    two = (a[:-1] << 8) | a[1:]
    return [a, two + 256, ((two[:-1] << 8) | a[2:]) + (256 + (1 << 16))]


def distinct(c: np.ndarray) -> int:
    """How many distinct codes there are."""
    c = np.sort(c)
    return int(np.count_nonzero(c[1:] != c[:-1])) + 1 if len(c) else 0


class Model:
    """Landmarks as a presence matrix over their n-grams, and the weights of the kernels with them."""

    def __init__(self, langs: list[str], grams: np.ndarray, marks: np.ndarray, weights: np.ndarray):
        self.langs, self.grams, self.weights = langs, grams, weights
        self.marks = marks / np.sqrt(np.maximum(marks.sum(axis=0), 1))
        self._column: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_column": None}

    def presence(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        """A row for each text, a column for each n-gram that a landmark holds; the last column takes all others and is left out."""
        if self._column is None:
            self._column = np.full(CODES, len(self.grams), np.uint16 if len(self.grams) < 1 << 16 else np.int32)
            self._column[self.grams] = np.arange(len(self.grams))
        x = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        for row, parts in zip(x, texts, strict=True):
            for c in parts:
                row[self._column[c]] = 1
        return x[:, :-1]

    def kernels(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        """Kernels with every landmark, in batched matrix products, and a constant."""
        out, step = [], max(1, CELLS // (len(self.grams) + 1))
        for i in range(0, len(texts), step):
            own = np.array([max(1, sum(map(distinct, t))) for t in texts[i : i + step]], np.float32)
            out.append((self.presence(texts[i : i + step]) @ self.marks) / np.sqrt(own)[:, None])
        k = np.concatenate(out) if out else np.zeros((0, self.marks.shape[1]), np.float32)
        return np.c_[k, np.ones(len(k), k.dtype)]

    def held(self, parts: list[np.ndarray]) -> float:
        """The share of a text's 3-grams that a landmark holds; 1 without 3-grams."""
        self.presence([])
        return float((self._column[parts[2]] < len(self.grams)).mean()) if len(parts[2]) else 1.0

    def lead(self, margins: np.ndarray) -> np.ndarray:
        top = 2 - 2 / len(self.langs)
        return np.clip((margins.max(axis=1) - margins.mean(axis=1)) / top, 0, 1) if top else np.ones(len(margins))

    def predict(self, texts: list[str | None], proof: list[tuple[float, float]] | None = None, least: tuple[float, float] | None = None) -> tuple[list[str], list[float]]:
        """Languages and scores; proof, if given, gets for each text what predict() says of held and lead."""
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.langs else []
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if proof is not None:
            proof += [(0.0, 0.0)] * len(texts)
        size, begin = 0, 0
        for j, i in enumerate(known):  # long texts make small batches
            size += len(texts[i])
            if size >= CELLS // 4 or j + 1 == len(known):
                now = known[begin : j + 1]
                parts = [codes(texts[k]) for k in now]
                margins = self.kernels(parts).astype(np.float64) @ self.weights
                if proof is not None:
                    for k, part, x in zip(now, parts, self.lead(margins).tolist(), strict=True):
                        proof[k] = (self.held(part), x)
                        if least and (proof[k][0] < least[0] or x < least[1]):
                            proof[k] = max(proof[k], self.words(texts[k]), key=lambda y: (y[0] >= least[0]) & (y[1] >= least[1]))
                for k, best, m in zip(now, margins.argmax(axis=1), margins.max(axis=1), strict=True):
                    lang[k], score[k] = self.langs[best], float(min(1.0, max(0.0, (m + 1) / 2)))
                size, begin = 0, j + 1
        return lang, score

    def words(self, text: str) -> tuple[float, float]:
        """held and lead of a text's words alone, without what holds figures or signs."""
        part = codes(" ".join(w for w in text.split() if WORDLIKE.fullmatch(w)))
        return (self.held(part), float(self.lead(self.kernels([part]).astype(np.float64) @ self.weights)[0])) if len(part[0]) else (0.0, 0.0)


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """rows: language and the sorted distinct codes of a text, in the order in which landmarks are taken."""
    rows = [(lang, np.frombuffer(b, np.int32)) for lang, b in rows]
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((1, 0)))
    seen, chosen = dict.fromkeys(langs, 0), []
    for lang, c in rows:
        seen[lang] += 1
        if seen[lang] <= LANDMARKS_PER_LANG:
            chosen.append(c)
    grams = np.unique(np.concatenate(chosen))
    model = Model(langs, grams, np.zeros((len(grams), 1), np.float32), np.zeros((1, 1)))
    marks = np.concatenate([model.presence([[c]]) for c in chosen]).T
    model = Model(langs, grams, marks, np.zeros((1, 1)))
    k = model.kernels([[c] for _, c in rows]).astype(np.float64)
    value, vector = np.linalg.eigh(model.kernels([[c] for c in chosen])[:, :-1].astype(np.float64))
    root = vector @ np.diag(np.where(value > 1e-6 * value.max(), 1 / np.sqrt(np.maximum(value, 1e-12)), 0)) @ vector.T
    features = np.c_[k[:, :-1] @ root, np.ones(len(k))]
    y = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    w = np.linalg.solve(features.T @ features + RIDGE * len(k) * np.eye(features.shape[1]), features.T @ y)
    model.weights = np.r_[root @ w[:-1], w[-1:]]
    return model


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """Fits on TRAIN_PER_LANG different labelled rows of each language at most, those of least hash of id and text.

    They are chosen by hash alone and their texts are fetched afterwards, through a broadcast of TRAIN_PER_LANG hashes a language. Hashes are first
    counted in BINS bins, so that of a language with a third of all rows only those of the least bins are sorted. The
    driver receives their languages and distinct n-grams, of which a text has CODES at most.
    """
    src = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("t"))
    src = src.where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}")).select("lang", F.xxhash64("id", "t").alias("h"), "t")
    h = kept(src.select("lang", "h").distinct().withColumn("bin", F.shiftrightunsigned("h", 65 - BINS.bit_length())), "language-hashes")
    seen = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) - F.col("n")
    bins = h.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumn("seen", seen).where(F.col("seen") < TRAIN_PER_LANG).select("lang", "bin")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("bin", "h"))
    chosen = h.join(F.broadcast(bins), ["lang", "bin"]).withColumn("n", number).where(F.col("n") <= TRAIN_PER_LANG).select("lang", "h", "n")
    least = src.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "n").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "n": b["n"], "c": [np.unique(np.concatenate(codes(t))).astype("<i4").tobytes() for t in b["t"]]})

    rows = least.select("lang", "n", "t").mapInPandas(run, "lang string, n int, c binary").collect()
    return fit([(r["lang"], bytes(r["c"])) for r in sorted(rows, key=lambda r: (r["lang"], r["n"]))])


def predict(docs: DataFrame, text_col: str, model: Model, proof: bool = False, least: tuple[float, float] | None = None) -> DataFrame:
    """All columns of docs, then lang_pred (string) and score (double, 0 to 1); these replace columns so named.

    proof: and held and lead (doubles, 0 to 1). held: the share of the text's 3-grams that a landmark holds. lead: by how much the
    greatest margin is above the mean of all, where a text that is wholly of one language has 1 and one of none about 0, however
    many languages there are; with one language always 1. least: a text that does not reach these figures has those of its words of
    letters alone, if they do: numbers, addresses and the like are of no language, but do not take a text's language away.

    A text that is null or has no letter gets UNKNOWN and 0, as do all if nothing was learned. No other column is looked
    at. The model that is broadcast is bounded by the landmarks.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    added = ["lang_pred", "score", *(["held", "lead"] if proof else [])]
    rest = [c for c in docs.columns if c.lower() not in added]
    inner = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(rest)], col(text_col).cast("string").alias("t"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            shown: list[tuple[float, float]] | None = [] if proof else None
            lang, score = sent.value.predict(b.column("t").to_pylist(), shown, least)
            more = [pa.array([x[i] for x in shown], pa.float64()) for i in (0, 1)] if proof else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more], [*b.schema.names[:-1], *added])

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["lang_pred string"] + [f"{c} double" for c in added[1:]])
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *added)


def low(docs: DataFrame, text_col: str, model: Model, share: float) -> tuple[float, float]:
    """The held and lead, in thousandths rounded down, that all but a share of the texts of docs with a letter reach; counted on every row."""
    rows = predict(docs.select(col(text_col).alias("t")), "t", model, proof=True).where(F.col("lang_pred") != UNKNOWN)
    bins = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("what"), F.floor(F.col(c) * 1000).alias("bin")) for i, c in enumerate(("held", "lead"))])).alias("x"))
    count = np.zeros((2, 1001))
    for r in bins.groupBy("x.what", "x.bin").count().collect():
        count[r["what"], r["bin"]] = r["count"]
    return tuple(float(np.searchsorted(np.cumsum(c), share * c.sum(), "right")) / 1000 if c.any() else 0.0 for c in count)


def held_out(id_col: Column) -> Column:
    """True where CRC-32 of the id as text leaves 2 on division by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), "text", model).select("doc_id", "held_out", "lang_pred", "score")
