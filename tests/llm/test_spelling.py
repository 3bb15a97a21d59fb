"""Neighbourhoods, forms and roots against brute force that compares words position by position."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from partsloom.llm import spelling

LOWER = {k: k + 32 for k in range(65, 91)}


def one_edit(a, b):
    """By definition: exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words(rows):
    c = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def expected(v):
    out, form, near = [], {}, {w: [x for x in v if one_edit(w, x)] for w in v}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        if best and v[best] >= 10 * n:
            form[w] = best
    for w, n in v.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), v[form[w]] if w in form else None))
    return sorted(out)


def frame(spark, v):
    return spark.createDataFrame(list(v.items()), "word string, n long")


def collected(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def some_words(n, seed=3):
    """Many near each other: few letters, repeated ones, accents, one outside the BMP, lengths from 1 on."""
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice("aabéz𝒳") for _ in range(rng.randint(1, 6)))
        out[w] = rng.choice([1, 2, 3, 20, 25, 300, 4000])
    return out


def test_edits_are_the_whole_neighbourhood_once():
    """Without a filter: every deletion, replacement and insertion over the alphabet, none twice, whatever the chunks."""
    alphabet = np.array(sorted(map(ord, "abé")), "<u4")
    for chunk in (1, 10, 10**6):
        spelling.CHUNK, old = chunk, spelling.CHUNK
        try:
            for w in ("aab", "abba", "ééé", "b"):
                got = [c for _, cs in spelling.edits([w], len(w), alphabet, lambda x: np.arange(len(x))) for c in cs]
                letters = "abé"
                want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
                assert len(got) == len(set(got)) and set(got) == want - {w, ""}
        finally:
            spelling.CHUNK = old


def test_numbers_of_edits_are_numbers_of_their_strings():
    """What the filter is asked for is what it was built from."""
    import pandas as pd

    asked = []
    alphabet = np.array(sorted(map(ord, "abz")), "<u4")
    got = [c for _, cs in spelling.edits(["abaz", "zzab"], 4, alphabet, lambda x: asked.append(x) or np.arange(len(x))) for c in cs]
    assert set(spelling.numbers(pd.Series(got)).tolist()) <= set(np.concatenate(asked).tolist())


def test_against_brute_force(spark):
    v = some_words(400)
    assert collected(spelling.variants(frame(spark, v))) == expected(v)


def test_filter_in_parts_and_rounds(spark, monkeypatch):
    """A vocabulary larger than what is sent at a time: the same rows."""
    v = some_words(500, seed=8)
    monkeypatch.setattr(spelling, "PART_BYTES", 200)
    monkeypatch.setattr(spelling, "SENT_BYTES", 500)
    monkeypatch.setattr(spelling, "TASK_WORDS", 100)
    assert collected(spelling.variants(frame(spark, v))) == expected(v)


def test_roots_follow_forms(spark):
    v = {"abcdefg": 3, "abcdefgh": 40, "abcdefghi": 500, "abcdefghij": 6000, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzyy": 20}
    got = {r[0]: r[1:3] for r in collected(spelling.variants(frame(spark, v)))}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij") and got["zzzzzzz"] == ("zzzzzzy", "zzzzzzy")


def test_ties_go_to_the_smallest(spark):
    v = {"bbbbbbb": 2, "bbbbbbc": 20, "bbbbbba": 20, "bbbbbbé": 20}
    got = {r[0]: r for r in collected(spelling.variants(frame(spark, v)))}
    assert got["bbbbbbb"] == ("bbbbbbb", "bbbbbba", "bbbbbba", 2, 3, 20) and got["bbbbbba"][4] == 3


def test_words_of_whole_texts(spark, tmp_path):
    """Nulls, cases, accents, a run of 5,000 letters, a long text, repeated rows, clashing columns; the whole query too."""
    rng = random.Random(1)
    base = ["Spelling", "spelling", "SPELLING", "spélling", "spellings", "Variants", "variant", "ÀÉîõü×÷ÿ", "short", "q" * 5000, "q" * 4999 + "r"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(base) for _ in range(60)) + ", spelling-variants'variants_") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "spelling " * 30_000)] + [(53, "repeated repeated row")] * 3
    v = words(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("run", F.lit("y")).withColumn("h", F.lit(1)).withColumn("Word", F.lit("z")).withColumn("a.b", F.lit(0))
    assert {r["word"]: r["n"] for r in spelling.words_of(docs, "doc_id", "text").collect()} == v
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert collected(spelling.op13_spelling(spark, str(tmp_path))) == expected(v)


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert spelling.op13_spelling(spark, str(tmp_path)).collect() == []
