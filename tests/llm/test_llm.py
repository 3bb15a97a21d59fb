"""Training-data operators against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from partsloom.llm import common, decontaminate, impact_search, language_id, line_dedup, lm_scoring, mixing, sharding, simhash, substring_dedup, token_store
from partsloom.llm.common import connected_components, with_columns

RNG = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(300)]


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words, n))


def frame(spark, rows, extra="lang string, source string"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    long = prose(30_000)
    a, b = prose(120), prose(80)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, b, None, None), (3, None, "en", "s"), (4, "", "en", "t"), (5, " \t\n", None, "t"), (6, long, "de", "s"), (None, a, "en", None), (7, "Übung macht 日本 " + b, "de", "t"), (8, a + " more", "en", "s"), (9, "\x1c\x85x", "de", None)]
    return frame(spark, rows)


def empty_docs(spark):
    return frame(spark, [])


def rows(df):
    return df.collect()


# 1: sharding


def test_lookup_table_is_fair_and_stable():
    names = [f"n{i}" for i in range(13)]
    table = sharding.lookup_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 12) < 0.15 * 1009
    for bad in ((names, 1008), ([], 7), (["a", "a"], 7), (names, 11)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_turns_by_hand():
    names, m = ["a", "b", "c"], 7
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    prefer = [[(h(f"offset:{n}") + k * (h(f"skip:{n}") % (m - 1) + 1)) % m for k in range(m)] for n in names]
    owner, turn = {}, 0
    while len(owner) < m:
        slot = next(s for s in prefer[turn % 3] if s not in owner)
        owner[slot] = turn % 3
        turn += 1
    assert sharding.lookup_table(names, m) == [owner[s] for s in range(m)]


def test_assign_shards_edges(spark):
    names = ["a", "b", "c"]
    docs = odd_docs(spark).withColumn("Shard", F.lit("old")).withColumn("a.b", F.lit(1))
    out = sharding.assign_shards(docs, ["doc_id"], names, 101)
    got = rows(out)
    assert len(got) == 11 and out.columns[-2:] == ["slot", "shard"] and "a.b" in out.columns and "Shard" not in out.columns
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert rows(sharding.assign_shards(empty_docs(spark), ["doc_id"], names, 101)) == []


def test_write_shards(spark, tmp_path):
    out = sharding.assign_shards(odd_docs(spark), ["doc_id", "source"], ["a", "b"], 11)
    sharding.write_shards(out, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 11


# 2: repeated substrings


def naive_removal(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        yield bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_difference_cover(r):
    v, d = substring_dedup.difference_cover(r)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) == 6 * r + 4


@pytest.mark.parametrize(("batch", "length", "short", "used"), [(300, 40, 28, 64), (10**6, 40, 10, 64), (2000, 100, 28, 64), (900, 100, 28, 5), (10**6, 60, 28, 3)])
def test_removal_matches_brute_force(spark, monkeypatch, batch, length, short, used):
    """With fingerprints of a few bits nearly all suffixes collide; bytes must decide all the same."""
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    shared = [prose(12) for _ in range(4)]
    texts = [" ".join([prose(int(RNG.integers(0, 40))), *RNG.choice(shared, int(RNG.integers(0, 3))), prose(int(RNG.integers(0, 9)))]) for _ in range(40)]
    texts += [texts[0], texts[0], "ab" * 90, "", None, "é" * length, texts[3][: length - 1], texts[3][:length], None]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = sorted(rows(substring_dedup.remove_repeats(docs, length=length, short=short, used=used)), key=lambda r: r["doc_id"])
    data = [(t or "").encode() for t in texts]
    for r, t, (left, spans) in zip(got, data, naive_removal(data, length), strict=True):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(t), len(t) - len(left), spans, left)
        assert r["kept_sha256"] == hashlib.sha256(left).hexdigest()


def test_removal_in_pieces(monkeypatch):
    """A batch's own pieces of positions, fingerprints and suffixes fit together, whatever their sizes."""
    import zstandard

    texts = [prose(60).encode() for _ in range(30)]
    texts += [t[:150] + texts[0][20:200] for t in texts[:9]] + [b"x" * 300, b"", texts[3][5:]]
    sizes, blob = np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.compress(b"".join(texts))
    want = None
    for window, piece, sent in ((1 << 16, 400_000, 20_000), (64, 50, 7)):
        for name, v in (("WINDOW", window), ("PIECE", piece), ("SENT", sent)):
            monkeypatch.setattr(substring_dedup, name, v)
        b = substring_dedup.Batch(sizes, blob, 100, 28)
        b.take(np.zeros(len(b.wholes()[0]), np.uint8))
        at = b.sampled()
        h = np.concatenate(list(b.pieces(at, 28)))
        known = {t[p : p + 28]: x for t, p, x in ((b.raw, int(p), int(x)) for p, x in zip(at, h, strict=True))}
        assert all(known[b.raw[p : p + 28]] == x for p, x in zip(at.tolist(), h.tolist(), strict=True)) and len(set(known.values())) == len(known)
        flags = np.concatenate([substring_dedup.company(*substring_dedup.counted(x))[0] for x in b.pieces(at, 28)])
        some = b.among(at, 28, flags)
        begin = b.starts(some)
        rows = np.concatenate([r[to] for _, r, to, _, _ in b.sent(*b.around(some, begin))])
        now = (h.tolist(), begin.tolist() if piece > 50 else None, rows.tolist() if piece > 50 else None)
        want = want or now
        assert now[0] == want[0]


def test_ties_by_definition():
    """Rows of few letters, so that ranks, sides and reaches tie in many ways."""
    short, reach = 4, 6
    r = np.zeros((300, short + 2 * reach + 4), np.uint8)
    r[:, : short + 2 * reach] = RNG.integers(97, 99, (300, short + 2 * reach))
    n = RNG.integers(0, reach + 1, (300, 2))
    for i in (0, 1):
        r[:, short + i * reach : short + (i + 1) * reach][np.arange(reach) >= n[:, i : i + 1]] = 0
    r[:, -4:] = n.astype(">u2").view(np.uint8).reshape(-1, 4)
    r = np.unique(r, axis=0)
    n = r[:, -4:].copy().view(">u2").astype(int)
    got = substring_dedup.ties(r, short, reach)
    for k in range(reach + 1):
        own = [(bytes(x[:short]), bytes(x[short : short + k]), bytes(x[short + reach : short + 2 * reach - k])) if a >= k and b >= reach - k else None for x, (a, b) in zip(r, n, strict=True)]
        seen = Counter(o for o in own if o)
        assert got[:, k].tolist() == [o is not None and seen[o] > 1 for o in own]


BIG = 2**53


def big_ids(spark):
    """Unlike texts under ids that a double cannot tell apart, beside a null one, in one partition."""
    return frame(spark, [(None, prose(60), "en", "s"), (BIG + 1, prose(70), "en", "s"), (BIG + 3, prose(80), None, "s"), (BIG + 5, prose(90), "en", None)]).coalesce(1)


WANT_IDS = [None, BIG + 1, BIG + 3, BIG + 5]


def test_large_ids_beside_a_null(spark, tmp_path, vocabulary):
    docs = big_ids(spark).cache()
    ids = lambda df: sorted((r["doc_id"] for r in rows(df)), key=lambda x: x or 0)
    assert ids(substring_dedup.remove_repeats(docs)) == WANT_IDS
    assert ids(simhash.near_duplicates(docs)) == WANT_IDS and sorted(r["component_id"] for r in rows(simhash.near_duplicates(docs)) if r["doc_id"]) == WANT_IDS[1:]
    folder = f"file://{tmp_path}/tok"
    assert ids(token_store.read_tokens(token_store.write_tokens(docs, "doc_id", "text", folder, vocabulary), folder)) == WANT_IDS
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    got = rows(decontaminate.contaminated(docs, items))
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=lambda x: x[0] or 0) == [(i, i) for i in WANT_IDS]
    assert ids(lm_scoring.score_texts(docs)) == WANT_IDS


def test_removal_edges(spark):
    got = rows(substring_dedup.remove_repeats(odd_docs(spark)))
    assert len(got) == 11 and [r["n_removed"] for r in got if r["doc_id"] == 1] == [r["n_bytes"] for r in got if r["doc_id"] == 1]
    assert rows(substring_dedup.remove_repeats(empty_docs(spark))) == []


def test_op2_at_its_own_length(spark, tmp_path):
    """Passages of over 50 words that documents share go if they have 400 bytes and stay if not; one that a single document repeats goes; n_bytes is the whole text's in any case."""
    rng = np.random.default_rng(12)  # texts of the other tests stay as they are
    words = lambda n: " ".join(rng.choice(WORDS, n))
    wide, narrow, own = words(110), " ".join(rng.choice([*"abcdefgh"], 60)), words(110)
    texts = [f"{words(30)} {wide} {words(20)}", f"{words(5)} {wide}", f"{words(40)} {narrow} {words(9)}", f"{narrow} é {words(200)}", f"{own} {words(7)} {own}", words(300), "a" * 400, "b" * 401, None]
    frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    out = substring_dedup.op2_substring_dedup(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    data = [(t or "").encode() for t in texts]
    want = [(i, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()) for i, (t, (left, spans)) in enumerate(zip(data, naive_removal(data, 400), strict=True))]
    assert sorted(map(tuple, rows(out))) == want and [i for i, _, n, *_ in want if n] == [0, 1, 4, 7]


# 3: mixing


def test_targets_by_water_filling(spark):
    sizes = {"b": 100, "a": 1000, "c": 5, None: 300, "é": 0}
    got = {r["source"]: r["target"] for r in rows(mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")))}
    order = ["a", "b", "c", "é", None]
    weight = dict(zip(order, [5, 2, 1, 5, 2], strict=True))
    left, want, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


def test_mix_meets_its_targets(spark):
    data = [(i, prose(int(RNG.integers(1, 60))), None, "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    docs = frame(spark, data)
    out = mixing.mix(docs, mixing.word_count(F.col("text")))
    got = out.toPandas()
    assert len(got) == 900 and (got["taken"] == got["copies"] * got["size"]).all() and got["copies"].between(0, 2).all()
    for _, g in got.groupby("source"):
        assert g["source_size"].iloc[0] == g["size"].sum() and abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        rate = g.sort_values("size")["rate"].to_numpy()  # tilted in size: rates are monotone, and so is their logit linear
        assert (np.diff(rate) >= -1e-9).all() or (np.diff(rate) <= 1e-9).all()
        if (rate < 2).all() and g["size"].nunique() > 2:
            x = np.log(rate / (2 - rate))
            s = np.sort(g["size"])
            assert np.allclose(np.diff(x), (x[-1] - x[0]) / (s[-1] - s[0]) * np.diff(s), atol=1e-6)
    again = mixing.mix(docs.repartition(7), mixing.word_count(F.col("text"))).toPandas()
    assert dict(zip(got["doc_id"], got["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))


def test_rates_against_bisection(spark):
    """Each source's rates are the tilted ones whose multiplier bisection finds, and the mix of least divergence."""
    data = [(i, prose(int(RNG.integers(1, 80))), None, f"s{i % 4}") for i in range(400)]
    got = mixing.mix(frame(spark, data), mixing.word_count(F.col("text"))).toPandas()
    prior = math.log(0.75 / 0.25)
    for _, g in got.groupby("source"):
        size, target = g["size"].to_numpy(float), g["target"].iloc[0]
        if target >= 2 * size.sum() * (1 - 1e-12):
            assert (g["rate"] == 2).all()
            continue
        rate = lambda x, size=size: 2 / (1 + np.exp(-np.clip(prior + x * size, -700, 700)))
        low, high = -10.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (rate(mid) * size).sum() < target else (low, mid)
        assert np.allclose(g["rate"], rate(low), rtol=1e-4)


def test_mix_edges(spark):
    docs = odd_docs(spark).withColumn("rate", F.lit("old"))
    got = rows(mixing.mix(docs, mixing.word_count(F.col("text"))))
    assert len(got) == 11 and all(r["taken"] <= 2 * r["size"] for r in got) and sum(r["size"] == 0 for r in got) == 3
    assert rows(mixing.mix(empty_docs(spark), mixing.word_count(F.col("text")))) == []


def test_mix_with_columns_of_all_its_own_names(spark):
    docs = frame(spark, [(i, prose(1 + i % 9), None, f"s{i % 3}") for i in range(60)])
    names = ["base", "quota", "s2", "z2", "s3", "z3", "p3", "part", "n", "n_cell", "extra", "seen", "sum", "lam", "low", "near", "size", "copies", "level", "w", "source_size", "Target"]
    wide = docs
    for c in names:
        wide = wide.withColumn(c, F.lit("x"))
    got = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(wide, mixing.word_count(F.col("text"))))}
    assert len(got) == 60 and sum(got.values()) == sum(r["taken"] for r in rows(mixing.mix(docs, mixing.word_count(F.col("text")))))


def test_a_third_of_all_rows_equal_is_dealt_out(spark, monkeypatch):
    """No part, and so no window, holds all of them; each source still comes near its target."""
    docs = spark.createDataFrame([(1, "a b c", None, "s")] * 3000 + [(i, prose(1 + i % 7), None, f"s{i % 3}") for i in range(6000)], "doc_id long, text string, lang string, source string").repartition(6)
    seen = []
    keep = mixing.kept
    monkeypatch.setattr(mixing, "kept", lambda df, what: (lambda x: (seen.append(x), x)[1] if what == "mix-cells" else x)(keep(df, what)))
    got = mixing.mix(docs, mixing.word_count(F.col("text"))).toPandas()
    assert len(got) == 9000 and seen[0].where("source = 's'").agg(F.max("n")).first()[0] < 30
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()


# 4: near-duplicates


def naive_fingerprint(text, k=4):
    w = (text or "").encode().translate(simhash.LOWER).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_match_brute_force(spark):
    base = [prose(int(RNG.integers(0, 400))) for _ in range(30)]
    texts = base + [t.replace(" w1", " W1").replace("w22", "zz") for t in base] + base[:9] + [None, "", "one", "One  two\tthree"]
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows(simhash.near_duplicates(frame(spark, [(i + 5, t, None, None) for i, t in enumerate(texts)])))}
    fps = [naive_fingerprint(t) for t in texts]
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            label[i] = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4)
    assert got == {i + 5: (f, label[i] + 5) for i, f in enumerate(fps)}


@pytest.mark.parametrize("n", [1, 2, 3, 40, 400])
def test_links_within_keep_every_connection(n):
    f = np.unique(RNG.integers(0, 1 << 9, n, dtype=np.uint64) * np.uint64(RNG.integers(1, 1 << 50)))
    find = {int(x): {int(x)} for x in f}
    for a, b in simhash.links_within(f, 4):
        assert (a ^ b).bit_count() <= 4
        both = find[a] | find[b]
        find |= dict.fromkeys(both, both)
    for a in f:
        for b in f[np.bitwise_count(f ^ a) <= 4]:
            assert int(b) in find[int(a)]


@pytest.mark.parametrize("edges_a_task", [1, 40, 10_000])
def test_components_of_many_edges(spark, monkeypatch, edges_a_task):
    """A dense group, small ones, a path and repeated edges, contracted in one task or in many."""
    monkeypatch.setattr(common, "EDGES", edges_a_task)
    dense = [(int(a) - 20, int(b) - 20) for a, b in RNG.integers(0, 40, (300, 2))]
    edges = dense + dense[:50] + [(100 + i, 101 + i) for i in range(0, 30, 3)] + [(200 + (7 * i) % 31, 200 + (7 * i + 7) % 31) for i in range(30)] + [(5000, 5000)]
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = rows(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)))
    assert len(got) == len(least)
    assert dict(map(tuple, got)) == least


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, rows(connected_components(spark.createDataFrame(edges, "a long, b long")))))
    assert got == {i: 0 for i in range(61)} | {100: 90, 90: 90, 95: 90}


def test_near_duplicate_edges(spark):
    got = rows(simhash.near_duplicates(odd_docs(spark)))
    assert len(got) == 11 and {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, None)} == {1}
    assert rows(simhash.near_duplicates(empty_docs(spark))) == []


# 5: top-k search


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "ROWS", 100)
    monkeypatch.setattr(impact_search, "QUERIES", 7)
    v = RNG.integers(-90, 90, (700, 12))
    v[5:20] = v[5]
    v[300:320] *= 10
    data = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(impact_search.top_k(data, data.where("id % 50 = 0")))}
    for q in range(0, 700):
        if q * 3 % 50 == 0:
            s = v @ v[q]
            best = sorted((-int(x), i * 3) for i, x in enumerate(s) if i != q)[:5]
            assert [got[q * 3, k + 1] for k in range(5)] == [(i, -x) for x, i in best]


def test_top_k_edges(spark):
    raw = spark.createDataFrame([(0, [1.0, float("nan")]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, []), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [-0.001, 1.0]), (100, [1.0])], "vec_id long, embedding array<float>")
    e = raw.select(F.col("vec_id").alias("id"), impact_search.quantised(F.col("embedding")).alias("v"))
    got = sorted(map(tuple, rows(impact_search.top_k(e, e.where("id % 50 = 0")))))
    vec = {50: [128, -64], 5: [-1, 256], 3: [], 100: [256]}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = [(q, n + 1, i, s) for q in (50, 100) for n, (s, i) in enumerate(sorted(((dot(vec[q], vec[i]), i) for i in [50, 50, 5, 3, 100] if i != q), key=lambda x: (-x[0], x[1])))]
    assert got == sorted(want)
    assert rows(impact_search.top_k(e.limit(0), e.limit(0))) == [] and rows(impact_search.top_k(e.limit(0), e)) == []


def test_equal_vectors_are_dealt_out(spark, monkeypatch):
    """A third of all rows equal: no block holds more than a little over its share, and results are those of brute force."""
    monkeypatch.setattr(impact_search, "ROWS", 100)
    monkeypatch.setattr(impact_search, "MOST_ROWS", 100)
    data = [(7, [3, 1, 2])] * 1000 + [(i, [int(x) for x in RNG.integers(-9, 9, 3)]) for i in range(100, 2100)]
    made, keep = [], impact_search.kept
    monkeypatch.setattr(impact_search, "kept", lambda df, what: (lambda x: (made.append(x), x)[1] if what == "search-blocks" else x)(keep(df, what)))
    df = spark.createDataFrame(data, "id long, v array<long>").repartition(5)
    got = sorted(map(tuple, impact_search.top_k(df, df.where("id = 7 or id = 100"), 3).collect()))
    sizes = [len(r["ids"]) // 8 for r in made[0].collect()]
    assert sum(sizes) == 3000 and max(sizes) < 160
    for q in (7, 100):
        v = next(x for i, x in data if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in data if i != q))[:3]
        assert [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)] == [x for x in got if x[0] == q]


def test_top_k_of_large_components(spark):
    """Beyond what doubles hold scores are still exact; beyond longs there is an error and no wrong number."""
    big = 2**31 - 1
    v = [[big - i, big - 3 * i] for i in range(8)]
    e = spark.createDataFrame([(50 * i, [float(x) for x in y]) for i, y in enumerate(v)], "id long, v array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in rows(impact_search.top_k(e, e.where("id = 100"), 3))}
    assert got == {(100, 50 * i): v[2][0] * v[i][0] + v[2][1] * v[i][1] for i in (0, 1, 3)}
    with pytest.raises(ValueError):
        impact_search.top_k(e.withColumn("v", F.transform("v", lambda x: x * 1e300)), e)
    huge = spark.createDataFrame([(1, [1e300, -1.5, 0.3])], "id long, x array<double>").select(impact_search.quantised(F.col("x")).alias("v")).first()["v"]
    assert huge == [256e300, -384.0, 76.0]


# 6: token files


def test_elias_fano_selects():
    for n, u in ((0, 1), (1, 0), (5, 3), (1000, 10), (1000, 10**9), (300, 10**11), (257, 0), (513, 600)):
        v = np.sort(RNG.integers(0, u + 1, n))
        b = token_store.EliasFano.encode(v).tobytes()
        f, took = token_store.EliasFano.frombytes(b + b"rest")
        assert took == len(b) and (f.select(0, n) == v).all() and all(f[i] == v[i] for i in range(0, n, 17))
        assert (f.select(n // 3, n // 2) == v[n // 3 : n // 2]).all()
    v = np.arange(0, 10**6, 10)
    assert 8 * len(token_store.EliasFano.encode(v).tobytes()) < len(v) * (2 + math.log2(10) + 1)


@pytest.fixture(scope="session")
def vocabulary():
    p = pytest.importorskip("public_tokenizers")
    return p.path("word_bpe_49k.json")


def odd_texts():
    """Texts at the edges of what the tokenizers treat apart, and random ones of such pieces."""
    out = ["Hello  it's a <|endoftext|>x ÉÀ é ́x ΣΑΣ\x1c\x1d1234 don't !!!? 日本", "", "a​b ÎĲ \x85 ß İ K z", "'s 's'll\t' s", " \n ", "<|ENDOFTEXT|> A<|endoftext|>b <| Ab", "it'S I'LL 'Tis A'b'c 12ab34!!x", prose(50), "\x00a\x01 b\x7f", "e\u0301 E\u0301A \u0301", "word\u00a0word\u2028x"]
    pieces = ["a", "B", "'", "'s", "'LL", " ", "\t", "12", "<|", "|>", "endoftext", "<|endoftext|>", "é", "\u0301", "Σ", ".", ",", "!?", "-", "日", "\x1c", "\u00a0", "Word", "the"]
    return out + ["".join(RNG.choice(pieces, int(RNG.integers(1, 40)))) for _ in range(400)]


def test_words_encode_as_whole_texts(vocabulary):
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole, by_word = Tokenizer.from_file(vocabulary), token_store.Encoder(vocabulary)
    assert by_word.by_words
    texts = odd_texts()
    for part in (texts, texts[::-1], texts[5:9], texts[:0]):
        ids, ends = by_word.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(part)] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in part]


def test_other_tokenizers_get_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    whole, enc = Tokenizer.from_file(path), token_store.Encoder(path)
    assert not enc.by_words
    texts = odd_texts()[:40]
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_token_files_round_trip(spark, tmp_path, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "FILE_IDS", 500)
    docs, folder = odd_docs(spark), f"file://{tmp_path}/tok"
    files = token_store.write_tokens(docs, "doc_id", "text", folder, vocabulary).cache()
    got = rows(token_store.read_tokens(files, folder))
    whole = Tokenizer.from_file(vocabulary)
    ids = {r["doc_id"]: whole.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows(docs)}
    for r in got:
        x = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[:-1].tolist()
    assert rows(token_store.read_tokens(token_store.write_tokens(empty_docs(spark), "doc_id", "text", folder, vocabulary), folder)) == []


# 7: language identification


def test_kernel_by_definition():
    x, y = "Abcab", "bcd"
    grams = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    m = language_id.fit([("a", np.unique(np.concatenate(language_id.codes(x))).tobytes()), ("b", np.unique(np.concatenate(language_id.codes("zzz"))).tobytes())])
    inside = grams(y) & (grams(x) | grams("zzz"))
    k = m.kernels([language_id.codes(y)])[0]
    assert k[0] == pytest.approx(len(inside & grams(x)) / math.sqrt(len(grams(y)) * len(grams(x)))) and k[1] == 0


def test_weights_against_a_solver_of_its_own(monkeypatch):
    """Margins are those of least squares with a penalty, solved over whitened kernels with landmarks as the definition has them."""
    monkeypatch.setattr(language_id, "LANDMARKS_PER_LANG", 4)
    tongues = {"aa": ["nashi", "kuro", "tamo"], "bb": ["strand", "brugt", "mork"], "cc": ["élu", "çava", "où"]}
    texts = [(t, prose(int(RNG.integers(3, 12)), tongues[t])) for _ in range(9) for t in tongues]
    pack = lambda t: np.unique(np.concatenate(language_id.codes(t))).astype("<i4").tobytes()
    model = language_id.fit([(t, pack(x)) for t, x in texts])
    grams = lambda t: {t.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    seen, marks = Counter(), []
    for t, x in texts:
        seen[t] += 1
        if seen[t] <= 4:
            marks.append(x)
    new = [prose(6, tongues[t]) for t in tongues] + ["tamo strand où"]
    k = lambda xs: np.array([[kernel(x, m) for m in marks] for x in xs])
    value, vector = np.linalg.eigh(k(marks))
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    x = np.c_[k([x for _, x in texts]) @ white, np.ones(len(texts))]
    y = np.array([[1.0 if t == lang else -1.0 for lang in sorted(tongues)] for t, _ in texts])
    penalty = math.sqrt(language_id.RIDGE * len(texts)) * np.eye(x.shape[1])
    w = np.linalg.lstsq(np.r_[x, penalty], np.r_[y, np.zeros((x.shape[1], 3))], rcond=None)[0]
    margins = np.c_[k(new) @ white, np.ones(len(new))] @ w
    lang, score = model.predict(new)
    assert lang == [sorted(tongues)[i] for i in margins.argmax(axis=1)]
    assert score == pytest.approx(np.clip((margins.max(axis=1) + 1) / 2, 0, 1).tolist(), abs=1e-4)


def test_training_rows_are_those_of_least_hash(spark, monkeypatch):
    """However many rows a language has and however few bins, the rows are the least by hash."""
    monkeypatch.setattr(language_id, "TRAIN_PER_LANG", 5)
    data = [(i, prose(4) + f" {i}", "aa" if i % 4 else f"b{i % 3}", None) for i in range(200)]
    docs = frame(spark, data)
    taken = []
    monkeypatch.setattr(language_id, "fit", lambda rows: taken.append(rows))
    h = sorted((r["lang"], r["h"] & (1 << 64) - 1, r["text"]) for r in rows(docs.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")))
    want = [(lang, t) for lang in ("aa", "b0", "b1", "b2") for _, _, t in [x for x in h if x[0] == lang][:5]]
    for bins in (4096, 2):
        monkeypatch.setattr(language_id, "BINS", bins)
        language_id.train(docs, "doc_id", "text", "lang")
    pack = lambda t: np.unique(np.concatenate(language_id.codes(t))).astype("<i4").tobytes()
    for got in taken:
        assert sorted((lang, c) for lang, c in got) == sorted((lang, pack(t)) for lang, t in want)


def test_languages_are_told_apart(spark):
    tongues = {"aa": ["nashi", "kuro", "tamo", "riku"], "bb": ["strand", "brugt", "mork", "glans"], "cc": ["élu", "çava", "où", "être"]}
    data = [(i, prose(int(RNG.integers(3, 60)), tongues[t]), t, None) for i, t in enumerate(list(tongues) * 60)]
    docs = frame(spark, data)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    got = rows(language_id.predict(docs.withColumn("score", F.lit("old")), "text", model))
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = rows(language_id.predict(frame(spark, [(1, None, None, None), (2, "12 ½ _ !", None, None), (3, "", None, None), (None, "strand " * 40_000, None, None)]), "text", model))
    assert [(r["lang_pred"], r["score"]) for r in odd[:3]] == [("und", 0.0)] * 3 and odd[3]["lang_pred"] == "bb"


def test_nothing_learned(spark):
    model = language_id.train(empty_docs(spark), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in rows(language_id.predict(odd_docs(spark), "text", model))} == {"und"}
    assert rows(language_id.predict(empty_docs(spark), "text", model)) == []


def test_held_out_fold(spark):
    got = rows(spark.range(50).select("id", language_id.held_out(F.col("id")).alias("h")))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


# 8: decontamination


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_wand_finds_all_above_the_threshold():
    items = [(i, prose(int(RNG.integers(5, 40)))) for i in range(120)]
    index = decontaminate.Index(items)
    for _ in range(150):
        base = items[int(RNG.integers(120))][1].split()
        words = [w.encode() for w in base[: int(RNG.integers(1, len(base) + 1))]] + [w.encode() for w in RNG.choice(WORDS, int(RNG.integers(0, 60)))]
        terms = sorted({index.term[w] for w in words if w in index.term})
        score = Counter()
        for t in terms:
            for k, g in zip(index.docs[t], index.impact[t], strict=True):
                score[k] += g
        assert sorted(k for k, _ in index.search(terms)) == sorted(k for k, s in score.items() if s >= 1)


def naive_leaks(docs, items):
    """By definition, with nothing of the index: passages of two steps at every step; shares of distinct runs of five words, or of two in items under 29 words; half of the words of question and answer."""
    split = lambda t: (t or "").encode().translate(simhash.LOWER).split()

    def parts(t):
        t = (t or "").strip()
        cut = t.rfind("\n")
        q, a = (t[:cut], t[cut + 1 :]) if cut >= 0 else ("", "")
        return (q, a, split(q + " " + a)) if q.strip() and a.strip() else (t, t, split(t))

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    def holds(passage, run):
        return any(tuple(passage[i : i + len(run)]) == run for i in range(len(passage) - len(run) + 1))

    every = [(k, *parts(t)) for k, t in enumerate(items)]
    every = [x for x in every if x[3]]
    step = max(64, math.ceil(1.25 * max(len(x[3]) for x in every)))
    out = set()
    for d, t in enumerate(docs):
        w = split(t)
        for begin in range(0, max(1, len(w)), step):
            passage = w[begin : begin + 2 * step]
            own = {n: runs(passage, n) if len(passage) >= n else set() for n in (2, 5)}
            for k, q, a, both in every:
                if any(len(set(split(x)) & set(passage)) < 0.5 * len(set(split(x))) for x in (q, a)):
                    continue
                for n in (5, 2) if len(both) < 29 else (5,):
                    s = runs(split(q), n) | runs(split(a), n)
                    if sum(x in own[n] or (len(x) < n and holds(passage, x)) for x in s) >= 0.8 * len(s):
                        out.add((d, k))
    return out


def test_a_short_item_with_a_word_changed(spark):
    """Of 11 to 16 words, any one changed; clean texts stay clean."""
    items = [prose(n) for n in range(11, 17)]
    docs = []
    for t in items:
        for at in range(len(t.split())):
            w = t.split()
            w[at] = "other"
            docs.append(prose(60) + " " + " ".join(w) + " " + prose(60))
    clean = [prose(300) for _ in range(50)]
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(frame(spark, [(i, t, None, None) for i, t in enumerate(docs + clean)]), benchmark(spark, items)))}
    assert got == naive_leaks(docs + clean, items)
    owner = [k for k, t in enumerate(items) for _ in t.split()]
    assert {(d, k) for d, k in enumerate(owner)} == got


def test_leaks_match_brute_force(spark):
    items = [prose(int(RNG.integers(8, 50))) for _ in range(30)] + ["Question " + prose(20) + "\nanswer " + prose(6), "", None, prose(3), "  \n "]
    docs = [prose(200) for _ in range(30)]
    for i in range(0, 30, 2):  # whole items, some with a word changed, at any place
        w = items[i].split()
        if i % 4:
            w[len(w) // 2] = "other"
        cut = docs[i].split()
        at = int(RNG.integers(0, len(cut)))
        docs[i] = " ".join(cut[:at] + w + cut[at:])
    docs += [items[30].upper(), items[33], "x " + items[33] + " y", None, "", " ".join(items[5].split()[:4])]
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(frame(spark, [(i, t, None, None) for i, t in enumerate(docs)]), benchmark(spark, items)))}
    want = naive_leaks(docs, items)
    assert got == want and {(0, 0), (4, 4), (30, 30), (31, 33), (32, 33)} <= got


def test_decontamination_edges(spark):
    got = rows(decontaminate.contaminated(odd_docs(spark), benchmark(spark, [prose(20)])))
    assert got == []
    a = [r["text"] for r in rows(odd_docs(spark).where("doc_id = 2"))][0]
    docs = frame(spark, [(1, a, None, None), (1, a, None, None), (None, a, None, None), (3, None, None, None)])
    assert len(rows(decontaminate.contaminated(docs, benchmark(spark, [a, a])))) == 6
    assert rows(decontaminate.contaminated(empty_docs(spark), benchmark(spark, [a]))) == []
    assert rows(decontaminate.contaminated(docs, benchmark(spark, []))) == []


def test_several_indexes(spark, monkeypatch):
    """The same rows, scores and all, as from one index; a quarter of each passage lacks a word of its item."""
    items = [prose(25) for _ in range(20)]
    texts = [" ".join(w for k, w in enumerate(t.split()) if i % 4 or k) for i, t in enumerate(items)]
    docs = frame(spark, [(i, prose(50) + " " + t, None, None) for i, t in enumerate(texts)])
    table = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in rows(decontaminate.contaminated(docs, benchmark(spark, items))))
    whole = table()
    assert len({x[2] for x in whole}) > 1
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 800)
    assert table() == whole
    assert len(list(decontaminate.indexes(benchmark(spark, items), "item_id", "text"))) > 1
    assert sorted((r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(docs, benchmark(spark, items)))) == [(i, i) for i in range(20)]


# 9: line dedup


def test_boilerplate_by_brute_force(spark):
    data = []
    for i in range(60):
        host = "hot" if i % 3 else f"h{i % 4}"
        lines = [f"own {i}", *[f"shared {host} {k}" for k in range(6) if RNG.random() < (k + 1) / 8], "", "  "]
        data.append((i, f"http://u@{host}:80/x?{i}", "\n".join(lines * (1 + i % 2))))
    pages = spark.createDataFrame([*data, (None, None, "a\na"), (61, "no host", "b"), (62, "http://hot/", None), (63, "http://hot/", "")], "page_id long, url string, text string")
    got = rows(line_dedup.drop_boilerplate(pages, line_dedup.host_of(F.col("url")), F.col("text"), 0.4, 3))
    hosts, count = Counter(), Counter()
    split = lambda t: [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]
    of = lambda u: u.split("/")[2].split("@")[-1].split(":")[0] if u and "//" in u else None
    for r in rows(pages):
        hosts[of(r["url"])] += 1
        count.update((of(r["url"]), x) for x in set(split(r["text"])))
    for r in got:
        h = of(r["url"])
        keep = [x for x in split(dict((p["page_id"], p["text"]) for p in rows(pages))[r["page_id"]]) if h is None or count[h, x] < 3 or count[h, x] <= 0.4 * hosts[h]]
        assert (r["host"], r["text"]) == (h, None if r["page_id"] == 62 else "\n".join(keep))
    assert sum(r["n_dropped"] for r in got) > 20 and len(got) == 64
    assert rows(line_dedup.drop_boilerplate(pages.limit(0), F.col("url"), F.col("text"))) == []


def test_boilerplate_of_odd_pages(spark):
    """Clashing columns make room, a very long page is one page, and a line on one page alone stays even if its host has no other."""
    long = "\n".join(f"line {i}" for i in range(60_000))
    pages = spark.createDataFrame([(1, "old", 7, "http://a/", long), (2, "old", 7, "http://a/", "line 1\nline 2\nown"), (3, "old", 7, "http://b/", "alone\nalone")], "page_id long, host string, N_Lines int, url string, html string").withColumn("text", F.lit("old"))
    out = line_dedup.drop_boilerplate(pages, line_dedup.host_of(F.col("url")), F.col("html"))
    got = {r["page_id"]: r for r in rows(out)}
    assert out.columns == ["page_id", "url", "html", "host", "n_lines", "n_dropped", "text"]
    assert (got[1]["host"], got[1]["n_lines"], got[1]["n_dropped"]) == ("a", 60_000, 2) and got[2]["text"] == "own" and got[3]["text"] == "alone\nalone"


def test_lines_of_html(spark):
    html = '<p>One <b>bold</b> <a href="x>y">link</a> &amp;lt; &lt;b&gt;<br>two<br/>three <I class="c">it</I><Section>four</Section><script>var x = "<p>";</script><!-- <p>no --><style>p{}</style>five&nbsp;six'
    got = spark.createDataFrame([(html,), (None,)], "h string").select(line_dedup.visible_lines(F.col("h")).alias("t")).collect()
    lines = [x.strip() for x in got[0]["t"].split("\n") if x.strip()]
    assert lines == ['One bold y">link &lt; <b>', "two", "three it", "four", "five six"] and got[1]["t"] is None


def test_clashing_columns(spark, tmp_path, vocabulary):
    """Columns of the names that operators use inside or give back are not looked at."""
    docs = odd_docs(spark)
    for n in ("id", "t", "i", "none", "h", "key", "fp", "batch", "ids", "sizes", "blob", "range", "piece", "item_id", "score", "component_id", "n_bytes", "held_out", "start"):
        docs = docs.withColumn(n, F.lit("x"))
    folder = f"file://{tmp_path}/tok"
    items = docs.where("doc_id = 2").select("text", "score", F.col("doc_id").alias("item_id"))
    assert len(rows(substring_dedup.remove_repeats(docs))) == len(rows(simhash.near_duplicates(docs))) == len(rows(lm_scoring.score_texts(docs))) == 11
    assert len(rows(token_store.read_tokens(token_store.write_tokens(docs, "doc_id", "text", folder, vocabulary), folder))) == 11
    assert [(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(docs, items))] == [(2, 2), (7, 2)]
    assert len(rows(language_id.predict(docs, "text", language_id.train(docs, "doc_id", "text", "lang")))) == 11


# 10: language-model scores


def exact_scores(texts):
    """For each text: tokens, whether it was learned from, known tokens, learned tokens, base score, and the score that exact counts, quantised, give."""
    quant = lambda x: 1.25 ** int(math.log(x) / math.log(1.25) + 1e-9) if x else 0
    low = lambda t: (t or "").encode().translate(simhash.LOWER).split()
    tokens = [[*low(t), "end"] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c, pairs, threes = Counter(), Counter(), Counter()
    for i in train:
        full = ["begin", *tokens[i]]
        c.update(tokens[i])
        pairs.update(zip(full, full[1:], strict=False))
        threes.update(zip(full, full[1:], full[2:], strict=False))
    n, v = sum(c.values()), len(c)
    context = c | {"begin": len(train)}
    for i, t in enumerate(tokens):
        full, base, score = ["begin", *t], 0.0, 0.0
        for k, w in enumerate(t):
            b = p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            if context.get(full[k], 0):
                p = lm_scoring.WEIGHT * min(1, quant(pairs[full[k], w]) / context[full[k]]) + (1 - lm_scoring.WEIGHT) * p
            if k and (before := quant(pairs[full[k - 1], full[k]])):
                p = lm_scoring.WEIGHT_3 * min(1, quant(threes[full[k - 1], full[k], w]) / before) + (1 - lm_scoring.WEIGHT_3) * p
            base, score = base + math.log10(b), score + math.log10(p)
        yield t, i in train, sum(c[w] > 0 for w in t), n, base, score


def test_scores_by_hand(spark):
    texts = [prose(int(RNG.integers(0, 60)), WORDS[:40]) for _ in range(60)] + [None, "", " \t ", " New words\nONLY ", "w1 W2", "w1\u00a0w2 w1\x1cw2"]
    got = {r["doc_id"]: r for r in rows(lm_scoring.score_texts(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])))}
    close = 0
    for i, (t, learned, known, n, base, score) in enumerate(exact_scores(texts)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learned, len(t), known, n)
        assert r["base_score"] == pytest.approx(base)
        close += r["score"] == pytest.approx(score, rel=0.01)
    assert close >= 0.9 * len(texts)


def test_filter_follows_the_input(spark, monkeypatch):
    """However many runs there are, each is found: no bound on the filter takes any out."""
    monkeypatch.setattr(lm_scoring, "LEAST_BITS", 1 << 10)
    texts = [prose(60) for _ in range(150)] * 2
    got = {r["doc_id"]: r["score"] for r in rows(lm_scoring.score_texts(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])))}
    assert all(got[i] == pytest.approx(x[-1], rel=0.01) for i, x in enumerate(exact_scores(texts)))


def test_scores_on_both_sides(spark, monkeypatch):
    """In a filter of so many bits that no stray run passes, every score is what exact counts, quantised, give: neither more nor less."""
    monkeypatch.setattr(lm_scoring, "ENTRY_BITS", 2000)
    texts = [prose(int(RNG.integers(0, 50)), WORDS[:60]) for _ in range(80)] + [None, "", "x y x y x", "x y x y x"]
    got = {r["doc_id"]: r["score"] for r in rows(lm_scoring.score_texts(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])))}
    assert [got[i] for i in range(len(texts))] == [pytest.approx(x[-1], rel=1e-9) for x in exact_scores(texts)]


def test_query_knows_pairs_seen_once(spark, tmp_path):
    """Of two held-out texts of the same words, the one whose pairs were learned once scores higher."""
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    out = [i for i in range(400) if i not in learned and zlib.crc32(str(i).encode()) % 5 == 1][:2]
    once = " ".join(WORDS)
    frame(spark, [(learned[0], once, None, None), (out[0], once, None, None), (out[1], " ".join(reversed(WORDS)), None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(lm_scoring.op10_lm_scoring(spark, str(tmp_path)))}
    seen, other = got[out[0]], got[out[1]]
    assert seen["held_out"] and seen["base_score"] == pytest.approx(other["base_score"])
    one, base = lm_scoring.WEIGHT, 1.5 / (301 + 0.5 * 302)
    pair = one + (1 - one) * base
    want = math.log10(pair) + 300 * math.log10(lm_scoring.WEIGHT_3 + (1 - lm_scoring.WEIGHT_3) * pair)
    assert seen["score"] == pytest.approx(want) and other["score"] < seen["score"] - 100


def test_filter_counts():
    keys = np.unique(RNG.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    n = RNG.integers(1, 3000, len(keys))
    f = lm_scoring.Filter(1 << 20, 3, 2)
    q = lm_scoring.level(n)
    part = keys >> np.uint64(61)
    f.data = np.concatenate([np.frombuffer(f.part(keys[part == k], q[part == k]), np.uint8) for k in range(8)])
    got = f.counts(keys)
    true = np.where(n >= 2, 1.25 ** (q - 1.0), 0)
    assert (got >= true - 1e-9).all() and (true <= n).all() and np.mean(np.isclose(got, true)) > 0.8
    assert np.mean(f.counts(RNG.integers(0, 1 << 63, 2000, dtype=np.uint64)) > 0) < 0.02


def test_score_edges(spark):
    got = rows(lm_scoring.score_texts(odd_docs(spark)))
    assert len(got) == 11 and all(r["base_score"] <= 0 and r["score"] <= 0 for r in got)
    assert rows(lm_scoring.score_texts(empty_docs(spark))) == []


def test_with_columns_replaces_in_any_case(spark):
    assert with_columns(spark.range(1).withColumn("A", F.lit(1)), {"a": F.lit(2)}).columns == ["id", "a"]


@pytest.mark.parametrize(("distance", "blocks"), [(4, 7), (7, 10), (2, 3)])
def test_links_connect_like_all_pairs(spark, distance, blocks):
    f = RNG.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in RNG.choice(64, 5, replace=False)) for _ in range(400)], np.uint64)
    f = np.unique(np.concatenate([f, RNG.choice(f[:20], 400) ^ flips, f[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    got = rows(simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), distance, blocks))

    def components(pairs):
        at = {int(x): int(x) for x in f}
        find = lambda x: x if at[x] == x else find(at[x])
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            at[b] = a
        return {x: find(x) for x in at}

    near = [(int(a), int(b)) for a in f for b in f[(np.bitwise_count(f ^ a) <= distance) & (f > a)]]
    mask = (1 << 64) - 1
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= distance for r in got)
    assert components([(r["a"] & mask, r["b"] & mask) for r in got]) == components(near)
