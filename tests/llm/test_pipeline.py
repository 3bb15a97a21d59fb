"""The pipeline's stages on planted documents, and the registry."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from partsloom.llm import language_id, registry, sharding, similar
from partsloom.llm.common import table

RNG = np.random.default_rng(2)
TONGUES = {"aa": [f"na{x}shi{y}" for x in "bcdfg" for y in "klmnp"], "bb": [f"str{x}dø{y}" for x in "bcdfg" for y in "klmnp"]}


def prose(lang, n):
    return " ".join(RNG.choice(TONGUES[lang], n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """60 clean documents; 60 to 69 are copies of 0 to 9, 70 to 79 near copies of 10 to 19, 80 to 84 hold an item, 85 and 86 have no letters."""
    docs = [(i, prose("ab"[i % 2] * 2, int(RNG.integers(150, 400))), "ab"[i % 2] * 2, f"s{i % 3}") for i in range(60)]
    docs += [(60 + i, docs[i][1], docs[i][2], "copies") for i in range(10)]
    docs += [(70 + i, docs[10 + i][1] + " tail", docs[10 + i][2], None) for i in range(10)]
    items = [prose("aa", 20) + "\n" + prose("aa", 8) for _ in range(5)]
    docs += [(80 + i, prose("aa", 100) + " " + items[i] + " " + prose("aa", 50), None, "s1") for i in range(5)]
    docs += [(85, "12 34 %%", "aa", "s0"), (86, None, "bb", "s0"), (87, docs[0][1], "aa", "s0"), (87, docs[0][1], "aa", "s0")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_in_order(spark, planted):
    docs = table(spark, planted, "documents")
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "decontaminate", "mix", "shard"]
    a = cp.language(spark, docs, planted)
    assert ids(a) == sorted([*range(85), 87, 87]) and a.columns == docs.columns
    b = cp.near_copies(spark, a, planted)
    assert ids(b) == sorted([*range(60), *range(80, 85)]) and b.columns == docs.columns
    c = cp.clean_of_benchmark(spark, b, planted)
    assert ids(c) == list(range(60)) and c.columns == docs.columns
    m = cp.mixed(spark, c, planted)
    assert m.columns == docs.columns and set(ids(m)) <= set(range(60)) and max(ids(m).count(i) for i in range(60)) == 2
    words = lambda df: df.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words(m) - 1.5 * words(c)) < 3 * 400
    s = cp.sharded(spark, m, planted)
    assert s.columns == [*docs.columns, "slot", "shard"] and s.count() == m.count()
    assert s.where((F.col("shard") < 0) | (F.col("shard") >= sharding.SHARDS)).count() == 0 and s.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_run_applies_the_stages(spark, planted):
    out = cp.run(spark, planted)
    assert set(ids(out)) <= set(range(60)) and out.count() > 60


def test_stages_on_odd_rows(spark, planted, tmp_path):
    docs = table(spark, planted, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, prose("aa", 200), None, None, None), (1, "", "aa", None, None)], docs.schema))
    for name, stage in cp.STAGES:
        out = stage(spark, odd, planted)
        assert out.count() >= 1 or name == "language", name
        assert stage(spark, docs.limit(0), planted).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_texts_of_no_learned_language_go(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    letters = lambda abc, low, high, n: " ".join("".join(RNG.choice(list(abc), int(RNG.integers(low, high)))) for _ in range(n))
    odd = ["我们今天去公园散步天气很好大家都很高兴" * 8, "Сегодня мы пошли в парк и долго гуляли там вместе с друзьями. " * 6, "Σήμερα πήγαμε στο πάρκο και περπατήσαμε πολλή ώρα. " * 6]
    odd += ["Tänään menimme puistoon ja kävelimme siellä pitkään ystävien kanssa, sää oli hyvä. " * 5, "Hôm nay chúng tôi đi công viên và đi dạo rất lâu với bạn bè. " * 5]
    odd += [letters("abcdefghijklmnopqrstuvwxyz", 2, 10, 120), letters("0123456789abcdef", 32, 33, 20), letters("ABCDEFGHIJKLMabcdefghijklmnopqrstuvwxyz0123456789+/", 700, 701, 1)]
    clean = [r["text"] for r in docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").limit(4).collect()]
    data = "+1 (807) 555-5623 lecne.06@mail4.example.com 39.73.140.133 4325404893167225 +1 (227) 555-6608"
    mixed = [f"{data} {' '.join(t.split()[:8])}" for t in clean]
    texts = [(-1 - i, t) for i, t in enumerate(odd)] + [(10**6 + i, t) for i, t in enumerate(mixed)]
    planted = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = ids(cp.language(spark, docs.select(*planted.columns).unionByName(planted), "/root/testdata/sf0.001"))
    assert kept[0] >= 0 and len(kept) >= 0.99 * docs.count() and kept[-4:] == [10**6 + i for i in range(4)]


def test_near_copies_are_those_of_enough_similarity(spark, planted):
    """Texts at a similarity of 0.808 go, those at 0.742 and short ones of one common shingle stay."""
    words = [f"w{i}" for i in range(400)]
    base = [list(RNG.choice(words, 240)) for _ in range(80)]
    edit = lambda t, n: " ".join("changed" if k % 30 == 15 and k // 30 < n else w for k, w in enumerate(t))
    texts = [" ".join(t) for t in base] + [edit(t, 5) for t in base[:40]] + [edit(t, 7) for t in base[40:]]
    short = [" ".join(RNG.choice(words, 6)) for _ in range(40)]
    texts += short + [t.rsplit(" ", 1)[0] + " changed" for t in short]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], table(spark, planted, "documents").schema)
    left = ids(cp.near_copies(spark, docs, planted))
    assert [i for i in left if not 80 <= i < 120] == [*range(80), *range(120, 240)] and len([i for i in left if 80 <= i < 120]) <= 2


def test_extra_columns_come_back_as_they_went_in(spark, planted):
    names = ["nth", "first_id", "size", "rate", "copies", "score", "held", "lead", "lang_pred", "t", "key", "node", "label", "component", "a.b"]
    docs = table(spark, planted, "documents")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    docs = docs.withColumn("slot", F.lit("own"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, planted)
        got = out.collect()
        assert got and (out.columns == docs.columns or name == "shard"), name
        for r in got:
            assert all(r[n] == f"{n}-{r['doc_id']}" for n in names), name
            assert name == "shard" or r["slot"] == "own"


def test_documents_under_odd_ids_stay(spark, planted):
    """Unlike texts beside a null id, under ids that doubles can't tell apart, and two under one id."""
    big = 2**53
    rows = [(None, prose("aa", 90)), (None, prose("bb", 70)), (big + 1, prose("aa", 80)), (big + 3, prose("bb", 80)), (big + 5, prose("aa", 60)), (7, prose("aa", 50)), (7, prose("bb", 50))]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], table(spark, planted, "documents").schema).coalesce(1)
    for name in ("language", "near_copies", "decontaminate"):
        got = [(r["doc_id"], r["text"]) for r in dict(cp.STAGES)[name](spark, docs, planted).collect()]
        assert sorted(got, key=str) == sorted(rows, key=str), name


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_similar_matches_brute_force(least):
    """Links connect just what all pairs at the least similarity connect, whatever is joined already."""
    sets = [np.unique(RNG.integers(0, 40, int(RNG.integers(1, 30))).astype(np.uint64)) for _ in range(120)]
    near = [[len(np.intersect1d(a, b)) >= least * len(np.union1d(a, b)) - 1e-9 for b in sets] for a in sets]

    def components(links, n):
        at = list(range(n))
        for _ in range(n):
            for a, b in links:
                at[a] = at[b] = min(at[a], at[b])
        return at

    every = [(i, j) for i in range(120) for j in range(i) if near[i][j]]
    links = similar.similar(sets, least)
    assert all(near[i][j] for i, j in links) and components(links, 120) == components(every, 120)
    known = np.array(components(every[::2], 120))
    more = similar.similar(sets, least, known)
    assert components([*every[::2], *more], 120) == components(every, 120) and len(more) <= len(links)


def test_groups_hold_every_near_pair():
    """Buckets of many and few rows: rows of other labels that are near come into one group."""
    n = 1500
    key = np.sort(np.r_[np.zeros(1100, np.int64), RNG.integers(1, 90, n - 1100)])
    one, two = RNG.integers(0, 1 << 63, n, dtype=np.uint64), RNG.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(0, n - 1, 3):
        one[i + 1], two[i + 1] = one[i] ^ np.uint64(1 << (i % 60)), two[i] ^ np.uint64(5)
    label = RNG.integers(0, 4, n)
    groups = [set(g.tolist()) for g in similar.groups_of(key, one, two, label, 20)]
    for i in range(0, n - 1, 3):
        if key[i] == key[i + 1] and label[i] != label[i + 1]:
            assert any(i in g and i + 1 in g for g in groups)
    assert all(len({int(label[i]) for i in g}) > 1 and len({int(key[i]) for i in g}) == 1 for g in groups)


def test_large_groups_in_parts(spark, planted, monkeypatch):
    """A chain in which neighbours alone are similar, and a dense group, come together in parts of three as they do in one."""
    words = [f"w{i}" for i in range(2000)]
    long = list(RNG.choice(words, 400))
    chain = [long[8 * k : 8 * k + 200] for k in range(14)]  # from 0.92 for neighbours down to none
    dense = [[("changed" if i == 13 * k else w) for i, w in enumerate(words[:180])] for k in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(chain + dense)]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], table(spark, planted, "documents").schema)
    want = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()}
    assert set(want.values()) == {0, 14}
    monkeypatch.setattr(similar, "PART", 3)
    assert {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()} == want
    label = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 1), (5, 5), (6, 1), (7, 1)], "node long, component long")
    large = spark.createDataFrame([(9, n) for n in range(1, 8)] + [(8, n) for n in (1, 2, 4)], "whole long, node long")
    parts = {}
    for r in similar.again(large, label).collect():
        parts.setdefault(r["group"], set()).add(r["node"])
    assert all({3, 5} <= p for p in parts.values()) and set().union(*parts.values()) == set(range(1, 8)) and len(parts) == 3


def test_near_copies_at_the_least_similarity_are_caught(spark, planted):
    """400 pairs of a similarity between 0.80 and 0.83: at least 98 in 100 are linked, and none below 0.8."""
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], 0
    for i in range(400):
        t = list(RNG.choice(words, 200))
        other = [("changed" if k in (20, 60, 100, 140) else w) for k, w in enumerate(t)]
        a, b = ({tuple(x[j : j + 5]) for j in range(196)} for x in (t, other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(other))]
        want += 1
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], table(spark, planted, "documents").schema)
    got = similar.near_copies(docs).collect()
    linked = sum(r["doc_id"] % 2 == 1 and r["component_id"] == r["doc_id"] - 1 for r in got)
    assert len(got) == 800 and linked >= 0.98 * want and all(r["component_id"] in (r["doc_id"], r["doc_id"] - 1) for r in got)


def test_everything_is_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(registry.SQL) <= set(registry.QUERIES)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.query("x", f'SELECT {", ".join(df.columns)} FROM x').fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    got = registry.QUERIES["op7_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and language_id.UNKNOWN not in {r["lang_pred"] for r in got}
