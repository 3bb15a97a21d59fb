"""Archives: exact round trips, digests by hand, faults, and the rule for copies against brute force."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from partsloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def sha(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def there_and_back(spark, pages, folder, content=True, **options):
    files = warc.write_warc(pages, f"file://{folder}", "page_id", "url", "html", **options)
    return files, warc.read_warc(files, content=content)


def expected(rows, least=0):
    """Brute force over (page_id, url, html)."""
    out = []
    for at, (i, u, t) in enumerate(rows):
        b = (t or "").encode()
        key = lambda k, r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""), -k)
        like = [(key(k, r), k, r) for k, r in enumerate(rows) if (r[2] or "") == (t or "")]
        first = max(like)
        mine = len(b) < least or first[1] == at
        out.append((i, len(b), sha(b), "response" if mine else "revisit", None if mine else first[2][0]))
    return sorted(out, key=str)


def digest_rows(df):
    rows = df.where("record_type <> 'warcinfo'").select("row_id", "payload_bytes", "payload_digest", "record_type", "refers_row_id").collect()
    return sorted(map(tuple, rows), key=str)


ODD = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (None, "http://a/5", "<p>x</p>"), (None, None, "only"), (7, "http://a/ 7\r\n", "é\n\r\n\r\nWARC/1.1\r\n"), (8, "u", "same"), (8, "u", "same"), (8, "u", "same"), (9, "u", "long " * 400_000), (10, "v", "long " * 400_000), (-5, "w", "minus")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_and_copies(spark, tmp_path, least):
    pages = spark.createDataFrame(ODD, SCHEMA).withColumn("key", F.lit(1)).withColumn("Size", F.lit(2)).withColumn("a.b", F.lit(3))
    files, back = there_and_back(spark, pages, tmp_path / "w", least_bytes=least)
    assert digest_rows(back) == expected(ODD, least)
    rows = [r for r in back.collect() if r["record_type"] != "warcinfo"]
    by_id = {r["record_id"]: r for r in rows}
    assert len(by_id) == len(ODD) == files.agg(F.sum("n_records")).first()[0]
    got = sorted((str(r["row_id"]), bytes((r if r["record_type"] == "response" else by_id[r["refers_to"]])["payload"])) for r in rows)
    assert got == sorted((str(i), (t or "").encode()) for i, _, t in ODD)
    for r in rows:
        if r["record_type"] == "revisit":
            assert by_id[r["refers_to"]]["record_type"] == "response" and by_id[r["refers_to"]]["payload_digest"] == r["payload_digest"]
    assert {r["target_uri"] for r in rows if r["row_id"] == 7} == {"http://a/%207%0D%0A"}


def test_empty_table_and_small_files(spark, tmp_path):
    files, back = there_and_back(spark, spark.createDataFrame([], SCHEMA), tmp_path / "none")
    assert files.count() == 0 and back.collect() == []
    rows = [(i, f"http://h/{i}", f"page {i} " + str(random.Random(i).random()) * 50) for i in range(300)]
    files, back = there_and_back(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), tmp_path / "many", file_bytes=5000)
    assert files.count() > 3 and digest_rows(back) == expected(rows)


def test_files_hold_the_members_themselves(spark, tmp_path):
    """Each record can be cut out of the file at its offset and unpacked by itself, without this reader."""
    rows = [(i, f"http://h/{i}", f"page {i // 2} " * 40) for i in range(20)]
    files, back = there_and_back(spark, spark.createDataFrame(rows, SCHEMA), tmp_path / "plain")
    raw = {r["path"]: open(r["path"].removeprefix("file://"), "rb").read() for r in files.collect()}
    assert {r["path"]: r["n_bytes"] for r in files.collect()} == {k: len(x) for k, x in raw.items()}
    cut = [(r, gzip.decompress(raw[r["path"]][r["offset"] : r["offset"] + r["size"]])) for r in back.collect()]
    assert len(cut) == len(rows) + len(raw) and all(x.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and x.endswith(b"\r\n\r\n") for r, x in cut)
    assert sorted(r["row_id"] for r, x in cut if r["record_type"] == "response" and x.endswith(rows[r["row_id"]][2].encode() + b"\r\n\r\n")) == list(range(1, 20, 2))


def test_a_third_of_all_rows_alike(spark, tmp_path, monkeypatch):
    """The hot digest is sent to all tasks, so its rows stay dealt out, and results stay the same."""
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"cold {i // 2}") for i in range(3000)]
    monkeypatch.setattr(warc, "HOT", 100)
    _, back = there_and_back(spark, spark.createDataFrame(rows, SCHEMA).repartition(8), tmp_path / "hot")
    hot, got = max(i for i, _, t in rows if t == "hot"), digest_rows(back)
    assert len(got) == 3000 and sum(r[3] == "revisit" and r[4] == hot for r in got) == 999
    cold = {}
    for i, _, t in rows:
        cold[t] = max(cold.get(t, -1), i)
    assert got == sorted(((i, len(t.encode()), sha(t.encode()), "response" if cold[t] == i else "revisit", None if cold[t] == i else cold[t]) for i, _, t in rows), key=str)


def test_members_are_plain_gzip_and_framed():
    a, b = warc.response("<urn:a>", "http://x/", b"abc", 5), warc.revisit("<urn:b>", None, hashlib.sha1(b"abc").digest(), 3, 6, "<urn:a>", "http://x/", 5)
    text = gzip.decompress(a)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nabc\r\n\r\n") and b"WARC-Payload-Digest: sha1:" + sha(b"abc").encode() in text
    got = [r for r, _, _ in warc.records(io.BytesIO(a + b))]
    assert [(r.payload_bytes, r.digest, r.payload) for r in got] == [(3, sha(b"abc"), b"abc"), (3, sha(b"abc"), None)]
    assert [(r.offset, r.size) for r in got] == [(0, len(a)), (len(a), len(b))]


def test_chunks_of_any_size(monkeypatch):
    """Heads, payloads and members that end anywhere in what is read."""
    all_ = b"".join(warc.response(f"<urn:{i}>", "u", bytes(range(256)) * i, i) for i in range(6))
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [r.payload for r, _, _ in warc.records(io.BytesIO(all_))] == [bytes(range(256)) * i for i in range(6)]


def record(head, body, end=b"\r\n\r\n"):
    return warc.member(head.encode().replace(b"\n", b"\r\n") + b"\r\n\r\n", body, end)


FAULTS = {
    "no record": warc.member(b"hello\r\n\r\n"),
    "Content-Length": record("WARC/1.1\nWARC-Type: resource", b"abc"),
    "too early": record("WARC/1.1\nWARC-Type: resource\nContent-Length: 99", b"abc"),
    "where it should": record("WARC/1.1\nWARC-Type: resource\nContent-Length: 2", b"abc"),
    "its digest says": record("WARC/1.1\nWARC-Type: resource\nContent-Length: 3\nWARC-Block-Digest: sha1:" + sha(b"abd"), b"abc"),
    "no header": record("WARC/1.1\nWARC-Type", b""),
    "cut short": warc.response("<urn:a>", "u", b"abc" * 50, 1)[:-9],
}


@pytest.mark.parametrize("what", FAULTS)
def test_faults(what):
    good = warc.response("<urn:a>", "u", b"abc", 1)
    with pytest.raises(warc.WarcError, match=what):
        list(warc.records(io.BytesIO(good + FAULTS[what])))
    after = [] if what == "cut short" else [good]
    got = list(warc.records(io.BytesIO(b"".join([good, FAULTS[what], *after])), strict=False))
    assert [f is None for _, _, f in got] == [True, False, *[True] * len(after)] and what in got[1][2]


def test_foreign_archives():
    """Other versions, digests by other names, folded headers, records of no HTTP."""
    x = record("WARC/1.0\nwarc-type: resource\nWARC-Record-ID:<urn:1>\nX-Long: one\n two\ncontent-length:3\nWARC-Payload-Digest: md5:" + hashlib.md5(b"abc").hexdigest() + "\nWARC-Block-Digest: odd:1", b"abc")
    (r, at, fault), = warc.records(io.BytesIO(x))
    assert fault is None and r.headers["x-long"] == "one two" and r.payload == b"abc" and r.digest == sha(b"abc")


def test_faults_as_rows(spark, tmp_path):
    good = warc.response("<urn:a>", "u", b"abc", 1)
    for n, x in enumerate((good + FAULTS["its digest says"] + good, b"", b"no gzip at all")):
        (tmp_path / f"{n}.warc.gz").write_bytes(x)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in range(3)], "path string")
    rows = warc.read_warc(files, strict=False).collect()
    assert sorted(r["fault"] is not None for r in rows) == [False, False, True, True]
    with pytest.raises(Exception, match="at byte"):
        warc.read_warc(files).collect()
