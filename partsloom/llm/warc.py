"""Web archives: WARC files of one gzip member a record, written by tasks and read back in sequence.

The reader decompresses a member bit by bit, takes as many bytes for a record as its Content-Length says, checks that nothing else
is in the member, and compares digests. It holds one chunk at a time, and a record's payload only if that is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.compose import file_system
from .common import col, kept, shared_dir, table

#: Compressed bytes after which a file ends and the next begins.
FILE_BYTES = 64_000_000
#: Bytes read, and decompressed, at a time; most bytes of a record's or a response's head.
CHUNK, HEAD = 1 << 18, 1 << 20
#: A payload that so large a share of all rows have, or more, is hot; there can be no more than HOT of them.
HOT = 1000
#: The date of all records, so that reruns agree; tables of pages have none.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION, END, REVISIT = "WARC/1.1", b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
#: Fields of our own: ids of the row and of the row that a revisit refers to.
ROW, REFERS_ROW = "Partsloom-Row-Id", "Partsloom-Refers-To-Row-Id"


class WarcError(ValueError):
    """A file that is no archive, or a record that is not what it says."""


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def labelled(digest: bytes) -> str:
    return "sha1:" + base32(digest)


def urn(*what: object) -> str:
    """A record's id from what it is about."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(what).encode()).digest())}>"


def head_of(kind: str, record_id: str, block_digest: str, content_type: str, length: int, date: str, more: dict[str, str | None]) -> bytes:
    rows = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, **more, "WARC-Block-Digest": block_digest, "Content-Type": content_type, "Content-Length": str(length)}
    lines = [VERSION, *(f"{k}: {v}" for k, v in rows.items() if v is not None)]
    return "\r\n".join(lines).encode() + END


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}".encode() + END


def member(*parts: bytes, level: int = 6) -> bytes:
    """One gzip member; it holds no time, so equal records are equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, parts), z.flush()])


def uri(url: str | None) -> str | None:
    """Blanks and control characters would end a header line: they are percent-encoded."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def response(record_id: str, url: str | None, payload: bytes, row: int | None, date: str = DATE) -> bytes:
    http = http_head(len(payload))
    block = hashlib.sha1(http)
    block.update(payload)
    more = {"WARC-Target-URI": uri(url), "WARC-Payload-Digest": labelled(hashlib.sha1(payload).digest()), ROW: None if row is None else str(row)}
    return member(head_of("response", record_id, labelled(block.digest()), HTTP, len(http) + len(payload), date, more), http, payload, END)


def revisit(record_id: str, url: str | None, digest: bytes, size: int, row: int | None, to: str, to_url: str | None, to_row: int | None, date: str = DATE) -> bytes:
    """The block is the response's head alone; its Content-Length is that of the payload which stands elsewhere."""
    http = http_head(size)
    more = {"WARC-Target-URI": uri(url), "WARC-Payload-Digest": labelled(digest), "WARC-Profile": REVISIT, "WARC-Refers-To": to, "WARC-Refers-To-Target-URI": uri(to_url), "WARC-Refers-To-Date": date}
    more |= {"WARC-Truncated": "length", ROW: None if row is None else str(row), REFERS_ROW: None if to_row is None else str(to_row)}
    return member(head_of("revisit", record_id, labelled(hashlib.sha1(http).digest()), HTTP, len(http), date, more), http, END)


def warcinfo(record_id: str, name: str, date: str = DATE) -> bytes:
    body = b"software: partsloom\r\nformat: WARC File Format 1.1\r\n"
    return member(head_of("warcinfo", record_id, labelled(hashlib.sha1(body).digest()), "application/warc-fields", len(body), date, {"WARC-Filename": name}), body, END)


class Members:
    """The gzip members of a stream one after the other, each decompressed CHUNK by CHUNK."""

    def __init__(self, stream):
        self.stream, self.raw, self.taken, self.at, self.z, self.held = stream, b"", 0, 0, None, b""

    def _fill(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            self.taken += len(self.raw)
        return bool(self.raw)

    def next(self) -> bool:
        """Goes to the next member, past what is left of this one; false at the end of the stream."""
        while self.z and not self.z.eof:
            self._more()
        self.at, self.held = self.taken - len(self.raw), b""
        if not self._fill():
            return False
        self.z = zlib.decompressobj(31)
        return True

    def _more(self) -> bytes:
        """Some more bytes of the member; none at its end."""
        while not self.z.eof:
            if not self._fill():
                raise WarcError("the last member is cut short")
            out = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def read(self, n: int) -> bytes:
        """At most n bytes; none at the member's end."""
        if not self.held:
            self.held = self._more()
        out, self.held = self.held[:n], self.held[n:]
        return out

    def until(self, end: bytes, most: int) -> bytes:
        """Up to end and no further."""
        out = b""
        while (i := out.find(end)) < 0:
            if len(out) > most:
                raise WarcError("a head has no end")
            if not (x := self.read(CHUNK)):
                raise WarcError("a member ends within a head")
            out += x
        self.held = out[i + len(end) :] + self.held
        return out[: i + len(end)]

    @property
    def end(self) -> int:
        """Where the next member begins, once this one is read."""
        return self.taken - len(self.raw)


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the others by lower-case name; a line that begins with a blank goes on with the one before."""
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    out = {}
    for x in filter(None, lines):
        name, colon, value = x.partition(":")
        if not colon:
            raise WarcError(f"no header: {x[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return first, out


def number(text: str | None, what: str) -> int:
    if text is None or not re.fullmatch("[0-9]+", text):
        raise WarcError(f"no {what}")
    return int(text)


#: Digests by label; a label that is not here is not compared.
DIGESTS = {"sha1": hashlib.sha1, "md5": hashlib.md5, "sha256": hashlib.sha256, "sha-1": hashlib.sha1, "sha-256": hashlib.sha256}


def same(told: str, h) -> bool:
    value = told.partition(":")[2]
    return value.lower() == h.hexdigest() or value.upper().rstrip("=") == base32(h.digest()).rstrip("=")


@dataclass
class Record:
    headers: dict[str, str]
    #: Where the member begins in the file, and its size.
    offset: int
    size: int = 0
    #: The payload's size and SHA-1; of a revisit without a payload those that it tells.
    payload_bytes: int = 0
    digest: str | None = None
    payload: bytes | None = field(default=None, repr=False)


def read_record(m: Members, content: bool) -> Record:
    version, headers = fields(m.until(END, HEAD))
    r = Record(headers, m.at)
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise WarcError(f"no record: {version[:40]!r}")
    left, kind = number(headers.get("content-length"), "Content-Length"), headers.get("warc-type")
    told = {k: (headers[f"warc-{k}-digest"], DIGESTS.get(headers[f"warc-{k}-digest"].partition(":")[0].lower())) for k in ("block", "payload") if f"warc-{k}-digest" in headers}
    hashes = {k: make() for k, (_, make) in told.items() if make}
    own, parts, n, http = hashlib.sha1(), [], 0, None

    def some(x: bytes, payload: bool) -> None:
        nonlocal n
        if "block" in hashes:
            hashes["block"].update(x)
        if payload:
            n += len(x)
            own.update(x)
            if "payload" in hashes:
                hashes["payload"].update(x)
            if content:
                parts.append(x)

    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http") and left:
        head = m.until(END, HEAD)
        if len(head) > left:
            raise WarcError("the response's head is longer than its record")
        some(head, False)
        left, http = left - len(head), fields(head)[1]
    while left:
        x = m.read(min(left, CHUNK))
        if not x:
            raise WarcError(f"a record ends {left} bytes too early")
        some(x, True)
        left -= len(x)
    tail = b""
    while len(tail) <= len(END) and (x := m.read(CHUNK)):
        tail += x
    if tail != END:
        raise WarcError("a record does not end where it should")
    elsewhere = kind == "revisit" and not n  # what it tells of its payload holds for another record's
    for k, h in hashes.items():
        if not (elsewhere and k == "payload") and not same(told[k][0], h):
            raise WarcError(f"the {k} is not what its digest says")
    if elsewhere:
        r.payload_bytes = number((http or {}).get("content-length"), "payload's Content-Length")
        r.digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        r.payload_bytes, r.digest, r.payload = n, base32(own.digest()), b"".join(parts) if content else None
    r.size = m.end - r.offset
    return r


def records(stream, content: bool = True, strict: bool = True) -> Iterator[tuple[Record | None, int, str | None]]:
    """(record, offset, fault). Strict: the first fault is an error. Else a faulty record gives its fault, and reading goes on with the next member, or ends where bytes can't be decompressed."""
    m = Members(stream)
    while True:
        try:
            if not m.next():
                return
            r, fault = read_record(m, content), None
        except (WarcError, zlib.error) as e:
            if strict:
                raise WarcError(f"at byte {m.at}: {e}") from e
            r, fault = None, str(e)
        yield r, m.at, fault
        if fault:
            try:
                while m.read(CHUNK):
                    pass
            except (WarcError, zlib.error):
                return


OUT = "path string, offset long, size long, record_type string, record_id string, target_uri string, refers_to string, row_id long, refers_row_id long, payload_bytes long, payload_digest string, payload binary, fault string"


def read_warc(files: DataFrame, content: bool = True, strict: bool = True) -> DataFrame:
    """A row for each record of the files (path): OUT. One task reads a file from its beginning to its end in bounded memory (and, with content, a payload at a time).

    A revisit's payload is null; its size and digest are those that the record tells. A fault is an error, or, not strict, a row that names it with all else null.
    Payloads are as they are stored: chunked or compressed bodies are not undone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for b in batches for p in b["path"]):
            store, where = file_system(path)
            rows, held = [], 0
            with store.open_input_stream(where, compression=None) as f:
                try:
                    for r, at, fault in records(f, content, strict):
                        h = r.headers if r else {}
                        row = lambda x, h=h: int(h[x.lower()]) if re.fullmatch("-?[0-9]+", h.get(x.lower(), "")) else None
                        rows.append((path, at, r and r.size, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), row(ROW), row(REFERS_ROW), r and r.payload_bytes, r and r.digest, r and r.payload, fault))
                        held += 500 + len((r and r.payload) or b"")
                        if held >= 8_000_000:
                            yield frame(rows)
                            rows, held = [], 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
            if rows:
                yield frame(rows)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInPandas(run, OUT)


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in OUT.split(", ")]
    out = pd.DataFrame(rows, columns=names).astype(object)
    for c in ("offset", "size", "row_id", "refers_row_id", "payload_bytes"):
        out[c] = pd.array(out[c], "Int64")
    return out.where(out.notna(), None)


def _write(rows: DataFrame, folder: str, date: str, file_bytes: int) -> DataFrame:
    """(path, n_records, n_bytes) of the files that tasks wrote. rows: id, url, html, key, digest (hex), size, and of a revisit to_id, to_url; html is null there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        part, n, out = TaskContext.get().partitionId(), 0, None
        name, count, size, done = "", 0, 0, []
        num = lambda x: None if pd.isna(x) else int(x)
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:  # each try of a task names its files anew, and only a task that ends well tells their names
                    name, count, size = f"{root}/{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)  # by its name Arrow would put all members into one more
                    x = warcinfo(urn(name), name.rsplit("/", 1)[-1], date)
                    out.write(x)
                    size = len(x)
                if r.kind == "response":
                    x = response(urn("response", r.key) if r.key else urn("row", part, n, num(r.id)), r.url, (r.html or "").encode("utf-8", "replace"), num(r.id), date)
                else:
                    x = revisit(urn("revisit", part, n, r.key, num(r.id)), r.url, bytes.fromhex(r.digest), int(r.size), num(r.id), urn("response", r.key), r.to_url, num(r.to_id), date)
                out.write(x)
                n, count, size = n + 1, count + 1, size + len(x)
                if size >= file_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name.rsplit('/', 1)[-1]}", count, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name.rsplit('/', 1)[-1]}", count, size))
        if done:
            yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    return kept(rows.mapInPandas(run, "path string, n_records long, n_bytes long"), "warc-files")


def write_warc(pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, least_bytes: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row and returns the list of files: path, n_records, n_bytes.

    Of rows with equal payloads (html in UTF-8, null: empty) of at least least_bytes bytes, that with the largest (id, url) is the response, the
    others revisit it; a null id is smaller than any. Of rows that are equal in all of this one is the response. Smaller payloads are all responses. A null URL
    is left out. Equal means an equal SHA-256. Other columns are not looked at, and an empty table gives no files.

    A payload moves once, to where its copies meet, and partial maxima leave one copy of it in each task; revisits move without it. What they refer to comes by
    a join on the digest. Digests that a HOT-th of all rows have, or more (HOT at most), are sent to all tasks instead, so no task gets all copies of one.
    """
    text = F.coalesce(col(html_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("bigint").alias("id"), col(url_col).cast("string").alias("url"), text.alias("html"), F.octet_length(text).cast("bigint").alias("size"))
    big = rows if least_bytes <= 0 else rows.where(F.col("size") >= least_bytes)
    keyed = big.withColumn("key", F.sha2("html", 256))
    first = F.max(F.struct("id", "url")).alias("to")
    # Responses: the payload of each digest, with the row that has the largest id.
    plain = [F.lit("response").alias("kind"), "id", "url", "html", "key", F.lit(None).cast("string").alias("digest"), "size", F.lit(None).cast("bigint").alias("to_id"), F.lit(None).cast("string").alias("to_url")]
    own = keyed.groupBy("key").agg(first, F.first("html").alias("html"), F.first("size").alias("size")).select("key", "to.id", "to.url", "html", "size").select(*plain)
    if least_bytes > 0:
        own = own.union(rows.where(F.col("size") < least_bytes).withColumn("key", F.lit(None).cast("string")).select(*plain))
    # Revisits: rows as often as they come, less one of those that are the response.
    light = kept(keyed.select("id", "url", "key", F.sha1("html").alias("digest"), "size").groupBy("id", "url", "key", "digest", "size").agg(F.count("*").alias("n")), "warc-rows")
    groups = light.groupBy("key").agg(first, F.sum("n").alias("n"))
    groups = kept(groups.where("n > 1"), "warc-groups")
    total = light.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") >= max(HOT, -(-total // HOT)))
    near = light.join(F.broadcast(hot.select("key", F.col("to").alias("hot"))), "key", "left")
    spread = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))  # a hot row asks for no digest
    both = near.withColumn("ask", spread).join(groups.select(F.col("key").alias("ask"), "to"), "ask", "left").withColumn("to", F.coalesce("hot", "to")).where("to is not null")
    it = F.col("id").eqNullSafe(F.col("to.id")) & F.col("url").eqNullSafe(F.col("to.url"))
    more = both.withColumn("n", F.col("n") - it.cast("int")).where("n > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    more = more.select(F.lit("revisit").alias("kind"), "id", "url", F.lit(None).cast("string").alias("html"), "key", "digest", "size", F.col("to.id").alias("to_id"), F.col("to.url").alias("to_url"))
    files = [_write(own, folder, date, file_bytes), _write(more, folder, date, file_bytes)]
    return files[0].union(files[1])


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; null and repeated page_ids: as write_warc and read_warc have it."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_warc(table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    back = read_warc(files, content=False).where(F.col("record_type").isin("response", "revisit"))
    return back.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_row_id").alias("refers_to"))


def _letters() -> str:
    """Base32 of a SHA-1 in hexadecimal, h: four letters of each five digits."""
    bits = "('0x' || substr(h, 5 * (g // 4) + 1, 5))::INT >> (15 - 5 * (g % 4))"
    return f"list_aggregate(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({bits}) & 31) + 1, 1)), 'string_agg', '')"


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, {_letters()} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""
