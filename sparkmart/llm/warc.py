"""WARC archives with an index that is written first, and reads that go by the index.

Of pages with equal payloads of `MIN_REVISIT` bytes or more the one with the largest id is a response, the others are
revisits of it. Payload digests with their largest id are found from digests alone and written; a page meets its
digest's entry in a join of two read tables, which adaptive execution can split where many pages share a digest.
A task writes its records, each a gzip member, into files of its own in the shared folder, begins a new
file at `FILE` bytes, and gives an index row per record: file, offset, length, URL and digest. A task that runs
again writes files of new names, and only the rows of the attempt that counts are in the index.

Reading takes index rows by file, sorted by offset, joins ranges that lie at most `GAP` bytes apart into one read
of `READ` bytes at most (a longer record is a read of its own), and parses the records in it.

Null payload: empty. Null ids are never the response of others; copies of which none has an id are all
responses. Rows that repeat the response's id are responses too. A record's id is of its file and offset, so rows that
repeat an id, or have none, are records of their own; a revisit names its response by URL, date and page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks

MIN_REVISIT, FILE, GAP, READ = 1000, 256 << 20, 64 << 10, 16 << 20
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
DATE = "2024-01-01T00:00:00Z"


def urn(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}:{offset}')}>"


def clean(url: str | None) -> str:
    """A URL as a header holds it: UTF-8, with control signs as percent codes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url or "")


def record(name: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """A gzip member; name: the record's own id. refers_to: the page that this one is a revisit of, if it is."""
    revisit = refers_to is not None
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of the HTTP answer in it, and the answer's body."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def files(path: str):
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; the index, one row for each page."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    leads = large.groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("lead"), F.count("*").alias("n")).where("n > 1 and lead is not null")
    leads = Scratch(pages.sparkSession).write(leads.select("digest", F.col("lead.page_id").alias("lead"), F.col("lead.url").alias("lead_url")), "leads")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for part in chunks(batch, "payload"):
                    index = []
                    for x in part.to_pylist():
                        if out is None or at >= FILE:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{base}/{name}", compression=None)
                        revisit = x["lead"] is not None and x["lead"] != x["page_id"]
                        refers = x["lead"] if revisit else None
                        data = record(urn(name, at), x["page_id"], x["url"], x["digest"], x["payload"], refers, x["lead_url"])
                        out.write(data)
                        index.append((x["page_id"], x["url"], x["digest"], "revisit" if revisit else "response", refers, name, at, len(data)))
                        at += len(data)
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names=["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return rows.join(leads, "digest", "left").select("page_id", "url", "payload", "digest", "lead", "lead_url").mapInArrow(write, INDEX)


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of records, sorted by offset, that one read takes."""
    a = 0
    for b in range(1, len(offsets) + 1):
        if b == len(offsets) or offsets[b] - (offsets[b - 1] + lengths[b - 1]) > GAP or offsets[b] + lengths[b] - offsets[a] > READ:
            yield a, b
            a = b


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records that the index rows select, from the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with `payload` the body (empty for revisits).

    A response's digest and size are of the payload as it was read, and must equal its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files(folder)
        name, source = None, None
        for batch in batches:
            at, n, file = (batch.column(c).to_pylist() for c in ("offset", "length", "file"))
            cut = [0, *(k for k in range(1, len(file)) if file[k] != file[k - 1]), len(file)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if file[lo] != name:
                    name = file[lo]
                    source = system.open_input_file(f"{base}/{name}")
                for a, b in ranges(at[lo:hi], n[lo:hi]):
                    first = at[lo + a]
                    data = source.read_at(at[lo + b - 1] + n[lo + b - 1] - first, first)
                    yield out([one(data[at[k] - first : at[k] - first + n[k]]) for k in range(lo + a, lo + b)])

    def one(member: bytes):
        fields, http, body = parse(member)
        kind, size = fields["WARC-Type"], int(http["Content-Length"])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError("a payload isn't what its headers say")
        number = lambda x: int(x) if x else None
        return number(fields["X-Page-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("X-Refers-To-Page-ID")), body

    def out(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        keep = 7 if payload else 6
        return pa.record_batch([pa.array(c, t) for c, t in list(zip(zip(*rows), kinds))[:keep]], names=names[:keep])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    # a given number, as index rows are few bytes and would be gathered into few tasks
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file", "offset", "length").repartition(tasks, "file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all pages, writes the index, and reads every record back through it."""
    scratch = Scratch(pages.sparkSession)
    folder = scratch.path("warc")
    index = scratch.write(archived(pages, folder, id_col, url_col, html_col), "index")
    return read(index, folder).drop("url")
