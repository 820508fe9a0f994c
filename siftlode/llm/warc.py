"""WARC revisit resolution: equal payloads are stored once, later records refer to the first.

Only headers (digest, page id, URL) are shuffled to find the first record of each payload, and only payloads that occur
more than once have an entry in the table of first records.  That table is written before it is joined to the pages, so
Spark knows its size: below the session's broadcast threshold the payloads stay where they were read, above it they are
shuffled by digest and adaptive execution splits large groups.  Each task writes archives of WARC/1.1 records behind a
``warcinfo`` record, one gzip member per record, with fresh headers; a result row is what reading the archives gives back.

Of records with equal payloads of at least ``min_bytes`` bytes that with the smallest page id is a ``response`` and the
others are ``revisit`` records; smaller payloads are all stored.  Record ids are unique: a first record's follows from its
page, URL and digest, every other one is random.  Defined results: null html is an empty payload; a null
page id never is the smallest unless all are null; rows that share the smallest page id of their payload are all
responses, and where that with the smallest URL stands there more than once, revisits name its URL and date but no record
id; null URLs give records without a target; line breaks in URLs are percent-encoded in headers; an empty table
gives no archives and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.common import materialise, read_file, scratch, write_file

#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 32 << 20
#: The date in fresh headers; a crawl's own date belongs here.
DATE = "2000-01-01T00:00:00Z"
INFO = b"software: siftlode\r\nformat: WARC File Format 1.1\r\n"
#: Compressed bytes that the reader takes at once: what it copies beyond a member's end.
PIECE = 8 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _first_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _fresh_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def _target(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _member(head: list[str], block: bytes) -> bytes:
    return gzip.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def info(date: str = DATE) -> bytes:
    """The record that opens an archive."""
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: {_fresh_id()}", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], INFO)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, own_id: str, first: tuple | None = None, date: str = DATE) -> bytes:
    """One gzip member; with ``first`` (page id, URL, record id or null) a revisit, which has the HTTP header of its response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_target(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if first:
        page, target, name = first
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {page}"]
        head += [f"WARC-Refers-To: {name}"] if name else []
        head += [f"WARC-Refers-To-Target-URI: {_target(target)}"] if target is not None else []
    head += [f"X-Page: {page_id}"] if page_id is not None else []
    return _member([*head, "Content-Type: application/http; msgtype=response"], http if first else http + payload)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; time and memory are linear in its size."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, raw = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + PIECE]
            raw.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        yield headers, rest[: int(headers["content-length"])]


def read_archive(uri: str) -> Iterator[tuple]:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, url) of an archive; payloads are verified."""
    for h, block in records(read_file(uri)):
        if h["warc-type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        said = h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response":
            real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if real != said or len(payload) != size:
                raise ValueError(f"{uri}: the payload of {h['warc-record-id']} does not have its digest")
        page, first = h.get("x-page"), h.get("x-refers-to-page")
        yield int(page) if page else None, size, said, h["warc-type"], int(first) if first and first != "None" else None, h.get("warc-target-uri")


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder; returns their list (uri, n)."""
    own = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    headers = own.where(F.length("payload") >= min_bytes).groupBy("sha", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    first = headers.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url", "n")).alias("f"), F.sum("n").alias("n")).where("n > 1")
    first = first.select(F.col("sha").alias("of"), F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), (F.col("f.n") == 1).alias("named"))
    first = materialise(first, "first-records")
    resolved = own.join(first, F.col("sha") == F.col("of"), "left")
    resolved = resolved.withColumn("revisit", F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    resolved = resolved.withColumn("named", F.coalesce("named", F.lit(False))).drop("of")
    folder = scratch(pages.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple[str, int]] = []
        out, n, size = io.BytesIO(), 0, 0

        def close() -> None:
            nonlocal out, n, size
            uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"  # only archives that a finished task lists are read
            write_file(uri, info(date) + out.getvalue())
            done.append((uri, n))
            out, n, size = io.BytesIO(), 0, 0

        whole = lambda x: None if pd.isna(x) else int(x)
        text = lambda x: x if isinstance(x, str) else None
        for pdf in batches:
            for page, url, payload, sha, at, at_url, named, revisit in zip(*(pdf[c] for c in cols), strict=True):
                page, url, at, at_url, digest = whole(page), text(url), whole(at), text(at_url), base64.b32encode(bytes.fromhex(sha)).decode()
                if revisit:
                    made = record(page, url, payload, digest, _fresh_id(), (at, at_url, _first_id(at, at_url, digest) if named else None), date)
                else:
                    made = record(page, url, payload, digest, _first_id(page, url, digest) if named and url == at_url else _fresh_id(), None, date)
                out.write(made)
                n, size = n + 1, size + len(payload)
                if size >= archive_bytes:
                    close()
        if n:
            close()
        yield pd.DataFrame(done, columns=["uri", "n"])

    cols = ("page_id", "url", "payload", "sha", "first", "first_url", "named", "revisit")
    return materialise(resolved.select(*cols).mapInPandas(write, "uri string, n long"), "warc-list")


def read_archives(listed: DataFrame) -> DataFrame:
    """One row for each page's record of the archives in ``listed`` (uri)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            for uri in pdf["uri"]:
                found = pd.DataFrame(list(read_archive(uri)), columns=names)
                yield found.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    # a task for each archive, so that a lost one costs little
    return listed.select("uri").repartition(max(1, listed.count())).mapInPandas(read, schema)


def archives_query(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, min_bytes=0))
