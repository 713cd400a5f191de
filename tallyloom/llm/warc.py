"""WARC archives: an index written with the records, and coalesced byte-range reads by it.

Archives go to a folder that all executors reach through ``pyarrow.fs`` (a file system shared by
all, or an object store); every task attempt writes files of its own name, and only files that
the index names are ever read, so lost or repeated tasks leave no wrong rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tallyloom import session
from tallyloom.llm.common import arrow_schema, as_schema, field, partitions, sliced

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Records carry this date unless the caller gives one: the pages have none.
DATE = "2000-01-01T00:00:00Z"

# An archive is closed once it is this long; a read spans at most READ_BYTES (or one record), and
# steps over gaps of at most GAP_BYTES.
ARCHIVE_BYTES = 64_000_000
READ_BYTES = 8_000_000
GAP_BYTES = 65_536

INDEX = [("file", "string"), ("offset", "long"), ("length", "long"), ("url", "string"),
         ("digest", "string"), ("record_type", "string")]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _header_value(text: str) -> str:
    """One line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP header alone, whose
    Content-Length still is that of the whole payload."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    block = http
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    whole = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record's gzip member; names in lower case."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def planned(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int
) -> DataFrame:
    """(page, url, payload, sha1, refers_to): what each record will be.

    The smallest id of a digest is found from digests alone; payloads are joined to it once.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    # a digest that stands once needs no partner: only repeated ones are joined
    firsts = (rows.filter(F.length("payload") >= min_bytes).groupBy("sha1")
              .agg(F.min("page").alias("first"), F.count("*").alias("n"))
              .filter("n > 1").select(F.col("sha1").alias("_sha1"), "first"))
    return rows.join(firsts, F.col("sha1") == F.col("_sha1"), "left").select(
        "page", "url", "payload", "sha1",
        F.when(F.col("first") < F.col("page"), F.col("first"))
        .when(F.col("page").isNull(), F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", min_bytes: int = 0, date: str = DATE,
) -> DataFrame:
    """Write a record per page below ``folder``; returns the written index.

    Index rows: (id, file, offset, length, url, digest, record_type). Of records with equal
    payloads of at least ``min_bytes`` bytes the one with the smallest id is the response, the
    others revisit it; payloads are equal if their SHA-1 is.

    Null payloads are empty, null urls give no target field, a null id has an empty record id and
    is never the smallest (if all ids of a payload are null, all are responses). Repeated rows
    with the smallest id are all responses. Payloads of any length are one record. An empty table
    writes no archive. Further columns are not read.
    """
    rows = planned(pages, id_col, url_col, payload_col, min_bytes)
    schema = as_schema([field(pages, id_col), *INDEX])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, path, at = None, None, 0
        for b in sliced(batches):
            made: list[list] = [[] for _ in target]
            for page, url, payload, sha1, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                digest = base32_of_hex(sha1)
                member = record(page, url, payload, digest, first, date)
                out.write(member)
                kind = "response" if first is None else "revisit"
                for column, v in zip(made, (page, path, at, len(member), url, digest, kind)):
                    column.append(v)
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            # the index speaks of bytes that are there: the stream is closed before the task ends
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(made, target)], schema=target)
        if out is not None:
            out.close()

    return session.settle(rows.mapInArrow(run, schema), "warc-index")


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list]]:
    """Neighbouring (file, offset, length) rows, in order, joined to (file, start, end, members)."""
    file, start, end, members = None, 0, 0, []
    for f, offset, length in rows:
        near = f == file and offset <= end + GAP_BYTES and offset + length - start <= READ_BYTES
        if not near:
            if members:
                yield file, start, end, members
            file, start, end, members = f, offset, offset, []
        members.append((offset - start, length))
        end = max(end, offset + length)
    if members:
        yield file, start, end, members


READ = [("page", "string"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"),
        ("record_type", "string"), ("refers_to", "string"), ("payload", "binary")]


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows, out of the archives.

    Rows: (page, url, payload_bytes, payload_digest, record_type, refers_to, payload), ids as
    text, all but the payload out of the records' own fields. The index rows are sorted by file and place, split
    over tasks by ranges, and neighbouring records are read at once. A response whose payload
    does not match its digest raises. A revisit has no payload of its own (null). A record that
    is listed twice is read twice. ``payloads=False`` leaves the payload column null. Urls come back as header
    fields hold them: without white space at their ends, control characters percent-encoded; a null url is
    null again. An empty index gives no rows; further columns of it are not read.
    """
    schema = as_schema(READ)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        wanted = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        opened, handle = None, None
        for file, start, end, members in ranges(wanted):
            if file != opened:
                opened, handle = file, store.open_input_file(file)
            data = handle.read_at(end - start, start)
            made: list[list] = [[] for _ in target]
            for at, length in members:
                warc, http, payload = parse(data[at:at + length])
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                kind = warc["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"damaged record at {start + at} of {file}")
                of = [re.sub(r"^<urn:page:(.*)>$", r"\1", warc.get(k, "")) or None
                      for k in ("warc-record-id", "warc-refers-to")]
                row = (of[0], warc.get("warc-target-uri"), int(http["content-length"]), digest, kind, of[1],
                       payload if payloads and kind == "response" else None)
                for column, v in zip(made, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(made, target)], schema=target)

    return (index.select("file", "offset", "length")
            .repartitionByRange(partitions(index), "file", "offset")
            .sortWithinPartitions("file", "offset").mapInArrow(run, schema))
