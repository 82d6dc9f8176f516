"""WARC archives with an index.

Writing: one archive a task, a gzip member a record, and an index row with file, offset, length, URL and digest for each
record.  The index is the commit: an archive of a failed attempt has a name of its own that no index row holds.
Reading: the index is filtered first; its rows are sorted by file and offset, neighbouring byte ranges are fetched
in one read, and every payload is compared with its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import sized
from rosterflow.session import shared_dir, written

DATE = "1970-01-01T00:00:00Z"
# Ranges that are at most so far apart are fetched together, up to so many bytes.
GAP = 64 << 10
MOST_READ = 8 << 20

INDEX = ("file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, "
         "record_type string, refers_to long")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit (``refers_to`` is given) has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parsed(member: bytes) -> dict:
    """Headers and payload of one record."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
            "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None,
            "bytes": int(sent["Content-Length"]), "payload": payload}


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows (page_id, sha, refers_to) of the pages whose payload an earlier page has."""
    slim = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"),
                        F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes")).where(F.col("bytes") >= least_bytes)
    slim = written(slim.select("page_id", "sha"), "digests")
    firsts = slim.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and refers_to is not null").select("sha", "refers_to")
    return slim.join(firsts, "sha").where("page_id is null or page_id > refers_to").select(
        "page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``folder`` and returns the index.

    Null html: an empty payload; null url: a record without one.  Of equal payloads of ``least_bytes`` or more the
    smallest page_id is the response (all its rows, if it repeats) and the others revisit it; a null page_id is never
    the smallest.  The folder may be any that the file systems of pyarrow reach.
    """
    later = written(revisits(pages, least_bytes), "revisits").select(
        F.col("page_id").alias("id"), F.col("sha").alias("own"), "refers_to")
    later = sized(later, later.count(), 120)
    own = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"))
    rows = own.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("own")), "left").select(
        "page_id", "url", "html", "sha", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            index = []
            for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record(page_id, url, payload, digest, refers_to)
                out.write(member)
                index.append((name, offset, len(member), page_id, url, digest, len(payload),
                              "response" if refers_to is None else "revisit", refers_to))
                offset += len(member)
            if index:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*index), kinds)],
                                      names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def _ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (file, offset, length), sorted, in groups that one read fetches."""
    group: list[tuple] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + GAP
                      or row[1] + row[2] - group[0][1] > MOST_READ):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the rows of an index, or of any selection of them.

    Sizes and digests are those of the payload that was read; a revisit has no payload of its own and keeps those of
    its headers.  A payload that differs from its digest raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        opened, name = None, None
        for batch in batches:
            found = []
            for group in _ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if group[0][0] != name:
                    name = group[0][0]
                    opened = system.open_input_file(f"{base}/{name}")
                start = group[0][1]
                chunk = opened.read_at(group[-1][1] + group[-1][2] - start, start)
                for _, offset, length, url in group:
                    got = parsed(chunk[offset - start:offset - start + length])
                    if got["type"] == "response":
                        digest = base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode()
                        if digest != got["digest"] or len(got["payload"]) != got["bytes"]:
                            raise ValueError(f"record at {offset} of {name} differs from its digest")
                    body = got["payload"] if with_payload and got["type"] == "response" else None
                    found.append((got["page_id"], url, got["bytes"], got["digest"], got["type"], got["refers_to"], body))
            if found:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                      names=[x.split()[0] for x in RECORD.split(", ")])

    rows = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, RECORD)


def archive_folder(pages: DataFrame) -> str:
    """A fresh shared folder for archives, as a URI."""
    path = shared_dir(pages.sparkSession, "warc")
    return path if "://" in path else f"file://{path.removeprefix('file:')}"
