"""Operator 3: web archives that are written index first and read by byte ranges.

Pages are written as WARC records, each its own gzip member, by the task that
holds them.  With each record an index row of file, offset, length, URL and
digest is made; the index is a table that Spark commits, so a file of a task
that failed or ran twice has no row and is never read.  Readers take rows of
the index, sort them by file and offset, join neighbouring ranges, and fetch
each joined range with one read.

Of pages with equal payloads the one with the largest page_id is the response
and the others are revisits that name it and carry no payload.

Defined results: null html is an empty payload, whose digest is that of no
bytes; a null url gets a placeholder target; rows without page_id, and repeated rows
of the response's page_id, are responses too; an empty table gives no archive
and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, full_uri, in_batches, small_side, staged, store_of

#: A task starts another file at this size.
FILE_BYTES = 256 << 20
#: Neighbouring ranges are joined over gaps up to this, into reads up to this.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: A task reads about so many bytes of archives.
TASK_BYTES = 256 << 20
#: Digests of repeated payloads up to this number are broadcast.
BROADCAST_DIGESTS = 250_000
#: Pages carry no time, and two runs shall write equal records.
DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_ID = "<urn:page:%s>"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    refers_to: int | None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record: Record, digest: str) -> bytes:
    """One WARC record as a gzip member."""
    revisit = record.refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(record.payload)
    block = http if revisit else http + record.payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record.url) if record.url else "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_ID % record.page_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID % record.refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """The fields of one record; ``payload`` is None for a revisit, ``payload_bytes`` is of the full payload."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def number(name: str) -> int | None:
        found = re.search(r":(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != fields["WARC-Payload-Digest"].removeprefix("sha1:")):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload.decode("utf-8"),
    }


def write_archives(pages: DataFrame, folder: str, least_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``; the result is the index, a stored table."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = keyed.filter(F.octet_length("payload") >= least_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    repeated = small_side(staged(repeated.filter("n > 1").select("digest", "kept"), "warc-repeats"), BROADCAST_DIGESTS)
    planned = keyed.join(repeated, "digest", "left").select("page_id", "url", F.when(F.col("page_id") != F.col("kept"), F.col("kept")).alias("refers_to"), "payload")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        name, out, at = "", None, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                record = Record(row["page_id"], row["url"], row["payload"].encode("utf-8"), row["refers_to"])
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                digest = digest_of(record.payload)
                member = record_bytes(record, digest)
                out.write(member)
                rows.append((name, at, len(member), record.url, digest, record.page_id, "response" if record.refers_to is None else "revisit", record.refers_to, len(record.payload)))
                at += len(member)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    return staged(in_batches(planned, write, INDEX), "warc-index")


def ranges(entries: Iterable[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Entries (file, offset, length), sorted, joined to reads (file, first byte, end, [(offset, length)])."""
    name, first, end, parts = "", 0, 0, []
    for file, offset, length in entries:
        if parts and (file != name or offset - end > gap or offset + length - first > most):
            yield name, first, end, parts
            parts = []
        if not parts:
            name, first = file, offset
        end = offset + length
        parts.append((offset, length))
    if parts:
        yield name, first, end, parts


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given rows of the index, with their payloads (null for revisits)."""
    order = ["file", "offset"]
    # the rows are few bytes, by which their partitions would be joined; the work is what they make a task read
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        name, source = "", None
        entries = (e for b in batches for e in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for file, first, end, parts in ranges(entries):
            if file != name:
                name, source = file, store.open_input_file(file)
            data = source.read_at(end - first, first)
            rows = [parsed(data[o - first : o - first + n]) for o, n in parts]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]))

    return in_batches(wanted, read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    folder = full_uri(pages.sparkSession, fresh_path(pages.sparkSession, "warc"))
    return read_records(write_archives(pages, folder), folder)
