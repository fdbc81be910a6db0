"""Web archives: a writer of gzip members, and a reader that splits archives by bytes.

The reader's tasks scan ranges of a file for gzip's magic bytes.  A candidate
counts only if what it inflates to begins like a record's header; a task owns
the records that start inside its range and reads on past its end for the last.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import new_path

LEAST_PAYLOAD = 100
SPLIT_BYTES = 16 << 20
#: Parts over which the rows of one digest are spread; rows that are too small for a revisit don't meet at all.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
RECORDS = ("path string, at long, record_type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, payload binary")


def with_record_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to) of (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    large = F.col("payload_bytes") >= LEAST_PAYLOAD
    first = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    small = rows.where(~large).withColumn("first_id", F.lit(None).cast("long"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    both = rows.where(large).join(first, ["payload_digest", "salt"], "left").select(*small.columns).union(small)
    return both.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>")
    head.append(f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}")
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(records: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write with_record_types() rows as one archive a partition; returns (path, bytes) of each.

    A task writes under a name of its own and moves the file when it is whole,
    so a repeated task replaces what a lost one left.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, out, size = f"{name}.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                data = record_bytes(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"])
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], ["path", "size"])

    columns = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return [(r.path, r["size"]) for r in records.select(*columns).mapInArrow(run, "path string, size long").collect()]


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields.get("Content-Length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    bare = lambda s: s.strip("<>") if s else None
    told = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
    if fields.get("WARC-Type") == "revisit":
        size = re.search(rb"content-length:\s*(\d+)", http, re.I)
        n, payload = int(size[1]) if size else None, None
    else:
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if told and told != digest:
            raise ValueError(f"payload of {fields.get('WARC-Record-ID')} doesn't match its digest")
        told = digest
    return {"record_type": fields.get("WARC-Type"), "record_id": bare(fields.get("WARC-Record-ID")), "target_uri": fields.get("WARC-Target-URI"),
            "refers_to": bare(fields.get("WARC-Refers-To")), "payload_digest": told, "payload_bytes": n, "payload": payload}


def members(file, size: int, start: int, end: int, step: int = 1 << 20):
    """(offset, inflated bytes) of the members that start in [start, end) of a random-access file."""
    at, window, base = start, b"", start

    def ensure(upto: int) -> None:
        nonlocal window
        while base + len(window) < min(upto, size):
            more = file.read_at(min(step, size - base - len(window)), base + len(window))
            if not more:
                return
            window += more

    while at < end:
        if at - base > 4 * step:
            window, base = window[at - base :], at
        ensure(at + step)
        k = window.find(MAGIC, at - base)
        if k < 0:
            seen = base + len(window)
            if seen >= size or seen >= end + 2:
                return
            at = seen - 2
            window, base = window[at - base :], at
            continue
        at = base + k
        if at >= end:
            return
        ensure(at + 4096)
        try:
            if not zlib.decompressobj(31).decompress(window[k : k + 4096], 64).startswith(b"WARC/1."):
                raise zlib.error
            unpack, got, fed = zlib.decompressobj(31), [], at
            while not unpack.eof:
                ensure(fed + step)
                piece = window[fed - base : fed - base + step]
                if not piece:
                    raise zlib.error
                got.append(unpack.decompress(piece))
                fed += len(piece)
        except zlib.error:
            at += 1
            continue
        yield at, b"".join(got)
        at = fed - len(unpack.unused_data)


def read_archives(spark: SparkSession, folder: str, files: list[tuple[str, int]], payloads: bool = False, split: int = SPLIT_BYTES) -> DataFrame:
    """RECORDS of archives given by (path, bytes), read in ranges of ``split`` bytes."""
    ranges = [(p, n, a, min(n, a + split)) for p, n in files for a in range(0, n, split)]
    plan = spark.createDataFrame(ranges, "path string, size long, start long, stop long")
    plan = plan.repartition(max(1, min(len(ranges), 100_000)))

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with store.open_input_file(r["path"]) as file:
                    for at, data in members(file, r["size"], r["start"], r["stop"]):
                        rows.append({"path": r["path"], "at": at} | parse_record(data))
                        if not payloads:
                            rows[-1]["payload"] = None
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    text, whole = pa.string(), pa.int64()
    schema = pa.schema([("path", text), ("at", whole), ("record_type", text), ("record_id", text), ("target_uri", text), ("refers_to", text),
        ("payload_digest", text), ("payload_bytes", whole), ("payload", pa.binary())])
    return plan.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every row of (page_id, url, html) to archives and read them back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to,
    url).  Payloads are the html in UTF-8, empty for a null.  Of equal payloads
    of at least 100 bytes the one with the smallest page_id is a response and the
    others revisit it; smaller ones are all responses.  Rows that repeat that
    smallest page_id are responses too.  A null page_id counts as the largest,
    and a null url is left out of the record.  An empty table gives an empty
    table.  ``folder`` is one that all executors share.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    files = write_archives(with_record_types(pages), folder)
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast("long")
    return read_archives(spark, folder, files).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
