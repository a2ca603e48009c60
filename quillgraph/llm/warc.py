"""WARC archives: a writer with revisit records and a splittable reader.

Writing: equal payloads of at least ``MIN_REVISIT`` bytes are stored once, as the response
of the smallest page; the others are revisits that refer to it. Each task writes its
records as single gzip members to files of its own in the shared folder, under names no
other attempt uses, and returns their paths; only the paths of successful attempts reach
the manifest.

Reading: a file is cut into byte ranges. A task scans its range for the gzip magic,
validates each candidate by decoding the member's first bytes up to a WARC header, and
owns the records that start inside, reading past the range's end where the last one ends.
No index and no listing on the driver is needed, and no range depends on another.

Files are reached through ``pyarrow.fs`` (local, HDFS, S3, GCS by the path's scheme).

Edge cases: a null html is an empty payload; a null url is left out; a null page id comes
back as null; rows that repeat a page id are all written; an empty table gives no file and
no row; a payload holding gzip magic is not mistaken, as members are decoded; a member of
any length is decoded in pieces.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_dir, written

MIN_REVISIT, FILE_BYTES, SPLIT_BYTES, PIECE = 100, 64 << 20, 8 << 20, 1 << 18
MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response, or a revisit if it refers to another page."""
    kind = "response" if refers_to is None else "revisit"
    body = _HTTP + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        done, out, path, size = [], None, "", 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    path, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                member = record(*row)
                out.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            names=["path", "size"],
        )

    return write


def write_archives(pages: DataFrame) -> tuple[str, DataFrame]:
    """Write a record a row of ``pages``; the folder's URI and the manifest (path, size)."""
    folder = fresh_dir(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    first = (
        rows.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    rows = rows.join(first, "digest", "left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return folder, written(rows.mapInArrow(_writer(folder), "path string, size long"), "manifest")


def parse(data: bytes) -> dict:
    """A record's headers, and its payload under ``payload``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    body = rest[: int(fields["Content-Length"])]
    fields["payload"] = body.partition(b"\r\n\r\n")[2]
    return fields


def _member(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The WARC record whose gzip member starts at ``at``, and where that ends; or None."""
    z, out, pos, seen = zlib.decompressobj(31), [], at, False
    try:
        while not z.eof:
            piece = f.read_at(min(PIECE, size - pos), pos)
            if not piece:
                return None
            pos += len(piece)
            out.append(z.decompress(piece))
            if not seen:
                seen = b"".join(out)[:7]
                if len(seen) == 7 and seen != b"WARC/1.":
                    return None
                seen = len(seen) == 7
    except zlib.error:
        return None
    return (b"".join(out), pos - len(z.unused_data)) if seen else None


def records(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """The records that start in the bytes [start, end) of an open file."""
    pos = start
    while pos < end:
        piece = f.read_at(min(PIECE, end + len(MAGIC) - 1 - pos, size - pos), pos)
        at = piece.find(MAGIC)
        if at < 0:
            if pos + len(piece) >= min(end + len(MAGIC) - 1, size):
                return
            pos += max(len(piece) - len(MAGIC) + 1, 1)
            continue
        pos += at
        if pos >= end:
            return
        found = _member(f, pos, size)
        if found is None:
            pos += 1
            continue
        yield found[0]
        pos = found[1]


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        number = lambda x: None if x is None or x.endswith(":null>") else int(x[10:-1])
        for batch in batches:
            for path, start, end, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "end", "size"))):
                cols: list[list] = [[] for _ in range(7)]
                held = 0
                with fs.open_input_file(path) as f:
                    for data in records(f, start, end, size):
                        r = parse(data)
                        new = r["WARC-Type"] == "response"
                        n = len(r["payload"]) if new else int(r["WARC-Payload-Bytes"])
                        digest = hashlib.sha256(r["payload"]).hexdigest() if new else r["WARC-Payload-Digest"][7:]
                        url = r.get("WARC-Target-URI")
                        values = (
                            number(r["WARC-Record-ID"]), url and unquote(url), n, digest, r["WARC-Type"],
                            number(r.get("WARC-Refers-To")), r["payload"] if new else None,
                        )
                        for c, v in zip(cols, values):
                            c.append(v)
                        held += len(r["payload"])
                        if held >= FILE_BYTES // 8:
                            yield _batch(cols)
                            cols, held = [[] for _ in range(7)], 0
                yield _batch(cols)

    return read


_FIELDS = [
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
]


def _batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])


def read_archives(folder: str, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (of what was read), record_type, refers_to,
    payload (null for a revisit): a row a record of the files in ``manifest (path, size)``."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    splits = manifest.where("size > 0").select("path", "size", F.explode(starts).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, "size"))
    spark = manifest.sparkSession
    splits = splits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return splits.mapInArrow(
        _reader(folder),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def resolved(rows: DataFrame) -> DataFrame:
    """Records with the payload that a revisit refers to filled in."""
    base = rows.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload").alias("_full")
    ).dropDuplicates(["refers_to"])
    return rows.join(base, "refers_to", "left").select(
        *[c for c in rows.columns if c != "payload"], F.coalesce("payload", "_full").alias("payload")
    )


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(*write_archives(pages)).drop("payload", "url")
