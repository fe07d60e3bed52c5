"""Seekable Zstandard WARC bundles.

A bundle is a sequence of independent Zstandard frames, each a run of whole
WARC records of about ``FRAME_BYTES``, followed by a seek table in a skippable
frame (compressed and decompressed size of every frame; the layout of the
public seekable format).  ``write`` returns one index row per record with its
bundle, frame and offset in the decompressed frame, so one record is read with
one range read; ``read`` walks whole bundles in parallel, ``fetch`` single
records.

Payloads are the UTF-8 bytes of a text column.  Of equal payloads of at least
``REVISIT_BYTES`` bytes the row with the largest id is a response record, the
others are revisit records without payload that refer to it.  Who refers to
whom is settled on (id, digest) rows alone, so neither payloads nor a large
group of equal ones meet in a task.

Defined results: a null text is an empty payload; a row without id is a
response; rows with equal id and payload are all responses if the id is the
largest of the payload; repeated rows are kept; extra columns are ignored; an
empty table gives no bundles, index rows or records.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import files
from .runtime import materialize, prepare, scratch_path, text_or_empty

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
REVISIT_BYTES = 0
DATE = "2026-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, id long, path string, frame int, frame_start long, frame_bytes long, offset long, length long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:record:{'none' if key is None else key}>"


def _line(value: str) -> str:
    """A header value without line ends."""
    return "".join(" " if c in "\r\n" else c for c in value)


def build_record(key: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` without the payload."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)),
            ("WARC-Date", DATE), ("WARC-Target-URI", _line(uri or "")),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Payload-Length", str(len(payload))),
            ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    if refers_to is not None:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", record_id(refers_to)))
    head.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    return head, data[body:stop], stop + 4


class BundleWriter:
    def __init__(self, uri: str):
        self.uri, self.out = uri, files.create(uri)
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.start = 0
        self.held: list[tuple[str, int | None, bytes]] = []
        self.bytes = 0

    def add(self, key: int | None, record: bytes) -> list[tuple]:
        self.held.append((record_id(key), key, record))
        self.bytes += len(record)
        return self.flush() if self.bytes >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        """Closes the frame under way; its index rows."""
        if not self.held:
            return []
        raw = b"".join(r for _, _, r in self.held)
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        rows, offset = [], 0
        for rid, key, r in self.held:
            rows.append((rid, key, self.uri, len(self.sizes), self.start, len(frame), offset, len(r)))
            offset += len(r)
        self.sizes.append((len(frame), len(raw)))
        self.start += len(frame)
        self.held, self.bytes = [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()
        return rows


def frames(uri: str):
    """Decompressed frames of a bundle, by its seek table."""
    with files.read(uri) as f:
        size = f.size()
        count, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"no seek table: {uri}")
        table = f.read_at(8 * count, size - 9 - 8 * count)
        start = 0
        for c, d in struct.iter_unpack("<II", table):
            yield zstandard.ZstdDecompressor().decompress(f.read_at(c, start), max_output_size=d)
            start += c


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def write(pages: DataFrame, key: str = "page_id", uri: str = "url", text: str = "html",
          folder: str | None = None) -> DataFrame:
    """Writes the bundles and returns the record index (columns of ``INDEX``)."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"),
                        text_or_empty(pages[text]).alias("text"))
    # SHA-256 and length stand for the payload.
    payload = F.sha2(F.col("text").cast("binary"), 256)
    narrow = materialize(rows.select("id", payload.alias("same"), F.octet_length("text").alias("n"))
                         .filter((F.col("n") >= REVISIT_BYTES) & F.col("id").isNotNull()), "payloads")
    groups = (narrow.groupBy("same", "n").agg(F.max("id").alias("last"), F.min("id").alias("first"))
              .filter("first < last").drop("first"))
    refers = (narrow.join(groups, ["same", "n"]).filter("id < last")
              .select(F.col("id").alias("id__"), F.col("same").alias("same__"), "last").distinct())
    decided = rows.join(refers, (rows["id"] == F.col("id__")) & (payload == F.col("same__")), "left").select(
        "id", "uri", "text", "last")

    def run(batches):
        bundle = None
        for b in batches:
            out = []
            for i, u, t, last in zip(*(c.to_pylist() for c in b.columns)):
                if bundle is None:
                    bundle = BundleWriter(files.fresh(folder, ".warc.zst"))
                out += bundle.add(i, build_record(i, u, t.encode(), last))
                if bundle.start >= BUNDLE_BYTES:
                    out += bundle.close()
                    bundle = None
            if out:
                yield _batch(out)
        if bundle is not None:
            out = bundle.close()
            if out:
                yield _batch(out)

    return materialize(decided.mapInArrow(run, INDEX), "warc_index")


_RECORD = ("id long, record_type string, target_uri string, payload binary, payload_bytes long, "
           "payload_digest string, refers_to long")


def _parsed(records) -> pa.RecordBatch:
    def key(value):
        found = value[len("<urn:record:"):-1] if value else "none"
        return None if found == "none" else int(found)

    rows = []
    for head, payload in records:
        kind = head["WARC-Type"]
        claimed = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != claimed:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        rows.append((key(head["WARC-Record-ID"]), kind, head["WARC-Target-URI"],
                     payload if kind == "response" else None,
                     len(payload) if kind == "response" else int(head["X-Payload-Length"]), claimed,
                     key(head.get("WARC-Refers-To"))))
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read(bundles: DataFrame) -> DataFrame:
    """All records of the bundles named in column ``path``, read whole."""
    parts = max(int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                for data in frames(uri):
                    found, at = [], 0
                    while at < len(data):
                        head, payload, at = parse_record(data, at)
                        found.append((head, payload))
                    yield _parsed(found)

    # Not by the column itself: a repartition by what the distinct has hashed by
    # would be dropped, and one coalesced task would read all bundles.
    return bundles.select("path").distinct().repartition(parts, F.xxhash64("path")).mapInArrow(run, _RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of some index rows, each by one range read of its frame."""
    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            if rows:
                found = []
                for r in rows:
                    with files.read(r["path"]) as f:
                        raw = zstandard.ZstdDecompressor().decompress(f.read_at(r["frame_bytes"], r["frame_start"]))
                    head, payload, _ = parse_record(raw[r["offset"]:r["offset"] + r["length"]])
                    found.append((head, payload))
                yield _parsed(found)

    return index.mapInArrow(run, _RECORD)


def digests(pages: DataFrame) -> DataFrame:
    return read(write(pages)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
                                     "record_type", "refers_to")


#: DuckDB has no base32: the hex digest is regrouped into five-bit digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
     b AS (SELECT page_id, p.html, last, list_aggregate(list_transform(string_split(h, ''),
                  lambda c: right(bin(strpos('0123456789abcdef', c) - 1 + 16), 4)), 'string_agg', '') AS bits
           FROM p JOIN g USING (html))
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1'
                    THEN 1 << (4 - j) ELSE 0 END))::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""
