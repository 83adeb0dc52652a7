"""WARC archives in seekable Zstandard bundles.

A bundle groups records into independent frames and ends with a seek table (a skippable frame whose footer gives
the number of frames), so that any frame can be found from the bundle's end. An index maps each record id to the
frame and to the record's offset and length within it; a lookup decompresses one frame.

Of records with equal payloads that with the largest page_id is stored as a response, the others as revisits of it
without their payload. Bundles are rows of a table in the shared folder, which Spark commits as a whole, so that a lost
executor leaves nothing half-written; `export` writes them out as files.

Defined results: a null html is an empty payload; a null page_id is less than any other; rows that repeat both the
largest page_id and its payload are each a response; very large payloads are written whole, in a frame of their own; CR, LF and other control characters in addresses are percent-encoded;
a null url is left out of its record; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ravelin.runtime import materialize, prepare

#: Bytes of records in a frame, compressed bytes in a bundle, level of compression, bytes of a table that is broadcast.
FRAME_BYTES, BUNDLE_BYTES, LEVEL, BROADCAST_BYTES = 256 << 10, 2 << 20, 3, 16 << 20
#: Payloads of at least so many bytes can be revisits; pages of one payload that meet in one task.
REVISIT_BYTES, KEY_ROWS = 0, 1 << 18
DATE = "2000-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit's block keeps the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place, and the place behind it."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    lo, size = head_end + 4, int(fields["content-length"])
    block = data[lo : lo + size]
    if data[lo + size : lo + size + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} breaks off")
    http_end = block.index(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:])}
    page = lambda name: None if (x := fields.get(name, "<urn:page:None>")[10:-1]) == "None" else int(x)
    revisit, body = fields["warc-type"] == "revisit", block[http_end + 4 :]
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (told != digest(body) or len(body) != int(http["content-length"])):
        raise ValueError(f"record at {at}: the payload isn't what was written")
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": told, "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"), "payload": None if revisit else body}, lo + size + 4


class BundleWriter:
    """Collects records into frames, and frames into a bundle."""

    def __init__(self):
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.buffer = bytearray()
        self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": len(self.buffer), "length": len(data)})
        self.buffer += data
        if len(self.buffer) >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.buffer:
            frame = self.zstd.compress(bytes(self.buffer))
            self.frames.append(frame)
            self.table.append((len(frame), len(self.buffer)))
            self.size += len(frame)
            self.buffer = bytearray()

    def finish(self) -> tuple[bytes, list[dict]]:
        """The bundle with its seek table, and its index; the writer is empty then."""
        self._end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        out = b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(entries)) + entries, self.index
        self.clear()
        return out


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of every frame, read from the bundle's end."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the bundle's end")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    first = len(bundle) - 9 - count * width
    for i in range(count):
        packed, size = struct.unpack_from("<II", bundle, first + i * width)
        out.append((at, packed, size))
        at += packed
    return out


def frame(bundle: bytes, number: int) -> bytes:
    """One frame, decompressed without its neighbours."""
    at, packed, size = seek_table(bundle)[number]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)


def lookup(bundle: bytes, entry: dict) -> dict:
    """The record that an index entry points to."""
    found, end = parse_record(frame(bundle, entry["frame"]), entry["offset"])
    if end - entry["offset"] != entry["length"]:
        raise ValueError("the index doesn't fit its bundle")
    return found


def _dealt(keyed: DataFrame, repeats: DataFrame) -> DataFrame:
    """The join by key, where the pages of a payload that very many share go to many tasks."""
    pieces = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    large = repeats.filter(F.col("n") > KEY_ROWS).select("key", pieces.alias("pieces"))  # one key in KEY_ROWS pages at most
    rows = keyed.join(F.broadcast(large), "key", "left").withColumn("piece", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("pieces", F.lit(1))).cast("int"))
    each = repeats.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n")
    return rows.join(each, ["key", "piece"], "left").drop("piece", "pieces")


def decisions(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, top, revisit); top: the largest page_id with that payload, where several have it."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("key", F.sha1("payload"))
    groups = keyed.filter(F.length("payload") >= least).groupBy("key").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    repeats = materialize(groups.filter("n > 1"), "repeats")
    small = repeats.count() * 64 <= BROADCAST_BYTES  # 40 characters, numbers and what a row costs
    joined = keyed.join(F.broadcast(repeats), "key", "left") if small else _dealt(keyed, repeats)
    grouped = F.col("top").isNotNull()
    return joined.select("page_id", "url", "payload", "top", (grouped & ~F.col("page_id").eqNullSafe(F.col("top"))).alias("revisit"))


_BUNDLES = "bundle_id string, bundle binary, n_records long, index array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def write_bundles(decided: DataFrame) -> DataFrame:
    """One row per bundle with its index; a bundle's id is its partition and number, the same in every attempt."""
    prepare(decided.sparkSession)
    schema = _parse_datatype_string(_BUNDLES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def bundle():
            nonlocal number
            data, index = writer.finish()
            number += 1
            return pa.RecordBatch.from_pylist([{"bundle_id": f"{part:06d}-{number:06d}", "bundle": data, "n_records": len(index), "index": index}], schema=arrow)

        for batch in batches:
            for page_id, url, payload, top, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(page_id, record(page_id, url, payload, top, revisit))
                if writer.size >= BUNDLE_BYTES:
                    yield bundle()
        if writer.index:
            yield bundle()

    return decided.select("page_id", "url", "payload", "top", "revisit").mapInArrow(run, schema)


def store(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages' archive as a table of bundles, at path or in the shared folder, and return it."""
    bundles = write_bundles(decisions(pages))
    if path is None:
        return materialize(bundles, "bundles")
    bundles.write.option("parquet.block.size", 32 << 20).parquet(path)
    return pages.sparkSession.read.schema(bundles.schema).parquet(path)


def index_of(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle_id, frame, offset, length) of every record."""
    return bundles.select("bundle_id", F.explode("index").alias("e")).select("e.page_id", "bundle_id", "e.frame", "e.offset", "e.length")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, a frame at a time."""
    prepare(bundles.sparkSession)
    schema = _parse_datatype_string(_RECORDS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for number in range(len(seek_table(data))):
                    records, at = frame(data, number), 0
                    rows = []
                    while at < len(records):
                        row, at = parse_record(records, at)
                        rows.append(row)
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return bundles.select("bundle").mapInArrow(run, schema)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the wanted page_ids, decompressing only their frames."""
    prepare(bundles.sparkSession)
    schema = _parse_datatype_string(_RECORDS)
    arrow = to_arrow_schema(schema)
    places = index_of(bundles).join(wanted.select("page_id").distinct(), "page_id").groupBy("bundle_id").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("entries"))  # a bundle's index bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, entries in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pylist([lookup(data, e) for e in entries], schema=arrow)

    return bundles.join(places, "bundle_id").select("bundle", "entries").mapInArrow(run, schema)


def export(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as a .warc.zst file in a folder that the executors share, by rename, so that attempts can repeat."""
    if "://" in folder:
        raise ValueError("export writes to a mounted folder")

    def save(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = f"{folder}/.{row.bundle_id}.{TaskContext.get().taskAttemptId()}"
            with open(part, "wb") as f:
                f.write(row.bundle)
            os.replace(part, f"{folder}/{row.bundle_id}.warc.zst")

    bundles.select("bundle_id", "bundle").foreachPartition(save)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all pages written as archives and read back."""
    bundles = store(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS top, upper(sha1(h)) AS x FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789ABCDEF', substr(x, i, 1))]), lambda s, t: s || t) AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, CAST(i * 5 + 1 AS BIGINT), 1) AS BIGINT) + 8 * CAST(substr(bits, CAST(i * 5 + 2 AS BIGINT), 1) AS BIGINT)
    + 4 * CAST(substr(bits, CAST(i * 5 + 3 AS BIGINT), 1) AS BIGINT) + 2 * CAST(substr(bits, CAST(i * 5 + 4 AS BIGINT), 1) AS BIGINT)
    + CAST(substr(bits, CAST(i * 5 + 5 AS BIGINT), 1) AS BIGINT), 1)), lambda s, t: s || t) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM b
"""
