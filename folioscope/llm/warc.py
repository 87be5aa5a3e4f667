"""WARC records in ZIP archives, written, indexed and read back by byte ranges.

An archive is a ZIP file whose members are stored, not deflated: one WARC file
with a gzip member per record, and an index with a line per record (offset and
length within the WARC member). The reader parses the end record, the ZIP64
locator and end record and the central directory, finds the stored members
through their local headers, and fetches single records by range; nothing is
extracted. Archives always carry ZIP64 records, so their size has no limit.

Archives are written by the executors to the shared folder through Arrow's file
systems; each attempt of a task writes files of its own name, and only those
that a finished task reports are read. Identical payloads are found by their
SHA-1: the smallest page_id keeps the payload as a response, others become
revisit records without one.

Defined cases: a null html is an empty payload; a null url leaves the target
out; a null page_id is kept as such and is a response only where no page with
the payload has an id; repeated rows with the smallest page_id are all
responses; an empty table gives no archives and no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, new_path

ARCHIVE_BYTES = 64 << 20
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
#: The profile of revisit records with equal payloads (fixed value).
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- WARC records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One uncompressed WARC record; a revisit carries the HTTP header without the payload."""
    name = "none" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a WARC record and, for responses, its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "payload_bytes": length}


# ---------------------------------------------------------------- ZIP archives


class ZipWriter:
    """Stored members and ZIP64 records on a write-only stream."""

    def __init__(self, stream):
        self.stream, self.at, self.members = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, at = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), at))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            fields = struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
            self._put(CENTRAL + fields + raw + extra)
        length, end64, n = self.at - start, self.at, len(self.members)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF, 0))


class ZipReader:
    """The members of a ZIP file on a seekable stream, by its central directory; ZIP64 where present."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail_at = max(0, size - 65557)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<10xHII", tail[at : at + 20])
        locator = tail[at - 20 : at] if at >= 20 else b""
        if locator[:4] == LOCATOR64:
            end64 = struct.unpack("<Q", locator[8:16])[0]
            head = self.read(end64, 56)
            if head[:4] != END64:
                raise ValueError("broken ZIP64 end record")
            n, length, start = struct.unpack("<QQQ", head[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, p = self.read(start, length), 0
        for _ in range(n):
            if directory[p : p + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, packed, full, names, extras, comments = struct.unpack("<6xHIIIIHHH", directory[p + 4 : p + 34])
            at = struct.unpack("<I", directory[p + 42 : p + 46])[0]
            name = directory[p + 46 : p + 46 + names].decode()
            extra = directory[p + 46 + names : p + 46 + names + extras]
            packed, at = self._wide(extra, full, packed, at)
            self.members[name] = (method, packed, at)
            p += 46 + names + extras + comments

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, at: int) -> tuple[int, int]:
        """Sizes and place from the ZIP64 extra field, which holds only those that did not fit."""
        q = 0
        while q + 4 <= len(extra):
            tag, length = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                values = list(struct.unpack(f"<{length // 8}Q", extra[q + 4 : q + 4 + length // 8 * 8]))
                if full == 0xFFFFFFFF:
                    values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if at == 0xFFFFFFFF:
                    at = values.pop(0)
            q += 4 + length
        return packed, at

    def read(self, at: int, length: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(length)

    def range_of(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member's data."""
        method, length, at = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read(at, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        names, extras = struct.unpack("<HH", head[26:30])
        return at + 30 + names + extras, length


# ---------------------------------------------------------------- Spark side

_PAGES = "page_id long, url string, html string, first long, known boolean"


def _gz(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (with ``first``, the id that keeps an equal payload) as archives; returns a row per archive."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(base, recursive=True)
        data, index = bytearray(), []

        def flush():
            name = f"{base}/{uuid.uuid4().hex}.zip"
            with system.open_output_stream(name) as stream:
                archive = ZipWriter(stream)
                archive.add(DATA_MEMBER, bytes(data))
                archive.add(INDEX_MEMBER, "".join(index).encode())
                archive.close()
                size = archive.at
            row = pa.RecordBatch.from_pydict({"path": [name], "records": [len(index)], "bytes": [size]})
            data.clear()
            index.clear()
            return row

        for batch in batches:
            for page_id, url, html, first, known in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                revisit = bool(known) and page_id != first and first is not None
                raw = _gz(record(page_id, url, (html or "").encode(), first, revisit))
                entry = {"url": url, "offset": len(data), "length": len(raw), "filename": DATA_MEMBER}
                index.append(f"{page_id} {json.dumps(entry)}\n")
                data.extend(raw)
                if len(data) >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    columns = [x.split()[0] for x in _PAGES.split(", ")]
    return pages.select(*columns).mapInArrow(run, "path string, records long, bytes long")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives, each fetched by the range that the index gives and checked against its digest."""

    def page(urn: str | None) -> int | None:
        name = urn.rsplit(":", 1)[1].rstrip(">") if urn else "none"
        return None if name == "none" else int(name)

    def records(stream, size: int) -> Iterator[tuple]:
        archive = ZipReader(stream, size)
        base, _ = archive.range_of(DATA_MEMBER)
        at, length = archive.range_of(INDEX_MEMBER)
        for line in archive.read(at, length).decode().splitlines():
            entry = json.loads(line.split(" ", 1)[1])
            got = parse_record(zlib.decompress(archive.read(base + entry["offset"], entry["length"]), 31))
            fields, payload = got["fields"], got["payload"]
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = fields["WARC-Type"]
            if kind == "response" and (digest_of(payload) != digest or len(payload) != got["payload_bytes"]):
                raise ValueError("a payload does not match its digest")
            url = fields.get("WARC-Target-URI")
            yield (page(fields["WARC-Record-ID"]), None if url is None else entry["url"], got["payload_bytes"], digest, kind, page(fields.get("WARC-Refers-To")), payload if with_payload and kind == "response" else None)

    def run(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                rows = []
                with system.open_input_file(path) as stream:
                    for row in records(stream, size):
                        rows.append(row)
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # an archive a task: the manifest itself is a few small files
    return archives.select("path", "bytes").repartition(max(1, archives.count())).mapInArrow(run, RECORDS)


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html and, where a payload occurs more than once, the smallest page_id that has it."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("_sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    firsts = rows.groupBy("_sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # its files are read back, so Spark knows their size and broadcasts them only below its threshold
    firsts = materialize(firsts.select(F.col("_sha").alias("f_sha"), "first", F.lit(True).alias("known")), "warc-firsts")
    return rows.join(firsts, F.col("_sha") == F.col("f_sha"), "left").select("page_id", "url", "html", "first", "known")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into ZIP-packaged WARC archives and read the records back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_path(spark, "archives")
    archives = materialize(write_archives(with_first(pages), folder), "warc-manifest")
    return read_archives(archives, folder, with_payload=False).drop("payload", "url")
