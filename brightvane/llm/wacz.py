"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP file with stored members: `archive/data.warc.gz`, the records end
to end, each compressed for itself, and `indexes/index.cdxj`, a line per record with
its offset and length within the archive member. The reader finds the end record (and
the ZIP64 one), walks the central directory, resolves a stored member to a byte
range of the file, and then reads single records by range.

Packages are files of the shared folder, read and written through Arrow's file
systems (local, HDFS, object stores). A task writes under names of its own attempt;
the table of packages, which Spark commits, lists only those of tasks that ended
well, so what a lost task left behind is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dealt, materialise, shared_folder, store, task_file, write_file

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 4 << 20
#: Payloads under so many bytes are never revisits.
REVISIT_BYTES = 100
_BIG = 0xFFFFFFFF


class BytesSource:
    def __init__(self, data: bytes):
        self._data, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        return bytes(self._data[offset : offset + length])


class FileSource:
    """A file in any store that Arrow reads, by ranges."""

    def __init__(self, uri: str):
        where, path = store(uri)
        self._file = where.open_input_file(path)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc32: int
    packed: int
    size: int
    header: int


class ZipReader:
    """The directory of a ZIP file and range reads within its stored members."""

    def __init__(self, source):
        self._source = source
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        size = self._source.size
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self._source.read(tail_at, size - tail_at)
        spot = tail.rfind(b"PK\x05\x06")
        while spot >= 0 and spot + 22 + int.from_bytes(tail[spot + 20 : spot + 22], "little") != len(tail):
            spot = tail.rfind(b"PK\x05\x06", 0, spot)
        if spot < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, spot + 10)
        if count == 0xFFFF or length == _BIG or start == _BIG:
            signature, _, at, _ = struct.unpack("<IIQI", self._source.read(tail_at + spot - 20, 20))
            if signature != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            end64 = self._source.read(at, 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at = self._source.read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            crc, packed, plain, n, extra, comment = struct.unpack_from("<IIIHHH", directory, at + 16)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            fields = directory[at + 46 + n : at + 46 + n + extra]
            wide = self._zip64(fields)
            if plain == _BIG:
                plain, wide = int.from_bytes(wide[:8], "little"), wide[8:]
            if packed == _BIG:
                packed, wide = int.from_bytes(wide[:8], "little"), wide[8:]
            if header == _BIG:
                header = int.from_bytes(wide[:8], "little")
            yield Member(name, method, crc, packed, plain, header)
            at += 46 + n + extra + comment

    @staticmethod
    def _zip64(fields: bytes) -> bytes:
        at = 0
        while at + 4 <= len(fields):
            kind, n = struct.unpack_from("<HH", fields, at)
            if kind == 1:
                return fields[at + 4 : at + 4 + n]
            at += 4 + n
        return b""

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin in the file."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; range reads need a stored member")
        head = self._source.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        member = self.members[name]
        length = member.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > member.size:
            raise ValueError("range outside the member")
        return self._source.read(self.start(name) + offset, length)


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 structures where sizes need them, or always if asked."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        title, crc, at = name.encode(), zlib.crc32(data), len(out)
        wide = zip64 or len(data) >= _BIG or at >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        sizes = (_BIG, _BIG) if wide else (len(data), len(data))
        version = 45 if wide else 20
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", version, 0x800, 0, 0, 33, crc, *sizes, len(title), len(extra)) + title + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", version, version, 0x800, 0, 0, 33, crc, *sizes, len(title), len(extra), 0, 0, 0, 0, _BIG if wide else at) + title + extra
    start, count = len(out), len(members)
    out += directory
    if zip64 or count >= 0xFFFF or start >= _BIG or len(directory) >= _BIG:
        at = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), start)
        out += struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
        out += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, _BIG, _BIG, 0)
    else:
        out += struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, count, count, len(directory), start, 0)
    return bytes(out)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of another page without it."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of the record at the start of data."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    body = data[end + 4 : end + 4 + int(headers["content-length"])]
    if len(body) != int(headers["content-length"]):
        raise ValueError("record cut short")
    return headers, body


def package(records: list[tuple[int | None, bytes]]) -> bytes:
    """A package of (page_id, compressed record)."""
    at, lines = 0, []
    for page_id, data in records:
        lines.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}))
        at += len(data)
    return write_zip([(ARCHIVE, b"".join(d for _, d in records)), (INDEX, "\n".join(lines).encode())])


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a package, each read by its own range. Raises if the archive or its index does not have the directory's checksum."""
    reader = ZipReader(source)
    member, base = reader.members[ARCHIVE], reader.start(ARCHIVE)
    index = reader.read(INDEX)
    if zlib.crc32(index) != reader.members[INDEX].crc32:
        raise ValueError("damaged index")
    check = at = 0
    for line in index.splitlines():
        entry = json.loads(line)
        if entry["offset"] != at or at + entry["length"] > member.size:
            raise ValueError("the index does not cover the archive")
        data = source.read(base + at, entry["length"])
        check, at = zlib.crc32(data, check), at + len(data)
        yield parse_record(gzip.decompress(data))
    if at != member.size or check != member.crc32:
        raise ValueError("damaged archive")


def _payload(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(bytearray()))


def decide_revisits(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another: equal payloads of REVISIT_BYTES or more, smallest id first."""
    payload = _payload(text_col)
    narrow = pages.select(F.col(id_col).cast("long").alias("_id"), F.octet_length(payload).alias("_n"), F.unhex(F.sha2(payload, 256)).alias("_d")).where(F.col("_n") >= REVISIT_BYTES)
    narrow = materialise(narrow.select("_id", "_d"), "payloads")
    salts = 32
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")
    groups = narrow.groupBy("_d").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_d", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    # the digest of a very common payload is dealt over `salts` keys
    return narrow.withColumn("_salt", salt).join(groups, ["_d", "_salt"]).where("_id <> _first").select("_id", F.lower(F.hex("_d")).alias("_digest"), F.col("_first").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", most: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all pages to packages in `folder`, a URI that all executors reach; gives a row (path, records, bytes) for each.

    To be evaluated once (`materialise` it): each evaluation writes packages of its
    own. A null or empty payload is an empty record. A null id is kept (never a
    revisit, never referred to). Where an id is repeated, its payloads are told apart by
    digest, so none is lost; copies under the smallest id are all responses. Bytes that
    are not UTF-8 are kept as they are. Columns other than the three are ignored.
    """
    again = decide_revisits(pages, id_col, text_col).distinct()
    url = F.expr(f"make_valid_utf8(cast(`{url_col}` as string))")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), _payload(text_col).alias("payload"), F.sha2(_payload(text_col), 256).alias("digest"))
    rows = rows.join(again, (rows["page_id"] == again["_id"]) & (rows["digest"] == again["_digest"]), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            name, data = task_file(folder, number, "wacz"), package(held)
            write_file(name, data)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])
            held, size, number = [], 0, number + 1
            return done

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.compress(warc_record(page_id, url, bytes(payload), digest, refers), 1, mtime=0)
                held.append((page_id, data))
                size += len(data)
                if size >= most:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(build, "path string, records long, bytes long")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the packages whose `path` is listed, read by ranges; a response's payload is checked against its digest and length."""

    def number(value: str | None) -> int | None:
        digits = (value or "").rpartition(":")[2].rstrip(">")
        return int(digits) if digits else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = FileSource(path)
                rows: list[tuple] = []
                for headers, body in records(source):
                    digest, length = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"])
                    if headers["warc-type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"damaged payload of {headers['warc-record-id']}")
                    rows.append((number(headers["warc-record-id"]), length, digest, headers["warc-type"], number(headers.get("warc-refers-to"))))
                source.close()
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return packages.select("path").mapInArrow(scan, READ_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Writes all pages to packages in the shared folder and reads the records back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    written = materialise(write_packages(pages, folder, id_col, url_col, text_col), "packages")
    return read_packages(dealt(written, "path"))
