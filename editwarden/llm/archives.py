"""WARC records in ZIP archives, written and read by range (operator 2).

Writing: each task writes one archive of gzipped WARC records (one gzip member per record, so that each can be read alone). Records
fill stored archive members of about MEMBER_BYTES; ``indexes/index.cdxj`` (stored, too) gives member, offset and length of each.
Of records with equal payloads of at least SHORTEST bytes the one with the smallest id is the response; the others become revisits
of it. An archive counts only if its task's row is in the manifest, so what a lost task leaves behind is never read.

Reading: the end of central directory, its ZIP64 form where there is one, the central directory, the stored index, and
then single records are read by position. Nothing is unpacked to disk and no archive is read whole.

A null payload is empty; a null url leaves the header out. Rows without page_id are responses and nothing refers to them. Repeated rows
have one record each. Files go through pyarrow's file systems (local, HDFS, S3, GCS) below the folder ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwarden.llm.frames import ready, scratch_path, stored

SHORTEST = 100
MEMBER_BYTES = 8 << 20
READ_BYTES = 4 << 20  # records of one reading task lie within so many bytes of an archive
DATE = "1970-01-01T00:00:00Z"
INDEX = "indexes/index.cdxj"
# Fixed values of the ZIP format: signatures and the sizes of the fixed parts.
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END_64, END_64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _file_system(path: str):
    from pyarrow import fs
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _page(value) -> str:
    return f"<urn:x-page:{value}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, gzipped. A revisit holds the HTTP head only, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_page(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    body = head + payload
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_page(refers_to)}"]
        body = head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def _headers(block: bytes):
    head, _, rest = block.partition(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), rest


def parse_record(data: bytes):
    """(page_id, url, payload length, payload digest, type, refers_to, intact) of one gzipped record."""
    head, rest = _headers(zlib.decompress(data, 31))
    body = rest[:int(head["Content-Length"])]
    http, payload = _headers(body)
    number = {k: None if v == _page(None) else int(v[len(_page("")) - 1:-1]) for k, v in head.items() if v.startswith("<urn:x-page:")}
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http["Content-Length"])
    revisit = head["WARC-Type"] == "revisit"
    found = hashlib.sha256(payload).hexdigest()
    intact = len(rest) >= len(body) and (revisit or (found == digest and len(payload) == size))
    return (number["WARC-Record-ID"], head.get("WARC-Target-URI"), size if revisit else len(payload), digest if revisit else found,
            head["WARC-Type"], number.get("WARC-Refers-To"), intact)


class ArchiveWriter:
    """Puts records into the members of one archive; holds at most one member in memory."""

    def __init__(self, stream, member_bytes: int = MEMBER_BYTES):
        self.archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member_bytes, self.member, self.lines, self.count = member_bytes, io.BytesIO(), [], 0

    def _name(self):
        return f"archive/data-{self.count:06d}.warc.gz"

    def add(self, page_id, record: bytes):
        place = json.dumps({"filename": self._name(), "offset": self.member.tell(), "length": len(record)})
        self.lines.append(f"{page_id} {re.sub('[^0-9]', '', DATE)} {place}")
        self.member.write(record)
        if self.member.tell() >= self.member_bytes:
            self._flush()

    def _flush(self):
        if self.member.tell():
            self.archive.writestr(zipfile.ZipInfo(self._name()), self.member.getvalue())
            self.member, self.count = io.BytesIO(), self.count + 1

    def close(self):
        self._flush()
        self.archive.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.archive.close()


class ArchiveReader:
    """Directory of a ZIP file that is read by position only."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        tail_at = max(0, size - END_SIZE - 0xFFFF)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at + 3)  # the signature may occur in the comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        where = tail_at + at - LOCATOR_SIZE
        if where >= 0 and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
            locator = self.read(where, LOCATOR_SIZE)
            if locator[:4] == LOCATOR:
                end = self.read(struct.unpack_from("<Q", locator, 8)[0], END_64_SIZE)
                if end[:4] != END_64:
                    raise ValueError("the ZIP64 end of central directory is not where its locator says")
                count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members = dict(self._entries(self.read(start, length), count))

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{length} bytes at {at} are not all there")
        return data

    @staticmethod
    def _entries(directory: bytes, count: int):
        """(name, (method, stored size, position of the local header)) of each member."""
        at = 0
        for _ in range(count):
            if directory[at:at + 4] != ENTRY:
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", directory, at + 10)
            squeezed, plain, name, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
            header, = struct.unpack_from("<I", directory, at + 42)
            more = directory[at + ENTRY_SIZE + name:at + ENTRY_SIZE + name + extra]
            while len(more) >= 4:
                kind, size = struct.unpack_from("<HH", more)
                if kind == 1:  # ZIP64: only the fields that are full above, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", more, 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    squeezed = next(wide) if squeezed == 0xFFFFFFFF else squeezed
                    header = next(wide) if header == 0xFFFFFFFF else header
                more = more[4 + size:]
            yield directory[at + ENTRY_SIZE:at + ENTRY_SIZE + name].decode(), (method, squeezed, header)
            at += ENTRY_SIZE + name + extra + comment

    def place(self, name: str) -> tuple[int, int]:
        """(position, size) of a stored member's bytes in the archive."""
        method, size, header = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        local = self.read(header, LOCAL_SIZE)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        return header + LOCAL_SIZE + sum(struct.unpack_from("<HH", local, 26)), size

    def records(self):
        """(position, length) of each record that an index names."""
        for name in self.members:
            if posixpath.dirname(name) == "indexes" and name.endswith(".cdxj"):
                places: dict[str, int] = {}
                for line in self.read(*self.place(name)).decode().splitlines():
                    entry = json.loads(line.split(" ", 2)[2])
                    if entry["filename"] not in places:
                        places[entry["filename"]] = self.place(entry["filename"])[0]
                    yield places[entry["filename"]] + entry["offset"], entry["length"]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages (page_id, url, html) below ``folder``; the manifest (path, size, records) is on disk when this returns."""
    ready(pages.sparkSession)
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    narrow = rows.where(F.octet_length("html") >= SHORTEST).select("page_id", "digest").where("page_id IS NOT NULL")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    # which pages revisit which: narrow rows only, the payloads are shuffled once and by page
    revisits = narrow.join(first, "digest").where("page_id > first").select("page_id", F.col("digest"), "first").distinct()
    planned = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"), "digest", "first")

    def work(batches):
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        path, writer, many = f"{root}/{uuid.uuid4().hex}.wacz", None, 0
        for batch in batches:
            for page, url, html, hexed, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                if writer is None:
                    stream = system.open_output_stream(path)
                    writer = ArchiveWriter(stream)
                writer.add(page, record_bytes(page, url, html, hexed, to))
                many += 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.record_batch([pa.array([path]), pa.array([system.get_file_info(path).size]), pa.array([many])], names=["path", "size", "records"])

    return stored(planned.mapInArrow(work, "path string, size long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives of a manifest (path, size), each read by its own range."""
    ready(manifest.sparkSession)

    def places(batches):
        system, _ = _file_system(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                with system.open_input_file(path) as file:
                    found = list(ArchiveReader(file, size).records())
                for k in range(0, len(found), 10_000):
                    at, length = zip(*found[k:k + 10_000])
                    yield pa.record_batch([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(length, pa.int64())], names=["path", "at", "length"])

    def records(batches):
        system, _ = _file_system(folder)
        path, file = None, None
        for batch in batches:
            out = []
            for one, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length"))):
                if one != path:
                    if file is not None:
                        file.close()
                    path, file = one, system.open_input_file(one)
                file.seek(at)
                out.append(parse_record(file.read(length)))
            if out:
                columns = list(zip(*out))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _RECORD.split(", ")])
        if file is not None:
            file.close()

    index = manifest.select("path", "size").repartition("path").mapInArrow(places, "path string, at long, length long")
    near = index.withColumn("part", F.floor(F.col("at") / READ_BYTES)).repartition("path", "part").sortWithinPartitions("path", "at")
    return near.select("path", "at", "length").mapInArrow(records, _RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back; a record that is not as written stops the job."""
    spark: SparkSession = ready(pages.sparkSession)
    folder = scratch_path(spark, "warc")
    out = read_archives(write_archives(pages, folder), folder)
    return out.where(F.col("intact") | F.raise_error(F.lit("a record is not as it was written")).cast("boolean"))
