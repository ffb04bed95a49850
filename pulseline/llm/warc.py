"""WARC archives as a Spark data source, in both directions.

Writing: one gzip member per record, whose header carries the member's length (the ``sl`` field of
the WARC guidelines), so that a reader can step over it. Each task writes files of bounded size
under names of its own; only the files of the attempts that Spark commits enter the manifest.

Reading: one partition per group of files. Of each record the headers come first; they are held
against the pushed-down predicates on record type and headers. The payload of a record that does
not pass, or whose payload is not asked for, is neither decompressed (if the member says how long
it is) nor decoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from pulseline.llm.common import shipped
from pulseline.session import work_dir

VERSION = b"WARC/1.0\r\n"
MANIFEST = "_manifest.json"
# What is decompressed at a time while the headers of a record are looked for.
HEAD = 2048

# Columns of the source, and the headers that those on text stand for.
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, headers map<string,string>, payload binary"
)
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    kind: str, record_id: str, target_uri: str | None, date: str, payload: bytes, refers_to: str | None
) -> bytes:
    """One record. A revisit has the HTTP headers of its response, with the full length, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if target_uri is not None:
        lines.append("WARC-Target-URI: " + target_uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _store(path: str):
    """The file system of a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", 64 << 20))
        self.level, self.gzip = int(options.get("level", 1)), options.get("gzip", "true") == "true"

    def write(self, batches) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in batches:
                names = batch.schema.names
                for row in zip(*[batch.column(names.index(c)) for c in (
                    "record_type", "record_id", "target_uri", "date", "payload", "refers_to"
                )]):
                    kind, record_id, uri, date, payload, refers_to = (x.as_py() for x in row)
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
                        out, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                        files.append([name, 0])
                    raw = record(kind, record_id, uri, date, payload or b"", refers_to)
                    raw = member(raw, self.level) if self.gzip else raw
                    out.write(raw)
                    size += len(raw)
                    files[-1][1] = size
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        """The manifest names what counts; files of lost or doubled attempts are not in it."""
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, folder = _store(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                store.delete_file(f"{folder}/{name}")


@dataclass
class Files(InputPartition):
    paths: list


class Bytes:
    """A forward reader over an open file, which can look at what comes and step over it."""

    def __init__(self, file, block: int = 1 << 18):
        self.file, self.block, self.buffer, self.at = file, block, b"", 0

    def have(self, n: int) -> bool:
        """Make the next ``n`` bytes available; False if the file ends before."""
        missing = n - (len(self.buffer) - self.at)
        if missing > 0:
            more = self.file.read(max(missing, self.block))
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return len(self.buffer) >= self.at + n

    def peek(self, n: int) -> bytes:
        self.have(n)
        return self.buffer[self.at : self.at + n]

    def skip(self, n: int) -> None:
        inside = len(self.buffer) - self.at
        if n <= inside:
            self.at += n
        else:
            self.file.seek(n - inside, 1)
            self.buffer, self.at = b"", 0


class Plain:
    """The content of an uncompressed record."""

    def __init__(self, source: Bytes):
        self.source, self.used = source, 0

    def upto(self, n: int) -> bytes:
        return self.source.peek(n)

    def close(self, length: int) -> None:
        self.source.skip(length)


class Packed:
    """The content of one gzip member, decompressed as far as it is asked for."""

    def __init__(self, source: Bytes):
        self.source, self.length = source, None
        head = source.peek(12)
        extra = struct.unpack("<H", head[10:12])[0] if head[3] & 4 else 0
        fields = source.peek(12 + extra)[12:]
        while len(fields) >= 4:
            size = struct.unpack("<H", fields[2:4])[0]
            if fields[:2] == b"sl" and size == 8:
                self.length = struct.unpack("<I", fields[4:8])[0] or None
            fields = fields[4 + size :]
        self.unpacker, self.content, self.taken = zlib.decompressobj(31), bytearray(), 0
        self.rest = b""

    def upto(self, n: int) -> bytes:
        while len(self.content) < n and not self.unpacker.eof:
            if not self.rest:
                step = HEAD if n <= 4 * HEAD else 1 << 18
                if self.length is not None:
                    step = min(step, self.length - self.taken)
                self.rest = self.source.peek(self.taken + step)[self.taken :]
                if not self.rest:
                    break
                self.taken += len(self.rest)
            self.content += self.unpacker.decompress(self.rest, n - len(self.content))
            self.rest = self.unpacker.unconsumed_tail
        return bytes(self.content[:n])

    def close(self, length: int) -> None:
        """Step over the member; without its length that takes decompressing it."""
        if self.length is None:
            while not self.unpacker.eof:
                self.content.clear()
                if not self.upto(1 << 18):
                    break
            self.length = self.taken - len(self.unpacker.unused_data)
        self.source.skip(self.length)


def _headers(content) -> tuple[dict, int] | None:
    """Headers of the record that begins here, names in lower case, and the length of their part."""
    want = HEAD
    while True:
        seen = content.upto(want)
        end = seen.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(seen) < want:
            return None
        want *= 4
    lines = seen[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, end + 4


def _http(headers: dict, content, start: int, length: int) -> tuple[int, int]:
    """Where the payload of a record's block begins, and how long the full payload is."""
    if not headers.get("content-type", "").startswith("application/http"):
        return start, length
    want = start + min(HEAD, length)
    while True:
        block = content.upto(want)[start:]
        end = block.find(b"\r\n\r\n")
        if end >= 0 or want >= start + length:
            break
        want = start + min(length, 4 * (want - start))
    if end < 0:
        return start, length
    full = length - end - 4
    for line in block[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            full = int(value)
    return start + end + 4, full


def records(file, wanted, fields: list[str]) -> Iterator[tuple]:
    """The records of an open file whose headers pass ``wanted``, as tuples of ``fields``."""
    source = Bytes(file)
    while source.have(1):
        lead = source.peek(2)
        if lead in (b"\r\n", b"\n\n") or lead[:1] == b"\n":
            source.skip(len(lead) if lead == b"\r\n" else 1)
            continue
        content = Packed(source) if lead == b"\x1f\x8b" else Plain(source)
        parsed = _headers(content)
        if parsed is None:
            raise ValueError("the archive ends inside the headers of a record")
        headers, start = parsed
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            row = {c: headers.get(h) for c, h in HEADER_OF.items() if c in fields}
            if row.get("payload_digest"):
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            if "headers" in fields:
                row["headers"] = headers
            if "payload" in fields or "payload_bytes" in fields:
                first, row["payload_bytes"] = _http(headers, content, start, length)
                if "payload" in fields:
                    row["payload"] = content.upto(start + length)[first:]
                    if len(row["payload"]) < start + length - first:
                        raise ValueError("the archive ends inside a record")
            yield tuple(row.get(c) for c in fields)
        content.close(start + length)


class Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.path, self.fields = options["path"], fields
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.allowed: dict[str, set | None] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality, IN and IS NOT NULL on the columns that are headers, but for the digest, whose header has a prefix."""
        for f in filters:
            path = getattr(f, "attribute", ())
            header = HEADER_OF.get(path[0]) if len(path) == 1 else None
            if header is None or header == "warc-payload-digest":
                yield f
            elif isinstance(f, EqualTo):
                self._allow(header, {f.value})
            elif isinstance(f, In):
                self._allow(header, set(f.value))
            elif isinstance(f, IsNotNull):
                self.allowed.setdefault(header, None)
            else:
                yield f

    def _allow(self, header: str, values: set) -> None:
        before = self.allowed.get(header)
        self.allowed[header] = values if before is None else before & values

    def partitions(self) -> list[Files]:
        """Files of the manifest (or of the folder, if others wrote it), in groups of about equal size."""
        from pyarrow import fs

        store, folder = _store(self.path)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.File:
            found = [("", info.size)]
        elif store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
                found = [(f"/{name}", size) for name, size in json.loads(f.read())]
        else:
            inside = store.get_file_info(fs.FileSelector(folder, recursive=True))
            found = sorted(
                (x.path[len(folder) :], x.size) for x in inside if x.path.endswith((".warc", ".warc.gz"))
            )
        groups, size = [], self.partition_bytes
        for name, n in found:
            if size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files):
        store, folder = _store(self.path)

        def wanted(headers: dict) -> bool:
            return all(h in headers and (v is None or headers[h] in v) for h, v in self.allowed.items())

        for name in partition.paths:
            with store.open_input_file(f"{folder}{name}") as file:
                yield from records(file, wanted, self.fields)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; a schema of fewer columns reads less."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark push predicates into Python sources."""
    shipped(__name__)
    spark.dataSource.register(WarcSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc")
    if columns:
        types = dict(x.split(" ", 1) for x in SCHEMA.replace("map<string,string>", "map<string;string>").split(", "))
        reader = reader.schema(", ".join(f"{c} {types[c].replace(';', ',')}" for c in columns))
    return reader.load(path)


def write_pages(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write a record per page; of equal payloads the largest ``page_id`` is stored, the others refer to it.

    Payloads under ``least_bytes`` are always stored. A NULL html is an empty payload. Rows that
    share the largest id and the payload are all stored; a page without id refers to one that has
    an id, and is stored if there is none. Payloads are compared by SHA-256 and length.
    """
    register(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    stored = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("stored_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = F.col("stored_id").isNotNull() & ~F.col("stored_id").eqNullSafe(F.col("page_id"))
    out = rows.join(stored, ["digest", "size"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name("page_id"), F.lit("<urn:page:none>")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.col("html").cast("binary").alias("payload"),
        F.when(revisit, name("stored_id")).alias("refers_to"),
    )
    out.write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives into the shared folder and read the headers of all records back."""
    path = work_dir(pages.sparkSession, "warc")
    write_pages(pages, path, least_bytes)
    back = read_warc(
        pages.sparkSession, path, ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"]
    )
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    return back.select(
        whole("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        whole("refers_to").alias("refers_to"),
    )
