"""WARC archives as a PySpark Python data source.

Reading plans one partition per file, or per block of a file that has an index of block starts
beside it.  Predicates on record type and headers are pushed down: each record's header block is
parsed first, and the payload of a record that is not wanted is neither inflated nor decoded.
Writing gives one file a task, which begins with a warcinfo record, records as gzip members that
tell their own length, and a manifest for each commit.  Files of our own writer are read only if a
manifest lists them, so those of failed attempts never are; archives of other writers in the folder
are always read.  Appending adds a manifest; overwriting deletes what was there once its own is written.

A null payload is written as an empty one.  Paths are those that pyarrow's file systems open.  A
record is held whole, some three times its payload, and batches are bounded by bytes.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from voltsheaf.llm.common import scratch_path, sized_broadcast, small_batches

READ_DDL = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, content_type string, headers map<string,string>, payload binary"
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload")
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
#: Compressed bytes between the block starts that a file's index lists.
BLOCK = 4 << 20
MANIFEST = re.compile(r"_manifest-[0-9a-f]{32}\.json$")
OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz$")
INFO = b"software: voltsheaf\r\nformat: WARC File Format 1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")]
    + [("payload_length", pa.int64()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def gzip_member(raw: bytes, level: int) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """One record: response with its payload, or revisit with headers alone."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if row["record_type"] == "revisit" else http + payload
    lines = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {row['target_uri']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    clean = "\r\n".join(line.replace("\r", " ").replace("\n", " ") for line in lines)
    return b"WARC/1.1\r\n" + clean.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    blocks: list[int]
    size: int


def info_bytes(name: str, date: str) -> bytes:
    return b"WARC/1.1\r\n" + f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(INFO)}\r\n\r\n".encode() + INFO + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", "4")), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        blocks, at = [0], 0
        try:
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                for batch in iterator:
                    for i in range(batch.num_rows):  # a row at a time: payloads are not held twice
                        row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                        member = gzip_member(record_bytes(row), self.level)
                        if not at:
                            at = out.write(gzip_member(info_bytes(name, row["date"]), self.level))
                        if at - blocks[-1] >= BLOCK:
                            blocks.append(at)
                        out.write(member)
                        at += len(member)
        except BaseException:
            system.delete_file(f"{root}/{name}")
            raise
        return Written(name, blocks, at)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        before = [x.path for x in system.get_file_info(fs.FileSelector(root)) if MANIFEST.search(x.path) or x.path.endswith((".warc", ".warc.gz"))] if self.overwrite else []
        fresh = {f"{root}/{m.name}" for m in messages if m is not None}
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.name, m.blocks, m.size] for m in messages if m is not None]).encode())
        # manifests first: a reader in between finds the new files alone
        for path in sorted(before, key=lambda x: not MANIFEST.search(x)):
            if path.rsplit("/", 1)[-1] not in {f.rsplit("/", 1)[-1] for f in fresh}:
                system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.name}")


@dataclass
class Block(InputPartition):
    file: str
    start: int
    stop: int  # -1: to the end of the file


def parsed(head: bytes) -> dict[str, str]:
    """Header lines after the version line, names in lower case; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def inflated(f, at: int) -> Iterator[bytes]:
    """All gzip members of a file from a place on, in pieces of at most 1 MB."""
    f.seek(at)
    inflate = zlib.decompressobj(31)
    data = b""
    while data or (data := f.read(1 << 16)):
        if inflate.eof:
            data = data.lstrip(b"\0")  # padding
            inflate = zlib.decompressobj(31)
            continue
        yield inflate.decompress(data, 1 << 20)
        data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
            if name in HEADER_OF and type(f) in kinds:
                self.tests.append((name, kinds[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Block]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Block(root, 0, -1)]
        out = []
        for x in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
            if MANIFEST.search(x.path):
                with system.open_input_stream(x.path) as f:
                    listed = json.loads(f.read())
                out += [Block(f"{root}/{name}", a, b) for name, blocks, size in listed for a, b in zip(blocks, [*blocks[1:], size]) if b > a]
            elif x.path.endswith((".warc", ".warc.gz")) and not OWN.search(x.path):
                out.append(Block(x.path, 0, -1))
        return out

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            have = row[name]
            if have is None or not {"is": lambda: have == value, "in": lambda: have in value, "starts": lambda: have.startswith(value), "ends": lambda: have.endswith(value), "has": lambda: value in have}[kind]():
                return False
        return True

    def row(self, headers: dict[str, str]) -> dict:
        row = {name: headers.get(h) for name, h in HEADER_OF.items()}
        for name in ("record_id", "refers_to"):
            if row[name]:
                row[name] = row[name].strip("<>")
        if row["payload_digest"] and row["payload_digest"].startswith("sha1:"):
            row["payload_digest"] = row["payload_digest"][5:]
        length = headers.get("x-payload-length", "")
        return row | {"payload_length": int(length) if length.isdigit() else None, "headers": list(headers.items()), "payload": None}

    def payload(self, row: dict, block: bytes) -> bytes | None:
        if row["record_type"] == "revisit":
            return None
        if (row["content_type"] or "").startswith("application/http"):
            return block.partition(b"\r\n\r\n")[2]
        return block

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        system, _ = opened(self.path)
        rows, held = [], 0
        with system.open_input_file(partition.file) as f:
            size = f.size()
            stop = size if partition.stop < 0 else partition.stop
            f.seek(partition.start)
            records = self.members(f, stop) if partition.file.endswith(".gz") else self.plain(f, stop)
            for row in records:
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, READ_SCHEMA)

    def members(self, f, stop: int) -> Iterator[dict]:
        """Records of gzip members that tell their length, one in each; from a member of another writer
        on, which may hold many records or a part of one, the file is inflated to its end."""
        at = f.tell()
        while at < stop:
            f.seek(at)
            front = f.read(4096)
            if not (front[:4] == b"\x1f\x8b\x08\x04" and front[12:14] == b"sl"):
                yield from self.stream(inflated(f, at))
                return
            length = struct.unpack("<I", front[16:20])[0]
            inflate = zlib.decompressobj(31)
            plain = inflate.decompress(front[:length])
            while b"\r\n\r\n" not in plain and not inflate.eof and (more := f.read(65536)):
                plain += inflate.decompress(more)
            head, _, rest = plain.partition(b"\r\n\r\n")
            headers = parsed(head)
            row = self.row(headers)
            keep = self.wanted(row)
            if keep and self.with_payload and row["record_type"] != "revisit":
                parts = [rest]
                while not inflate.eof and (more := f.read(max(1, at + length - f.tell()))):
                    parts.append(inflate.decompress(more))
                row["payload"] = self.payload(row, b"".join(parts)[: int(headers.get("content-length", 0))])
            at += length
            if keep and head:
                yield row

    def stream(self, pieces: Iterator[bytes]) -> Iterator[dict]:
        """Records of inflated bytes, one after another; unwanted blocks are not held."""
        held = b""
        while True:
            held = held.lstrip(b"\r\n")
            while b"\r\n\r\n" not in held:
                if (more := next(pieces, None)) is None:
                    return
                held = (held + more).lstrip(b"\r\n")
            head, _, held = held.partition(b"\r\n\r\n")
            headers = parsed(head)
            row, left = self.row(headers), int(headers.get("content-length", 0))
            keep = self.wanted(row)
            need = keep and self.with_payload and row["record_type"] != "revisit"
            parts = []
            while True:
                part, held = held[:left], held[left:]
                left -= len(part)
                if need:
                    parts.append(part)
                if not left or (more := next(pieces, None)) is None:
                    break
                held = more
            if need:
                row["payload"] = self.payload(row, b"".join(parts))
            if keep:
                yield row

    def plain(self, f, stop: int) -> Iterator[dict]:
        """Records of a file that is not compressed; unwanted blocks are skipped by seeking."""
        while f.tell() < stop:
            at = f.tell()
            head = b""
            while b"\r\n\r\n" not in head and (more := f.read(4096)):
                head += more
            head, sep, _ = head.partition(b"\r\n\r\n")
            if not sep:
                return
            headers = parsed(head.lstrip(b"\r\n"))
            row, n = self.row(headers), int(headers.get("content-length", 0))
            f.seek(at + len(head) + 4)
            if self.wanted(row):
                if self.with_payload:
                    row["payload"] = self.payload(row, f.read(n))
                yield row
            f.seek(at + len(head) + 4 + n + 4)


class WarcSource(DataSource):
    """format("warc"): options path (or load/save path), payload (read: false skips all payloads), level (gzip)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_DDL

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """The record of each page.  Of equal payloads of at least least_bytes the largest page_id is the
    response and the others revisit it; a null page_id is smaller than any other.  Rows that repeat
    the response's page_id are responses too.  Only the digests of the pages are shuffled."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("whole"), F.octet_length("payload").cast("long").alias("n"))
    groups = rows.filter(F.col("n") >= least_bytes).groupBy("whole").agg(F.max("page_id").alias("best"), F.count("*").alias("k")).filter("k > 1 and best is not null").select("whole", "best").checkpoint()
    rows = rows.join(sized_broadcast(groups), "whole", "left")
    again = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(again, F.concat(F.lit("urn:page:"), F.col("best").cast("string"))).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        "payload",
    )


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as WARC and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from the payload that was read, those of a revisit
    from its headers.  No pages: no records.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    small_batches(spark)
    page_records(pages).write.format("warc").mode("append").save(path)
    # pushed down to the record headers: the warcinfo record of each file is not even inflated
    back = spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit"))

    def id_of(c):
        return F.nullif(F.substring(c, len("urn:page:") + 1, 30), F.lit("")).cast("long")

    whole = F.col("record_type") == "response"
    return back.select(
        id_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        id_of(F.col("refers_to")).alias("refers_to"),
    )
