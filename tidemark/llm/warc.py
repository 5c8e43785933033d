"""WARC archives: a Python data source that writes and reads them, and payload dedup by revisit records.

Writing: a file per task, of gzip members, one for each record; a member's extra field tells its compressed size. Each attempt of a task writes a
name of its own and the commit lists the files that count in a manifest, so lost executors and repeated tasks leave no wrong record.
Reading: partitions are planned from the files' sizes, small ones together; filters on record_type and on headers are pushed down; a record's
headers are parsed first, and where a record or its payload isn't wanted the rest of the member is skipped without being inflated.

Defined cases of `write_pages`: a null html is the empty payload; a null url is left out of the record; a null page_id comes back null and is
never the first of its payload unless all are; rows that repeat id and payload are all the first one if their id is the smallest; an empty table gives an
empty archive; extra columns are left out."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import common

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
MANIFEST = "_manifest.json"
#: Bytes of archives to a partition of a read, and to a file of a write.
PARTITION, FILE = 64 << 20, 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that a filter can be pushed down for, and the header that each is read from.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}


def filesystem(uri: str):
    """The file system of a path and the path in it: local, or any that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field SL holds the compressed and the plain size."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"SL" + struct.pack("<H", 16) + struct.pack("<QQ", len(body), len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%"))
    head |= {"WARC-Payload-Digest": f"sha1:{payload_digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    """Rows: record_id, target_uri, payload, payload_digest (base32, or null to compute it), refers_to."""

    def __init__(self, path: str, overwrite: bool, date: str):
        self.path, self.overwrite, self.date = path.rstrip("/"), overwrite, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = filesystem(self.path)
        files: list = []
        out, name, size = None, "", 0

        def close() -> None:
            if out:
                out.close()
                files.append([name, size])

        for b in iterator:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("record_id", "target_uri", "payload", "payload_digest", "refers_to")]
            for i in range(b.num_rows):
                rid, url, payload, known, refers = (c[i].as_py() for c in cols)
                payload = payload or b""
                data = member(record(rid, url, payload, known or digest(payload), refers, self.date))
                if out is None or size > FILE:
                    close()
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                out.write(data)
                size += len(data)
        close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        fs.create_dir(at)
        files = [f for m in messages if m for f in m.files]
        if not self.overwrite:
            files = listed(self.path, manifest_only=True) + files
        with fs.open_output_stream(f"{at}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{at}/{name}")


def listed(path: str, manifest_only: bool = False) -> list:
    """[name, size] of an archive's files: what its manifest lists, or else all of its WARC files."""
    from pyarrow import fs as pafs

    fs, at = filesystem(path)
    info = fs.get_file_info(f"{at}/{MANIFEST}")
    if info.type == pafs.FileType.File:
        with fs.open_input_stream(info.path) as f:
            return json.loads(f.read())
    if manifest_only:
        return []
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [["", fs.get_file_info(at).size]]
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted([f.base_name, f.size] for f in found if f.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    names: list


class Records:
    """Records of one stream of gzip members or plain records, in order: headers first, bodies on demand."""

    def __init__(self, stream):
        self.stream, self.ahead = stream, b""

    def more(self, n: int = 1 << 16) -> bool:
        data = self.stream.read(n)
        self.ahead += data
        return bool(data)

    def take(self, n: int) -> bytes:
        while len(self.ahead) < n and self.more(max(1 << 16, n - len(self.ahead))):
            pass
        out, self.ahead = self.ahead[:n], self.ahead[n:]
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.ahead))
        self.ahead, n = self.ahead[inside:], n - inside
        if n:
            try:
                self.stream.seek(self.stream.tell() + n)
            except OSError:  # a stream that can't seek
                while n > 0 and (got := len(self.stream.read(min(n, 1 << 20)))):
                    n -= got

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        """(headers, body): body() gives the record's block, and may be left uncalled."""
        while self.ahead or self.more():
            if len(self.ahead) < 12:
                self.more()
            if self.ahead[:2] == b"\x1f\x8b":
                yield from self.zipped()
            elif self.ahead[:2] == b"\r\n":
                self.ahead = self.ahead[2:]
            else:
                yield from self.plain()

    def plain(self) -> Iterator[tuple[dict, object]]:
        while (end := self.ahead.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a WARC record ends within its headers")
        head = parsed(self.take(end + 4))
        size, got = int(head["content-length"]), []
        yield head, lambda: got.append(self.take(size)) or got[0]
        if not got:
            self.skip(size)

    def zipped(self) -> Iterator[tuple[dict, object]]:
        start = self.take(12)
        known = None
        if start[3] & 4:
            extra = self.take(struct.unpack("<H", start[10:12])[0])
            if extra[:4] == b"SL" + struct.pack("<H", 16):
                known = struct.unpack("<QQ", extra[4:20])[0]
        else:
            self.ahead = start[10:] + self.ahead
        for flag in (8, 16):  # name, comment
            while start[3] & flag and self.take(1) not in (b"\0", b""):
                pass
        if start[3] & 2:
            self.take(2)
        z, plain, used = zlib.decompressobj(-15), b"", 0

        def inflate(most: int) -> bool:
            """Some more of the member's plain bytes."""
            nonlocal plain, used
            if z.eof:
                return False
            data = z.unconsumed_tail
            if not data:
                if not self.ahead and not self.more():
                    raise ValueError("a gzip member is cut short")
                data = self.take(min(len(self.ahead), known - used) if known is not None else len(self.ahead))
                used += len(data)
            plain += z.decompress(data, most)
            if z.eof:
                self.ahead = z.unused_data + self.ahead
                used -= len(z.unused_data)
            return True

        while (end := plain.find(b"\r\n\r\n")) < 0:
            if not inflate(2048):
                raise ValueError("a WARC record ends within its headers")
        head = parsed(plain[: end + 4])
        size = int(head["content-length"])

        def body() -> bytes:
            while len(plain) < end + 4 + size and inflate(1 << 24):
                pass
            return plain[end + 4 : end + 4 + size]

        yield head, body
        if known is None:
            while inflate(1 << 24):
                plain = plain[-16:]
        elif not z.eof:
            self.skip(known - used)
        self.take(8)


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def column(head: dict[str, str], name: str) -> str | None:
    value = head.get(HEADERS[name])
    if value is None:
        return None
    return unquote(value) if name == "target_uri" else value.strip("<>") if name in ("record_id", "refers_to") else value


class Reader(DataSourceReader):
    """Options: path; verify (true: payloads are digested and held against their headers). Only the schema's columns are made:
    one without payload and headers, and without verify, inflates nothing but headers."""

    def __init__(self, schema, options: dict):
        self.names = [f.name for f in schema]
        self.path, self.verify = options["path"].rstrip("/"), str(options.get("verify", "false")).lower() == "true"
        self.wanted: list[tuple[str, list]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((f.attribute[0], [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self) -> list:
        out, size = [], PARTITION
        for name, n in sorted(listed(self.path)):
            if size + n > PARTITION:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, at = filesystem(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{at}/{name}".rstrip("/")) as stream:
                for head, body in Records(stream):
                    if all(column(head, c) in values for c, values in self.wanted):
                        yield self.row(head, body)

    def row(self, head: dict, body) -> tuple:
        found = {c: column(head, c) for c in HEADERS}
        known = head.get("warc-payload-digest")
        if known:
            found["payload_digest"] = known.partition(":")[2] or known
        if "payload_bytes" in self.names or "payload" in self.names or self.verify:
            found |= self.content(head, body)
        if "headers" in self.names:
            found["headers"] = head
        return tuple(found.get(c) for c in self.names)

    def content(self, head: dict, body) -> dict:
        block = body()
        if not head.get("content-type", "").startswith("application/http"):
            return {"payload": block, "payload_bytes": len(block)}
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = head.get("warc-type") == "revisit"
        length = next((int(x[15:]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")), None)
        if self.verify and not revisit and (digest(payload) != head.get("warc-payload-digest", "").partition(":")[2] or length != len(payload)):
            raise ValueError(f"the payload of {head.get('warc-record-id')} is not what its headers say")
        return {"payload": None if revisit else payload, "payload_bytes": length if revisit else len(payload)}


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        path = self.options["path"]
        fs, at = filesystem(path)
        fs.create_dir(at)
        return Writer(path, overwrite, self.options.get("date", "2024-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per page (page_id, url, html). Of pages whose equal payloads have at least so many bytes, that with the smallest page_id is
    the response and the others revisit it.

    The smallest ids are aggregated from (page_id, digest) alone. Payloads met twice or more are joined back: their table is broadcast if its
    counted rows allow, and the html then moves nowhere; else by a shuffle join whose hot payloads AQE splits."""
    spark = pages.sparkSession
    register(spark)
    common.small_batches(spark, rows=512, size="8m")
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = common.if_small(common.written(first.select(F.col("sha").alias("_sha"), "first"), "payloads"))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    joined = rows.join(first, F.col("sha") == F.col("_sha"), "left")
    refers = F.when(F.col("first").isNotNull() & ~common.same(F.col("page_id"), F.col("first")) & (F.length("payload") >= least_bytes), named("first"))
    out = joined.select(named("page_id").alias("record_id"), F.col("url").alias("target_uri"), "payload", F.lit(None).cast("string").alias("payload_digest"), refers.alias("refers_to"))
    out.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str | None = None, verify: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").option("verify", str(verify).lower())
    return (reader.schema(schema) if schema else reader).load(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = common.scratch(spark, "warc")
    write_pages(pages, path)
    back = read(spark, path, "record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string", verify=True)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS {pages.schema['page_id'].dataType.simpleString()})")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS int), 5) AS int) >> CAST(15 - 5 * (i % 4) AS int)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
