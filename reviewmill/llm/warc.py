"""WARC archives as a Spark data source, for reading and writing.

Reading plans partitions from the committed files and the split points noted at
writing. Conditions on the record type and other header columns are pushed into the
source: a record's headers are parsed first, and the payload of a record that fails
them is skipped. Compressed records carry their lengths in the gzip header (subfield
``sl``), so a skipped one is neither read nor inflated.

Every write task makes a file of its own name and a commit lists the files that
count, so a task that ran twice or was lost leaves no record behind.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from reviewmill.llm.common import table
from reviewmill.session import materialize, shared_folder

READ_SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string,"
    " refers_to string, content_length long, file string, offset long, payload binary, payload_sha1 string"
)
#: Column of the source and the header it stands for (names fixed by the WARC standard).
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 32 << 20  # a file is read in parts of about this size
BATCH_BYTES = 4 << 20


@dataclass
class Files(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {_one_line(v)}" for k, v in headers.items() if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose header says how long it is, compressed and not."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    head = struct.pack("<4BIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size % 2**32, len(data) % 2**32)
    if max(size, len(data)) >= 2**32:  # too long for the subfield
        head = struct.pack("<4BIBB", 0x1F, 0x8B, 8, 0, 0, 0, 255)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:60]!r}")
    named: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            named[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            named[last] = value.strip()
    return named


def _payload(block: bytes, content_type: str) -> bytes:
    """The body of an HTTP message; any other block is the payload itself."""
    if content_type.replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class _Plain:
    """Records of an uncompressed file: seeking past a block skips it."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file = file

    def head(self) -> bytes | None:
        lines: list[bytes] = []
        while line := self.file.readline():
            if line.strip():
                lines.append(line)
            elif lines:
                return b"".join(lines).rstrip(b"\r\n")
        if lines:
            raise EOFError("a record ends within its headers")
        return None

    def block(self, length: int) -> bytes:
        data = self.file.read(length)
        if len(data) < length:
            raise EOFError("a record ends within its block")
        return data

    def skip(self, length: int) -> None:
        self.file.seek(length, io.SEEK_CUR)


class _Gzip:
    """Records of a file with a gzip member each: inflated up to the headers, on only if wanted."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file = file

    def head(self) -> bytes | None:
        start = self.file.tell()
        fixed = self.file.read(12)
        if not fixed:
            return None
        if fixed[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        self.next = None
        if fixed[3] & 4:
            extra = self.file.read(struct.unpack("<H", fixed[10:12])[0])
            at = 0
            while at + 4 <= len(extra):
                name, size = struct.unpack("<2sH", extra[at : at + 4])
                if name == b"sl" and size == 8:
                    self.next = start + struct.unpack("<I", extra[at + 4 : at + 8])[0]
                at += 4 + size
        self.file.seek(start)
        self.inflate, self.data = zlib.decompressobj(31), b""
        while (end := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more(2048):
                raise EOFError("a record ends within its headers")
        raw, self.data = self.data[:end], self.data[end + 4 :]
        return raw

    def _more(self, most: int) -> bool:
        given = self.inflate.unconsumed_tail or self.file.read(65_536 if most > 4096 else 2048)
        if not given and not self.inflate.eof:
            raise EOFError("a gzip member ends too early")
        got = self.inflate.decompress(given, most)
        self.data += got
        return bool(got) or not self.inflate.eof

    def block(self, length: int) -> bytes:
        parts, have = [self.data], len(self.data)
        self.data = b""
        while not self.inflate.eof:
            self._more(1 << 20)
            parts.append(self.data)
            have += len(self.data)
            self.data = b""
        if have < length:
            raise EOFError("a record ends within its block")
        self.file.seek(self.file.tell() - len(self.inflate.unused_data))
        return b"".join(parts)[:length]

    def skip(self, length: int) -> None:
        if self.next is None:
            self.block(length)
        else:
            self.file.seek(self.next)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes =, IN and LIKE 'x%' on header columns; anything else stays with Spark."""
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                kind = type(f).__name__
                self.tests.append((HEADERS[column], kind, set(f.value) if kind == "In" else getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            got = headers.get(name)
            if got is None or (kind == "EqualTo" and got != value) or (kind == "In" and got not in value) or (kind == "StringStartsWith" and not got.startswith(value)):
                return False
        return True

    def partitions(self) -> list[Part]:
        store, root = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        commits = [f for f in found if f.base_name.startswith("_commit-")]
        base = self.path.rstrip("/")
        if not commits:
            one = len(found) == 1 and found[0].path.rstrip("/") == root.rstrip("/")
            return [Part(base if one else f"{base}/{f.base_name}", 0, None) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        parts = []
        for commit in commits:
            with store.open_input_stream(commit.path) as listed:
                for name, size, splits in json.loads(listed.read()):
                    parts += [Part(f"{base}/{name}", a, b) for a, b in zip([0, *splits], [*splits, size], strict=True)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, path = _opened(part.path)
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string())) for c in READ_SCHEMA.split(",")])
        rows: list[dict] = []
        held = 0
        with io.BufferedReader(store.open_input_file(path), 1 << 20) as file:
            file.seek(part.start)
            records = _Gzip(file) if path.endswith(".gz") else _Plain(file)
            while part.end is None or file.tell() < part.end:
                offset = file.tell()
                raw = records.head()
                if raw is None:
                    break
                headers = _headers(raw)
                length = int(headers["content-length"])
                if not self._wanted(headers):
                    records.skip(length)
                    continue
                row = {column: headers.get(name) for column, name in HEADERS.items()}
                row |= {"content_length": length, "file": part.path, "offset": offset}
                if self.payload:
                    row["payload"] = _payload(records.block(length), headers.get("content-type", ""))
                    row["payload_sha1"] = base32_digest(row["payload"])
                    held += len(row["payload"])
                else:
                    records.skip(length)
                rows.append(row)
                if held > BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, record_type, target_uri, sha1_hex, refers_to, payload)."""

    def __init__(self, path: str, compressed: bool, date: str) -> None:
        self.path, self.compressed, self.date = path.rstrip("/"), compressed, date

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"records-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed
        splits: list[int] = []
        at = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    data = self._record(**row)
                    data = gzip_member(data) if self.compressed else data
                    if at - (splits[-1] if splits else 0) >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        return Files(name, at, splits)

    def _record(self, record_id: str, record_type: str, target_uri: str | None, sha1_hex: str, refers_to: str | None, payload: str | None) -> bytes:
        body = (payload or "").encode()
        status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        headers = {
            "WARC-Type": record_type, "WARC-Record-ID": record_id, "WARC-Date": self.date, "WARC-Target-URI": target_uri,
            "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode(),
        }
        if record_type == "revisit":
            headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
        return encode_record(headers, status + body)

    def commit(self, messages: list[Files]) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        listed = json.dumps([[m.name, m.size, m.splits] for m in messages if m])
        with store.open_output_stream(f"{root}/_commit-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(listed.encode())

    def abort(self, messages: list[Files]) -> None:
        store, root = _opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options: payload (true), compression (gzip or none), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        date = self.options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", date)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write a WARC record per row to ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the smallest id is
    the response, the others are revisits without a body; smaller payloads are all
    responses. A null html is an empty payload, a null url has no target URI. Rows
    that repeat the smallest id are responses too, and so is a row without an id,
    which can't be told to come later. An empty table writes no record.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), html.alias("html"), F.sha1(html).alias("sha1_hex"))
    # Only what occurs more than once is joined back: broadcast while that is small, else dealt by digest, where AQE splits a hot one.
    repeats = rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha1_hex").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    repeats = materialize(repeats.filter("n > 1").select("sha1_hex", "least"), "repeats")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    rows = rows.join(repeats, "sha1_hex", "left").select(
        F.coalesce(F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")), F.lit("<urn:page>")).alias("record_id"),
        F.when(later, "revisit").otherwise("response").alias("record_type"), "target_uri", "sha1_hex",
        F.when(later, F.concat(F.lit("<urn:page:"), F.col("least").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(~later, F.col("html")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(path)


def page_of(record_id: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)


def archived_pages(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response come from the payload read back. Revisits are
    read without payloads and take theirs from the response they refer to.
    """
    register(spark)
    response = spark.read.format("warc").load(path).filter("record_type = 'response'").select(
        page_of("record_id", kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"),
    )
    response = materialize(response, "responses")
    revisit = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    revisit = materialize(revisit.select(page_of("record_id", kind).alias("page_id"), page_of("refers_to", kind).alias("refers_to")), "revisits")
    whole = response.join(revisit.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("of"))
    seen = revisit.join(whole.withColumnRenamed("page_id", "at"), F.col("refers_to") == F.col("at"), "left")
    return response.unionByName(seen.select("page_id", "of.payload_bytes", "of.payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    archive_pages(pages, path)
    return archived_pages(spark, path, dict(pages.dtypes)["page_id"])
