"""WARC archives as a Python data source, for reading and writing.

Reading plans a partition per archive file, or several small files together,
and tells Spark which columns it can filter by: record type, target URI,
record id, date and digest come from a record's headers, which are parsed
first, so a record that fails a pushed predicate is skipped by its length
without its payload being decoded, and payloads are only decoded when the
payload column is asked for.

Writing streams each partition into files of its own, one gzip member a
record, under temporary names that are renamed when the task commits; a lost
task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .store import Work, file_sizes, open_fs, qualify

#: header behind each column that predicates can be pushed for
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, content_type string, content_length long, http_length long, payload binary, file string, offset long"
_CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record; line breaks in header values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(str(v).split())}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


class _Inflated(io.RawIOBase):
    """A file of gzip members, or a plain one, read as a stream that can skip."""

    def __init__(self, raw):
        self.raw, self.left, self.at, self.record_at = raw, b"", 0, 0
        head = raw.read(2)
        self.gzip = head == b"\x1f\x8b"
        self.ahead, self.z = head, zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bytes:
        while True:
            data = self.ahead or self.raw.read(1 << 18)
            self.ahead = b""
            if not data or not self.gzip:
                return data
            if self.z.eof:
                data = data.lstrip(b"\0")  # padding between members
                if not data:
                    continue
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data)
            self.ahead = self.z.unused_data
            if out:
                return out

    def line(self) -> bytes:
        """Up to and with the next line break; empty at the end."""
        while (k := self.left.find(b"\n")) < 0:
            more = self._more()
            if not more:
                out, self.left = self.left, b""
                self.at += len(out)
                return out
            self.left += more
        out, self.left = self.left[: k + 1], self.left[k + 1 :]
        self.at += len(out)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or with keep false nothing of them."""
        parts = []
        self.at += n
        while n:
            if not self.left:
                self.left = self._more()
                if not self.left:
                    raise ValueError("the archive ends within a record")
            part, self.left = self.left[:n], self.left[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def _headers(stream: _Inflated) -> dict[str, str] | None:
    line = stream.line()
    while line and not line.strip():
        line = stream.line()
    if not line:
        return None
    stream.record_at = stream.at - len(line)
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := stream.line()).strip() or not line:
        if not line:
            raise ValueError("the archive ends within a record's headers")
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _length(headers: dict[str, str], path: str, offset: int) -> int:
    text = headers.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"{path}: the record at {offset} has no valid Content-Length: {text!r}")
    return int(text)


def _http_head(stream: _Inflated, length: int) -> bytes:
    """The head of an HTTP message of length bytes, all of which are passed: block by block up to the empty line."""
    head = b""
    while length and _CRLF * 2 not in head:
        n = min(length, 8192)
        head += stream.take(n, keep=True)
        length -= n
    stream.take(length, keep=False)
    return head


def _http(block: bytes) -> tuple[int | None, bytes]:
    """Content-Length of an HTTP message's header, and its body."""
    head, _, body = block.partition(_CRLF * 2)
    length = None
    for line in head.split(_CRLF)[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"content-length":
            with suppress(ValueError):
                length = int(v)
    return length, body


def _passes(test: tuple, headers: dict[str, str]) -> bool:
    kind, column, value = test
    own = headers.get(HEADERS[column].lower())
    if own is None:
        return False
    return own in value if kind == "in" else own.startswith(value) if kind == "prefix" else True


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.options = {k.lower(): v for k, v in options.items()}
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership, prefix and not-null tests of header columns; hand the rest back."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo) or isinstance(f, EqualNullSafe) and f.value is not None:
                self.tests.append(("in", column, {f.value}))
            elif isinstance(f, In):
                self.tests.append(("in", column, set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("prefix", column, f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append(("set", column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files packed up to partitionbytes each; a larger file stands alone."""
        most, out, room = int(self.options.get("partitionbytes", 64 << 20)), [], 0
        for path, size in self._files():
            if not out or size > room:
                out.append(_Files([]))
                room = most
            out[-1].files.append((path, size))
            room -= size
        return out or [_Files([])]

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, where = open_fs(self.options["path"])
        infos = system.get_file_info(fs.FileSelector(where, allow_not_found=True)) if system.get_file_info(where).type != fs.FileType.File else [system.get_file_info(where)]
        prefix = self.options["path"][: -len(where)] if self.options["path"].endswith(where) else ""
        return sorted((prefix + x.path, x.size) for x in infos if x.is_file and x.path.endswith((".warc", ".warc.gz")))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, _ in partition.files:
            for row in self._records(path):
                rows.append(row)
                held += len(row[-1] or b"") + 400
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "http_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        order = [n for n in self.names if n != "payload"] + ["payload"]
        columns = dict(zip(order, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.string())) for n in self.names], names=self.names)

    def _records(self, path: str) -> Iterator[tuple]:
        wants = self.options.get("payload", "true").lower() == "true"
        names = [n for n in self.names if n != "payload"]
        system, where = open_fs(path)
        with system.open_input_stream(where, compression=None) as raw:
            stream = _Inflated(raw)
            while True:
                headers = _headers(stream)
                if headers is None:
                    return
                offset = stream.record_at
                length = _length(headers, path, offset)
                if not all(_passes(t, headers) for t in self.tests):
                    stream.take(length, keep=False)
                    continue
                is_http = headers.get("content-type", "").startswith("application/http")
                http_length, payload = None, None
                if is_http and not wants:
                    http_length = _http(_http_head(stream, length))[0]
                elif wants or is_http:
                    block = stream.take(length, keep=True)
                    http_length, payload = _http(block) if is_http else (None, block)
                else:
                    stream.take(length, keep=False)
                values = {"content_length": length, "http_length": http_length, "file": path, "offset": offset}
                own = [values[n] if n in values else headers.get(HEADERS[n].lower()) for n in names]
                yield (*own, payload if wants else None)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, record_id, target_uri, warc_date, payload_sha1 in hex, refers_to, payload_bytes, payload)."""

    def __init__(self, options: dict[str, str]):
        own = {k.lower(): v for k, v in options.items()}
        self.path, self.roll = own["path"].rstrip("/"), int(own.get("filebytes", 1 << 30))
        self.level = int(own.get("level", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, where = open_fs(self.path)
        system.create_dir(where, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > self.roll:
                        if out:
                            out.close()
                        final = f"part-{uuid.uuid4().hex}.warc.gz"
                        files.append((f"{where}/.{final}.tmp", f"{where}/{final}"))
                        out, size = system.open_output_stream(files[-1][0]), 0
                    data = gzip.compress(self._record(row), self.level, mtime=0)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return _Written(files)

    @staticmethod
    def _record(row: dict) -> bytes:
        payload = row["payload"] or b""
        revisit = row["record_type"] == "revisit"
        # a revisit repeats the HTTP header, which tells the payload's length, and leaves the payload out
        length = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        headers = {
            "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["warc_date"], "WARC-Target-URI": row["target_uri"],
            "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(row['payload_sha1'])).decode()}", "WARC-Refers-To": row["refers_to"],
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
            "Content-Type": "application/http; msgtype=response",
        }
        return record_bytes(headers, http + (b"" if revisit else payload))

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for now, final in m.files if m else ():
                open_fs(self.path)[0].move(now, final)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for now, _ in m.files if m else ():
                with suppress(Exception):
                    open_fs(self.path)[0].delete_file(now)


class WarcDataSource(DataSource):
    """Format "warc".  Read options: path, partitionBytes, payload (false: never decode payloads).
    Write options: path, fileBytes, level.  offset counts the bytes of the inflated archive.  An archive that
    ends within a record, or a record without a valid length, raises."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make format("warc") known; predicate pushdown of Python sources is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def record_id(page_id) -> "F.Column":
    """A urn made of the page's id, so that records and pages can be told from each other's."""
    return F.when(page_id.isNotNull(), F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">")))


def archive_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages.

    Of rows with equal payloads of at least revisit_bytes bytes, the one with
    the largest id is the response and the others revisit it; smaller payloads
    are all responses.  A null html is an empty payload.  Rows without an id
    are responses and are revisited by none; rows that repeat the largest id
    are all responses.
    """
    register(pages.sparkSession)
    work = Work(pages.sparkSession, "warc")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.col(html_col).cast("string"), "UTF-8").alias("payload"))
    rows = base.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    # only equal payloads need the id of their response: a small table that leaves payloads where they are
    same = rows.where((F.col("payload_bytes") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("payload_sha1", "payload_bytes")
    first = work.table("responses", same.agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(first, ["payload_sha1", "payload_bytes"], "left")
    revisit = F.col("page_id").isNotNull() & F.col("response").isNotNull() & (F.col("page_id") != F.col("response"))
    out = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_id(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        "payload_sha1", F.when(revisit, record_id(F.col("response"))).alias("refers_to"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _page_of(urn: str):
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of responses are those of the payloads that were read;
    a revisit's are those its headers tell, which hold no payload.  A null html
    is an empty payload; rows without an id come back with a null one, repeated
    rows each; an empty table gives an empty result.  Only the named columns are read.
    """
    spark = pages.sparkSession
    work = Work(spark, "warc-round")
    path = qualify(spark, work.folder("archives"))
    archive_pages(pages, path)
    names = ["record_type", "record_id", "payload_bytes", "payload_digest", "refers_to"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, own, body, told, digest, refers = (batch.column(k) for k in range(6))
            rows = zip(kind.to_pylist(), body, told.to_pylist(), digest.to_pylist(), strict=True)
            facts = [(t, d.removeprefix("sha1:")) if k == "revisit" else (len(b := x.as_py() or b""), base32_sha1(b)) for k, x, t, d in rows]
            size, sha1 = zip(*facts, strict=True) if facts else ((), ())
            yield pa.RecordBatch.from_arrays([kind, own, pa.array(size, pa.int64()), pa.array(sha1, pa.string()), refers], names=names)

    records = read_archives(spark, path).where("record_type in ('response', 'revisit')").select("record_type", "record_id", "payload", "http_length", "payload_digest", "refers_to")
    both = records.mapInArrow(measured, "record_type string, record_id string, payload_bytes long, payload_digest string, refers_to string")
    return both.select(_page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_of("refers_to").alias("refers_to"))
