"""WARC archives with a two-level capture index.

Records are written by the tasks that hold them, a file for each task and a gzip member for each record, to a folder that driver
and executors share; only files named by rows of a finished job count, so a lost or repeated attempt leaves at most an
orphan. The index is sorted by reversed-host URL key and cut in compressed blocks, written to index files; a sparse directory, a table
in the same order, holds each block's first key and byte range. A lookup binary-searches the directory, reads the byte
ranges of the blocks it finds, binary-searches these, and reads the records' byte ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stage
from .text import column

BLOCK_ROWS = 512
SLICE_BYTES = 1 << 22
ENTRY = "key string, url string, page_id long, file string, start long, length long, kind string, digest string"
BLOCK = "first_key string, last_key string, n long, file string, start long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.Example.com:80/a?b`` is ``com,example)/a?b``; without a host, the text itself.

    The scheme, user, ``www.`` and default ports are left out, the host is lower-cased; a null URL is an empty key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column, from built-in functions: 5 hex digits give 4 letters."""
    digest = F.sha1(value)
    pieces = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*pieces)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or an absolute path; executors reach local ones through a shared mount."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(raw: bytes) -> dict:
    """A gzip member's record. Raises ValueError if its lengths or its payload's digest don't hold."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest, kind = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")

    def page(name: str) -> int | None:
        found = fields.get(name, "").strip("<>").removeprefix("urn:x-page:")
        return int(found) if found.lstrip("-").isdigit() else None

    return {"page_id": page("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to"), "url": fields["warc-target-uri"], "payload": payload if kind == "response" else None}


@dataclass(frozen=True)
class Archive:
    """``directory``: a row (first_key, last_key, n, file, start, length) for each block of the index, sorted by key within its partitions,
    which hold ranges of keys."""

    root: str
    directory: DataFrame

    def entries(self) -> DataFrame:
        """The index: an ``ENTRY`` for each record."""
        by_place = self.directory.select("file", "start", "length").repartition("file", F.floor(F.col("start") / SLICE_BYTES)).sortWithinPartitions("file", "start")
        return by_place.mapInArrow(_opened, ENTRY)

    def records(self) -> DataFrame:
        """All records, read back by their byte ranges."""
        return read_records(self.entries())

    def blocks_of(self, urls: list[str]) -> DataFrame:
        """The rows of the directory whose blocks can hold one of the URLs, each with its ``keys``.

        A task may read several files of the directory, in any order, so it sorts what it has; ranges don't overlap but in equal keys, so
        last keys ascend with first ones.
        """
        keys = sorted({url_key(u) for u in urls})
        in_range = self.directory.where((F.col("first_key") <= keys[-1]) & (F.col("last_key") >= keys[0])) if keys else self.directory.limit(0)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first, last = column(batch, "first_key").to_pylist(), column(batch, "last_key").to_pylist()
                wanted: dict[int, list[str]] = {}
                for key in keys[bisect.bisect_left(keys, first[0]) : bisect.bisect_right(keys, last[-1])] if first else ():
                    at = bisect.bisect_right(first, key) - 1  # the last block that can hold it, and those before if equal keys run on
                    while at >= 0 and last[at] >= key:
                        wanted.setdefault(at, []).append(key)
                        at -= 1
                rows = sorted(wanted)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array([wanted[i] for i in rows], pa.list_(pa.string()))], [*batch.schema.names, "keys"])

        return in_range.sortWithinPartitions("first_key", "last_key").mapInArrow(find, f"{BLOCK}, keys array<string>")

    def lookup(self, urls: list[str]) -> DataFrame:
        """Records of the given URLs; reads only the blocks and byte ranges that can hold them."""

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for wanted, table in zip(column(batch, "keys").to_pylist(), _opened([batch]), strict=True):
                    own = column(table, "key").to_pylist()
                    for key in wanted:
                        a, b = bisect.bisect_left(own, key), bisect.bisect_right(own, key)
                        if b > a:
                            yield table.slice(a, b - a)

        return read_records(self.blocks_of(urls).mapInArrow(find, ENTRY))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each block, read by its byte range."""
    names = [x.split()[0] for x in ENTRY.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in ENTRY.split(", ")]
    for data in _ranges(batches):
        rows = [json.loads(x) for x in zlib.decompress(data).decode().splitlines()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The bytes of each row's (file, start, length); a file stays open while its rows follow each other."""
    handle, name = None, None
    try:
        for batch in batches:
            for file, start, length in zip(*(column(batch, k).to_pylist() for k in ("file", "start", "length")), strict=True):
                if file != name:
                    if handle is not None:
                        handle.close()
                    fs, path = filesystem(file)
                    handle, name = fs.open_input_file(path), file
                yield handle.read_at(length, start)
    finally:
        if handle is not None:
            handle.close()


def read_records(entries: DataFrame) -> DataFrame:
    """The records that index entries point to, read in order of file and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[dict] = []
        for raw in _ranges(batches):
            got.append(parse_record(raw))
            if len(got) == 500:
                yield _records(got)
                got = []
        yield _records(got)

    def _records(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))], [x.split()[0] for x in RECORD.split(", ")])

    by_place = entries.repartition("file", F.floor(F.col("start") / SLICE_BYTES)).sortWithinPartitions("file", "start")
    return by_place.mapInArrow(run, RECORD)


class _Appender:
    """A file of the archive's folder that a task opens when it has something to write; it keeps the place."""

    def __init__(self, root: str, ending: str) -> None:
        self.root, self.ending, self.handle, self.name, self.at = root, ending, None, "", 0

    def write(self, data: bytes) -> tuple[str, int, int]:
        if self.handle is None:
            self.name = f"{self.root}/{uuid.uuid4().hex}{self.ending}"
            fs, path = filesystem(self.name)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.handle = fs.open_output_stream(path, compression=None)
        self.handle.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()


def _indexer(root: str):
    """For entries in order: writes their blocks to an index file and gives the directory's rows, which follow the file's close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        out, rows = _Appender(root, ".cdx.z"), []

        def cut(own: list[list]) -> None:
            rows.append((own[0][0], own[-1][0], len(own), *out.write(zlib.compress("\n".join(json.dumps(r) for r in own).encode(), 6))))

        for batch in batches:
            held += [list(r) for r in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            while len(held) >= BLOCK_ROWS:
                cut(held[:BLOCK_ROWS])
                held = held[BLOCK_ROWS:]
        if held:
            cut(held)
        out.close()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

    return run


def write_archive(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> Archive:
    """A WARC record for each row of ``pages``, its payload the html in UTF-8 (null: empty), and the index of all records.

    Of equal payloads the record with the largest id is the response, the others are revisits that refer to it; rows that
    repeat that id are responses too. Null URLs have an empty key, a null id is written as none. Other columns are not read.
    """
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    named = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).cast("binary").alias("payload"))
    hashed = named.withColumn("digest", base32_sha1(F.col("payload")))
    owners = stage(hashed.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("digest").alias("of"), "owner"), "owners")
    told = hashed.join(owners, F.col("digest") == F.col("of"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Appender(root, ".warc.gz")
        for batch in batches:
            rows = zip(*(column(batch, k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to")), strict=True)
            out = []
            for page_id, url, payload, digest, refers_to in rows:
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                place = file.write(packer.compress(_record(page_id, url, payload, digest, refers_to)) + packer.flush())
                out.append((url_key(url), url, page_id, *place, "response" if refers_to is None else "revisit", digest))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 8, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [x.split()[0] for x in ENTRY.split(", ")])
        file.close()

    written = stage(told.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, ENTRY), "captures")
    ordered = written.repartitionByRange("key", "page_id", "start").sortWithinPartitions("key", "page_id", "start")
    return Archive(root, stage(ordered.mapInArrow(_indexer(root), BLOCK), "directory"))


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records, and what the records read back say."""
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive.records().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
owners AS (SELECT hex, max(page_id) AS owner FROM hashed GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hashed.hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM hashed JOIN owners USING (hex)
"""
