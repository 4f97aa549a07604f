"""WARC archives as a PySpark data source (``format("warc")``), and payload deduplication for writing.

Writing: every task writes its records to files of at most ``roll_mb`` under a name of its own attempt; files get
their final name when the whole job commits, so repeated or lost tasks leave nothing readable behind. All access goes
through pyarrow's file systems, so paths may be local, HDFS or object stores.

Reading: files are packed into partitions by size. A record's headers are parsed first; a record that a pushed
filter on ``record_type``, ``record_id``, ``target_uri``, ``refers_to``, ``payload_digest`` or ``payload_length``
refuses is skipped by seeking over its block, and with option ``payload`` = false no block is read at all. (`register`
switches the session's filter pushdown for Python sources on.) With option ``compression`` = gzip each record is a
gzip member; blocks that are not wanted are then inflated and thrown away, but not decoded.

Records: ``response`` holds an HTTP head and the payload, ``revisit`` refers to the response with the same payload
and holds none; digest and length of the payload are in the headers of both.

Defined cases: null text is an empty payload; a null url is a record without target; line breaks in header values are
percent-coded; rows that repeat the smallest id of their payload are all responses; an empty table is an archive
without records; a null id is a record id without a number; very long payloads are held whole by one task at a time. A file
that ends inside a record, and one that holds something else than records, gives the records before that place, then
one row with the headers it has, no payload, and the reason in ``damage``.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringStartsWith,
    WriterCommitMessage,
)

from docwarden.session import settle

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: What a record is read as: ``damage`` says why it, and with it the rest of its file, could not be read.
READ = RECORD + ", damage string"
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SAME_FROM = 100


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _record(row: dict) -> bytes:
    head = ["WARC/1.1", f"WARC-Date: {DATE}"]
    for field, name in HEADERS.items():
        if row[field] is not None:
            value = str(row[field]).replace("\r", "%0D").replace("\n", "%0A")
            head.append(f"{name}: {value}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        block = b""
    else:
        payload = row["payload"] or b""
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, roll_mb: int, packed: bool) -> None:
        self.path, self.roll, self.packed = path, roll_mb << 20, packed

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = _file_system(self.path)
        fs.create_dir(folder, recursive=True)
        attempt, names, out, size = uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                record = _record(row)
                if self.packed:
                    record = gzip.compress(record, 6, mtime=0)
                if out is None or size + len(record) > self.roll and size:
                    if out is not None:
                        out.close()
                    names.append(f"{attempt}-{len(names):05d}.warc" + ".gz" * self.packed)
                    out, size = fs.open_output_stream(f"{folder}/{names[-1]}.open"), 0
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, folder = _file_system(self.path)
        fs.create_dir(folder, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{folder}/{name}.open", f"{folder}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, folder = _file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{folder}/{name}.open")


@dataclass
class _Files(InputPartition):
    names: list[str]


def _test(kind: object, value: object) -> object:
    """A test on a header's value for a filter of Spark, or None if it is not one of ours."""
    if isinstance(kind, (EqualTo, EqualNullSafe)):
        return lambda x: x == value
    if isinstance(kind, In):
        return lambda x: x in value
    if isinstance(kind, IsNotNull):
        return lambda x: x is not None
    if isinstance(kind, StringStartsWith):
        return lambda x: x is not None and x.startswith(value)
    if isinstance(kind, StringContains):
        return lambda x: x is not None and value in x
    for cls, compare in ((GreaterThan, "__gt__"), (GreaterThanOrEqual, "__ge__"), (LessThan, "__lt__"), (LessThanOrEqual, "__le__")):
        if type(kind) is cls:
            return lambda x, compare=compare: x is not None and getattr(x, compare)(value) is True
    return None


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_mb: int, payload: bool) -> None:
        self.path, self.split, self.payload = path, split_mb << 20, payload
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):  # noqa: N802  the name is Spark's
        for f in filters:
            field = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            test = _test(f, getattr(f, "value", None)) if field in HEADERS else None
            if test is None:
                yield f
            else:
                self.tests.append((field, test))

    def partitions(self) -> list[_Files]:
        fs, folder = _file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = sorted((i.base_name, i.size) for i in found if i.base_name.endswith((".warc", ".warc.gz")))
        parts, size = [], 0
        for name, n in files:
            if not parts or size + n > self.split:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, folder = _file_system(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{folder}/{name}") as raw:
                packed = name.endswith(".gz")
                source = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 18)
                try:
                    yield from self._records(source, None if packed else raw.size())
                except (EOFError, zlib.error, gzip.BadGzipFile) as broken:
                    yield (*[None] * (len(HEADERS) + 1), f"{name}: {type(broken).__name__}")

    def _records(self, source, size: int | None) -> Iterator[tuple]:
        """Records of a plain file of ``size`` bytes, or of an inflated one."""

        def skip(n: int) -> int:
            """Pass over ``n`` bytes; how many of them there were."""
            if size is not None:
                at = source.tell()
                source.seek(n, io.SEEK_CUR)
                return min(n, size - at)
            left = n
            while left > 0 and (some := len(source.read(min(left, 1 << 20)))):
                left -= some
            return n - left

        while True:
            line = source.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                if line.strip():
                    yield (*[None] * (len(HEADERS) + 1), f"not a record: {line[:60]!r}")
                    return
                continue
            head: dict[str, str] = {}
            while (line := source.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            row = {field: head.get(name.lower()) for field, name in HEADERS.items()}
            if row["payload_length"] is not None:
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"].isdigit() else None
            wanted = all(test(row[field]) for field, test in self.tests)
            if not head.get("content-length", "").isdigit():
                if wanted:
                    yield (*row.values(), None, f"no length of a record: {head.get('content-length')!r}")
                return
            length = int(head["content-length"])
            payload = None
            if wanted and self.payload and row["record_type"] == "response":
                block = source.read(length)
                there = len(block)
                payload = block.partition(b"\r\n\r\n")[2] if "http" in head.get("content-type", "") else block
            else:
                there = skip(length)
            if there < length:
                if wanted:
                    yield (*row.values(), None, f"a record of {length} bytes ends after {there}")
                return
            skip(4)
            if wanted:
                yield (*row.values(), payload, None)


class WarcSource(DataSource):
    """Options: ``path``; writing ``roll_mb`` (64), ``compression`` (none, gzip); reading ``split_mb`` (64), ``payload`` (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("an archive is never overwritten: write to a new path with mode append")
        return _Writer(self.options["path"], int(self.options.get("roll_mb", 64)), self.options.get("compression") == "gzip")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split_mb", 64)), self.options.get("payload", "true") != "false")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    # a reader that takes filters is refused without it
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, same_from: int = SAME_FROM) -> DataFrame:
    """(page_id, url, html) -> the columns of a record, equal payloads of ``same_from`` bytes and more once in full.

    First ids are found on digests alone; only digests that occur more than once are joined back, and Spark splits
    the partition of a digest that very many pages share.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.sha2(payload, 256)
    keyed = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"))
    slim = pages.select("page_id", digest.alias("digest"), F.length(payload).alias("n"))
    repeated = settle(
        slim.filter(F.col("n") >= same_from)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    joined = keyed.join(repeated, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))

    def urn(c: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, urn("first_id")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, compression: str = "none") -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").option("compression", compression).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_number(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
