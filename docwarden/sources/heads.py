"""A file source that reads what it is asked for: heads, archive directories, and contents only where they are wanted.

``read_heads(spark, root, "path", "ext", "members")`` opens a file for its first bytes and, if it is an archive, seeks to the
directory at its end; files that the pushed conditions on ``ext`` and ``length`` rule out are not opened. Files are listed
when the read is planned and dealt to tasks by the bytes that a task will read; what falls to each task is written to a list
in the shared folder, so that the driver holds no names. Any file system that Arrow knows will do; on others than the local one
the driver holds the names of one folder at a time.

Defined cases: an empty folder gives no rows; a file that cannot be read keeps its row, with nulls and the reason in
``error``; ``members`` is null for what is no archive; a head that is blank is read on until it is not, so that leading blanks of
any length do not hide a type.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from docwarden.session import shared_folder, small_batches

SCHEMA = {
    "path": "string", "length": "bigint", "ext": "string", "head": "binary", "members": "array<string>", "content": "binary",
    "bytes_read": "bigint", "error": "string",
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
HEAD_BYTES, BLANKS = 1024, b" \t\n\r\x0b\x0c"
#: What an opened file costs beside its bytes.
OPEN_BYTES = 64 << 10


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return os.path.splitext(name)[1].lower()


class _Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file) -> None:
        self.file, self.bytes = file, 0

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(None if n is None or n < 0 else n)
        self.bytes += len(data)
        return data

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True


def _names(file: _Counted) -> list[str] | None:
    try:
        with zipfile.ZipFile(file) as archive:
            return archive.namelist()
    except Exception:
        return None


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path, length) of what lies in a folder, a folder in it without length; a local folder is not held as a whole."""
    if not isinstance(fs, pafs.LocalFileSystem):
        for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if i.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield i.path, i.size if i.type == pafs.FileType.File else None
        return
    try:
        opened = os.scandir(folder)
    except FileNotFoundError:
        return
    with opened:
        for entry in opened:
            try:
                if entry.is_dir() or entry.is_file():
                    yield entry.path, None if entry.is_dir() else entry.stat().st_size
            except FileNotFoundError:  # gone since
                continue


def listed(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """(path, length) of all files below a folder but hidden ones."""
    for path, size in _entries(fs, folder):
        if size is None:
            yield from listed(fs, path)
        elif not path.rsplit("/", 1)[-1].startswith((".", "_")):
            yield path, size


class _Files(InputPartition):
    """Files by name, or the stretch of a list that names them."""

    def __init__(self, files: list[tuple[str, int]], stretch: tuple[str, int, int] | None = None) -> None:
        self.named, self.stretch = files, stretch

    @property
    def files(self) -> list[tuple[str, int]]:
        if self.stretch is None:
            return self.named
        path, start, size = self.stretch
        fs, path = file_system(path)
        with fs.open_input_file(path) as opened:
            opened.seek(start)
            return [(path, size) for path, size in json.loads(opened.read(size))]


_COMPARE = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class _Reader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], split_bytes: int, lists: str | None = None) -> None:
        self.root, self.columns, self.split, self.lists = root, columns, split_bytes, lists
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):  # noqa: N802  the name is Spark's
        for f in filters:
            field = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if field in ("ext", "length") and type(f) in _COMPARE:
                self.tests.append((field, type(f), f.value))
            else:
                yield f

    def _wanted(self, path: str, size: int) -> bool:
        facts = {"ext": suffix(path), "length": size}
        return all(_COMPARE[kind](facts[field], value) for field, kind, value in self.tests)

    def _dealt(self, files: Iterable[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
        part: list[tuple[str, int]] = []
        held = 0
        for path, size in files:
            cost = OPEN_BYTES + (size if "content" in self.columns else min(size, HEAD_BYTES))
            if part and held + cost > self.split:
                yield part
                part, held = [], 0
            part.append((path, size))
            held += cost
        if part:
            yield part

    def partitions(self) -> list[_Files]:
        fs, folder = file_system(self.root)
        dealt = self._dealt((path, size) for path, size in listed(fs, folder) if self._wanted(path, size))
        if self.lists is None:
            return [_Files(part) for part in dealt] or [_Files([])]
        fs, folder = file_system(self.lists)
        fs.create_dir(folder, recursive=True)
        name, start, parts = uuid.uuid4().hex, 0, []
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for part in dealt:
                data = json.dumps(part).encode()
                out.write(data)
                parts.append(_Files([], (f"{self.lists}/{name}", start, len(data))))
                start += len(data)
        return parts or [_Files([])]

    def _one(self, fs: pafs.FileSystem, path: str, size: int) -> dict:
        row = dict.fromkeys(SCHEMA) | {"path": path, "length": size, "ext": suffix(path), "bytes_read": 0}
        if not {"head", "members", "content"} & set(self.columns):
            return row
        file = None
        try:
            with fs.open_input_file(path) as opened:
                file = _Counted(opened)
                head = file.read(HEAD_BYTES)
                while head and not head.strip(BLANKS) and (more := file.read(HEAD_BYTES)):
                    head += more
                if "content" in self.columns:
                    row["content"] = head + file.read()
                if "members" in self.columns and head.startswith(b"PK"):
                    row["members"] = _names(file)
                row["head"] = head if "head" in self.columns else None
        except OSError as failed:
            row["error"] = f"{type(failed).__name__}: {failed}"[:200]
        row["bytes_read"] = file.bytes if file else 0
        return row

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.root)
        kinds = [_ARROW[SCHEMA[c]] for c in self.columns]
        rows, size = [], 0
        for path, length in partition.files:
            row = self._one(fs, path, length)
            rows.append([row[c] for c in self.columns])
            size += len(row["content"] or b"") + len(row["head"] or b"")
            if size > 4 << 20 or len(rows) == 1000:
                yield _batch(rows, self.columns, kinds)
                rows, size = [], 0
        if rows:
            yield _batch(rows, self.columns, kinds)


def _batch(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class FileHeads(DataSource):
    """Options: ``path``, ``split_mb`` (64): bytes that one task reads, ``lists``: a shared folder for the names of the files.

    Without ``lists`` the names travel through the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in SCHEMA.items())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema.names, int(self.options.get("split_mb", 64)) << 20, self.options.get("lists"))


def read_heads(spark: SparkSession, root: str, *columns: str, split_mb: int = 64) -> DataFrame:
    """Files below ``root`` with these columns of ``SCHEMA``, all but the content if none are named.

    A column that is not asked for is not read: without head, members and content no file is opened. The lists of files go to the
    folder in ``spark.checkpoint.dir``, which Arrow must know as well.
    """
    wanted = columns or tuple(c for c in SCHEMA if c != "content")
    if unknown := set(wanted) - set(SCHEMA):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    spark.dataSource.register(FileHeads)
    # a reader that takes filters is refused without it
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = ", ".join(f"{c} {SCHEMA[c]}" for c in wanted)
    lists = f"{shared_folder(spark)}/listed"
    return spark.read.format("file_heads").schema(schema).option("split_mb", split_mb).option("lists", lists).load(root)


def write_files(df: DataFrame, root: str) -> int:
    """(path, content) -> files below ``root``, and their number. A repeated task writes the same files again.

    Each file is written under a name of its own and moved into place, so a reader never sees a part of one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                target = f"{folder}/{path}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target.rsplit('/', 1)[0]}/.{os.urandom(8).hex()}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_py() or b"")
                fs.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    small_batches(df)
    written = df.select("path", "content").mapInArrow(rows, "n long")
    return written.groupBy().sum("n").first()[0] or 0
