"""Zip archives as member rows, and back.

The archive directory and the inflation need zip code, so these two steps run in Python on Arrow batches. All
counting and filtering is done on the member rows by Spark.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarden.session import small_batches

MEMBER_SCHEMA = "file_id bigint, pos int, member string, body binary"


def _members(content: bytes) -> list[tuple[str, bytes | None]]:
    """Names and bodies; an unreadable archive has none, an unreadable member has a name only."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            found = []
            for info in archive.infolist():
                try:
                    found.append((info.filename, archive.read(info)))
                except Exception:
                    found.append((info.filename, None))
            return found
    except Exception:
        return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(content: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> list[str] | None:
        if not data:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return archive.namelist()
        except Exception:
            return None

    return content.map(one)


def member_names(content: Column) -> Column:
    """Names of an archive's members in their order, null for what is no archive. Only the directory is read."""
    small_batches()
    return _names(content)


def explode_members(df: DataFrame) -> DataFrame:
    """(file_id, content) -> one row per member, in archive order.

    One output batch per archive: memory holds one inflated file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if not data:
                    continue
                members = _members(data)
                if members:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file_id] * len(members), pa.int64()),
                            pa.array(range(1, len(members) + 1), pa.int32()),
                            pa.array([m for m, _ in members], pa.string()),
                            pa.array([b for _, b in members], pa.binary()),
                        ],
                        names=["file_id", "pos", "member", "body"],
                    )

    small_batches(df)
    return df.select("file_id", "content").mapInArrow(run, MEMBER_SCHEMA)


@F.pandas_udf(T.BinaryType())
def _zip_up(members: pd.Series) -> pd.Series:
    def one(rows: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for row in rows:
                # a fixed date keeps the bytes the same on every run
                info = zipfile.ZipInfo(row["member"], date_time=(1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, row["body"] or b"")
        return out.getvalue()

    return members.map(one)


def zip_array(members: Column) -> Column:
    """Archive bytes from an array of (pos, member, body)."""
    small_batches()
    return _zip_up(members)


def rebuild_archives(members: DataFrame) -> DataFrame:
    """Member rows -> (file_id, content). A group is the members of one file, so its size is that of the file."""
    packed = members.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "member", "body"))).alias("members")
    )
    return packed.select("file_id", zip_array(F.col("members")).alias("content"))
