"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.session import settle, small_batches  # noqa: F401  operators take it from here

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give freed memory of this Python worker back: workers are kept between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def n_words(text: str | Column) -> Column:
    """Number of words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(df: DataFrame, keys: Sequence[str | Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Add the global row number by ``keys`` (from 0, nulls first) and return the number of rows as well.

    Rows are dealt by range, sorted inside each range and written with their place. Only the row counts of the
    ranges reach the driver; rows that agree in all keys are interchangeable. Give keys that tell rows apart, so that
    no range holds more than its share.
    """
    spark = df.sparkSession
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    place = F.monotonically_increasing_id()
    sorted_rows = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", place))
    part = F.shiftright("_at", 33)
    # one row per range, as many as there are shuffle partitions
    sizes = sorted(sorted_rows.groupBy(part.alias("p")).count().collect())
    total, starts = 0, []
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    numbered = (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_start", "_at")
    )
    return numbered, total
