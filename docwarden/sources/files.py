"""Files as rows: labelled trees, bounded reads, content-addressed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import fixed, text


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Every file below ``root`` as (path, modified, length, content, ext).

    A file above the size limit keeps its row, without content and with a reason in ``rejected``; the limit is a
    predicate on ``length``, so the reader never opens such a file.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _as_files(df, max_bytes)


def read_arriving_files(spark: SparkSession, root: str, files_per_batch: int = 1000, max_bytes: int | None = None) -> DataFrame:
    """The same rows for files as they appear below ``root``, a bounded number of them per batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    return _as_files(reader.option("maxFilesPerTrigger", files_per_batch).load(root), max_bytes)


def _as_files(df: DataFrame, max_bytes: int | None) -> DataFrame:
    def rows(part: DataFrame, content: Column, rejected: Column) -> DataFrame:
        return part.select(
            F.xxhash64("path").alias("file_id"),
            "path",
            F.col("modificationTime").alias("modified"),
            "length",
            content.alias("content"),
            text.split_ext(F.col("path")).alias("ext"),
            rejected.cast("string").alias("rejected"),
        )

    if max_bytes is None:
        return rows(df, F.col("content"), F.lit(None))
    read = rows(df.filter(F.col("length") <= max_bytes), F.col("content"), F.lit(None))
    return read.unionByName(rows(df.filter(F.col("length") > max_bytes), F.lit(None).cast("binary"), F.lit("file too large")))


def scan_labelled_tree(spark: SparkSession, root: str) -> DataFrame:
    """Training files from ``root/{json_features,office_pdf}/{benign,malicious}/**`` with label and source.

    ``file_id`` is the hash of the whole content.
    """
    # the suffix lists need no content, so unmatched files are never opened
    placed = read_files(spark, root).withColumn(
        "source", F.regexp_extract("path", r"/(json_features|office_pdf)/(benign|malicious)/", 1)
    )
    wanted = ((F.col("source") == "json_features") & (F.col("ext") == ".json")) | (
        (F.col("source") == "office_pdf") & F.col("ext").isin(*fixed.SUPPORTED_EXTS)
    )
    label = F.regexp_extract("path", r"/(json_features|office_pdf)/(benign|malicious)/", 2)
    return placed.filter(wanted).select(
        F.sha2("content", 256).alias("file_id"),
        "path",
        "ext",
        (label == "malicious").cast("int").alias("label"),
        "source",
        "content",
    )


def bounded(content: Column, limit: int) -> Column:
    """At most ``limit`` leading bytes, nothing for a missing file."""
    return F.coalesce(F.substring(content, 1, limit), F.lit(b"").cast("binary"))


def write_splits(df: DataFrame, path: str) -> None:
    """Split table laid out as split / source / label folders."""
    df.write.mode("overwrite").partitionBy("split", "source", "label").parquet(path)


def store_by_hash(new: DataFrame, path: str, name: str = "filename", clean: bool = False) -> None:
    """Add the contents that the store at ``path`` lacks; equal contents are stored once.

    Contents are named by hash and file name, cleaned ones with a mark in between.

    The keeper of each hash is chosen from ids alone, so contents are not shuffled to find duplicates.
    """
    spark = new.sparkSession
    keyed = new.withColumn("sha256", F.sha2("content", 256)).withColumn(
        "stored_as", F.concat_ws("_clean_" if clean else "_", F.col("sha256"), F.col(name))
    )
    keepers = keyed.groupBy("sha256").agg(F.min("file_id").alias("file_id"))
    try:
        known = spark.read.parquet(path).select("sha256")
        keepers = keepers.join(known, "sha256", "left_anti")
    except Exception as missing:  # no store yet
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    fresh = keyed.join(keepers, ["file_id", "sha256"], "left_semi")
    fresh.write.mode("append").parquet(path)


def write_bucket(df: DataFrame, root: str, bucket: str) -> None:
    """One of the three blob tables: uploads, sanitized, reports. Metadata stays in plain columns."""
    if bucket not in ("uploads", "sanitized", "reports"):
        raise ValueError(f"unknown bucket {bucket}")
    df.write.mode("append").parquet(f"{root}/{bucket}")


def fetch_owned(df: DataFrame, item_id: object, user_id: object, id_column: str = "id") -> DataFrame:
    """Row of one id, only if it belongs to the user; both filters reach the scan."""
    return df.filter((F.col(id_column) == item_id) & (F.col("user_id") == user_id))
