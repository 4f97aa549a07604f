"""Session and shared-folder settings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "docwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; a cluster's own settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # plans of many expressions are built faster without a call site per expression
        "spark.sql.dataFrameQueryContext.enabled": "false",
        # archive and entropy tasks ship whole files through Arrow: a byte limit per batch bounds the memory
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only when a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="docwarden-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over all cores when the scan itself yields fewer tasks than there are cores.

    A table with a split for every core is returned as it is: a large corpus is never moved. Keys are ids, so the
    placement is the same when a lost task runs again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    A plain column is repeated inside every later filter that mentions it, and with it all it is made of. Columns
    that come out of a generator are not: filters on them stay above it.
    """
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select(*[c for c in df.columns if c not in columns], F.inline(made))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame | None = None) -> None:
    """Limit the session's Arrow batches to 4 MB: whole files and texts pass through several Python workers an executor.

    A lower limit of the session stays.
    """
    spark = df.sparkSession if df is not None else SparkSession.getActiveSession()
    if spark is None:
        return
    given = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(_BATCH_BYTES, "64m").lower())
    if given is None or not 0 < int(given[1]) << 10 * " kmgt".index(given[2] or " ") < 4 << 20:
        spark.conf.set(_BATCH_BYTES, "4m")
