"""Running a stream to the end of what is there, into a table in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarden.session import shared_folder


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A given table as a stream of its files; the table may be one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream takes a file's name only as a pattern, and a pattern that fits a folder stands for its files
    return reader.parquet(f"{folder}/{name}.parque[t]")


def append_all(df: DataFrame, path: str | None = None) -> DataFrame:
    """Append mode into files; the sink's own log makes each batch count once. Returns the table."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def upsert_all(df: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Update mode: each batch writes the rows it changed to its own folder, the newest row of a key counts.

    A batch that runs again overwrites its folder, so repeats do no harm.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    values = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def fold_batches(
    df: DataFrame,
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
    state_schema: str,
    path: str | None = None,
) -> DataFrame:
    """Each batch sees the state table that the batch before it left, writes its rows, then its own state table.

    ``step(batch, state)`` gives the rows to write and a function from the written rows to the new state. Rows and
    state of a batch have folders of their own, so a batch that runs again gives the same result. Within a batch
    everything is ordinary DataFrame work: a large key is spread over the tasks, which keyed state would not do.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    schema: list[T.StructType] = []

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        state = own.createDataFrame([], state_schema)
        if epoch > 0:
            state = own.read.schema(state_schema).parquet(f"{path}/state/epoch={epoch - 1}")
        rows, after = step(batch, state)
        rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        written = own.read.schema(rows.schema).parquet(f"{path}/rows/epoch={epoch}")
        after(written).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
        schema.append(rows.schema)

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    reader = spark.read.schema(schema[0]) if schema else spark.read
    return reader.parquet(f"{path}/rows").drop("epoch")
