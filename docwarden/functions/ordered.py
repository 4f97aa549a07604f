"""Ordered computations that do not put a whole key into one task.

One account may own a third of all rows. Each key is therefore cut into slices that keep the order: quantiles of
the ordering value over the whole table, so that no slice is large whatever the distribution, or prefixes of a
hash. Per-slice totals are few and are chained per key; rows are ordered inside their slice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICES = 512


def quantile_slices(df: DataFrame, value: Column, out: str, slices: int = SLICES) -> DataFrame:
    """Add the number of the slice that ``value`` falls into; every slice holds about 1/``slices`` of all rows.

    The bounds come from one pass over a mergeable sketch, and at most ``slices`` of them reach the driver.
    """
    valued = df.withColumn("_value", value.cast("double"))
    bounds = valued.approxQuantile("_value", [i / slices for i in range(1, slices)], 1 / (4 * slices))
    splits = [float("-inf"), *sorted(set(bounds) or {0.0}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_value", outputCol=out, handleInvalid="keep")
    return cut.transform(valued).drop("_value")


def running_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_of: Column,
    out: str,
    carry: DataFrame | None = None,
    total: str | None = None,
) -> DataFrame:
    """1, 2, 3 ... per key in the given order. ``slice_of`` must not decrease along that order.

    ``carry`` has further columns for (some of) the keys, at most one row each. They ride on the slice totals:
    a join of the rows themselves would gather a large key in one task. ``total`` names a column for the number of
    rows of the key.
    """
    cut = [*keys, "_slice"]
    sliced = df.withColumn("_slice", slice_of)
    sizes = sliced.groupBy(*cut).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    chained = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")]
    if total is not None:
        chained.append(F.sum("_n").over(Window.partitionBy(*keys)).alias(total))
    before = sizes.select(*cut, *chained)
    if carry is not None:
        before = before.join(carry, [k for k in keys if k in carry.columns])
    inside = Window.partitionBy(*cut).orderBy(*order)
    return (
        sliced.join(before, cut)
        .withColumn(out, (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
        .drop("_slice", "_before")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, out: str) -> DataFrame:
    """The first k rows of each key with their rank.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) Spark limits each input split to k rows per key.
    A key that is in every split would still send all of those to one task, so they are limited once more per group
    of splits on the way; for a larger k that step is the first to limit.
    """
    grouped = df.withColumn("_group", F.spark_partition_id() % SLICES)
    near = Window.partitionBy(*keys, "_group").orderBy(*order)
    kept = grouped.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= k).drop("_near", "_group")
    return kept.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def group_share(df: DataFrame, keys: Sequence[str], id_column: str, out: str) -> DataFrame:
    """Position of each row among the rows of its key, by the hash of its id, as a share in (0, 1]."""
    hashed = df.withColumn("_hash", F.sha2(F.col(id_column).cast("string"), 256))
    order, prefix = ["_hash", id_column], F.substring("_hash", 1, 3)
    ranked = running_number(hashed, keys, order, prefix, "_rank", total="_size")
    return ranked.withColumn(out, F.col("_rank") / F.col("_size")).drop("_hash", "_rank", "_size")


def next_greater(df: DataFrame, keys: Sequence[str], value: str, distance: int, out: str) -> DataFrame:
    """For every row the smallest value of its key that lies more than ``distance`` above its own, or null.

    Values and the points they look from are cut by common quantiles. A point finds its answer in its own slice,
    else it is the smallest value of the key's next slice that has one.
    """
    none = F.lit(None).cast("bigint")
    looks = df.select(*keys, (F.col(value) + distance).alias("_at"), none.alias("_found"), F.col(value))
    stands = df.select(*keys, F.col(value).alias("_at"), F.col(value).alias("_found"), none.alias(value))
    points = quantile_slices(looks.unionByName(stands), F.col("_at"), "_slice")
    # descending order turns "all that follow" into a frame that grows row by row
    above = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = points.groupBy(*keys, "_slice").agg(F.min("_found").alias("_first"))
    beyond = firsts.select(*keys, "_slice", F.min("_first").over(later).alias("_beyond"))
    inside = points.withColumn("_hit", F.min("_found").over(above)).filter(F.col(value).isNotNull())
    return inside.join(beyond, [*keys, "_slice"]).select(*keys, value, F.coalesce("_hit", "_beyond").alias(out))
