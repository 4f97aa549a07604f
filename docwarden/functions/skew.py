"""Joins whose left side may hold one key very often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-3


def attach_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Inner join with a right side that has one row per key and knows, in ``weight``, how often the left holds it.

    Keys with more than a thousandth of all left rows are fewer than a thousand, so that part of the right side
    is broadcast and the hot rows stay where they are. They are taken out of the left side before the rest of it is
    joined by hash.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = right.filter(F.col(weight) > limit)
    rest = right.filter(F.col(weight) <= limit)
    on = list(keys)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(cold.join(rest, on))


def left_join_known(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key stay where they are, instead of meeting in one task to find nothing."""
    known = df.filter(F.col(key).isNotNull()).join(other, key, "left")
    return known.unionByName(df.filter(F.col(key).isNull()), allowMissingColumns=True)
