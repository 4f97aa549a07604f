"""Sharding: a Feistel permutation over global row numbers.

Row numbers 0..n-1 are permuted by a balanced Feistel network over the next even number of bits; values that fall
outside 0..n-1 are put through the network again until they fall inside (cycle walking). The image ``y`` of a row
gives its shard ``y % shards`` and its slot ``y // shards``: counts differ by one at most, slots have no gap, and
both are computed from the row number alone, in either direction (``row_at``).

Null ids and texts sort first and are dealt out like all others; rows that agree in every ordering key are
interchangeable; an empty table gives an empty result. Columns of the input that are called ``row_no``, ``shard`` or
``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import in_order

ROUNDS = 6
#: Odd and below 2^31, so that its product with a half of 32 bits fits a signed 64-bit number.
MULTIPLIER = 1540483477
KEY_STEP = 668265263


def round_keys(seed: int) -> list[int]:
    return [(seed * 2654435761 + (i + 1) * KEY_STEP) % (1 << 31) for i in range(ROUNDS)]


def half_bits(rows: int) -> int:
    """Half the bits of the smallest even-width domain that holds all rows."""
    bits = 1
    while 1 << (2 * bits) < rows:
        bits += 1
    return bits


def _network(x: np.ndarray, bits: int, keys: Sequence[int]) -> np.ndarray:
    mask = np.int64((1 << bits) - 1)
    left, right = x >> np.int64(bits), x & mask
    for key in keys:
        mixed = right * np.int64(MULTIPLIER) + np.int64(key)
        left, right = right, left ^ ((mixed ^ (mixed >> np.int64(15))) & mask)
    return (left << np.int64(bits)) | right


def _backwards(x: np.ndarray, bits: int, keys: Sequence[int]) -> np.ndarray:
    mask = np.int64((1 << bits) - 1)
    left, right = x >> np.int64(bits), x & mask
    for key in reversed(keys):
        mixed = left * np.int64(MULTIPLIER) + np.int64(key)
        left, right = right ^ ((mixed ^ (mixed >> np.int64(15))) & mask), left
    return (left << np.int64(bits)) | right


def _walk(step, x: np.ndarray, rows: int, bits: int, keys: Sequence[int]) -> np.ndarray:
    y = step(x.astype(np.int64), bits, keys)
    while (out := y >= rows).any():
        y[out] = step(y[out], bits, keys)
    return y


def permuted(x: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """Images of row numbers below ``rows``: a bijection of 0..rows-1."""
    return _walk(_network, x, rows, half_bits(rows), round_keys(seed))


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int = 0) -> int:
    """The row number that lies in a slot of a shard."""
    y = np.array([slot * shards + shard])
    return int(_walk(_backwards, y, rows, half_bits(rows), round_keys(seed))[0])


def permute(row_no: Column, rows: int, seed: int = 0) -> Column:
    @F.pandas_udf("long")
    def image(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), rows, seed))

    return image(row_no)


def shuffle_rows(df: DataFrame, order: Sequence[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long) to every row; ``order`` names the columns that number the rows."""
    numbered, rows = in_order(df.drop("row_no", "shard", "slot"), order)
    image = numbered.withColumn("_image", permute(F.col("row_no"), rows, seed))
    return image.withColumns(
        {"shard": (F.col("_image") % shards).cast("int"), "slot": F.floor(F.col("_image") / shards).cast("long")}
    ).drop("_image", "row_no")


def write_shards(df: DataFrame, order: Sequence[str], shards: int, path: str, pieces: int = 1, seed: int = 0) -> None:
    """Write whole rows below ``path/shard=k``, each shard in slot order cut into ``pieces`` ranges of slots."""
    placed = shuffle_rows(df, order, shards, seed)
    rows_per_piece = F.greatest(F.lit(1), F.ceil(F.lit(df.count() / shards / pieces)))
    placed = placed.withColumn("piece", F.floor(F.col("slot") / rows_per_piece))
    placed.repartition(shards * pieces, "shard", "piece").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard", "piece"
    ).parquet(path)
