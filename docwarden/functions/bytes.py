"""Byte-level statistics that have no built-in: one Arrow batch in, one out, a 256-bin count per chunk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwarden.session import small_batches


_AT_ONCE = 1 << 22


def entropies(data: bytes, chunk: int) -> np.ndarray:
    """Bits per byte of each ``chunk``-sized piece; what is held beside the data is bounded."""
    codes = np.frombuffer(data, dtype=np.uint8)
    pieces, step = -(-codes.size // chunk), max(1, _AT_ONCE // chunk)
    out = np.empty(pieces)
    for first in range(0, pieces, step):
        part = codes[first * chunk : (first + step) * chunk]
        rows = -(-part.size // chunk)
        counts = np.zeros(rows * 256)
        for at in range(0, part.size, _AT_ONCE):
            some = part[at : at + _AT_ONCE]
            counts += np.bincount(np.arange(at, at + some.size) // chunk * 256 + some, minlength=rows * 256)
        counts = counts.reshape(rows, 256)
        share = counts / counts.sum(axis=1, keepdims=True)
        out[first : first + rows] = -(share * np.log2(share, where=share > 0, out=np.zeros_like(share))).sum(axis=1)
    return np.abs(out)


@F.pandas_udf(T.DoubleType())
def _whole_entropy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: float(entropies(b, len(b))[0]) if b else 0.0).astype("float64")


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of the whole content in bits per byte; 0 when empty."""
    small_batches()
    return _whole_entropy(content)


def chunk_entropy_p95(content: Column, chunk: int = 4096) -> Column:
    """95th percentile (linear interpolation) of the entropies of consecutive chunks; 0 when empty."""
    small_batches()

    @F.pandas_udf(T.DoubleType())
    def p95(content: pd.Series) -> pd.Series:
        return content.map(lambda b: float(np.percentile(entropies(b, chunk), 95)) if b else 0.0).astype("float64")

    return p95(content)
