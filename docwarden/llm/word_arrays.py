"""Words of a batch of texts as one array of codes, made from the batch's own bytes without a Python object a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that part words: blank, tab, line feed, vertical tab, form feed and carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a word of letters and digits; bytes of other alphabets are part of one.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(b).isalnum() for b in range(128)]
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


@dataclass
class Words:
    """``codes[bounds[r]:bounds[r + 1]]`` are the words of row r; ``names`` holds each code's bytes."""

    codes: np.ndarray
    names: pa.Array
    bounds: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and where each text starts (and the last one ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return whole, at - at[0]


def split_words(texts: pa.Array, parts: np.ndarray = BLANK, to: np.ndarray = AS_IS) -> Words:
    """Words of each text: maximal runs of bytes that are not in ``parts``, with their bytes mapped by ``to``."""
    data, at = text_bytes(texts)
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's end parts words as well
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts)))
    spelt = to[data[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(spelt)])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(starts, at))
