"""Words and windows of words as 64-bit hashes, for use inside Arrow tasks.

Words are runs of anything but ASCII white space, which is what ``bytes.split`` cuts at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def slices(texts: Sequence[str | None] | np.ndarray, chars: int = 1 << 20) -> Iterator[slice]:
    """Cut a batch, given its texts or their lengths, into runs of rows of about ``chars`` characters, so that what is held at once is bounded."""
    lengths = texts.tolist() if isinstance(texts, np.ndarray) else [len(t or "") for t in texts]
    start, held = 0, 0
    for i, length in enumerate(lengths):
        held += length
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each window of ``k`` hashes, in order; none if there are fewer."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * _PRIME
        out ^= out >> _SHIFT
    return out


def shingle_set(text: str | None, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a shorter text is one shingle, a text without words none."""
    raw = as_bytes(text)
    words = (raw.lower() if lower else raw).split()
    return np.unique(window_hashes(word_hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def in_repeated_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each word whether it lies in a window of ``k`` words that the text holds twice or more."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    windows = window_hashes(hashes, k)
    if len(windows):
        _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[where] > 1)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + k, -1)
    return np.cumsum(covered[:-1]) > 0
