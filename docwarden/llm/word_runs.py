"""Periodic runs of words by Baier grouping.

A run is a stretch of consecutive words with smallest period q, at least ``max(least, times * q)`` words long, that no
neighbouring word extends. Each text is searched inside one task:

1. A run of exponent ``times`` holds each of its words ``times`` times and each pair of neighbouring words at least
   ``times - 1`` times. Words and pairs that are rarer in their stretch cut it; what stays is searched whole, so nothing is lost.
2. Phase one of Baier's suffix sorting groups the suffixes of a stretch by their longest Lyndon prefix: groups are
   taken from the greatest down, and each suffix of a group lengthens the prefix of the nearest suffix to its left
   that is still waiting. The lengths at which groups are taken are the Lyndon array. It is made under an order of
   the words and under the opposite order.
3. By the runs theorem every run has a Lyndon root under one of both orders. Each Lyndon word is a candidate root; it
   is extended by the longest common extensions to both sides of the text and the text moved by the root's length,
   read from the nearest mismatches.

Words are told apart by their bytes, without hashing. Time and memory of a text are linear in its length but for step
3, which passes over a stretch once for each different length of a root that repeats.

Defined cases: null, empty and blank texts have no words and no run; ids may be null or repeat, every row gives a row;
ties for the greatest run go to the smallest start, then period; very long texts are searched whole, in one task each; an
empty table gives an empty result; only ``key`` and ``text`` are read, other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import release, small_batches
from docwarden.llm.word_arrays import Words, split_words

TIMES, LEAST = 4, 6
#: Cutting stops here at the latest; it only saves work.
CUTS = 8


def stretches(words: Words, times: int = TIMES, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of ``words.codes`` outside of which no run lies; none crosses a row."""
    n, kinds = len(words.codes), len(words.names)
    at, part = np.arange(n), words.rows
    codes = words.codes
    for _ in range(CUTS):
        before = len(at)
        group, _ = pd.factorize(part * kinds + codes)
        often = np.bincount(group)[group] >= times if len(at) else np.empty(0, bool)
        joined = (at[1:] == at[:-1] + 1) & (part[1:] == part[:-1]) & often[1:] & often[:-1]
        pairs, _ = pd.factorize(codes[:-1][joined] * kinds + codes[1:][joined])
        inside, _ = pd.factorize(part[:-1][joined] * (len(pairs) + 1) + pairs)
        rare = np.flatnonzero(joined)[np.bincount(inside)[inside] < times - 1] if len(pairs) else np.empty(0, np.int64)
        joined[rare] = False
        # words that are still joined to a neighbour, in stretches that are long enough
        if not len(at):
            return
        stretch = np.concatenate(([0], np.cumsum(~joined)))
        stays = np.bincount(stretch)[stretch] >= least
        at, codes, part = at[stays], codes[stays], stretch[stays]
        if len(at) == before:
            break
    if len(at):
        edges = np.flatnonzero(np.diff(part)) + 1
        yield from zip(at[np.concatenate(([0], edges))].tolist(), (at[np.concatenate((edges - 1, [len(at) - 1]))] + 1).tolist(), strict=True)


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position, by the groups of Baier's first phase."""
    n = len(ranks)
    _, firsts = np.unique(ranks, return_inverse=True)
    kinds = int(firsts.max()) + 1 if n else 0
    group = firsts.tolist()
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, g in enumerate(group):
        members[g].append(i)
    width = [1] * kinds
    below, above = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    left = list(range(-1, n - 1))
    out = [0] * n
    top = kinds - 1
    while top >= 0:
        mine = [i for i in members[top] if group[i] == top]
        members[top] = []
        size = width[top]
        for i in mine:
            out[i] = size
            group[i] = -1
        # the nearest waiting suffix to the left of each, and how often it is met
        met: dict[int, int] = {}
        for i in mine:
            j = left[i]
            while j >= 0 and group[j] < 0:
                left[i] = j = left[j]
            if j >= 0:
                met[j] = met.get(j, 0) + 1
        lengthened: dict[tuple[int, int], list[int]] = {}
        for j, times in met.items():
            lengthened.setdefault((times, group[j]), []).append(j)
        # those met most often are the greatest: each new group goes right above the one it leaves
        for times, old in sorted(lengthened, reverse=True):
            new, moved = len(members), lengthened[times, old]
            members.append(moved)
            width.append(width[old] + times * size)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for j in moved:
                group[j] = new
        top = below[top]
    return np.array(out, np.int64)


def runs(codes: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    n = len(codes)
    if not n:
        return []
    found: set[tuple[int, int, int]] = set()
    starts, periods = [], []
    for ranks in (codes, -codes):
        period = lyndon_array(ranks)
        at = np.arange(n)
        # the first root of a run has another times - 2 periods behind it that lie in the run
        fits = at + (times - 1) * period <= n
        at, period = at[fits], period[fits]
        for m in (min(1, times - 2), times - 2):
            moved = at + m * period
            alike = (codes[at] == codes[moved]) & (codes[at + period - 1] == codes[moved + period - 1])
            at, period = at[alike], period[alike]
        starts.append(at)
        periods.append(period)
    start, period = np.concatenate(starts), np.concatenate(periods)
    order = np.argsort(period, kind="stable")
    start, period = start[order], period[order]
    for p, mine in zip(*_by_value(period, start), strict=True):
        # extensions of the text and the text moved by p end at the nearest mismatches
        unlike = np.flatnonzero(codes[:-p] != codes[p:])
        after = np.searchsorted(unlike, mine)
        stops = np.append(unlike, n - p)[after] + p
        begins = np.concatenate(([-1], unlike))[after] + 1
        long = stops - begins >= max(least, times * p)
        found.update((int(b), int(e - b), int(p)) for b, e in set(zip(begins[long].tolist(), stops[long].tolist(), strict=True)))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _by_value(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys and the values of each."""
    kinds, at = np.unique(keys, return_index=True)
    return kinds.tolist(), np.split(values, at[1:]) if len(kinds) else []


def word_runs(docs: DataFrame, key: str = "doc_id", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(key, text) -> (key, n_words, runs, collapsed): the runs of each text, and its words without the repeats.

    ``runs`` is an array of (start, length, period) by start and period, start counting words from 0. A word is left
    out of ``collapsed`` if a run holds it after that run's first period; the others are joined by one blank.
    """
    small_batches(docs)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column("text"))
            dropped = np.zeros(len(words.codes) + 1, np.int32)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for a, b in stretches(words, times, least):
                row = int(np.searchsorted(words.bounds, a, side="right")) - 1
                begin = a - int(words.bounds[row])
                for start, length, period in runs(words.codes[a:b], times, least):
                    found[row].append((begin + start, length, period))
                    dropped[a + start + period] += 1
                    dropped[a + start + length] -= 1
            kept = np.cumsum(dropped[:-1]) == 0
            sizes = np.concatenate(([0], np.cumsum(kept)))[words.bounds]
            spelt = pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), words.names.take(pa.array(words.codes[kept])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.diff(words.bounds), pa.int64()),
                    pa.array(found, kind),
                    pc.binary_join(spelt, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string()),
                ],
                names=[key, "n_words", "runs", "collapsed"],
            )
            release()

    name = f"`{key}` {docs.schema[key].dataType.simpleString()}"
    return docs.select(key, "text").mapInArrow(rows, f"{name}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def greatest(found: str = "runs") -> F.Column:
    """The run with most words; ties go to the smallest start, then period. Null without a run."""
    return F.array_max(
        F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"), r.alias("run")))
    )["run"]
