"""Documents as a sparse matrix of word counts, in shards.

1. Texts are read in blocks of about ``BLOCK`` bytes. A block's words are coded by a vocabulary of its own, and its
   documents become the rows of a CSR shard: where each row starts, its columns and its counts. Shards are written once.
2. The vocabularies, one row for each word and block, are dealt by word and sorted where they are. Each different word
   gets the next number there; with the counts of the parts, which are all that reaches the driver, the numbers run from 0
   without gaps over the whole corpus. A frequent word has one row a block, however often it occurs.
3. The numbers go back to their block as arrays, and the block's columns become numbers of the dictionary.

Words are compared by their bytes. A shard is one row, bounded by ``BLOCK`` and the longest text. Arrays of a shard are
little-endian bytes: Spark moves them as they are.

Defined cases: null and empty texts are empty rows; ids may be null or repeat, each row of the input is a row of the
matrix; a very long text is a shard of its own; an empty table gives an empty matrix; ``carry`` names what else is kept
with a row, whatever its names: they are held in a struct of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from docwarden.llm.common import release, small_batches
from docwarden.llm.word_arrays import split_words
from docwarden.session import settle

BLOCK = 6 << 20

Measure = Callable[[pa.Array], dict[str, pa.Array]]


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint8 if not len(values) or values.max() < 1 << 8 else np.uint16 if values.max() < 1 << 16 else np.uint32)


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(docs: DataFrame, carry: Sequence[str], block: int = BLOCK, measure: Measure | None = None, measured: StructType | None = None) -> DataFrame:
    """(text, *carry) -> one row per block: shard, carried, starts, columns, counts, width, words.

    Columns are places in ``words``, counts are ``width`` bytes wide. ``measure`` adds columns taken from the texts to what is carried.
    """
    kept = StructType([docs.schema[c] for c in carry] + (measured.fields if measured else []))
    names = list(carry)

    def shard(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        text = whole.column("text").combine_chunks()
        words = split_words(text)
        kinds, rows = max(len(words.names), 1), words.rows
        cells, counts = np.unique(rows * kinds + words.codes, return_counts=True)
        starts = np.searchsorted(cells, np.arange(whole.num_rows + 1) * kinds)
        counts = _narrow(counts)
        fields = {c: whole.column(c).combine_chunks() for c in names} | (measure(text) if measure else {})
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                _list(pa.StructArray.from_arrays([fields[f.name] for f in kept.fields], kept.names)),
                _bytes(starts.astype(np.int64)),
                _bytes((cells % kinds).astype(np.uint32)),
                _bytes(counts),
                pa.array([counts.itemsize], pa.int64()),
                _list(words.names.cast(pa.large_string()).cast(pa.string())),
            ],
            names=["shard", "carried", "starts", "columns", "counts", "width", "words"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= block:
                yield shard(held, number)
                held, size, number = [], 0, number + 1
                release()
        if held:
            yield shard(held, number)
            release()

    fields = [
        StructField("shard", LongType()), StructField("carried", ArrayType(kept)),
        *(StructField(c, BinaryType()) for c in ("starts", "columns", "counts")),
        StructField("width", LongType()), StructField("words", ArrayType(StringType())),
    ]
    return docs.select("text", *carry).mapInArrow(rows, StructType(fields))


def number_words(cut: DataFrame) -> DataFrame:
    """Blocks -> (part, shard, local, place, words, first): numbers of words inside each part, as arrays a shard.

    ``local`` and ``place`` hold places in the block's vocabulary and in the part; rows without a shard hold the
    part's new words, the first of which has the number ``first``.
    """
    named = cut.select("shard", F.posexplode("words").alias("local", "word"))
    sorted_words = named.repartition("word").sortWithinPartitions("word")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            changed = np.ones(len(words), bool)
            changed[1:] = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            changed[0] = words[0].as_py() != last
            before, place = count, count - 1 + np.cumsum(changed)
            last, count = words[len(words) - 1].as_py(), int(place[-1]) + 1
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            kinds, first = np.unique(shard[order], return_index=True)
            local = np.split(batch.column("local").to_numpy().astype(np.uint32)[order], first[1:])
            places = np.split(place[order], first[1:])
            n = len(kinds) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()),
                    pa.array([*kinds.tolist(), None], pa.int64()),
                    pa.array([*(x.tobytes() for x in local), None], pa.binary()),
                    pa.array([*(x.astype(np.int64).tobytes() for x in places), None], pa.binary()),
                    pa.array([*[None] * len(kinds), words.filter(pa.array(changed)).to_pylist()], pa.list_(pa.string())),
                    pa.array([*[None] * len(kinds), before], pa.int64()),
                ],
                names=["part", "shard", "local", "place", "words", "first"],
            )

    return sorted_words.mapInArrow(rows, "part int, shard long, local binary, place binary, words array<string>, first long")


@dataclass
class TermMatrix:
    """CSR shards with the numbers of their columns beside them; ``dictionary`` is (term, word)."""

    joined: DataFrame
    dictionary: DataFrame
    kept: StructType

    def _map(self, make: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: StructType) -> DataFrame:
        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    raw = {c: row.column(c)[0].as_py() for c in ("starts", "columns", "counts", "width")}
                    starts, local = np.frombuffer(raw["starts"], np.int64), np.frombuffer(raw["columns"], np.uint32)
                    counts = np.frombuffer(raw["counts"], {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw["width"]])
                    terms = np.zeros(int(local.max()) + 1 if len(local) else 0, np.int64)
                    for piece in row.column("terms")[0].as_py() or []:
                        terms[np.frombuffer(piece["local"], np.uint32)] = piece["base"] + np.frombuffer(piece["place"], np.int64)
                    columns = terms[local]
                    order = np.lexsort((columns, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                    yield make(row.column("carried").flatten(), starts, columns[order], counts[order].astype(np.int64))
                release()

        return self.joined.mapInArrow(shards, schema)

    def cells(self) -> DataFrame:
        """One row for each document: carried, terms and counts, by term."""

        def made(carried: pa.Array, starts: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v)) for v in (columns, counts)]
            return pa.RecordBatch.from_arrays([carried, *lists], names=["carried", "terms", "counts"])

        longs = ArrayType(LongType())
        return self._map(made, StructType([StructField("carried", self.kept), StructField("terms", longs), StructField("counts", longs)]))

    def totals(self) -> DataFrame:
        """One row for each document: the carried columns, n_words (the row's sum) and n_distinct (its nonzero cells)."""
        kept = self.kept

        def made(carried: pa.Array, starts: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            sums = np.concatenate(([0], np.cumsum(counts)))[starts]
            # a column counts once in its row
            new = np.ones(len(columns), np.int64)
            new[1:] = columns[1:] != columns[:-1]
            new[starts[:-1][starts[:-1] < len(columns)]] = 1
            cells = np.concatenate(([0], np.cumsum(new)))[starts]
            return pa.RecordBatch.from_arrays([*carried.flatten(), pa.array(np.diff(sums)), pa.array(np.diff(cells))], names=[*kept.names, "n_words", "n_distinct"])

        return self._map(made, StructType([*kept.fields, StructField("n_words", LongType()), StructField("n_distinct", LongType())]))


def term_matrix(docs: DataFrame, carry: Sequence[str], block: int = BLOCK, measure: Measure | None = None, measured: StructType | None = None) -> TermMatrix:
    """The matrix of (text, *carry)."""
    small_batches(docs)
    spark = docs.sparkSession
    cut = settle(blocks(docs, carry, block, measure, measured))
    numbered = settle(number_words(cut))
    # one number a part: as many as there are shuffle partitions
    sizes = sorted(numbered.filter("words is not null").groupBy("part").agg(F.sum(F.size("words"))).collect())
    bases, total = [], 0
    for part, size in sizes:
        bases.append((part, total))
        total += size
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    terms = (
        numbered.filter("shard is not null").join(base, "part").groupBy("shard").agg(F.collect_list(F.struct("local", "place", "base")).alias("terms"))
    )
    return TermMatrix(cut.drop("words").join(terms, "shard", "left"), _dictionary(numbered, base), cut.schema["carried"].dataType.elementType)


def _dictionary(numbered: DataFrame, base: DataFrame) -> DataFrame:
    """(term, word): a part's new words, in the order in which they were numbered."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, words = batch.column("first")[i].as_py(), batch.column("words").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(words))), words], names=["term", "word"])

    new = numbered.filter("words is not null").join(base, "part").select((F.col("base") + F.col("first")).alias("first"), "words")
    return new.mapInArrow(rows, "term long, word string")
