"""SentencePiece encoding and decoding as a relational lattice.

1. Texts are cut into units that no piece crosses: wherever two bytes meet that stand side by side in no piece. The
   best way through a text is that of its units one after the other. The distinct units of the corpus are counted.
2. Each unit's substrings of at most the longest piece's length are exploded and joined to the piece table (a
   vocabulary of fixed size, broadcast); a character without a piece gets the unknown edge. Edges are grouped by unit
   without another exchange and folded with ``aggregate``: the best way to each end position, by the sum of scores.
3. Documents are encoded by looking their units up. Units by falling count, at most ``MAX_ENTRIES``
   with ``PIECES_PER_ENTRY`` times as many pieces, go to the tasks as sorted hash arrays (at most 32 bytes a unit, so the
   size is bounded whatever the corpus); documents that
   hold other units are the only ones that move: their missing units are joined by unit and sent back by document.

The objective is the unigram one: the segmentation with the greatest sum of piece scores, ties to the earlier start,
as SentencePiece computes for a unigram model. A model file of another type gives its pieces and scores to the same
objective; its own merge order is not reproduced. Characters without a piece become byte pieces if the model has
them, else the unknown id. Only the identity normalisation is supported and checked.

Units longer than ``LONG_UNIT`` characters are folded by the same recurrence in a loop inside a task, because the
higher-order fold copies its state at every position.

Defined cases: null and empty texts have no pieces; repeated ids are encoded each; an empty table gives an empty
result; decoding gives the text back exactly, but for U+2581 in the source, which the format itself reads as a blank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from docwarden.llm.common import release, small_batches
from docwarden.llm.shingles import slices
from docwarden.llm.word_arrays import Words, text_bytes
from docwarden.session import settle

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BLOCK, MAX_ENTRIES, PIECES_PER_ENTRY, LONG_UNIT = 4 << 20, 1 << 23, 8, 256
#: Units whose edges one task of the lattice holds at once.
UNITS_PER_TASK = 4_000
#: Such groups of units that one task goes through, one after the other, into one file.
GROUPS_PER_FILE = 16
#: Characters of texts whose units a task looks up at once.
CHARS_AT_ONCE = 1 << 18
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """What is needed of a model: pieces with scores, and ids for what has no piece."""

    pieces: list[str]
    ids: list[int]
    scores: list[float]
    unknown: int
    unknown_score: float
    bytes_from: int | None
    surface: list[bytes]
    prefix: bool
    #: For each two bytes whether a unit may end between them.
    cuts: np.ndarray

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation and word marks in front are supported")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i, p in enumerate(proto.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)]
    pieces = [proto.pieces[i].piece for i in normal]
    inside = np.zeros((256, 256), bool)
    for p in pieces:
        spelt = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
        inside[spelt[:-1], spelt[1:]] = True
    # never inside a character
    inside[:, 0x80:0xC0] = True
    scores = [float(proto.pieces[i].score) for i in normal]
    base = model.piece_to_id("<0x00>") if proto.trainer_spec.byte_fallback else None
    surface = [
        bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else b"" if p.type in (p.CONTROL,) else p.piece.replace(MARK, " ").encode()
        for p in proto.pieces
    ]
    surface[model.unk_id()] = " ⁇ ".encode()
    return Pieces(pieces, normal, scores, model.unk_id(), min(scores) - UNKNOWN_PENALTY, base, surface, spec.add_dummy_prefix, ~inside.ravel())


def units_of(texts: pa.Array, model: Pieces) -> Words:
    """Units of each text from the texts' own bytes, with blanks for word marks."""
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    data, at = text_bytes(texts)
    if model.prefix:
        full = at[:-1][at[1:] > at[:-1]]
        data = np.insert(data, full, 32)
        at = at + np.searchsorted(full, at, side="left")
    first = np.zeros(len(data), bool)
    first[1:] = model.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
    first[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
    coded = units.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(starts, at))


def marked(units: pa.Array) -> pa.Array:
    """Units as they stand in the lattice: blanks as word marks."""
    return pc.replace_substring(units.cast(pa.large_string()), " ", MARK)


def count_units(docs: DataFrame, model: Pieces) -> DataFrame:
    """(text) -> (unit, n), summed inside each block of texts first."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        release()  # what this worker kept of earlier work

        def rows() -> pa.RecordBatch:
            units = units_of(pa.chunked_array(held).combine_chunks(), model)
            counts = np.bincount(units.codes, minlength=len(units.names))
            return pa.RecordBatch.from_arrays([marked(units.names).cast(pa.string()), pa.array(counts, pa.int64())], names=["unit", "n"])

        for batch in batches:
            held.append(batch.column("text"))
            size += batch.nbytes
            if size >= BLOCK:
                yield rows()
                held, size = [], 0
                release()
        if held:
            yield rows()
            release()

    counted = docs.select("text").mapInArrow(found, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return counted.coalesce(n_files(docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4))


def n_files(df: DataFrame, parts: int, each: int) -> int:
    """Files for so many small parts, ``each`` of them in one, but two for each core at least.

    Every file costs its writer calls to the store, on a local one a process of its own beside the executor.
    """
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-parts // each))


def byte_ids(char: Column, base: int) -> Column:
    """Ids of the byte pieces of a character."""
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(1), F.length(digits), F.lit(2)),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + base,
    )


def edges(units: DataFrame, table: DataFrame, model: Pieces) -> DataFrame:
    """(unit, n) -> (unit, n, edges): all pieces that lie on each unit, by end and start; id -1 where there is none."""
    # exploded by end, so that the edges of a unit come in the order in which they are folded
    ends = units.withColumn("end", F.explode(F.sequence(F.lit(1), F.length("unit"))))
    spans = ends.withColumn("size", F.explode(F.sequence(F.least(F.lit(model.longest), F.col("end")), F.lit(1), F.lit(-1))))
    spans = spans.withColumn("piece", F.substring("unit", F.col("end") - F.col("size") + 1, F.col("size")))
    joined = spans.join(F.broadcast(table), "piece", "left").filter(F.col("id").isNotNull() | (F.col("size") == 1))
    edge = F.struct(
        "end",
        (F.col("end") - F.col("size")).alias("start"),
        F.coalesce("id", F.lit(-1)).alias("id"),
        F.coalesce("score", F.lit(model.unknown_score)).alias("score"),
    )
    return joined.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def best_way(found: Column) -> Column:
    """Viterbi over edges sorted by end: (start, id) of the edges on the way with the greatest sum of scores.

    The state holds score and last edge of each finished end, and the best so far for the end at hand. Every end has
    an edge, the one of its last character, so ends follow each other without a gap.
    """
    none = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("id"))
    start = F.struct(
        F.array().cast("array<double>").alias("scores"),
        F.array().cast("array<struct<start:int,id:int>>").alias("back"),
        F.lit(0).alias("end"),
        F.lit(0.0).alias("score"),
        none.alias("edge"),
    )

    def step(s: Column, e: Column) -> Column:
        edge = F.struct(e["start"].alias("start"), e["id"].alias("id"))
        total = (e["score"] + F.get(s["scores"], e["start"])).alias("score")
        # the first edge to an end closes the end before it; most other edges do not win and leave the state as it is
        closed = F.array_append(s["scores"], s["score"])
        opened = F.struct(
            closed.alias("scores"), F.array_append(s["back"], s["edge"]).alias("back"), e["end"].alias("end"),
            (e["score"] + F.when(e["start"] == s["end"], s["score"]).otherwise(F.get(s["scores"], e["start"]))).alias("score"), edge.alias("edge"),
        )
        better = F.struct(s["scores"].alias("scores"), s["back"].alias("back"), s["end"].alias("end"), total, edge.alias("edge"))
        return F.when(e["end"] != s["end"], opened).when(e["score"] + F.get(s["scores"], e["start"]) > s["score"], better).otherwise(s)

    def trace(s: Column) -> Column:
        # from the last edge to the first
        return F.reverse(
            F.aggregate(
                F.reverse(s["back"]),
                F.array(s["edge"]),
                lambda way, _: F.when(
                    F.element_at(way, -1)["start"] > 0, F.array_append(way, F.get(s["back"], F.element_at(way, -1)["start"]))
                ).otherwise(way),
            )
        )

    return F.aggregate(found, start, step, trace)


def long_way(unit: str, ids: dict[str, tuple[int, float]], model: Pieces) -> list[int]:
    """The same recurrence for one long unit."""
    longest, n = model.longest, len(unit)
    best, back = [0.0] + [-float("inf")] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            hit = ids.get(unit[start:end])
            if hit is None and start == end - 1:
                hit = (-1, model.unknown_score)
            if hit and best[start] + hit[1] > best[end]:
                best[end], back[end] = best[start] + hit[1], (start, hit[0])
    out: list[list[int]] = []
    at = n
    while at:
        start, i = back[at]
        if i >= 0:
            out.append([i])
        elif model.bytes_from is None:
            out.append([model.unknown])
        else:
            out.append([model.bytes_from + b for b in unit[start:at].encode("utf-8", "replace")])
        at = start
    return [i for part in reversed(out) for i in part]


def encode_units(units: DataFrame, model: Pieces) -> DataFrame:
    """(unit, n) at rest -> (unit, n, ids), written.

    Units are dealt so that the edges of one group's units fit in memory, and folded where they are. A task goes
    through several groups, each when the one before is folded and written, so that files do not get as many as groups.
    """
    spark = units.sparkSession
    table = settle(
        spark.createDataFrame(pd.DataFrame({"piece": model.pieces, "id": model.ids, "score": model.scores}), "piece string, id int, score double").coalesce(1)
    )
    groups = max(1, -(-units.count() // UNITS_PER_TASK))
    short, long = units.filter(F.length("unit") <= LONG_UNIT), units.filter(F.length("unit") > LONG_UNIT)
    ways = edges(short.repartition(groups, "unit"), table, model).select("unit", "n", best_way(F.col("edges")).alias("way"))
    if model.bytes_from is None:
        ids = F.transform("way", lambda e: F.when(e["id"] < 0, F.lit(model.unknown)).otherwise(e["id"]))
    else:
        spelt = F.flatten(
            F.transform(
                "way",
                lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(byte_ids(F.substring("unit", e["start"] + 1, F.lit(1)), model.bytes_from)),
            )
        )
        ids = F.when(F.exists("way", lambda e: e["id"] < 0), spelt).otherwise(F.transform("way", lambda e: e["id"]))
    folded = ways.select("unit", "n", ids.alias("ids")).coalesce(n_files(units, groups, GROUPS_PER_FILE))

    @F.pandas_udf("array<int>")
    def looped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = {p: (i, s) for p, i, s in zip(model.pieces, model.ids, model.scores, strict=True)}
        for batch in batches:
            yield batch.map(lambda u: long_way(u, known, model))

    # beyond this many groups the aggregation would sort and spill all edges
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(8 * UNITS_PER_TASK))
    try:
        return settle(folded.unionByName(long.select("unit", "n", looped("unit").alias("ids"))))
    finally:
        spark.conf.set(setting, before)


def _hash(units: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))


def dictionary(encoded: DataFrame, model: Pieces, entries: int = MAX_ENTRIES) -> tuple[dict[str, np.ndarray], int]:
    """Sorted hash arrays of the units with the highest counts, and the least count that is in."""
    kind = np.uint16 if len(model.surface) <= 1 << 16 else np.int32
    # as many rows as there are different counts
    by_count = sorted(encoded.groupBy("n").agg(F.count("*"), F.sum(F.size("ids"))).collect())
    units, pieces, least = sum(r[1] for r in by_count), sum(r[2] for r in by_count), 1
    for n, some_units, some_pieces in by_count:
        if units <= entries and pieces <= PIECES_PER_ENTRY * entries:
            break
        least, units, pieces = n + 1, units - some_units, pieces - some_pieces

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, sizes = ids.flatten().to_numpy(zero_copy_only=False).astype(kind), np.asarray(ids.value_lengths()).astype(np.uint32)
            blobs = (_hash(batch.column("unit").to_pylist()), sizes, flat)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], names=["h", "k", "v"])

    # one part at a time: the driver never holds more than the arrays themselves and one part
    parts: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.uint64, np.uint32, kind)]
    rows = encoded.filter(F.col("n") >= least).select("unit", "ids").mapInArrow(packed, "h binary, k binary, v binary")
    for row in rows.toLocalIterator():
        for part, blob in zip(parts, row, strict=True):
            part.append(np.frombuffer(bytes(blob), part[0].dtype))
    hashes, sizes, ids = (np.concatenate(part) for part in parts)
    del parts
    order = np.argsort(hashes)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    return {"hashes": hashes[order], "starts": starts[order].astype(np.uint32), "sizes": sizes[order], "ids": ids}, least


def _find(hashes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands among the sorted ones, and whether it does; asked in order, which is kind to the caches."""
    order = np.argsort(asked)
    at = np.empty(len(asked), np.int64)
    at[order] = np.minimum(np.searchsorted(hashes, asked[order]), max(len(hashes) - 1, 0))
    return at, hashes[at] == asked if len(hashes) else np.zeros(len(asked), bool)


def _gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def look_up(docs: DataFrame, arrays: dict[str, np.ndarray], model: Pieces, key: str) -> DataFrame:
    """(key, text) -> (key, ids, decoded_crc32, missing, text): ids where all units are known, else the units that are not, and the text."""
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    prefix = model.prefix
    spelt = pa.array(model.surface, pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        hashes, starts, sizes, ids = (table[k] for k in ("hashes", "starts", "sizes", "ids"))
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for piece in slices(lengths, CHARS_AT_ONCE):
                n = piece.stop - piece.start
                texts = batch.column("text").slice(piece.start, n)
                units = units_of(texts, model)
                per_text = np.diff(units.bounds)
                at, known = _find(hashes, _hash(marked(units.names).to_pylist()))
                at, known = at[units.codes], known[units.codes]
                owner = units.rows
                holes = np.bincount(owner, ~known, n) > 0
                use = ~holes[owner]
                n_ids = np.bincount(owner, np.where(use, sizes[at] if len(sizes) else 0, 0), n).astype(np.int64)
                chosen = at[use]
                values = _gather(starts[chosen].astype(np.int64), sizes[chosen].astype(np.int64), ids).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_ids))), pa.int32()), pa.array(values))
                crc = pa.array([zlib.crc32(b) for b in spell(found, spelt, prefix)], pa.int64(), mask=holes)
                missing, again = [None] * n, [None] * n
                for i in np.flatnonzero(holes).tolist():
                    again[i] = texts[i].as_py()
                    own = slice(units.bounds[i], units.bounds[i] + per_text[i])
                    missing[i] = marked(units.names.take(pa.array(np.unique(units.codes[own][~known[own]])))).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(piece.start, n), found, crc, pa.array(missing, pa.list_(pa.string())), pa.array(again, pa.string())],
                    names=[key, "ids", "decoded_crc32", "missing", "text"],
                )
            release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(rows, f"{key} {kind}, ids array<int>, decoded_crc32 long, missing array<string>, text string")


def fill(partial: DataFrame, encoded: DataFrame, arrays: dict[str, np.ndarray], model: Pieces, key: str) -> DataFrame:
    """Documents with missing units: the units are joined by unit, sent back by document and put in their places."""
    spelt = pa.array(model.surface, pa.binary())
    wanted = partial.select(key, F.explode("missing").alias("unit")).distinct()
    found = wanted.join(encoded.select("unit", "ids"), "unit").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("unit", "ids"))).alias("extra"))
    shared = partial.sparkSession.sparkContext.broadcast(arrays)
    prefix = model.prefix

    @F.pandas_udf("array<int>")
    def put(texts: pd.Series, extra: pd.Series) -> pd.Series:
        table = shared.value
        hashes, starts, sizes, ids = (table[k] for k in ("hashes", "starts", "sizes", "ids"))

        def one(text: str, own: dict) -> np.ndarray:
            own = dict(own)
            units = units_of(pa.array([text]), model)
            names = marked(units.names).to_pylist()
            at, _ = _find(hashes, _hash(names))
            kinds = [
                np.asarray(own[name], np.int32) if name in own else ids[int(starts[i]) : int(starts[i]) + int(sizes[i])].astype(np.int32)
                for name, i in zip(names, at.tolist(), strict=True)
            ]
            return np.concatenate([kinds[c] for c in units.codes.tolist()])

        return pd.Series([one(t, e) for t, e in zip(texts, extra, strict=True)])

    # a null id joins itself: its documents share one map of units
    left = partial.select(key, "text")
    named = found.withColumnRenamed(key, "_key")
    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(b) for b in spell(ids, spelt, prefix)], pa.int64())

    whole = left.join(named, left[key].eqNullSafe(named["_key"])).select(key, put("text", "extra").alias("ids"))
    return whole.select(key, "ids", crc("ids").alias("decoded_crc32"))


def encode(docs: DataFrame, path: str = MODEL, key: str = "doc_id", entries: int = MAX_ENTRIES) -> DataFrame:
    """(key, text) -> (key, ids, decoded_crc32), one row per row.

    ``decoded_crc32`` is the checksum of the UTF-8 that the ids decode to, taken in the task that made them. Sets the
    session's limit for Arrow batches: texts and ids pass through a Python worker.
    """
    model = load(path)
    small_batches(docs)
    encoded = encode_units(settle(count_units(docs, model)), model)
    arrays, least = dictionary(encoded, model, entries)
    looked = look_up(docs, arrays, model, key)
    if least == 1:
        return looked.select(key, "ids", "decoded_crc32")
    looked = settle(looked)
    rest = looked.filter("missing is not null")
    return looked.filter("missing is null").select(key, "ids", "decoded_crc32").unionByName(
        fill(rest, encoded.filter(F.col("n") < least), arrays, model, key)
    )


def spell(ids: pa.Array, surface: pa.Array, prefix: bool) -> list[bytes]:
    """UTF-8 of each array of ids; a null array gives an empty text."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    whole = pc.binary_join(pa.ListArray.from_arrays(offsets, surface.take(ids.flatten())), b"").to_pylist()
    return [b.removeprefix(b" ") for b in whole] if prefix else whole


def decode(ids: Column, path: str = MODEL) -> Column:
    """Text of an array of ids; a null array gives an empty text. Ids that no text encodes to give replacement marks."""
    model = load(path)
    surface, prefix = model.surface, model.prefix

    @F.arrow_udf("string")
    def text(batch: pa.Array) -> pa.Array:
        return pa.array([b.decode("utf-8", "replace") for b in spell(batch, pa.array(surface, pa.binary()), prefix)], pa.string())

    return text(ids)
