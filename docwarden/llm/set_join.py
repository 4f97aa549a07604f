"""N-gram Jaccard join by set relations: index lists with blocks that are skipped, answers derived from a similar set.

1. Each text becomes the set of its distinct k-word shingles (64-bit hashes). Equal sets are one class; the class
   with the smallest id stands for all, so copies never meet.
2. Shingles are put in one global order, rare ones first by a table of counts over hash buckets (``SKETCH_BITS``, a
   fixed size), then by hash. Two sets that link share a shingle of their prefixes, and the smaller one has it in the
   shorter index prefix. Shingles of a single prefix are counted out first. Index lists hold (shingle, block, size,
   position, id); a list is cut into blocks of sets whose sizes may link at all, and blocks without a posting in an index
   prefix are skipped, as are postings behind the position that their size allows. What a block says of its postings is
   one row, joined back to them, so that a frequent shingle is never sorted or held as a whole.
3. A block's first set by id leads it. Sets that a leader leads in any block are compared with each other in the
   leader's group, first by histograms: a set's shingles are counted in about n / 8 parts of the hash space, and two
   sets differ in at least as many shingles as their counts do in sum. Sets without a partner that this bound allows
   leave the group; they met by chance, and their texts never move.
4. The rest is compared in full: the leader's overlaps with all sets of the group are counted once from an inverted list, and those
   of any other set follow from the leader's by the shingles in which the two differ. A set that is already connected
   within the group is not answered again for sets of its own component. A large group is cut into pieces of
   ``PIECE`` sets, and each pair of pieces is a task of its own.
5. Groups return links that connect (never all pairs); components are found over these.

Every pair of linked sets meets in at least one group, so none is lost: their first common shingle is in both
prefixes and in the smaller one's index prefix, they are in one block of its list, and so in that block's group.

Defined cases: null and blank texts have the empty set and are alone; fewer than k words are one shingle; repeated
ids are one document each by text, joined as one node (``firsts_of_groups`` tells them apart); a null id has a row, and
its copies are told by their text; very long texts are held whole by one task at a time; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import in_order, release, small_batches
from docwarden.llm.components import components
from docwarden.llm.shingles import shingle_set
from docwarden.session import settle

SKETCH_BITS, SLICE_BITS = 20, 12
PIECE = 1000
#: Ids of near-copies that are sent to all tasks, at about 30 bytes each.
NAMES_AT_ONCE = 1 << 20


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """One pass: rows with doc_id, n and signature for each text, and rows with slices of the bucket counts."""
    width = 1 << SLICE_BITS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sizes, signs = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                sizes.append(len(s))
                signs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "n", "sign", "slice", "counts"],
            )
            release()
        used = [i for i in range(0, len(counts), width) if counts[i : i + width].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()),
                pa.array([i // width for i in used], pa.int32()), pa.array([counts[i : i + width].tobytes() for i in used], pa.binary()),
            ],
            names=["doc_id", "n", "sign", "slice", "counts"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n long, sign binary, slice int, counts binary")


def bucket_counts(signed: DataFrame) -> np.ndarray:
    """Counts over all texts, summed by slice in tasks; 2^SKETCH_BITS numbers whatever the input."""

    def total(part: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(c, np.int64) for c in part["counts"])
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "counts": [summed.tobytes()]})

    slices = signed.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(total, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for s, c in slices.collect():
        out[s << SLICE_BITS : (s + 1) << SLICE_BITS] = np.frombuffer(c, np.int64)
    return out


def needed(a: int, b: int, t: Fraction) -> int:
    """Least overlap with which sets of these sizes link: Jaccard >= t."""
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


def histogram(s: np.ndarray) -> np.ndarray:
    """Shingles of a set by part of the hash space, counts of 255 and more as 255; a power of two of parts."""
    parts = 16
    while parts * 8 < len(s):
        parts *= 2
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) & (parts - 1), minlength=parts)
    return np.minimum(counts, 255).astype(np.uint8)


def possible(sizes: np.ndarray, histograms: list[np.ndarray], side: np.ndarray, t: Fraction) -> np.ndarray:
    """For each set whether the histograms allow a link with another one; sides 0 and 1 meet, and side 2 meets itself."""
    parts = np.array([len(h) for h in histograms])
    found = np.zeros(len(sizes), bool)
    num, den = t.numerator, t.denominator
    for p in np.unique(parts):
        mine = np.flatnonzero(parts == p)
        # a linked set is at most 1 / t times as large, and so are its parts, to the next power of two
        near = np.flatnonzero((parts >= p) & (parts * num < 2 * p * den))
        folded = np.minimum([histograms[i].reshape(-1, p).astype(np.int16).sum(axis=0) for i in near], 255).astype(np.int16)
        own = np.array([histograms[i] for i in mine], np.int16)
        step = max(1, (1 << 22) // (len(near) * int(p)))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            distance = np.abs(own[at : at + step, None, :] - folded[None]).sum(axis=2)
            both = sizes[rows][:, None] + sizes[near][None]
            allowed = both - 2 * (-(-num * both // (num + den)))
            meets = (distance <= allowed) & (rows[:, None] != near[None])
            meets &= (side[rows][:, None] == 2) | (side[rows][:, None] != side[near][None])
            found[rows] |= meets.any(axis=1)
            found[near] |= meets.any(axis=0)
    return found


def prefixes(docs: DataFrame, k: int, t: Fraction, counts: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, prefix, parts): a set's first shingles in the global order and its histogram."""
    ranks = docs.sparkSession.sparkContext.broadcast(counts)
    num, den = t.numerator, t.denominator

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            sizes, firsts, parts = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                n = len(s)
                length = n - -(-num * n // den) + 1 if n else 0
                order = np.lexsort((s, rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                sizes.append(n)
                firsts.append(s[order[:length]].view(np.int64))
                parts.append(histogram(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(parts, pa.binary())],
                names=["doc_id", "n", "prefix", "parts"],
            )
            release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n long, prefix array<long>, parts binary")


def groups(firsts: DataFrame, t: Fraction) -> DataFrame:
    """(id, n, prefix) -> (lead, id): the sets that are to be compared with each other, at most once per leader."""
    num, den = t.numerator, t.denominator
    n, pos = F.col("n"), F.col("pos")
    # sets of sizes a <= b link only if t * b <= a: they are in the same block of sizes or in the next
    # (a hair wider, so that rounding of logarithms cannot part a pair)
    block = F.floor(F.log(n) / (float(np.log(den / num)) * 1.000001)).cast("int")
    short = n - F.ceil(2 * num * n / (num + den)) + 1
    postings = firsts.select("id", "n", F.posexplode("prefix").alias("pos", "shingle"))
    # most shingles are in one set only: they are told by a count, combined before the exchange, and never moved again
    shared = settle(postings.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1").select("shingle"))
    met = (
        settle(postings.join(shared, "shingle", "left_semi"))
        .withColumn("short", pos < short)
        .withColumn("block", F.explode(F.array(block - 1, block)))
    )
    lists = settle(
        met.groupBy("shingle", "block")
        .agg(
            F.min("id").alias("lead"), F.count("*").alias("members"), F.sum(F.col("short").cast("int")).alias("shorts"),
            F.min(F.when(F.col("short"), n)).alias("least"),
        )
        .filter("members > 1 and shorts > 0")
        .drop("members", "shorts")
    )
    # behind its index prefix a set can only be the larger of a pair; a list is one row here, so a long one can be split
    led = met.join(lists, ["shingle", "block"]).filter(F.col("short") | (F.col("least") < n))
    return led.select("lead", "id").distinct()


class _Group:
    """Overlaps of sets with the sets of a piece, from an inverted list; a set's follow from its leader's."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(starts, len(tokens))

    def count(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        found = at[self.tokens[at] == tokens]
        lengths = self.ends[found + 1] - self.ends[found]
        if not len(lengths):
            return np.zeros(len(self.sizes), np.int64)
        flat = np.repeat(self.ends[found] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[flat], minlength=len(self.sizes))


def connect(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], t: Fraction) -> list[tuple[int, int]]:
    """Links between two lists of (id, set) that connect them: one for each union of two components.

    Give the same list twice for the links inside it.
    """
    index = _Group([s for _, s in right])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    num, den = t.numerator, t.denominator
    ids = np.array([i for i, _ in right])
    links = []
    leader = left[0][1]
    led = index.count(leader)
    for at, (i, s) in enumerate(left):
        gone, come = np.setdiff1d(leader, s, assume_unique=True), np.setdiff1d(s, leader, assume_unique=True)
        if len(gone) + len(come) < len(s):
            overlap = led - index.count(gone) + index.count(come)
        else:
            overlap = index.count(s)
        linked = (num + den) * overlap >= num * (index.sizes + len(s))
        if left is right:
            linked[: at + 1] = False
        for j in ids[linked].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def deal(led: DataFrame, piece: int) -> DataFrame:
    """(lead, id) -> (lead, a, b, id, own): tasks of each leader's group; groups of one set have none.

    Members of a large group are dealt to pieces by hash; each pair of pieces is a task that gets both.
    """
    pieces = settle(
        led.groupBy("lead").agg(F.count("*").alias("members")).filter("members > 1")
        .select("lead", F.ceil(F.col("members") / piece).cast("int").alias("pieces"))
    )
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda other: F.struct(F.least(other, "own").alias("a"), F.greatest(other, "own").alias("b")),
    )
    return led.join(pieces, "lead").withColumn("own", own).select("lead", "id", "own", F.inline(pairs))


def allowed_members(led: DataFrame, firsts: DataFrame, t: Fraction, piece: int) -> DataFrame:
    """Members of leaders' groups that the histograms leave a partner."""

    def kept(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part["a"].iloc[0], part["b"].iloc[0]
        side = np.full(len(part), 2) if a == b else (part["own"] == b).to_numpy(int)
        histograms = [np.frombuffer(h, np.uint8) for h in part["parts"]]
        return part.loc[possible(part["n"].to_numpy(np.int64), histograms, side, t), ["lead", "id"]]

    measured = deal(led, piece).join(firsts.select("id", "n", "parts"), "id")
    return measured.groupBy("lead", "a", "b").applyInPandas(kept, "lead long, id long").distinct()


def compare(led: DataFrame, texts: DataFrame, k: int, t: Fraction, piece: int) -> DataFrame:
    """(lead, id) and (id, text) -> (u, v): connecting links inside each leader's group."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(part["id"], part["own"], part["text"], strict=True), key=lambda r: r[:2])
        a, b = part["a"].iloc[0], part["b"].iloc[0]
        left, right = ([(i, shingle_set(text, k)) for i, own, text in rows if own == x] for x in (a, b))
        found = connect(left, left if a == b else right, t) if left and right else []
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return settle(deal(led, piece)).join(texts, "id").groupBy("lead", "a", "b").applyInPandas(links, "u long, v long")


def join_sets(docs: DataFrame, k: int = 3, threshold: tuple[int, int] = (9, 10), piece: int = PIECE) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, n_shingles, component_id."""
    t = Fraction(*threshold)
    small_batches(docs)
    signed = settle(signatures(docs, k))
    own = signed.filter("slice is null")
    classes = settle(own.filter("sign is not null").groupBy("sign").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    firsts = prefixes(docs, k, t, bucket_counts(signed)).filter("n > 0")
    standing = classes.select(F.col("id").alias("doc_id"))
    firsts = settle(
        firsts.join(standing, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("id"), "n", "prefix", "parts", F.xxhash64("prefix").alias("same"))
        .dropDuplicates(["id", "n", "same"])
    )
    led = settle(allowed_members(settle(groups(firsts, t)), firsts, t, piece))
    # texts of sets that are to be compared; most documents are in no group
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(settle(led.select("id").distinct()), "id", "left_semi")
    links = settle(compare(led, settle(texts.dropDuplicates(["id", "text"])), k, t, piece))
    joined = components(links)
    copies = settle(classes.filter("copies > 1").join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        "sign", F.coalesce("component_id", "id").alias("class_component")
    ))
    return (
        own.join(copies, "sign", "left")
        .join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_component", "component_id", "doc_id").alias("component_id"))
    )


def nodes(docs: DataFrame) -> DataFrame:
    """Add ``_node``: the id, or, where rows with one id hold different texts, a number of its own for each further text.

    These numbers are above all ids, by id and digest of the text, so they do not depend on the run. Rows without an id have none.
    """
    repeated = settle(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    own = docs.withColumn("_node", F.col("doc_id").cast("long"))
    if repeated.isEmpty():
        return own
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = settle(docs.select("doc_id", digest.alias("digest")).join(repeated, "doc_id", "left_semi").distinct())
    least = texts.groupBy("doc_id").agg(F.min("digest").alias("first"))
    further = texts.join(least, "doc_id").filter("digest <> first").select("doc_id", "digest")
    numbered, _ = in_order(further, ["doc_id", "digest"], "place")
    top = docs.agg(F.max("doc_id")).first()[0]
    numbered = settle(numbered.select("doc_id", "digest", (F.col("place") + top + 1).alias("other")))
    numbered = numbered.withColumnsRenamed({"digest": "_digest", "other": "_other"})
    named = own.withColumn("_digest", digest).join(numbered, ["doc_id", "_digest"], "left")
    return settle(named.withColumn("_node", F.coalesce("_other", "_node")).drop("_digest", "_other"))


def firsts_of_groups(docs: DataFrame, k: int, threshold: tuple[int, int], piece: int = PIECE) -> DataFrame:
    """Rows of ``docs`` without near-copies: of each group of linked texts the row with the smallest id, once.

    Rows with one id and different texts are documents of their own: the text with the least digest stands for the
    id, the others come behind all ids. Rows without an id cannot be named and stay.
    """
    known = nodes(docs.filter("doc_id is not null"))
    joined = settle(join_sets(known.select(F.col("_node").alias("doc_id"), "text"), k, threshold, piece).withColumnRenamed("doc_id", "_node"))
    # what goes is named, not what stays: texts are moved only where these names are too many to send to all tasks
    goes = settle(joined.filter("_node <> component_id").select("_node").distinct())
    if goes.limit(NAMES_AT_ONCE + 1).count() <= NAMES_AT_ONCE:
        goes = F.broadcast(goes)
    first = known.join(goes, "_node", "left_anti")
    equal = settle(joined.filter("_node = component_id").groupBy("_node").agg(F.count("*").alias("n")).filter("n > 1").select("_node"))
    if not equal.isEmpty():
        once = first.join(equal, "_node", "left_semi").dropDuplicates(["_node"])
        first = first.join(equal, "_node", "left_anti").unionByName(once)
    return first.drop("_node").unionByName(docs.filter("doc_id is null"))
