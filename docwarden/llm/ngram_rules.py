"""Quality rules with an n-gram language model: modified Kneser-Ney over the bytes of running text, counted by Spark.

1. A text is read as its words with one blank between them, so n-grams run across words. An n-gram is ``ORDER`` bytes,
   packed into one long: its context and its suffix are shifts of it, and no two n-grams share a key. Blocks of texts are
   counted in their tasks, and the counts summed by language and n-gram in Spark. Copies of a text count once together.
2. Continuation counts, discounts, context weights and interpolated probabilities are joins and sums of the tables of
   each order, again in Spark. Nothing is cut off: the tables grow with the corpus.
3. Probabilities reach the tasks as arrays sorted by hash (a bijection of the packed n-gram): at most ``ENTRIES`` of
   them (12 bytes each), those with the highest counts. Documents that hold other n-grams send these, counted, to the whole
   tables, which are joined by language and key; their sums come back by row. N-grams that no text of the model
   holds back off through the lower orders the same way.
4. A language's band runs from ``BAND`` interquartile ranges below its first quartile of log perplexity to as many above
   its third, the quartiles taken over all different documents that pass the base rules. A mean over few words strays further, so
   the ranges (at least ``LEAST_SPREAD``) are widened by sqrt(1 + STEADY_WORDS / words). Documents outside the band are
   rejected, as are those that fail the base rules.

Defined cases: a null text counts as empty and fails the base rules; null and empty languages are one language; an empty
table gives an empty result; repeated rows are scored and counted each, also where they have one id or none; a document without words
has no perplexity and is not kept; very long texts and words take time and memory in proportion. ``carry`` may
not name a column of the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import release, small_batches
from docwarden.llm.shingles import slices, window_hashes
from docwarden.llm.word_arrays import Words, split_words, text_bytes
from docwarden.session import settle

ORDER = 5
ENTRIES = 1 << 22
#: Digests of texts that are sent to the texts, at about 60 bytes each; beyond that the texts are joined to them.
GROUPS_AT_ONCE = 1 << 19
BAND, STEADY_WORDS = 3.0, 200
#: Least range between the quartiles: a language may have few texts.
LEAST_SPREAD = 0.03
#: Stands before the first word, as often as an n-gram reaches back.
START = 2
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
BLOCK = 8 << 20
#: Bytes that are told apart, and the end of what is known.
ALPHABET = 257
#: Leaves some probability to what was never counted, however few counts there are.
LEAST_DISCOUNT = 0.05
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashed(grams: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys that spreads them evenly."""
    h = grams.astype(np.uint64) * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def packed(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram at each byte, row of each byte) of texts as words with one blank behind each; rows begin with START."""
    names = words.names.cast(pa.large_binary())
    lengths = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    spelt = names.take(pa.array(words.codes))
    _, offsets, data = spelt.buffers()
    raw = np.frombuffer(data, np.uint8)[: int(lengths.sum())] if data is not None else np.empty(0, np.uint8)
    # a blank behind each word, and order - 1 marks before each row
    rows, filled = words.rows, np.flatnonzero(np.diff(words.bounds))
    head = np.zeros(len(words.codes), np.int64)
    head[words.bounds[filled]] = order - 1
    ends = np.cumsum(lengths + 1 + head)
    out = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint64)
    out[np.repeat(ends - 1 - lengths, lengths) + (np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths))] = raw
    out[ends - 1] = 32
    own = np.ones(len(out), bool)
    marks = np.repeat((ends - 1 - lengths - head)[head > 0], order - 1) + np.tile(np.arange(order - 1), int((head > 0).sum()))
    own[marks] = False
    grams = np.zeros(len(out), np.uint64)
    for back in range(order - 1, -1, -1):
        grams[order - 1 :] = (grams[order - 1 :] << np.uint64(8)) | out[order - 1 - back : len(out) - back]
    return grams[own].view(np.int64), np.repeat(rows, lengths + 1)


def by_language(langs: Sequence[str], rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Places of each language among places that are given by row."""
    names, codes = np.unique(np.array(langs, dtype=object), return_inverse=True) if len(langs) else ([], np.empty(0, int))
    for i, name in enumerate(names):
        yield name, slice(None) if len(names) == 1 else np.flatnonzero(codes[rows] == i)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, text, share) -> (lang, gram, c): n-grams of the highest order, summed inside each block of texts first."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "c"])
            held.clear()
            release()

        for batch in batches:
            langs, share = batch.column("lang").to_pylist(), batch.column("share").to_numpy()
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for piece in slices(lengths):
                some = piece.stop - piece.start
                grams, owner = packed(split_words(batch.column("text").slice(piece.start, some)), order)
                for lang, at in by_language(langs[piece], owner):
                    kinds, where = np.unique(grams[at], return_inverse=True)
                    held.setdefault(lang, []).append((kinds, np.bincount(where, share[piece][owner[at]])))
            size += batch.nbytes
            if size >= 2 * BLOCK:
                yield from rows()
                size = 0
        yield from rows()

    counted = docs.select("lang", "text", "share").mapInArrow(found, "lang string, gram long, c double")
    # the shares of a text's copies add up to one
    return counted.groupBy("lang", "gram").agg(F.round(F.sum("c")).cast("long").alias("c"))


def with_shares(docs: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, text, share): copies of one text share its count, so that none is likely for being copied.

    Only digests are grouped; the copied ones are few and are sent to the texts unless they are too many for that.
    """
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    copied = settle(texts.groupBy("lang", digest).agg(F.count("*").alias("n")).filter("n > 1 and digest is not null"))
    groups = copied.limit(GROUPS_AT_ONCE + 1).count()
    if not groups:
        return texts.withColumn("share", F.lit(1.0))
    if groups <= GROUPS_AT_ONCE:
        copied = F.broadcast(copied)
    named = texts.select("lang", "text", digest).join(copied, ["lang", "digest"], "left")
    return named.select("lang", "text", (1 / F.coalesce("n", F.lit(1))).alias("share"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = table.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    return tuple(
        min(max(i - (i + 1) * y * (b / a), LEAST_DISCOUNT), float(i)) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    )


def lower_counts(top: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Tables (lang, gram, c) of orders 1..``order``: counts at the top, below it the number of bytes that come before."""
    tables = [top]
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        tables.insert(0, settle(tables[0].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("c"))))
    return tables


@dataclass
class Model:
    """(lang, gram, p) and (lang, gram, weight) of each order, the weight being that of a context as one order shorter."""

    probabilities: list[DataFrame]
    weights: list[DataFrame]
    counts: DataFrame

    @property
    def order(self) -> int:
        return len(self.probabilities)

    def arrays(self, entries: int = ENTRIES) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """By language, hashes in order and the logarithms beside them, of the n-grams with the highest counts."""
        table = self.probabilities[-1].join(self.counts, ["lang", "gram"])
        power = F.floor(F.log2("c")).cast("int")
        # one row for each power of two that a count reaches
        sizes = sorted(table.groupBy(power.alias("k")).count().collect(), reverse=True)
        least, room = 64, entries
        for k, n in sizes:
            if n > room:
                break
            least, room = k, room - n
        parts: dict[str, list] = {}

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, values = hashed(batch.column("gram").to_numpy()), np.log(batch.column("p").to_numpy()).astype(np.float32)
                for lang, at in by_language(batch.column("lang").to_pylist(), np.arange(batch.num_rows)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([keys[at].tobytes()], pa.binary()), pa.array([values[at].tobytes()], pa.binary())], names=["lang", "k", "v"]
                    )

        for lang, k, v in table.filter(power >= least).select("lang", "gram", "p").mapInArrow(made, "lang string, k binary, v binary").toLocalIterator():
            parts.setdefault(lang, []).append((np.frombuffer(bytes(k), np.uint64), np.frombuffer(bytes(v), np.float32)))
        out = {}
        for lang in list(parts):
            keys, values = (np.concatenate(x) for x in zip(*parts.pop(lang), strict=True))
            order = np.argsort(keys)
            out[lang] = keys[order], values[order]
        return out

    def log_p(self, grams: DataFrame) -> DataFrame:
        """(lang, gram), distinct -> (lang, gram, log_p), backing off where an n-gram was never counted."""
        left = grams.select("lang", "gram", F.col("gram").alias("part"), F.lit(0.0).alias("sum"))
        done = []
        for k in range(self.order, 0, -1):
            known = self.probabilities[k - 1].withColumnRenamed("gram", "part")
            looked = settle(left.join(known, ["lang", "part"], "left"))
            done.append(looked.filter("p is not null").select("lang", "gram", (F.col("sum") + F.log("p")).alias("log_p")))
            rest = looked.filter("p is null").withColumn("context", F.shiftright("part", 8))
            weights = self.weights[k - 1].withColumnRenamed("gram", "context")
            left = rest.join(weights, ["lang", "context"], "left").select(
                "lang", "gram", F.col("part").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("part"),
                (F.col("sum") + F.log(F.coalesce("weight", F.lit(1.0)))).alias("sum"),
            )
            if left.isEmpty():
                break
        else:
            done.append(left.select("lang", "gram", (F.col("sum") - float(np.log(ALPHABET))).alias("log_p")))
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of (lang, text)."""
    small_batches(docs)
    tables = lower_counts(settle(count_grams(with_shares(docs), order)), order)
    probabilities, weights = [], []
    for k, table in enumerate(tables, 1):
        d1, d2, d3 = discounts(table)
        c, context = F.col("c"), F.shiftright("gram", 8)
        discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        per_context = settle(
            table.groupBy("lang", context.alias("context")).agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("weight"))
        )
        part = table.select("lang", "gram", context.alias("context"), F.greatest(c - discount, F.lit(0.0)).alias("rest")).join(per_context, ["lang", "context"])
        if k == 1:
            lower = part.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            shorter = probabilities[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            lower = part.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(shorter, ["lang", "suffix"])
        probabilities.append(settle(lower.select("lang", "gram", (F.col("rest") / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))))
        weights.append(per_context.select("lang", F.col("context").alias("gram"), "weight"))
    return Model(probabilities, weights, tables[-1])


# ---- base rules --------------------------------------------------------------------------------------------

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.split(None, 1):
            seen.add(line)
    return repeated


def repeated_words(words: Words) -> np.ndarray:
    """For each word whether it lies in a window of ``WINDOW`` words that its row holds twice or more."""
    n = len(words.codes)
    covered = np.zeros(n + 1, np.int64)
    rows = words.rows
    # the row is part of each word, so windows of different rows differ
    windows = window_hashes(hashed(rows * (len(words.names) + 1) + words.codes), WINDOW)
    if len(windows):
        inside = rows[: len(windows)] == rows[WINDOW - 1 :]
        _, where, counts = np.unique(windows[inside], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(inside)[counts[where] > 1]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
    return np.cumsum(covered[:-1]) > 0


def base_counts(texts: pa.Array, words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, at = text_bytes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(at))
    chars = np.bincount(owner, ((data & 0xC0) != 0x80) & (data != 32) & ((data < 9) | (data > 13)), n)
    symbols = np.bincount(owner, _SYMBOL[data], n)
    whole = data.tobytes()
    lines = np.array([duplicate_lines(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
    repeats = np.bincount(words.rows, repeated_words(words), n)
    return [np.diff(words.bounds), *(x.astype(np.int64) for x in (chars, symbols, lines, repeats))]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: Model, carry: Sequence[str] = (), entries: int = ENTRIES) -> DataFrame:
    """(doc_id, lang, text) -> doc_id, lang (null: empty), the columns to carry, base counts and log perplexity, at rest."""
    # plain arrays: workers need not be able to import this module to read them
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays(entries))
    order = model.order
    kept = ["doc_id", "lang", *carry]
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    given = docs.select("doc_id", lang, *carry, *[c for c in ("text",) if c not in carry])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, part, number = shared.value, TaskContext.get().partitionId() << 33, 0
        nothing = np.empty(0, np.uint64), np.empty(0, np.float32)
        for batch in batches:
            all_langs = batch.column("lang").to_pylist()
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for piece in slices(lengths):
                n = piece.stop - piece.start
                texts = batch.column("text").slice(piece.start, n)
                words = split_words(texts)
                grams, owner = packed(words, order)
                total, length = np.zeros(n), np.bincount(owner, minlength=n)
                open_: list[tuple[np.ndarray, np.ndarray]] = []
                for name, at in by_language(all_langs[piece], owner):
                    keys, values = tables.get(name, nothing)
                    kinds, where = np.unique(grams[at], return_inverse=True)
                    codes = hashed(kinds)
                    found = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
                    known = keys[found] == codes if len(keys) else np.zeros(len(kinds), bool)
                    total += np.bincount(owner[at], np.where(known, values[found] if len(keys) else 0, 0)[where], n)
                    if not known.all():
                        lost = ~known[where]
                        open_.append((owner[at][lost], grams[at][lost]))
                missing: list = [None] * n
                if open_:
                    who, what = (np.concatenate(x) for x in zip(*open_, strict=True))
                    by_row = np.argsort(who, kind="stable")
                    who, what = who[by_row], what[by_row]
                    for r, a, b in zip(*_runs(who), strict=True):
                        kinds, counts = np.unique(what[a:b], return_counts=True)
                        missing[r] = [{"gram": g, "times": c} for g, c in zip(kinds.tolist(), counts.tolist(), strict=True)]
                own = batch.select(kept).slice(piece.start, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns, *(pa.array(x, pa.int64()) for x in base_counts(texts, words)), pa.array(total), pa.array(length, pa.int64()),
                        pa.array(part + number + np.arange(n), pa.int64()), pa.array(missing, pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))),
                    ],
                    names=[*kept, *BASE, "_sum", "_length", "_row", "_missing"],
                )
                number += n
            release()

    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in kept)
    base = ", ".join(f"{c} long" for c in BASE)
    first = settle(given.mapInArrow(rows, f"{kinds}, {base}, _sum double, _length long, _row long, _missing array<struct<gram:long,times:long>>"))
    mean = F.when(F.col("_length") > 0, -F.col("_sum") / F.col("_length")).alias("log_perplexity")
    rest = first.filter("_missing is not null")
    if rest.isEmpty():
        return first.select(*kept, *BASE, mean)
    asked = settle(rest.select("_row", "lang", F.inline("_missing")))
    log_p = model.log_p(asked.select("lang", "gram").distinct())
    sums = settle(asked.join(log_p, ["lang", "gram"]).groupBy("_row").agg(F.sum(F.col("times") * F.col("log_p")).alias("_more")))
    return settle(first.join(sums, "_row", "left").withColumn("_sum", F.col("_sum") + F.coalesce("_more", F.lit(0.0))).select(*kept, *BASE, mean))


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each value of a sorted array, with the start and end of its run."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
    return values[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist()


def judge(docs: DataFrame, band: float = BAND, carry: Sequence[str] = (), entries: int = ENTRIES) -> DataFrame:
    """(doc_id, lang, text) -> base counts, base_failed, log_perplexity, the language's band and kept.

    Columns named in ``carry`` (the text among them, if wanted) come along.
    """
    made = {"doc_id", "lang", *BASE, "base_failed", "log_perplexity", "lower_band", "upper_band", "kept"}
    if made & set(carry) or len(set(carry)) < len(carry):
        raise ValueError(f"columns of the result cannot be carried: {sorted(made & set(carry))}")
    measured = measure(docs, fit(docs), carry, entries)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    # copies have one perplexity and count once
    different = measured.filter(~F.col("base_failed")).select("lang", "log_perplexity").distinct()
    bands = different.groupBy("lang").agg(quartiles.alias("q"))
    bands = settle(bands.select("lang", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("q3")))
    reach = band * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD)) * F.sqrt(1 + STEADY_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band"))
    return (
        measured.join(bands, "lang", "left")
        .withColumns({"lower_band": F.col("q1") - reach, "upper_band": F.col("q3") + reach})
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("q1", "q3")
    )
