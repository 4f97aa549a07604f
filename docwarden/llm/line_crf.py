"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are measured on it and on its two neighbours; the field adds a weight
for each pair of labels in a row. Forward-backward gives each line's probability of being good; the mean of these,
weighted by line length, is the document's score. Scoring takes one pass over the documents and moves nothing.

The field is fitted on the driver on a bounded sample of labelled documents: at most ``per_class`` of each label,
the smallest by hash, and at most ``max_lines`` lines in whole documents; a document that no longer fits is passed
over, the ones after it are not. All lines of a document take its label.
Only rows with ``held_out`` false are ever used for it.

Defined cases: null and empty texts are one empty line; blank lines weigh 1; a document with labels that contradict
counts as bad; null labels are not used; with fewer than one document of either label (that fits by
itself) all scores are 0.5; an empty
table gives an empty result; a null id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import release, small_batches
from docwarden.llm.shingles import as_bytes, in_repeated_windows
from docwarden.session import settle

PER_CLASS, MAX_LINES = 2000, 200_000
ROUNDS, RATE, DECAY = 200, 0.1, 1e-3
CUT = 0.3
OWN = 11
#: Own features, then those of the line before and the line after, then a constant.
WIDTH = 3 * OWN + 1

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_CLASSES = np.zeros((5, 256), np.int32)
_CLASSES[0, 65:91] = 1
_CLASSES[1, 97:123] = 1
_CLASSES[2, 48:58] = 1
_CLASSES[3, list(b"#*$%&|<>{}[]\\/=_~^@+")] = 1
_CLASSES[4, list(b"!?")] = 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths of the lines of a text."""
    raw = as_bytes(text) + b"\n"
    a = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = (ends - starts).astype(np.float64)
    upper, lower, digits, symbols, marks = (np.add.reduceat(c[a], starts) for c in _CLASSES)
    blank = _BLANK[a]
    begins = ~blank & np.concatenate(([True], blank[:-1]))
    n_words = np.add.reduceat(begins.astype(np.int32), starts)
    lines = len(starts)
    # equality inside one text is all that is asked of these hashes
    words = raw.split()
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    owner = np.repeat(np.arange(lines), n_words)
    repeats = np.bincount(owner, in_repeated_windows(hashes, 5), lines)
    _, first = np.unique(hashes, return_index=True)
    new_words = np.bincount(owner[first], minlength=lines)
    seen: set[bytes] = set()
    again = np.zeros(lines)
    for i, line in enumerate(raw[:-1].split(b"\n")):
        if line in seen:
            again[i] = 1.0
        elif line:
            seen.add(line)
    chars, words_or_1 = np.maximum(length, 1), np.maximum(n_words, 1)
    last = a[np.maximum(ends - 1, 0)]
    own = np.column_stack(
        (
            np.log1p(length) / 8,
            5 * symbols / chars,
            5 * marks / chars,
            upper / np.maximum(upper + lower, 1),
            digits / chars,
            np.minimum(length / words_or_1 / 10, 3),
            again,
            repeats / words_or_1,
            new_words / words_or_1,
            (length > 0) & np.isin(last, list(b".!?:;\"'")),
            length == 0,
        )
    ).astype(np.float64)
    out = np.zeros((lines, WIDTH))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[:, -1] = 1.0
    return out, chars


def forward_backward(odds: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of "good" for every line, and the summed probabilities of label pairs per chain.

    ``odds`` holds the good-against-bad scores of all chains one after the other, ``sizes`` their lengths, ``pairs``
    the weights of (this, next) labels. All chains advance together, the longest first.
    """
    chains = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[chains]
    ordered = sizes[chains]
    emit = np.stack((np.ones(len(odds)), np.exp(np.clip(odds, -30, 30))), axis=1)
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.exp(pairs - pairs.max())
    steps = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(steps), side="left")
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    for t in range(steps):
        at = starts[: active[t]] + t
        x = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    both = np.zeros((len(sizes), 2, 2))
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        n_next = active[t + 1] if t + 1 < steps else 0
        x = np.ones((len(at), 2))
        if n_next:
            after = emit[at[:n_next] + 1] * beta[at[:n_next] + 1]
            joint = alpha[at[:n_next]][:, :, None] * move[None] * after[:, None, :]
            both[chains[:n_next]] += joint / joint.sum(axis=(1, 2), keepdims=True)
            x[:n_next] = after @ move.T
        beta[at] = x / x.sum(axis=1, keepdims=True)
    good = alpha * beta
    return good[:, 1] / good.sum(axis=1), both


class Field:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def scores(self, texts) -> np.ndarray:
        """Length-weighted mean probability of "good" of each text."""
        measured = [line_features(t) for t in texts]
        if not measured:
            return np.empty(0)
        sizes = np.array([len(n) for _, n in measured])
        odds = np.concatenate([f @ self.weights for f, _ in measured])
        lengths = np.concatenate([n for _, n in measured])
        good, _ = forward_backward(odds, sizes, self.pairs)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return np.clip(np.bincount(owner, good * lengths, len(sizes)) / np.bincount(owner, lengths, len(sizes)), 0.0, 1.0)


def fit_field(features: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with decay; every document counts the same, both labels weigh the same in sum."""
    weights, pairs = np.zeros(WIDTH), np.zeros((2, 2))
    if len(set(labels.tolist())) < 2:
        return Field(weights, pairs)
    sizes = np.array([len(f) for f in features])
    x, owner = np.concatenate(features), np.repeat(np.arange(len(sizes)), sizes)
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / sizes
    y = labels[owner].astype(float)
    wanted = np.zeros((len(sizes), 2, 2))
    wanted[np.arange(len(sizes)), labels, labels] = sizes - 1
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        good, both = forward_backward(x @ theta[:WIDTH], sizes, theta[WIDTH:].reshape(2, 2))
        slope = np.concatenate((x.T @ ((y - good) * share[owner]), ((wanted - both) * share[:, None, None]).sum(axis=0).ravel())) - DECAY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_lines: int = MAX_LINES) -> pd.DataFrame:
    """(features, n_lines, label) of the documents to learn from: bounded in documents and in lines."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # at most twice per_class ids, so the join is a broadcast of a proven size
    bad, good = (settle(usable.filter(F.col("label") == y).orderBy(*order).limit(per_class)) for y in (0, 1))
    chosen = F.broadcast(bad.unionByName(good))
    lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    picked = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).withColumn("n_lines", lines)
    picked = settle(picked)
    # at most per_class ids of each label
    room, taken = {}, []
    for r in picked.select("doc_id", "label", "n_lines").orderBy(*order).collect():
        if r.n_lines <= room.setdefault(r.label, max_lines // 2):
            room[r.label] -= r.n_lines
            taken.append((r.doc_id,))
    kind = picked.schema["doc_id"].dataType.simpleString()
    picked = picked.join(F.broadcast(docs.sparkSession.createDataFrame(taken, f"doc_id {kind}")), "doc_id")

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(lambda t: line_features(t)[0].ravel())

    return picked.select(features("text").alias("features"), "n_lines", F.col("label").cast("int")).toPandas()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_lines: int = MAX_LINES) -> Field:
    small_batches(docs)
    found = sample(docs, labels, per_class, max_lines)
    return fit_field([np.asarray(f).reshape(-1, WIDTH) for f in found["features"]], found["label"].to_numpy(int))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """Add ``score`` to all columns of ``docs``; only the text goes through Python."""
    small_batches(docs)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(field.scores(texts))
        release()

    return docs.withColumn("score", scored(F.col("text")))
