"""What each filter of a chain removes, in every order of the chain.

Five filters judge whole texts; A and B come from the rows of a sparse document-term matrix (row sum and number of
nonzero cells), the others from the text itself:

A: under 200 words. B: fewer than half of the words are distinct. C: more than 2 % of the characters are A-Z.
D: holds any of ``#$%&*|``. E: the same text as a row with a smaller id.

Documents are counted by part and by the set of filters that they fail: 32 sets, whatever the corpus. All orders are
read off these counts: in an order, a filter removes the documents whose set holds it and none of the filters before
it. Equal texts fail the same filters, so copies are counted by text, part and labels first, and only these counts
are joined to the least id of the text: no text's copies meet in one task.

Defined cases: a null text is empty; null source is the part of the empty string; a null id has no
smaller one and is no copy, and takes no label; rows that share id and text are no copies of each other; of repeated labels any 1
counts, null labels do not; an empty table gives an empty result; other columns of ``documents`` and ``labels`` do not matter.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from docwarden.llm.term_matrix import BLOCK, term_matrix
from docwarden.llm.word_arrays import text_bytes
from docwarden.session import settle

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
_UPPER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a character of UTF-8.
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


MEASURED = StructType([StructField("capitals", BooleanType()), StructField("symbols", BooleanType())])


def measure(texts: pa.Array) -> dict[str, pa.Array]:
    """Filters C and D, from the bytes of the texts."""
    data, at = text_bytes(texts)
    upper, points, marks = (np.concatenate(([0], np.cumsum(kind[data], dtype=np.int32)))[at] for kind in (_UPPER, _FIRST_BYTE, _SYMBOL))
    return {"capitals": pa.array(100 * np.diff(upper).astype(np.int64) > MOST_CAPITALS * np.diff(points).astype(np.int64)), "symbols": pa.array(np.diff(marks) > 0)}


def failures(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, part, digest, fails): the set of filters A to D that each document fails."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        text.alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    matrix = term_matrix(facts, ["doc_id", "part", "digest"], block, measure, MEASURED)
    n = F.col("n_words")
    failed = {"A": n < LEAST_WORDS, "B": 100 * F.col("n_distinct") < LEAST_DISTINCT * n, "C": F.col("capitals"), "D": F.col("symbols")}
    fails = sum((F.when(condition, bit(letter)).otherwise(0) for letter, condition in failed.items()), F.lit(0))
    return matrix.totals().select("doc_id", "part", "digest", fails.alias("fails"))


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part by the set of all filters that they fail."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = failed.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ["digest", "part", "fails", "good", "toxic"]
    by_id = known.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))
    by_text = settle(
        by_id.groupBy(*kinds).agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        )
    )
    # a text has at most four rows a part here
    least = by_text.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    own = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("fails").alias("fails"), own.alias("n")),
        F.struct((F.col("fails") + bit("E")).alias("fails"), (F.col("n") - own).alias("n")),
    )
    split = by_text.join(least, "digest").select("part", "good", "toxic", F.inline(sides))
    return split.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def orders() -> Column:
    """All steps of all orders: (filter_order, step, own, before), the last two as sets of filters; one literal."""
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "own": bit(letter), "before": sum(map(bit, order[:i]))}
        for order in permutations(FILTERS)
        for i, letter in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, source), (doc_id, quality, toxic) -> one row per part, order of filters and step."""
    sets = counts(failures(docs, block), labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    spread = sets.select("part", "sets", F.inline(orders()))
    own, before = F.col("own"), F.col("before")

    def total(take, value=lambda s: s["n"]) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda acc, s: acc + F.when(take(s["fails"]), value(s)).otherwise(F.lit(0).cast("long")))

    def here(fails: Column) -> Column:
        return (fails.bitwiseAND(own) != 0) & (fails.bitwiseAND(before) == 0)

    return spread.select(
        "part",
        "filter_order",
        "step",
        total(lambda f: f.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda f: (f.bitwiseAND(own) != 0) & (f.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda f: f == own).alias("unique_fails"),
        total(here, lambda s: s["good"]).alias("good_lost"),
        total(here, lambda s: s["toxic"]).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in an equal share of all orders
        total(lambda f: f.bitwiseAND(own) != 0, lambda s: s["n"] * (120 / F.bit_count(s["fails"])).cast("long")).alias("shapley"),
    )
