"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each source gets a share of ``budget`` times all sizes in proportion to its weight, but never more than ``most``
times its own size; what is above is shared again by weight (closed form of water filling over the sources). The
whole part of target / size repeats every document of the source; the rest is a budget that the documents with the
smallest hashes fill: sizes are summed by source and hash bucket, the bucket where the running sum passes the budget
is found, and only that bucket is divided further, level by level, until a bucket is a single hash. No document is
sorted; a level's histogram has at most 2^12 rows per source, whatever the number of documents.

Defined cases: a null text has size 0 and is taken with 0 words; a null source is a source of its own, last in
order; documents with equal id and text share a hash and are taken or left together; an empty table gives an empty
result; a source of size 0 has target 0; very long texts are counted like others; ``keep`` may name any column of the
input but those of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.common import n_words
from docwarden.session import settle

WEIGHTS = (5, 2, 1)
LEVEL_BITS, LEVELS = 12, 5
HASH_BITS = LEVEL_BITS * LEVELS


def source_key(source: Column) -> Column:
    """Sorts sources by code point, null last, and is never null itself."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def document_hash(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of a digest of id and text."""
    whole = F.concat(
        F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(F.encode(whole, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(key, source_size) -> the same with ``target``; one row per source."""
    rank = F.row_number().over(Window.orderBy("key"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * most)
    # sources by the level at which they are full; before a source stand the caps, from it on the weights
    level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    share = (
        F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    stepped = ranked.withColumn("share", share)
    water = F.min(F.when(F.col("share") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("key"), F.col("share"))))
    found = stepped.withColumn("found", water.over(everything))
    target = F.when(F.col("found").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("found.share") * F.col("weight"))
    )
    return found.withColumn("target", target).select("key", "source_size", "target")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, size, hash) and one row per source with ``need`` -> (key, threshold): hashes up to it are taken.

    ``size`` sums up to the threshold come as near to ``need`` as whole hashes allow.
    """
    state = settle(
        wanted.select(
            "key",
            F.col("need").cast("double").alias("need"),
            F.lit(0).cast("long").alias("prefix"),
            F.lit(None).cast("long").alias("threshold"),
        )
    )
    for level in range(1, LEVELS + 1):
        below = HASH_BITS - level * LEVEL_BITS
        bucket = F.shiftright("hash", below)
        in_prefix = F.shiftright("hash", below + LEVEL_BITS) == F.col("prefix")
        open_sources = state.filter(F.col("threshold").isNull())
        sums = (
            rows.join(open_sources.select("key", "prefix"), "key")
            .filter(in_prefix)
            .groupBy("key", bucket.alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        running = F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))
        boundary = (
            sums.withColumn("upto", running)
            .join(open_sources.select("key", "need"), "key")
            .filter(F.col("upto") > F.col("need"))
            .groupBy("key")
            .agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
        )
        left = F.col("need") - (F.col("b.upto") - F.col("b.n"))
        if level < LEVELS:
            # no boundary: everything fits, which only the first level can find
            last = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(
                F.col("b").isNull(), F.lit((1 << HASH_BITS) - 1)
            )
        else:
            last = (
                F.when(F.col("threshold").isNotNull(), F.col("threshold"))
                .when(F.col("b").isNull(), F.lit((1 << HASH_BITS) - 1))
                .when(2 * left >= F.col("b.n"), F.col("b.bucket"))
                .otherwise(F.col("b.bucket") - 1)
            )
        state = settle(
            state.join(boundary, "key", "left").select(
                "key",
                F.when(F.col("b").isNull(), F.col("need")).otherwise(left).alias("need"),
                F.coalesce("b.bucket", "prefix").alias("prefix"),
                last.cast("long").alias("threshold"),
            )
        )
    return state.select("key", "threshold")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: int = 2, keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, text, source) -> one row per document: doc_id, size, source_size, target, copies, taken.

    ``copies`` is how often the mix repeats the document, ``taken`` the words that makes. Columns named in ``keep``
    come along.
    """
    made = {"size", "source_size", "target", "copies", "taken", "_key", "_hash", "_whole", "_need", "_threshold"}
    if made & set(keep) or len(set(keep)) < len(keep):
        raise ValueError(f"columns of the result cannot be kept: {sorted(made & set(keep))}")
    rows = settle(
        docs.select(
            *keep,
            *[c for c in ("doc_id",) if c not in keep],
            n_words("text").alias("size"),
            source_key(F.col("source")).alias("_key"),
            document_hash(F.col("doc_id"), F.col("text")).alias("_hash"),
        )
    )
    per_source = settle(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("source_size")))
    planned = targets(per_source, weights, budget, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = settle(
        planned.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    cut = thresholds(rows.select(F.col("_key").alias("key"), "size", F.col("_hash").alias("hash")), planned)
    plan = settle(planned.join(cut, "key").select(F.col("key").alias("_key"), "source_size", "target", *[F.col(c).alias(f"_{c}") for c in ("whole", "need", "threshold")]))
    extra = ((F.col("_hash") <= F.col("_threshold")) & (F.col("_need") > 0)).cast("long")
    return (
        rows.join(plan, "_key")
        .withColumn("copies", F.col("_whole") + extra)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_key", "_hash", "_whole", "_need", "_threshold")
    )
