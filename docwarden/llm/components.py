"""Connected components of a table of links, by alternating large and small stars.

Each round links every node's larger neighbours to the least node around it, then its smaller ones, until nothing
changes; the number of rounds grows with the logarithm of the longest path. A node with very many neighbours is one
row after the partial aggregation, and the join that sends its least neighbour back is split by Spark where a
partition is too large. Rounds are written to the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.session import settle


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u").toDF("u", "v"))
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settle(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component_id) for every node that has a link; the id is its least node."""
    now = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    digest = _digest(now)
    while digest[0]:
        now = settle(_small(settle(_large(now))))
        if (then := _digest(now)) == digest:
            break
        digest = then
    # at rest every link is a star around the least node
    return settle(now.groupBy("u").agg(F.min("v").alias("component_id")).toDF("node", "component_id").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    ))
