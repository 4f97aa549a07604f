"""URL filters: explicit rules first, link-graph propagation for the rest, in DataFrame operations only.

Trust starts at hosts with allowed pages and follows links (personalised PageRank); distrust starts at hosts with
blocked pages and follows links backwards, to those who link there. Edges are summed by pair of hosts before anything
else is done, so a host with very many pages is one row per neighbour. A host is blocked if its distrust is above
``ratio`` times its trust; hosts that neither reaches are allowed.

Defined cases: a null url or one without ``://`` has empty host and path and belongs to the empty host; null html has
no links; relative links stay on their host; links without a host are dropped; repeated pages count once each;
empty tables give an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import ascii_lower
from docwarden.session import settle

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"
#: Rounds that the SQL beside this takes; here rounds go on until every host's rank is at rest.
ROUNDS = 8
DAMPING, RATIO, REST = 0.85, 1.0, 1e-6


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def first(values: list[str]) -> Column:
        fits = [
            F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(v))
            for (h, p, _), v in zip(by_length, values, strict=True)
        ]
        return F.coalesce(*fits)

    return first([h + p for h, p, _ in by_length]), first([v for _, _, v in by_length])


def host_edges(pages: DataFrame) -> DataFrame:
    """(host, html) -> (src, dst, n) with the number of links between two different hosts."""
    link = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link")
    # protocol-relative links carry a host as well
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return (
        pages.filter(F.col("html").contains("://") | F.col("html").contains("//"))
        .select(F.col("host").alias("src"), link)
        .select("src", host_of(whole).alias("dst"))
        .filter((F.col("dst") != "") & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, seed_trust, seed_distrust) -> the same with ``trust`` and ``distrust``, after ``rounds`` or at rest.

    At rest two more rounds reach no new host and change no rank by more than ``REST`` of itself.

    Both run in one job: a row of the doubled edges says whose rank flows where. Rank that arrives at a host without
    links onwards ends there.
    """
    flows = edges.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    out = flows.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    flows = settle(flows.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("share")))
    seeds = settle(
        hosts.select(F.lit(0).alias("kind"), "host", F.col("seed_trust").alias("seed"))
        .unionByName(hosts.select(F.lit(1).alias("kind"), "host", F.col("seed_distrust").alias("seed")))
    ).filter("seed > 0")
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    settled = ranks
    for i in itertools.count() if rounds is None else range(rounds):
        moved = ranks.withColumnRenamed("host", "a").join(flows, ["kind", "a"]).select(
            "kind", F.col("b").alias("host"), (F.col("rank") * F.col("share") * damping).alias("part")
        )
        start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("part"))
        ranks = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("part").alias("rank"))
        if i % 2 or i + 1 == rounds:
            ranks = settle(ranks)
            if rounds is None:
                before = settled.select("kind", "host", F.col("rank").alias("was"))
                change = F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))
                # one number
                if not ranks.join(before, ["kind", "host"], "left").filter(change > F.col("rank") * REST).count():
                    break
                settled = ranks
    wide = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("rank"))).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("rank"))).alias("distrust"),
    )
    zero = F.lit(0.0)
    return hosts.join(wide, "host", "left").withColumns(
        {"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)}
    )


def host_scores(pages: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, html, ruled) -> one row per host of a page with its seeds and scores."""
    hosts = settle(
        pages.groupBy("host").agg(
            (F.sum((F.coalesce("ruled", F.lit("")) == "allow").cast("long")) / F.count("*")).alias("seed_trust"),
            (F.sum((F.coalesce("ruled", F.lit("")) == "block").cast("long")) / F.count("*")).alias("seed_distrust"),
        )
    )
    return propagate(hosts, settle(host_edges(pages)), rounds, damping)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int | None = None, damping: float = DAMPING,
    ratio: float = RATIO,
) -> DataFrame:
    """(page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": ruled})
    scores = settle(host_scores(parsed, rounds, damping).select("host", "trust", "distrust"))
    spread_out = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return parsed.drop("html").join(scores, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", spread_out).alias("verdict"), "trust", "distrust"
    )
