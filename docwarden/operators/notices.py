"""Notifications: order, read marks, and the one-hour rule.

The one-hour rule is sequential: a notice is dropped when an *accepted* notice of the same user and type lies at
most an hour back. It is solved exactly without walking a user's history in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.functions.ordered import next_greater, top_per_key
from docwarden.session import settle

KEYS = ["user_id", "type"]


def inbox(notices: DataFrame, k: int = 50) -> DataFrame:
    """Unread first, newest first, k per user, with the number of unread ones among them."""
    shown = top_per_key(notices, ["user_id"], ["is_read", F.desc("created_at"), "notification_id"], k, "rank")
    return shown.withColumn("unread_count", F.count_if(~F.col("is_read")).over(Window.partitionBy("user_id")))


def mark_read(notices: DataFrame, at: str, users: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Mark all unread notices of some users, or single ones, as read at a given time."""
    hit = F.lit(False)
    if users is not None:
        notices = notices.join(users.select("user_id").distinct().withColumn("_u", F.lit(True)), "user_id", "left")
        hit = hit | (F.coalesce("_u", F.lit(False)) & ~F.col("is_read"))
    if ids is not None:
        notices = notices.join(ids.select("notification_id").distinct().withColumn("_i", F.lit(True)), "notification_id", "left")
        hit = hit | F.coalesce("_i", F.lit(False))
    return notices.withColumns(
        {"read_at": F.when(hit, F.lit(at).cast("timestamp_ntz")), "is_read": F.col("is_read") | hit}
    ).drop("_u", "_i")


def _sessions(rows: DataFrame, gap: int) -> DataFrame:
    """(user, type, slice) -> session, its size and its first instant. A slice is one gap long.

    More than a gap between neighbours starts a session, and such a break can only lie between slices. The rows
    are reduced to slices before anything is ordered per key.
    """
    slices = rows.groupBy(*KEYS, "slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(*KEYS).orderBy("slice")
    fresh = F.coalesce(F.col("lo") - F.lag("hi").over(w) > gap, F.lit(True)).cast("int")
    numbered = slices.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    whole = Window.partitionBy(*KEYS, "session")
    return numbered.select(
        *KEYS, "slice", "session", F.sum("n").over(whole).alias("rows"), F.min("lo").over(whole).alias("first")
    )


def _fold(placed: DataFrame, gap: int) -> DataFrame:
    """Accepted rows of sessions of bounded size: one pass over a sorted array."""
    row = "struct<t:bigint,notification_id:bigint>"
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(f"array<{row}>").alias("kept"))
    grouped = placed.groupBy(*KEYS, "session").agg(F.array_sort(F.collect_list(F.struct("t", "notification_id"))).alias("rows"))
    taken = F.aggregate(
        "rows",
        start,
        lambda acc, r: F.when(
            acc["last"].isNull() | (r["t"] - acc["last"] > gap),
            F.struct(r["t"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept")),
        ).otherwise(acc),
    )["kept"]
    return grouped.select(*KEYS, F.inline(taken)).select(*KEYS, "t", "notification_id")


def _chase(placed: DataFrame, gap: int) -> DataFrame:
    """Accepted rows of sessions of any size, by doubling the step along "next instant more than a gap later".

    Of the rows at one instant only the first can be accepted. Every join is on (user, type, instant), which is
    unique then, so a large session is spread over all tasks. The number of rounds is the logarithm of the
    session's length in gaps.
    """
    points = settle(placed.groupBy(*KEYS, "session", "first", "t").agg(F.min("notification_id").alias("notification_id")))
    jump = settle(next_greater(points, [*KEYS, "session"], "t", gap, "next").filter(F.col("next").isNotNull()).drop("session"))
    kept = settle(points.filter(F.col("t") == F.col("first")).select(*KEYS, "t"))
    while True:
        reached = kept.join(jump, [*KEYS, "t"]).select(*KEYS, F.col("next").alias("t"))
        if reached.isEmpty():
            return points.join(kept, [*KEYS, "t"]).select(*KEYS, "t", "notification_id")
        kept = settle(kept.unionByName(reached))
        onward = jump.select(*KEYS, F.col("next").alias("far"), F.col("t").alias("next"))
        jump = settle(jump.join(onward, [*KEYS, "next"]).select(*KEYS, "t", F.col("far").alias("next")))


def dedup(notices: DataFrame, seconds: int = 3600, fold_rows: int = 10_000) -> DataFrame:
    """Accepted notices under the one-hour rule. Sessions above ``fold_rows`` take the doubling way."""
    gap = seconds * 1_000_000
    rows = notices.select(*KEYS, "notification_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    rows = rows.withColumn("slice", F.floor(F.col("t") / gap))
    sessions = settle(_sessions(rows, gap))
    placed = rows.join(sessions, [*KEYS, "slice"])
    accepted = _fold(placed.filter(F.col("rows") <= fold_rows), gap)
    if not sessions.filter(F.col("rows") > fold_rows).isEmpty():
        accepted = accepted.unionByName(_chase(placed.filter(F.col("rows") > fold_rows), gap))
    return accepted.select(*KEYS, "notification_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("created_at"))
