"""Queries over the scan ledger: statistics, history, quota, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.ordered import quantile_slices, running_number, top_per_key
from docwarden.operators.ensemble import normalise_verdict

#: Ranges of time that a page is looked up by.
RANGES = 128


def ledger(scans: DataFrame) -> DataFrame:
    """Scan rows with one spelling of the verdict."""
    return scans.withColumn("verdict", normalise_verdict(F.col("raw_verdict"), F.col("risk_score")))


def plan_limits(spark) -> DataFrame:
    """The three plans and their limits, -1 for none. Three rows, so joins may broadcast it."""
    rows = [(plan, v["scans"], v["api_calls"], v["storage_mb"]) for plan, v in fixed.PLAN_LIMITS.items()]
    return spark.createDataFrame(rows, "plan string, scans_limit int, api_calls_limit int, storage_limit_mb int")


def limit_of(plan: Column, kind: str = "scans") -> Column:
    """Limit of a plan as an expression; an unknown plan has that of FREE."""
    value = F.lit(fixed.PLAN_LIMITS["FREE"][kind])
    for name, limits in fixed.PLAN_LIMITS.items():
        value = F.when(plan == name, F.lit(limits[kind])).otherwise(value)
    return value


def user_stats(scans: DataFrame) -> DataFrame:
    """Counts and last activity of each user in one pass."""
    return scans.groupBy("user_id").agg(
        F.count("*").alias("total_scans"),
        F.count_if(F.col("verdict") == "BENIGN").alias("benign"),
        F.count_if(F.col("verdict") == "MALICIOUS").alias("malicious"),
        F.max("created_at").alias("last_activity"),
    )


def monthly_usage(scans: DataFrame) -> DataFrame:
    month = F.date_trunc("MONTH", F.col("created_at")).cast("timestamp_ntz")
    return scans.groupBy("user_id", month.alias("month")).agg(F.count("*").alias("scans_used"))


def quota_summary(users: DataFrame, scans: DataFrame, as_of: str) -> DataFrame:
    """Used, limit, remaining and permission of every user for the month of ``as_of``."""
    first_day = F.date_trunc("MONTH", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")
    # the date predicate reaches the ledger scan
    used = scans.filter(F.col("created_at") >= first_day).groupBy("user_id").agg(F.count("*").alias("scans_used"))
    limit = limit_of(F.col("plan"))
    free = limit == -1
    n = F.coalesce("scans_used", F.lit(0))
    return users.join(used, "user_id", "left").select(
        "user_id",
        "plan",
        n.alias("scans_used"),
        limit.alias("scans_limit"),
        F.when(free, "Unlimited").otherwise(F.greatest(F.lit(0), limit - n).cast("string")).alias("scans_remaining"),
        free.alias("is_unlimited"),
        (free | (n < limit)).alias("can_scan"),
    )


def quota_decisions(scans: DataFrame, users: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each scan with its number in the user's month, whether the quota allows it and which notice it causes.

    ``seen``: (user_id, month, seen) scans that were counted before these.
    """
    month = F.date_trunc("MONTH", F.col("created_at")).cast("timestamp_ntz")
    rows = scans.select("scan_id", "user_id", "created_at", month.alias("month"))
    sliced = quantile_slices(rows, F.unix_micros(F.col("created_at").cast("timestamp")), "slice")
    carry = users.select("user_id", "plan")
    if seen is not None:
        carry = rows.select("user_id", "month").distinct().join(carry, "user_id").join(seen, ["user_id", "month"], "left")
    joined = running_number(sliced, ["user_id", "month"], ["created_at", "scan_id"], F.col("slice"), "scan_no", carry)
    if seen is not None:
        joined = joined.withColumn("scan_no", F.col("scan_no") + F.coalesce("seen", F.lit(0)))
    limit = limit_of(F.col("plan"))
    allowed = (limit == -1) | (F.col("scan_no") <= limit)
    percent = F.col("scan_no") / limit * 100
    return joined.select(
        "scan_id",
        "user_id",
        "plan",
        "scan_no",
        allowed.alias("allowed"),
        F.when(allowed & (percent >= 100), "QUOTA_EXCEEDED").when(allowed & (percent >= 80), "QUOTA_WARNING").otherwise("NONE").alias("notice"),
    )


def quota_notices(decisions: DataFrame) -> DataFrame:
    """Notice texts for the scans that cause one."""
    limit = limit_of(F.col("plan"))
    share = F.floor(F.col("scan_no") / limit * 100 + 0.5).cast("int")
    warned = F.col("notice") == "QUOTA_WARNING"
    return decisions.filter(F.col("notice") != "NONE").select(
        "scan_id",
        "user_id",
        F.col("notice").alias("type"),
        F.when(warned, "Scan Quota Warning").otherwise("Scan Quota Exceeded").alias("title"),
        F.when(
            warned,
            F.format_string(
                "You've used %d of %d scans this month (%d%%). Consider upgrading for more scans.", F.col("scan_no"), limit, share
            ),
        ).otherwise(F.format_string("You've reached your monthly limit of %d scans. Upgrade to continue scanning.", limit)).alias("message"),
    )


def usage_tracking(scans: DataFrame, subs: DataFrame) -> DataFrame:
    """One row per subscription, year and month: scans used beside the limits of the plan."""
    used = scans.groupBy("user_id", F.year("created_at").alias("year"), F.month("created_at").alias("month")).agg(F.count("*").alias("scans_used"))
    plan = F.col("plan")
    return used.join(subs, "user_id").select(
        "subscription_id",
        "user_id",
        "year",
        "month",
        "scans_used",
        limit_of(plan).alias("scans_limit"),
        F.lit(0).alias("api_calls_used"),
        limit_of(plan, "api_calls").alias("api_calls_limit"),
        limit_of(plan, "storage_mb").alias("storage_limit_mb"),
    )


def merge_usage(current: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of ``new`` added to ``current``; rows that are only in one of them stay. Limits of the newer win."""
    both = current.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    keys = ["subscription_id", "user_id", "year", "month"]
    return both.groupBy(*keys).agg(
        F.sum("scans_used").alias("scans_used"),
        *[F.max_by(c, "_age").alias(c) for c in ("scans_limit", "api_calls_used", "api_calls_limit", "storage_limit_mb")],
    )


def usage_last_months(usage: DataFrame, months: int = 12) -> DataFrame:
    """The last months of every subscription, newest first; the ranking limit drops rows before the exchange."""
    w = Window.partitionBy("subscription_id").orderBy(F.desc("year"), F.desc("month"))
    return usage.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= months)


def latest_per_user(scans: DataFrame, k: int, id_column: str = "scan_id") -> DataFrame:
    """The k newest rows of each user with their rank. At most k rows of a user leave a task, however many it holds."""
    return top_per_key(scans, ["user_id"], [F.desc("created_at"), id_column], k, "rank")


def history(scans: DataFrame, k: int = 50) -> DataFrame:
    """History items: newest k of each user."""
    rows = latest_per_user(scans, k)
    sid = F.col("scan_id").cast("string")
    return rows.select(
        "user_id",
        "rank",
        "scan_id",
        "created_at",
        F.lower("verdict").alias("verdict"),
        "risk_score",
        F.concat(F.lit("/api/report/"), sid).alias("report_url"),
        F.when(F.col("verdict") == "MALICIOUS", F.concat(F.lit("/api/download/"), sid)).alias("download_clean_url"),
    )


def trend(scans: DataFrame, shown: int = 20) -> DataFrame:
    """Risk percentages of the newest scans of each user, oldest first."""
    rows = latest_per_user(scans, shown)
    oldest = Window.partitionBy("user_id").orderBy(F.desc("rank"))
    return rows.select(
        "user_id", "scan_id", F.row_number().over(oldest).alias("step"), text.percent(F.col("risk_score")).alias("risk_percent")
    )


def page(scans: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page, newest first, at any depth.

    Times are cut into ranges and the rows of each are counted: as many numbers as there are ranges reach the driver. Only the
    ranges that the page lies in are read again and numbered, so what is moved does not grow with the offset.
    Rows without a time come last.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100, offset not negative")
    timed = scans.withColumn("_at", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))))
    bounds = sorted({int(b) for b in timed.approxQuantile("_at", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))}, reverse=True)
    # the newest range first; a range ends before its bound
    ranges = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        ranges = F.when(F.col("_at") >= bound, i).otherwise(ranges)
    sizes = dict(timed.groupBy(ranges.alias("r")).count().collect())
    before, taken = 0, {}
    for r in sorted(sizes):
        if before < offset + limit and before + sizes[r] > offset:
            taken[r] = before
        before += sizes[r]
    if not taken:
        return scans.limit(0)
    low, high = (bounds[max(taken)] if max(taken) < len(bounds) else None), (bounds[min(taken) - 1] if min(taken) else None)
    near = timed.filter(F.lit(True) if low is None else F.col("_at") >= low).filter(F.lit(True) if high is None else F.col("_at") < high)
    start = F.create_map(*[F.lit(x) for pair in taken.items() for x in pair])
    inside = Window.partitionBy("_range").orderBy(F.desc("_at"), "scan_id")
    numbered = near.withColumn("_range", ranges).withColumn("_no", F.row_number().over(inside) + F.try_element_at(start, F.col("_range")))
    return numbered.filter((F.col("_no") > offset) & (F.col("_no") <= offset + limit)).drop("_at", "_range", "_no")


def verdict_rollup(scans: DataFrame) -> DataFrame:
    """Counts per user and verdict, per user, and in all."""
    return scans.rollup("user_id", "verdict").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("scans"), F.max("risk_score").alias("max_risk")
    )


def month_resets(scans: DataFrame) -> DataFrame:
    """Scans at which a user's counter starts again: the first of each month that follows another one.

    The first scan of a month is found by aggregation, so only one row per user and month is ordered.
    """
    month = F.date_trunc("MONTH", F.col("created_at")).cast("timestamp_ntz")
    firsts = scans.groupBy("user_id", month.alias("month")).agg(
        F.min(F.struct("created_at", "scan_id")).alias("first"), F.count("*").alias("used_in_month")
    )
    w = Window.partitionBy("user_id").orderBy("month")
    seen = firsts.withColumns({"previous_month": F.lag("month").over(w), "used_before": F.lag("used_in_month").over(w)})
    return seen.filter(F.col("previous_month").isNotNull()).select(
        "user_id", F.col("first.scan_id").alias("scan_id"), F.col("first.created_at").alias("reset_at"), "previous_month", "used_before"
    )


def retention_due(scans: DataFrame, as_of: str, hours: int = fixed.RETENTION_HOURS) -> DataFrame:
    """Pending files whose time is over. The comparison is on the stored column, so old days alone are read."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return scans.filter((F.col("created_at") <= limit) & (F.col("status") == "PENDING")).select(
        "scan_id", "user_id", (F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("scheduled_for")
    )


def duplicates_by_hash(df: DataFrame) -> DataFrame:
    """(file_id, content) -> hashes that occur more than once. Copies are counted before the exchange."""
    return (
        df.select("file_id", F.sha2("content", 256).alias("sha256"))
        .groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min("file_id").alias("first_file_id"), F.max("file_id").alias("last_file_id"))
        .filter(F.col("copies") > 1)
    )
