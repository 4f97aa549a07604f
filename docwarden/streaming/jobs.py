"""The time-driven behaviour as streams. Each function takes rows at rest or arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.functions import fixed
from docwarden.operators import ledger, notices, rules
from docwarden.streaming.sink import fold_batches


def timed(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a zoned timestamp with a watermark: rows that are later than ``late`` are left out."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def scan_arrivals(files: DataFrame) -> DataFrame:
    """Result row of each arriving file; the same plan as in batch, without state."""
    s = rules.scan(files, with_archives=True)
    return s.select("file_id", "verdict", "risk_score", F.to_json("findings").alias("findings"))


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Scans per user and day; a day leaves the state once the watermark has passed it."""
    w = F.window("ts", "1 day")
    counted = timed(events, late=late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("scans"))
    return _plain(counted.select("user_id", F.col("w.start").alias("day"), "scans"), "day")


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    month = F.date_trunc("MONTH", "day").cast("timestamp_ntz")
    return daily.groupBy("user_id", month.alias("month")).agg(F.sum("scans").alias("scans_used"))


def sliding_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Scans and highest value per event type over the last day, every hour."""
    w = F.window("ts", "1 day", "1 hour")
    out = timed(events, late=late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("scans"), F.max("value").alias("max_value"))
    return _plain(out.select("event_type", F.col("w.start").alias("start"), "scans", "max_value"), "start")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of each user, written once no row can join them any more."""
    s = timed(events, late=late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return _plain(s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"), "start", "end")


def expired_hours(events: DataFrame, hours: int = fixed.RETENTION_HOURS) -> DataFrame:
    """Hours of uploads whose files are all due for deletion: the watermark is the retention time."""
    kept = timed(events, late=f"{hours} hours").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("files"))
    return _plain(kept.select(F.col("w.start").alias("hour"), "files"), "hour")


def plan_state(webhooks: DataFrame) -> DataFrame:
    """Plan of each customer after its last billing event."""
    last = webhooks.groupBy("customer_id").agg(
        F.max(F.struct("created_at", "event_id", "kind", "plan")).alias("e"), F.count("*").alias("events")
    )
    return last.select(
        "customer_id",
        F.when(F.col("e.kind") == "deleted", "FREE").otherwise(F.col("e.plan")).alias("plan"),
        F.col("e.kind").alias("last_kind"),
        "events",
    )


def codes_used_in_time(issued: DataFrame, used: DataFrame, valid: str = "10 minutes") -> DataFrame:
    """One-time codes that were used while they were valid. Both states are dropped when the interval is over."""
    a = timed(issued.select(F.col("user_id").alias("issued_to"), F.col("event_id").alias("issue_id"), F.col("ts").alias("issued_at")), "issued_at")
    b = timed(used.select("user_id", F.col("event_id").alias("use_id"), F.col("ts").alias("used_at")), "used_at")
    when = (F.col("used_at") >= F.col("issued_at")) & (F.col("used_at") <= F.col("issued_at") + F.expr(f"INTERVAL {valid}"))
    joined = a.join(b, (F.col("issued_to") == F.col("user_id")) & when)
    return _plain(joined.select("user_id", "issue_id", "use_id", "issued_at", "used_at"), "issued_at", "used_at")


def log_webhooks(events: DataFrame, provider: str = "billing") -> DataFrame:
    """Append-only log of arriving billing events, payload kept as text."""
    return events.select(
        F.lit(provider).alias("provider"),
        F.col("event_type").alias("event"),
        F.col("props").alias("payload"),
        F.lit(False).alias("processed"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        "event_id",
    )


def audit_rows(calls: DataFrame) -> DataFrame:
    """Audit rows from the three ways of calling: one document, positions, or names.

    ``calls``: (call_id, form, doc, action, user_id, details, at). A document wins over the columns, and a missing
    time is that of the call. A call that cannot be read still leaves a row.
    """
    doc = F.from_json("doc", "action string, user_id string, details string, created_at string")
    given = F.when(F.col("form") == "document", doc)
    return calls.select(
        "call_id",
        F.coalesce(given["action"], F.col("action")).alias("action"),
        F.coalesce(given["user_id"], F.col("user_id").cast("string")).alias("user_id"),
        F.coalesce(given["details"], F.col("details")).alias("details"),
        F.coalesce(given["created_at"].try_cast("timestamp_ntz"), F.col("at").cast("timestamp_ntz")).alias("created_at"),
    )


def dedup_roughly(arriving: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Built-in duplicate removal within the watermark: bounded state, may hold a notice back longer than ``gap``."""
    return timed(arriving, "created_at", gap).dropDuplicatesWithinWatermark(["user_id", "type"])


def dedup_exactly(notices_stream: DataFrame, seconds: int = 3600, path: str | None = None) -> DataFrame:
    """The one-hour rule over a stream, run to its end. The state is the last accepted instant per user and type.

    What lies within the hour behind that instant is dropped; the rest of the batch then starts afresh, so the
    batch rule applies to it as it is.
    """
    gap = seconds * 1_000_000

    def step(batch: DataFrame, state: DataFrame):
        at = F.unix_micros(F.col("created_at").cast("timestamp"))
        fresh = batch.join(state, notices.KEYS, "left").filter(F.col("last").isNull() | (at - F.col("last") > gap)).drop("last")

        def after(written: DataFrame) -> DataFrame:
            both = written.select(*notices.KEYS, at.alias("last")).unionByName(state)
            return both.groupBy(*notices.KEYS).agg(F.max("last").alias("last"))

        return notices.dedup(fresh, seconds), after

    return fold_batches(notices_stream, step, "user_id bigint, type string, last bigint", path)


def quota_alerts(scans: DataFrame, users: DataFrame, path: str | None = None) -> DataFrame:
    """Warning and exceeded notices at the very scan that causes them, over a stream that is run to its end.

    The state is the number of scans per user and month; each batch goes on counting from there.
    """
    month = F.date_trunc("MONTH", F.col("created_at")).cast("timestamp_ntz")

    def step(batch: DataFrame, state: DataFrame):
        def after(written: DataFrame) -> DataFrame:
            counted = batch.groupBy("user_id", month.alias("month")).agg(F.count("*").alias("seen"))
            return counted.unionByName(state).groupBy("user_id", "month").agg(F.sum("seen").alias("seen"))

        decided = ledger.quota_decisions(batch, users, state)
        return decided.filter(F.col("notice") != "NONE").select("scan_id", "user_id", "scan_no", "notice"), after

    return fold_batches(scans, step, "user_id bigint, month timestamp_ntz, seen bigint", path)
