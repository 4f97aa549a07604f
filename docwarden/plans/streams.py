"""Streams over the given tables, run to their end; the SQL gives the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.plans import sql
from docwarden.plans.accounts import _DECIDED, _HOOKS, _dedup_sql
from docwarden.plans.registry import query
from docwarden.sources import corpus, tables
from docwarden.streaming import jobs
from docwarden.streaming.sink import append_all, read_stream, upsert_all


@query("stream_scan", f"WITH {sql.CORPUS}, {sql.RULES} SELECT file_id, verdict, risk_score FROM decided")
def stream_scan(spark: SparkSession, folder: str) -> DataFrame:
    arriving = corpus.planted(read_stream(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return append_all(jobs.scan_arrivals(arriving)).select("file_id", "verdict", "risk_score")


@query(
    "stream_usage",
    "SELECT user_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*)::BIGINT AS scans_used FROM events GROUP BY ALL",
)
def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    daily = upsert_all(jobs.daily_usage(read_stream(spark, folder, "events")), ["user_id", "day"])
    return jobs.monthly_from_daily(daily)


@query(
    "stream_sliding",
    """WITH w AS (SELECT event_type, value, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS start FROM events)
SELECT event_type, CAST(start AS TIMESTAMP) AS start, count(*) AS scans, max(value) AS max_value FROM w GROUP BY ALL""",
)
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return upsert_all(jobs.sliding_activity(read_stream(spark, folder, "events")), ["event_type", "start"])


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""",
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that are closed when the stream ends; the later ones stay in the state."""
    return append_all(jobs.sessions(read_stream(spark, folder, "events")))


@query(
    "stream_retention",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS files FROM events GROUP BY ALL
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 48 HOUR""",
)
def stream_retention(spark: SparkSession, folder: str) -> DataFrame:
    return append_all(jobs.expired_hours(read_stream(spark, folder, "events")))


@query(
    "stream_plan_state",
    f"""WITH {_HOOKS} SELECT customer_id, CASE WHEN kind = 'deleted' THEN 'FREE' ELSE plan END AS plan, kind AS last_kind, events FROM (
  SELECT *, count(*) OVER (PARTITION BY customer_id) AS events, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, event_id DESC) AS n FROM hooks) WHERE n = 1""",
)
def stream_plan_state(spark: SparkSession, folder: str) -> DataFrame:
    return upsert_all(jobs.plan_state(tables.as_webhooks(read_stream(spark, folder, "events"))), ["customer_id"])


@query(
    "stream_otp",
    """SELECT i.user_id, i.event_id AS issue_id, u.event_id AS use_id, i.ts AS issued_at, u.ts AS used_at FROM events i JOIN events u
ON u.user_id = i.user_id AND u.ts >= i.ts AND u.ts <= i.ts + INTERVAL 10 MINUTE WHERE i.event_type = 'signup' AND u.event_type <> 'signup'""",
)
def stream_otp(spark: SparkSession, folder: str) -> DataFrame:
    issued = read_stream(spark, folder, "events").filter(F.col("event_type") == "signup")
    used = read_stream(spark, folder, "events").filter(F.col("event_type") != "signup")
    return append_all(jobs.codes_used_in_time(issued, used))


@query("stream_notif_dedup", _dedup_sql(1))
def stream_notif_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.dedup_exactly(tables.as_notifications(read_stream(spark, folder, "events")))


@query("stream_dedup")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The built-in approximation: its rows are a subset of the arriving ones, at least one per user and type."""
    out = jobs.dedup_roughly(tables.as_notifications(read_stream(spark, folder, "events")))
    return append_all(out).select("user_id", "type", "notification_id")


@query("stream_quota_alerts", f"WITH {_DECIDED} SELECT scan_id, user_id, scan_no, notice FROM dec WHERE notice <> 'NONE'")
def stream_quota_alerts(spark: SparkSession, folder: str) -> DataFrame:
    scans = tables.as_scans(read_stream(spark, folder, "events")).select("scan_id", "user_id", "created_at")
    return jobs.quota_alerts(scans, tables.users(spark, folder))


@query(
    "stream_webhook_log",
    "SELECT 'billing' AS provider, event_type AS event, props AS payload, false AS processed, ts AS created_at, event_id FROM events",
)
def stream_webhook_log(spark: SparkSession, folder: str) -> DataFrame:
    return append_all(jobs.log_webhooks(read_stream(spark, folder, "events")))


@query(
    "stream_audit",
    """SELECT event_id AS call_id, event_type AS action, CAST(user_id AS VARCHAR) AS user_id, props AS details,
  CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-02 03:04:05' ELSE ts END AS created_at FROM events""",
)
def stream_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Events as audit calls of all three forms."""
    e = read_stream(spark, folder, "events")
    n = F.col("event_id")
    doc = F.to_json(
        F.struct(
            F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user_id"), F.col("props").alias("details"),
            F.lit("2024-02-02 03:04:05").alias("created_at"),
        )
    )
    by_doc = n % 3 == 0
    calls = e.select(
        n.alias("call_id"),
        F.when(by_doc, "document").when(n % 3 == 1, "positions").otherwise("names").alias("form"),
        F.when(by_doc, doc).alias("doc"),
        F.when(~by_doc, F.col("event_type")).alias("action"),
        F.when(~by_doc, F.col("user_id")).alias("user_id"),
        F.when(~by_doc, F.col("props")).alias("details"),
        F.col("ts").alias("at"),
    )
    return append_all(jobs.audit_rows(calls))
