"""Queries on the ledger, quotas, notifications and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import text
from docwarden.operators import accounts, features, ledger, notices, rules, sanitize
from docwarden.plans import sql
from docwarden.plans.registry import query
from docwarden.sources import corpus, tables

AS_OF = "2024-03-20 00:00:00"


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.ledger(tables.scans(spark, folder))


@query(
    "user_stats",
    f"""WITH {sql.SCANS} SELECT user_id, count(*) AS total_scans, count(*) FILTER (verdict = 'BENIGN') AS benign,
  count(*) FILTER (verdict = 'MALICIOUS') AS malicious, max(created_at) AS last_activity FROM ledger GROUP BY user_id""",
)
def user_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.user_stats(_ledger(spark, folder))


@query(
    "monthly_usage",
    f"""WITH {sql.SCANS} SELECT user_id, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS month, count(*) AS scans_used FROM scans GROUP BY ALL""",
)
def monthly_usage(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.monthly_usage(tables.scans(spark, folder))


@query(
    "quota_summary",
    f"""WITH {sql.SCANS}, {sql.USERS}, u AS (SELECT user_id, count(*) AS n FROM scans WHERE created_at >= TIMESTAMP '2024-03-01' GROUP BY user_id)
SELECT users.user_id, plan, coalesce(n, 0) AS scans_used, limits.scans AS scans_limit,
  CASE WHEN limits.scans = -1 THEN 'Unlimited' ELSE CAST(greatest(0, limits.scans - coalesce(n, 0)) AS VARCHAR) END AS scans_remaining,
  limits.scans = -1 AS is_unlimited, limits.scans = -1 OR coalesce(n, 0) < limits.scans AS can_scan
FROM users JOIN limits USING (plan) LEFT JOIN u ON u.user_id = users.user_id""",
)
def quota_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.quota_summary(tables.users(spark, folder), tables.scans(spark, folder), AS_OF)


_DECIDED = f"""{sql.SCANS}, {sql.USERS}, r AS (
  SELECT scan_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, scan_id) AS scan_no FROM scans),
j AS (SELECT r.*, plan, limits.scans AS lim FROM r JOIN users USING (user_id) JOIN limits USING (plan)),
q AS (SELECT *, lim = -1 OR scan_no <= lim AS allowed FROM j),
dec AS (SELECT *, CASE WHEN allowed AND lim > 0 AND scan_no * 100 >= lim * 100 THEN 'QUOTA_EXCEEDED'
  WHEN allowed AND lim > 0 AND scan_no * 100 >= lim * 80 THEN 'QUOTA_WARNING' ELSE 'NONE' END AS notice FROM q)"""


@query("quota_decisions", f"WITH {_DECIDED} SELECT scan_id, user_id, plan, scan_no, allowed, notice FROM dec")
def quota_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.quota_decisions(tables.scans(spark, folder), tables.users(spark, folder))


@query(
    "quota_notices",
    f"""WITH {_DECIDED} SELECT scan_id, user_id, notice AS type,
  CASE notice WHEN 'QUOTA_WARNING' THEN 'Scan Quota Warning' ELSE 'Scan Quota Exceeded' END AS title,
  CASE notice WHEN 'QUOTA_WARNING' THEN 'You''ve used ' || scan_no || ' of ' || lim || ' scans this month (' ||
    CAST(floor(scan_no * 100.0::DOUBLE / lim + 0.5) AS INTEGER) || '%). Consider upgrading for more scans.'
  ELSE 'You''ve reached your monthly limit of ' || lim || ' scans. Upgrade to continue scanning.' END AS message FROM dec WHERE notice <> 'NONE'""",
)
def quota_notices(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.quota_notices(quota_decisions(spark, folder))


_USAGE = f"""{sql.SCANS}, {sql.USERS}, {sql.SUBSCRIPTIONS}, usage AS (
  SELECT subscription_id, s.user_id, CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month,
    count(*) AS scans_used, any_value(limits.scans) AS scans_limit, 0 AS api_calls_used, any_value(limits.api_calls) AS api_calls_limit,
    any_value(limits.storage_mb) AS storage_limit_mb
  FROM scans s JOIN subs USING (user_id) JOIN limits USING (plan) GROUP BY ALL)"""


@query("usage_tracking", f"WITH {_USAGE} SELECT * FROM usage")
def usage_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the clicks and views, merged with those of all other scans."""
    s, subs = tables.scans(spark, folder), tables.subscriptions(spark, folder)
    early = F.col("event_type").isin("click", "view")
    return ledger.merge_usage(ledger.usage_tracking(s.filter(early), subs), ledger.usage_tracking(s.filter(~early), subs))


@query(
    "usage_last12",
    f"""WITH {_USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY year DESC, month DESC) AS rank FROM usage)
SELECT subscription_id, year, month, scans_used, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""",
)
def usage_last12(spark: SparkSession, folder: str) -> DataFrame:
    usage = ledger.usage_tracking(tables.scans(spark, folder), tables.subscriptions(spark, folder))
    return ledger.usage_last_months(usage).select("subscription_id", "year", "month", "scans_used", "rank")


@query(
    "verdict_rollup",
    f"""WITH {sql.SCANS} SELECT user_id, verdict, CAST(grouping(user_id, verdict) AS INTEGER) AS level, count(*) AS scans,
  max(risk_score) AS max_risk FROM ledger GROUP BY ROLLUP (user_id, verdict)""",
)
def verdict_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.verdict_rollup(_ledger(spark, folder))


_RANKED = f"""{sql.SCANS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id) AS rank FROM ledger)"""


@query(
    "history_top50",
    f"""WITH {_RANKED} SELECT user_id, CAST(rank AS INTEGER) AS rank, scan_id, created_at, lower(verdict) AS verdict, risk_score,
  '/api/report/' || scan_id AS report_url, CASE WHEN verdict = 'MALICIOUS' THEN '/api/download/' || scan_id END AS download_clean_url
FROM ranked WHERE rank <= 50""",
)
def history_top50(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.history(_ledger(spark, folder))


@query(
    "scans_page",
    f"WITH {sql.SCANS} SELECT scan_id, user_id, created_at, risk_score FROM scans ORDER BY created_at DESC, scan_id LIMIT 100 OFFSET 20",
)
def scans_page(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.scans(spark, folder).select("scan_id", "user_id", "created_at", "risk_score")
    return ledger.page(s, limit=100, offset=20)


@query(
    "scans_deep_page",
    f"""WITH {sql.SCANS}, n AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, scan_id) AS no FROM scans)
SELECT scan_id, user_id, created_at, risk_score FROM n, (SELECT count(*) * 3 // 4 AS skipped FROM scans) WHERE no > skipped AND no <= skipped + 100""",
)
def scans_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page behind three quarters of all scans."""
    s = tables.scans(spark, folder).select("scan_id", "user_id", "created_at", "risk_score")
    return ledger.page(s, limit=100, offset=s.count() * 3 // 4)


@query(
    "risk_trend20",
    f"""WITH {_RANKED}, t AS (SELECT * FROM ranked WHERE rank <= 20)
SELECT user_id, scan_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank DESC) AS INTEGER) AS step,
  CAST(floor(risk_score * 100 + 0.5) AS INTEGER) AS risk_percent FROM t""",
)
def risk_trend20(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.trend(tables.scans(spark, folder))


@query("recent5", f"WITH {_RANKED} SELECT user_id, scan_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def recent5(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.latest_per_user(tables.scans(spark, folder).select("user_id", "scan_id", "created_at"), 5).drop("created_at")


@query(
    "month_reset",
    f"""WITH {sql.SCANS}, l AS (
  SELECT *, date_trunc('month', created_at) AS m, lag(date_trunc('month', created_at)) OVER w AS pm FROM scans WINDOW w AS (PARTITION BY user_id ORDER BY created_at, scan_id)),
c AS (SELECT user_id, date_trunc('month', created_at) AS m, count(*) AS n FROM scans GROUP BY ALL)
SELECT l.user_id, scan_id, created_at AS reset_at, CAST(pm AS TIMESTAMP) AS previous_month, n AS used_before
FROM l JOIN c ON c.user_id = l.user_id AND c.m = l.pm WHERE l.m > l.pm""",
)
def month_reset(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.month_resets(tables.scans(spark, folder))


@query(
    "retention_due",
    f"""WITH {sql.SCANS} SELECT scan_id, user_id, created_at + INTERVAL 48 HOUR AS scheduled_for FROM scans
WHERE created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND event_type <> 'view'""",
)
def retention_due(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.scans(spark, folder).withColumn("status", F.when(F.col("event_type") == "view", "COMPLETED").otherwise("PENDING"))
    return ledger.retention_due(s, AS_OF)


@query(
    "dup_by_hash",
    """SELECT sha256(encode(text)) AS sha256, count(*) AS copies, min(doc_id) AS first_file_id, max(doc_id) AS last_file_id
FROM documents GROUP BY text HAVING count(*) > 1""",
)
def dup_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    d = tables.table(spark, folder, "documents")
    return ledger.duplicates_by_hash(d.select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content")))


# ---- notifications -----------------------------------------------------------------------------------------


@query(
    "notifications_sorted",
    """WITH n AS (SELECT event_id AS notification_id, user_id, event_id % 4 = 0 AS is_read, ts AS created_at FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_read, created_at DESC, notification_id) AS rank FROM n)
SELECT user_id, notification_id, is_read, created_at, CAST(rank AS INTEGER) AS rank,
  count(*) FILTER (NOT is_read) OVER (PARTITION BY user_id) AS unread_count FROM r WHERE rank <= 50""",
)
def notifications_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return notices.inbox(tables.notifications(spark, folder).drop("type"))


def _dedup_sql(hours: int) -> str:
    return f"""WITH RECURSIVE n AS (SELECT user_id, upper(event_type) AS type, ts, min(event_id) AS notification_id FROM events GROUP BY ALL),
f AS (SELECT user_id, type, min(ts) AS ts FROM n GROUP BY ALL
  UNION ALL
  SELECT f.user_id, f.type, (SELECT min(n.ts) FROM n WHERE n.user_id = f.user_id AND n.type = f.type AND n.ts > f.ts + INTERVAL {hours} HOUR)
  FROM f WHERE f.ts IS NOT NULL)
SELECT f.user_id, f.type, notification_id, f.ts AS created_at FROM f JOIN n ON n.user_id = f.user_id AND n.type = f.type AND n.ts = f.ts"""


@query("notif_dedup_1h", _dedup_sql(1))
def notif_dedup_1h(spark: SparkSession, folder: str) -> DataFrame:
    return notices.dedup(tables.notifications(spark, folder))


@query("notif_dedup_1d", _dedup_sql(24))
def notif_dedup_1d(spark: SparkSession, folder: str) -> DataFrame:
    """The same rule with a day, which chains many notices and so exercises the doubling way for every larger session."""
    return notices.dedup(tables.notifications(spark, folder), seconds=86_400, fold_rows=8)


@query(
    "mark_read",
    f"""WITH n AS (SELECT event_id AS notification_id, user_id, event_id % 4 = 0 AS is_read, value FROM events),
h AS (SELECT *, (user_id % 10 = 3 AND NOT is_read) OR value > 150 AS hit FROM n)
SELECT notification_id, is_read OR hit AS is_read, CASE WHEN hit THEN TIMESTAMP '{AS_OF}' END AS read_at FROM h""",
)
def mark_read(spark: SparkSession, folder: str) -> DataFrame:
    n = tables.notifications(spark, folder)
    all_of = tables.users(spark, folder).filter(F.col("user_id") % 10 == 3)
    single = tables.table(spark, folder, "events").filter(F.col("value") > 150).select(F.col("event_id").alias("notification_id"))
    return notices.mark_read(n, AS_OF, all_of, single).select("notification_id", "is_read", "read_at")


@query(
    "notice_types",
    """SELECT upper(event_type) AS type, count(*) AS notices, count(*) FILTER (event_id % 4 <> 0) AS unread FROM events
WHERE event_type IN ('error', 'purchase') GROUP BY event_type""",
)
def notice_types(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of chosen types and the unread ones among them."""
    n = tables.notifications(spark, folder).filter(F.col("type").isin("ERROR", "PURCHASE"))
    return n.groupBy("type").agg(F.count("*").alias("notices"), F.count_if(~F.col("is_read")).alias("unread"))


# ---- accounts ----------------------------------------------------------------------------------------------


@query(
    "dup_users",
    f"""WITH {sql.USERS}, k AS (SELECT *, lower(trim(email)) AS email_key FROM users),
r AS (SELECT user_id, email, email_key, first_value(user_id) OVER w AS previous_id, first_value(plan) OVER w AS previous_plan,
  count(*) OVER (PARTITION BY email_key) AS accounts, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY email_key ORDER BY user_id))
SELECT user_id, email, email_key, previous_id, previous_plan, accounts FROM r WHERE n > 1""",
)
def dup_users(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.duplicate_users(tables.users(spark, folder))


@query(
    "user_subscription",
    f"""WITH {sql.USERS}, {sql.SUBSCRIPTIONS} SELECT users.user_id, users.plan, subscription_id, subs.plan AS sub_plan, status,
  subscription_id IS NOT NULL AS has_subscription FROM users LEFT JOIN subs ON subs.user_id = users.user_id""",
)
def user_subscription(spark: SparkSession, folder: str) -> DataFrame:
    joined = accounts.with_subscription(tables.users(spark, folder), tables.subscriptions(spark, folder))
    return joined.select("user_id", "plan", "subscription_id", "sub_plan", "status", "has_subscription")


@query(
    "scan_owners",
    f"""WITH {sql.SCANS}, {sql.USERS} SELECT plan, verdict, count(*) AS scans, count(DISTINCT user_id) AS users
FROM ledger JOIN users USING (user_id) GROUP BY ALL""",
)
def scan_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Scans by plan of their owner. Counted per user first, so that the join sees one row per user and verdict."""
    per_user = _ledger(spark, folder).groupBy("user_id", "verdict").agg(F.count("*").alias("n"))
    owned = per_user.join(tables.users(spark, folder).select("user_id", "plan"), "user_id")
    return owned.groupBy("plan", "verdict").agg(F.sum("n").alias("scans"), F.count("*").alias("users"))


@query(
    "resolve_users",
    f"""WITH {sql.USERS}, q AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'cus_' || o_custkey END AS billing_id,
  upper(email) AS email FROM orders JOIN users ON user_id = o_custkey),
b AS (SELECT billing_id, min(user_id) AS b FROM users WHERE billing_id IS NOT NULL GROUP BY ALL),
e AS (SELECT lower(trim(email)) AS k, min(user_id) AS e FROM users GROUP BY ALL)
SELECT request_id, coalesce(b, e) AS user_id, CASE WHEN b IS NOT NULL THEN 'billing_id' WHEN e IS NOT NULL THEN 'email' END AS matched_by
FROM q LEFT JOIN b USING (billing_id) LEFT JOIN e ON e.k = lower(trim(q.email))""",
)
def resolve_users(spark: SparkSession, folder: str) -> DataFrame:
    """Billing requests, half with a billing id and all with an address in another case, matched to accounts."""
    u = tables.users(spark, folder)
    o = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"))
    requests = o.join(u.select("user_id", "email"), "user_id").select(
        "request_id",
        F.when(F.col("request_id") % 2 == 0, F.concat(F.lit("cus_"), F.col("user_id").cast("string"))).alias("billing_id"),
        F.upper("email").alias("email"),
    )
    return accounts.resolve_users(requests, u).select("request_id", "user_id", "matched_by")


def _billing(spark: SparkSession, folder: str) -> DataFrame:
    """Active external subscriptions, from the orders: an open order is one, and many of them mean the large plan."""
    o = tables.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count("*").alias("n")
    )
    key = F.col("user_id").cast("string")
    return o.filter(F.col("open") > 0).select(
        "user_id",
        F.when(F.col("n") >= 10, "ENTERPRISE").otherwise("PRO").alias("billed_plan"),
        F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("new_"), key)).otherwise(F.concat(F.lit("ext_"), key)).alias("billed_id"),
    )


_SYNC = f"""{sql.USERS}, {sql.SUBSCRIPTIONS}, bill AS (
  SELECT o_custkey AS user_id, CASE WHEN count(*) >= 10 THEN 'ENTERPRISE' ELSE 'PRO' END AS billed_plan,
    CASE WHEN o_custkey % 7 = 0 THEN 'new_' ELSE 'ext_' END || o_custkey AS billed_id
  FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') > 0),
b AS (SELECT user_id, subs.plan, subs.billing_id, external_id, billed_id, CASE WHEN billed_id IS NULL THEN 'FREE' ELSE billed_plan END AS new_plan
  FROM subs LEFT JOIN bill USING (user_id)),
sync AS (SELECT user_id, plan, new_plan, external_id, billed_id AS new_external_id FROM b
  WHERE billing_id IS NOT NULL AND (plan <> new_plan OR (billed_id IS NOT NULL AND external_id IS DISTINCT FROM billed_id)))"""


@query("plan_sync", f"WITH {_SYNC} SELECT * FROM sync")
def plan_sync(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.plan_mismatches(tables.subscriptions(spark, folder), _billing(spark, folder))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """Plan changes found by the comparison, and a paid plan for every third user that has no subscription yet."""
    found = plan_sync(spark, folder).select("user_id", "new_plan", "new_external_id")
    key = F.col("user_id")
    fresh = tables.users(spark, folder).filter((key % 4 == 3) & (key % 3 == 0)).select(
        "user_id", F.lit("PRO").alias("new_plan"), F.concat(F.lit("ext_"), key.cast("string")).alias("new_external_id")
    )
    return found.unionByName(fresh)


_CHANGES = f"""{_SYNC}, chg AS (SELECT user_id, new_plan, new_external_id FROM sync
  UNION ALL SELECT user_id, 'PRO', 'ext_' || user_id FROM users WHERE user_id % 4 = 3 AND user_id % 3 = 0)"""


@query(
    "plan_upsert",
    f"""WITH {_CHANGES}, m AS (SELECT coalesce(s.user_id, c.user_id) AS user_id, s.subscription_id, s.plan, s.status, s.external_id,
  c.new_plan, c.new_external_id, c.user_id IS NOT NULL AS changed FROM subs s FULL JOIN chg c ON c.user_id = s.user_id)
SELECT m.user_id, coalesce(subscription_id, 'sub_' || m.user_id) AS subscription_id, CASE WHEN changed THEN new_plan ELSE m.plan END AS plan,
  CASE WHEN changed AND subscription_id IS NOT NULL AND new_plan = 'FREE' AND new_external_id IS NULL THEN 'CANCELED' WHEN changed THEN 'ACTIVE' ELSE status END AS status,
  CASE WHEN changed THEN new_external_id ELSE external_id END AS external_id, limits.scans AS monthly_scans_limit,
  CASE WHEN changed AND subscription_id IS NOT NULL AND new_plan = 'FREE' THEN TIMESTAMP '{AS_OF}' END AS canceled_at,
  CASE WHEN NOT changed THEN 'kept' WHEN subscription_id IS NOT NULL THEN 'updated' ELSE 'created' END AS action
FROM m JOIN limits ON limits.plan = CASE WHEN changed THEN new_plan ELSE m.plan END""",
)
def plan_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.upsert_plans(tables.subscriptions(spark, folder), _changes(spark, folder), AS_OF)


@query(
    "plan_notices",
    f"""WITH {_CHANGES} SELECT user_id, CASE WHEN new_plan = 'FREE' THEN 'SUBSCRIPTION_CANCELED' ELSE 'SUBSCRIPTION_RENEWED' END AS type,
  CASE WHEN new_plan = 'FREE' THEN 'Subscription Updated' ELSE 'Upgraded to ' || new_plan || ' Plan!' END AS title,
  CASE WHEN new_plan = 'FREE' THEN 'Your subscription has been updated. You are now on the FREE plan.' ELSE 'Your plan has been upgraded to ' || new_plan
    || '. You now have ' || CASE WHEN limits.scans = -1 THEN 'unlimited' ELSE CAST(limits.scans AS VARCHAR) END || ' scans per month.' END AS message
FROM chg JOIN limits ON limits.plan = new_plan""",
)
def plan_notices(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.change_notices(_changes(spark, folder))


@query(
    "default_rows",
    f"""WITH {sql.USERS}, {sql.SUBSCRIPTIONS} SELECT subscription_id, user_id, plan, status, false AS created FROM subs
UNION ALL SELECT 'sub_' || user_id, user_id, 'FREE', 'ACTIVE', true FROM users WHERE user_id NOT IN (SELECT user_id FROM subs)""",
)
def default_rows(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.add_defaults(tables.users(spark, folder), tables.subscriptions(spark, folder))


def _plan_events(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.scans(spark, folder).filter(F.col("event_type").isin("purchase", "error"))
    bought, even = F.col("event_type") == "purchase", F.col("k") % 2 == 0
    return s.select(
        F.col("scan_id").alias("event_id"),
        "user_id",
        F.when(bought, "UPGRADE").when(even, "CANCEL").otherwise("CANCEL_AT_END").alias("action"),
        F.when(bought & even, "PRO").when(bought, "ENTERPRISE").alias("new_plan"),
    )


@query(
    "plan_changes",
    f"""WITH {sql.SCANS}, {sql.USERS}, {sql.SUBSCRIPTIONS}, ev AS (
  SELECT scan_id AS event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'UPGRADE' WHEN k % 2 = 0 THEN 'CANCEL' ELSE 'CANCEL_AT_END' END AS action,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'PRO' ELSE 'ENTERPRISE' END END AS new_plan
  FROM scans WHERE event_type IN ('purchase', 'error')),
l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
c AS (SELECT s.user_id, CASE action WHEN 'UPGRADE' THEN new_plan WHEN 'CANCEL' THEN 'FREE' ELSE plan END AS plan,
  CASE action WHEN 'UPGRADE' THEN 'ACTIVE' WHEN 'CANCEL' THEN 'CANCELED' ELSE status END AS status, action = 'CANCEL_AT_END' AS at_end FROM subs s JOIN l USING (user_id))
SELECT 'subscription' AS kind, user_id, -1::BIGINT AS event_id, c.plan || '/' || status || '/' || limits.scans || '/' || at_end AS detail FROM c JOIN limits USING (plan)
UNION ALL SELECT 'notification', user_id, event_id, CASE action WHEN 'UPGRADE' THEN 'Welcome to ' || new_plan || ' Plan! Your plan has been upgraded. You now have '
    || CASE new_plan WHEN 'PRO' THEN '100' ELSE 'unlimited' END || ' scans per month.'
  WHEN 'CANCEL' THEN 'Subscription Canceled Your subscription has been canceled. You now have a FREE plan.'
  ELSE 'Subscription Canceled Your subscription will be canceled at the end of the billing period.' END FROM ev
UNION ALL SELECT 'audit', ev.user_id, event_id, plan || '->' || new_plan FROM ev JOIN subs ON subs.user_id = ev.user_id WHERE action = 'UPGRADE'""",
)
def plan_changes(spark: SparkSession, folder: str) -> DataFrame:
    out = accounts.apply_plan_events(_plan_events(spark, folder), tables.subscriptions(spark, folder))
    s, n, a = out["subscriptions"], out["notifications"], out["audit"]
    state = F.concat_ws("/", "plan", "status", F.col("monthly_scans_limit").cast("string"), F.col("cancel_at_period_end").cast("string"))
    return (
        s.select(F.lit("subscription").alias("kind"), "user_id", F.lit(-1).cast("bigint").alias("event_id"), state.alias("detail"))
        .unionByName(n.select(F.lit("notification").alias("kind"), "user_id", "event_id", F.concat_ws(" ", "title", "message").alias("detail")))
        .unionByName(a.select(F.lit("audit").alias("kind"), "user_id", "event_id", F.concat_ws("->", "old_plan", "new_plan").alias("detail")))
    )


@query(
    "scan_permission",
    f"""WITH {sql.SCANS}, {sql.USERS}, {sql.SUBSCRIPTIONS}, u AS (SELECT user_id, count(*) AS n FROM scans WHERE created_at >= TIMESTAMP '2024-03-01' GROUP BY user_id),
s AS (SELECT users.user_id, coalesce(subs.plan, 'FREE') AS plan, coalesce(status, 'ACTIVE') AS status, coalesce(n, 0) AS used
  FROM users LEFT JOIN subs ON subs.user_id = users.user_id LEFT JOIN u ON u.user_id = users.user_id),
d AS (SELECT s.*, status NOT IN ('ACTIVE', 'TRIALING') AS idle, plan <> 'ENTERPRISE' AND used >= limits.scans AS over, limits.scans AS lim FROM s JOIN limits USING (plan))
SELECT user_id, plan, status, used AS scans_used, NOT idle AND NOT over AS allowed, CASE WHEN idle THEN 'Subscription is not active'
  WHEN over THEN 'Monthly quota exceeded. You''ve used ' || used || '/' || lim || ' scans.' END AS reason FROM d""",
)
def scan_permission(spark: SparkSession, folder: str) -> DataFrame:
    used = ledger.monthly_usage(tables.scans(spark, folder).filter(F.col("created_at") >= F.lit("2024-03-01").cast("timestamp_ntz")))
    per_user = used.groupBy("user_id").agg(F.sum("scans_used").alias("scans_used"))
    return accounts.scan_permission(tables.users(spark, folder), tables.subscriptions(spark, folder), per_user)


@query(
    "account_erase",
    f"""WITH {sql.SCANS}, gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0)
SELECT 'scan' AS kind, scan_id AS row_id, user_id FROM scans WHERE user_id NOT IN (SELECT user_id FROM gone)
UNION ALL SELECT 'audit', scan_id, CASE WHEN user_id NOT IN (SELECT user_id FROM gone) THEN user_id END FROM scans""",
)
def account_erase(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.scans(spark, folder).select("scan_id", "user_id")
    gone = tables.users(spark, folder).filter(F.col("c_acctbal") < 0)
    kept, marked = accounts.erase_accounts(gone, s, s)
    return kept.select(F.lit("scan").alias("kind"), F.col("scan_id").alias("row_id"), "user_id").unionByName(
        marked.select(F.lit("audit").alias("kind"), F.col("scan_id").alias("row_id"), "user_id")
    )


@query(
    "unique_checks",
    f"""WITH {sql.USERS}, {_USAGE.replace(sql.USERS + ', ', '')}
SELECT 'email' AS key, lower(trim(email)) AS value, count(*) AS rows FROM users GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'billing_id', billing_id, count(*) FROM users GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'usage', subscription_id || '/' || year || '/' || month, count(*) FROM usage GROUP BY ALL HAVING count(*) > 1""",
)
def unique_checks(spark: SparkSession, folder: str) -> DataFrame:
    u = tables.users(spark, folder).withColumn("email_key", accounts.email_key(F.col("email")))
    usage = ledger.usage_tracking(tables.scans(spark, folder), tables.subscriptions(spark, folder))
    usage = usage.withColumn("usage", F.concat_ws("/", "subscription_id", "year", "month"))
    parts = [(u, "email", "email_key"), (u, "billing_id", "billing_id"), (usage, "usage", "usage")]
    found = [
        accounts.key_violations(df, [column]).select(F.lit(name).alias("key"), F.col(column).alias("value"), "rows")
        for df, name, column in parts
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "upload_checks",
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 0 ELSE strlen(text) END AS n FROM documents)
SELECT doc_id AS file_id, CASE WHEN n = 0 THEN 'empty file' WHEN n > 20000 THEN 'file too large' END AS rejected, CAST(n AS INTEGER) AS size_bytes FROM f""",
)
def upload_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Empty and oversized uploads get a reason; nothing is lost."""
    d = tables.table(spark, folder, "documents")
    content = F.encode(F.when(F.col("doc_id") % 40 == 0, "").otherwise(F.col("text")), "UTF-8")
    return features.check_uploads(d.select(F.col("doc_id").alias("file_id"), content.alias("content")), 20_000)


@query(
    "paid_users",
    f"WITH {sql.USERS} SELECT user_id, plan, email FROM users WHERE plan <> 'FREE'",
)
def paid_users(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.paid_users(tables.users(spark, folder)).select("user_id", "plan", "email")


@query(
    "webhooks_latest",
    "SELECT event_id, ts AS created_at, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10",
)
def webhooks_latest(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events").select("event_id", F.col("ts").alias("created_at"), "event_type")
    return accounts.newest(e, 10, "event_id")


_HOOKS = """hooks AS (SELECT event_id, ts AS created_at, 'cus_' || user_id AS customer_id,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'completed' ELSE 'updated' END AS kind,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN 'PRO' ELSE 'ENTERPRISE' END AS plan FROM events WHERE event_type <> 'view')"""


@query(
    "webhook_plan_state",
    f"""WITH {_HOOKS} SELECT customer_id, CASE WHEN kind = 'deleted' THEN 'FREE' ELSE plan END AS plan, kind AS last_kind, events FROM (
  SELECT *, count(*) OVER (PARTITION BY customer_id) AS events, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, event_id DESC) AS n FROM hooks) WHERE n = 1""",
)
def webhook_plan_state(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.latest_plan_state(tables.webhooks(spark, folder))


@query("users_count", "SELECT count(*) AS users FROM customer")
def users_count(spark: SparkSession, folder: str) -> DataFrame:
    return tables.users(spark, folder).agg(F.count("*").alias("users"))


@query(
    "secret_mask",
    """SELECT c_custkey AS user_id, CASE WHEN length(s) < 10 THEN '****' ELSE s[:4] || '...' || right(s, 4) END AS masked
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS s FROM customer)""",
)
def secret_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Names as secrets; every second one is put in quotes, which are not part of the secret."""
    c = tables.table(spark, folder, "customer")
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    quoted = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    return c.select(F.col("c_custkey").alias("user_id"), text.mask_secret(quoted).alias("masked"))


@query(
    "artifact_links",
    f"""WITH {sql.CORPUS}, {sql.RULES}
SELECT file_id, sha256(encode(text)) AS sha256, verdict = 'malicious' AS has_clean, verdict, CAST(strlen(text) AS INTEGER) AS size_bytes FROM decided""",
)
def artifact_links(spark: SparkSession, folder: str) -> DataFrame:
    """Upload, clean copy and report rows of each file, joined by its id."""
    c = corpus.text_corpus(spark, folder).drop("text")
    scanned = rules.scan(c, with_entropy=False).select("file_id", "ext", "content", "verdict")
    uploads = features.hashes(c)
    cleans = sanitize.sanitize(scanned.filter(F.col("verdict") == "malicious"), archives_too=False).select("file_id", F.sha2("clean", 256).alias("clean_sha256"))
    linked = accounts.artifacts(uploads, cleans, scanned.select("file_id", "verdict"))
    return linked.select("file_id", "sha256", F.col("clean_sha256").isNotNull().alias("has_clean"), "verdict", "size_bytes")


@query(
    "report_fetch",
    f"WITH {sql.SCANS} SELECT scan_id, user_id, risk_score FROM scans JOIN (SELECT max(scan_id) AS scan_id FROM scans) USING (scan_id)",
)
def report_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """The newest scan of the ledger, fetched by id; the owner must match as well."""
    from docwarden.sources.files import fetch_owned

    s = tables.scans(spark, folder).select("scan_id", "user_id", "risk_score")
    last = s.agg(F.max(F.struct("scan_id", "user_id")).alias("m")).select("m.scan_id", "m.user_id").first()
    return fetch_owned(s, last["scan_id"], last["user_id"], "scan_id")


@query(
    "billing_periods",
    """WITH o AS (SELECT o_orderkey AS id, o_orderdate AS s, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)) AS e FROM orders)
SELECT id, s AS period_start, CAST(e AS TIMESTAMP) AS period_end, strftime(s, '%Y-%m-%dT%H:%M:%S.000Z') AS start_text, strftime(e, '%Y-%m-%dT%H:%M:%S.000Z') AS end_text FROM o""",
)
def billing_periods(spark: SparkSession, folder: str) -> DataFrame:
    o = tables.table(spark, folder, "orders")
    return accounts.billing_periods(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started")))
