"""Accounts and subscriptions: matching, upserts, permissions, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions.skew import attach_by_key, left_join_known
from docwarden.operators.ledger import limit_of


def email_key(email: Column) -> Column:
    return F.lower(F.trim(email))


def duplicate_users(users: DataFrame) -> DataFrame:
    """Later accounts whose address differs from an earlier one only in case or outer blanks, with that first one."""
    keyed = users.withColumn("email_key", email_key(F.col("email")))
    firsts = keyed.groupBy("email_key").agg(
        F.min("user_id").alias("previous_id"), F.min_by("plan", "user_id").alias("previous_plan"), F.count("*").alias("accounts")
    ).filter(F.col("accounts") > 1)
    both = attach_by_key(keyed, firsts, ["email_key"], "accounts", users.count())
    return both.filter(F.col("user_id") != F.col("previous_id")).select("user_id", "email", "email_key", "previous_id", "previous_plan", "accounts")


def with_subscription(users: DataFrame, subs: DataFrame) -> DataFrame:
    """Every user with the subscription, if any."""
    s = subs.select("user_id", "subscription_id", F.col("plan").alias("sub_plan"), "status")
    return users.join(s, "user_id", "left").withColumn("has_subscription", F.col("subscription_id").isNotNull())


def resolve_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests by billing id, else by address: two left joins, the first hit wins.

    Of several accounts with one address the oldest is taken, so each lookup has one row per key.
    """
    by_billing = users.filter(F.col("billing_id").isNotNull()).groupBy("billing_id").agg(F.min("user_id").alias("_b"))
    by_email = users.groupBy(email_key(F.col("email")).alias("_key")).agg(F.min("user_id").alias("_e"))
    keyed = requests.withColumn("_key", email_key(F.col("email")))
    return (
        left_join_known(left_join_known(keyed, by_billing, "billing_id"), by_email.filter("_key is not null"), "_key")
        .withColumns({"user_id": F.coalesce("_b", "_e"), "matched_by": F.when(F.col("_b").isNotNull(), "billing_id").when(F.col("_e").isNotNull(), "email")})
        .drop("_b", "_e", "_key")
    )


def plan_mismatches(local: DataFrame, billing: DataFrame) -> DataFrame:
    """Accounts whose plan or external subscription differs from the billing state, and the plan to set.

    ``billing`` holds active subscriptions only: (user_id, billed_plan, billed_id). An account without one goes
    back to FREE; an account that never had a billing id is left alone.
    """
    both = local.join(billing, "user_id", "full_outer")
    active = F.col("billed_id").isNotNull()
    target = F.when(active, F.col("billed_plan")).otherwise("FREE")
    differs = ~F.col("plan").eqNullSafe(target) | (active & ~F.col("external_id").eqNullSafe(F.col("billed_id")))
    return both.filter(F.col("billing_id").isNotNull() & differs).select(
        "user_id", "plan", target.alias("new_plan"), "external_id", F.col("billed_id").alias("new_external_id")
    )


def upsert_plans(current: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """Subscription table after plan changes (user_id, new_plan, new_external_id): rows are updated or added."""
    now = F.lit(at).cast("timestamp_ntz")
    both = current.join(changes.withColumn("_changed", F.lit(True)), "user_id", "full_outer")
    changed = F.coalesce("_changed", F.lit(False))
    known = F.col("subscription_id").isNotNull()
    plan = F.when(changed, F.col("new_plan")).otherwise(F.col("plan"))
    canceled = changed & known & (F.col("new_plan") == "FREE") & F.col("new_external_id").isNull()
    status = F.when(canceled, "CANCELED").when(changed, "ACTIVE").otherwise(F.col("status"))
    return both.select(
        "user_id",
        F.coalesce("subscription_id", F.concat(F.lit("sub_"), F.col("user_id").cast("string"))).alias("subscription_id"),
        plan.alias("plan"),
        status.alias("status"),
        F.when(changed, F.col("new_external_id")).otherwise(F.col("external_id")).alias("external_id"),
        limit_of(plan).alias("monthly_scans_limit"),
        F.when(changed & known & (F.col("new_plan") == "FREE"), now).alias("canceled_at"),
        F.when(~changed, "kept").when(known, "updated").otherwise("created").alias("action"),
    )


def change_notices(changes: DataFrame) -> DataFrame:
    """Notification rows for plan changes."""
    free = F.col("new_plan") == "FREE"
    limit = limit_of(F.col("new_plan"))
    scans = F.when(limit == -1, "unlimited").otherwise(limit.cast("string"))
    return changes.select(
        "user_id",
        F.when(free, "SUBSCRIPTION_CANCELED").otherwise("SUBSCRIPTION_RENEWED").alias("type"),
        F.when(free, "Subscription Updated").otherwise(F.format_string("Upgraded to %s Plan!", F.col("new_plan"))).alias("title"),
        F.when(free, "Your subscription has been updated. You are now on the FREE plan.")
        .otherwise(F.format_string("Your plan has been upgraded to %s. You now have %s scans per month.", F.col("new_plan"), scans))
        .alias("message"),
    )


def add_defaults(users: DataFrame, subs: DataFrame) -> DataFrame:
    """Free subscriptions for the users that have none, beside the ones that exist."""
    missing = users.join(subs.select("user_id"), "user_id", "left_anti")
    made = missing.select(
        F.concat(F.lit("sub_"), F.col("user_id").cast("string")).alias("subscription_id"),
        "user_id",
        F.lit("FREE").alias("plan"),
        F.lit("ACTIVE").alias("status"),
        F.lit(True).alias("created"),
    )
    return subs.select("subscription_id", "user_id", "plan", "status", F.lit(False).alias("created")).unionByName(made)


def apply_plan_events(events: DataFrame, subs: DataFrame) -> dict[str, DataFrame]:
    """Upgrades and cancellations -> changed subscriptions, notifications, audit rows.

    ``events``: (event_id, user_id, action UPGRADE | CANCEL | CANCEL_AT_END, new_plan). The last one of a user
    decides the subscription; each one is told and logged.
    """
    upgrade, now = F.col("action") == "UPGRADE", F.col("action") == "CANCEL"
    last = events.groupBy("user_id").agg(F.max_by(F.struct("action", "new_plan"), "event_id").alias("e")).select("user_id", "e.action", "e.new_plan")
    merged = subs.join(last, "user_id")
    new_plan = F.when(upgrade, F.col("new_plan")).when(now, "FREE").otherwise(F.col("plan"))
    changed = merged.select(
        "user_id",
        "subscription_id",
        new_plan.alias("plan"),
        F.when(upgrade, "ACTIVE").when(now, "CANCELED").otherwise(F.col("status")).alias("status"),
        limit_of(new_plan).alias("monthly_scans_limit"),
        (F.col("action") == "CANCEL_AT_END").alias("cancel_at_period_end"),
    )
    limit = limit_of(F.col("new_plan"))
    scans = F.when(limit == -1, "unlimited").otherwise(limit.cast("string"))
    told = events.select(
        "event_id",
        "user_id",
        F.when(upgrade, "SUBSCRIPTION_RENEWED").otherwise("SUBSCRIPTION_CANCELED").alias("type"),
        F.when(upgrade, F.format_string("Welcome to %s Plan!", F.col("new_plan"))).otherwise("Subscription Canceled").alias("title"),
        F.when(upgrade, F.format_string("Your plan has been upgraded. You now have %s scans per month.", scans))
        .when(now, "Your subscription has been canceled. You now have a FREE plan.")
        .otherwise("Your subscription will be canceled at the end of the billing period.")
        .alias("message"),
    )
    logged = events.filter(upgrade).join(subs.select("user_id", F.col("plan").alias("old_plan")), "user_id").select(
        "event_id", "user_id", F.lit("UPGRADE_PLAN").alias("action"), "old_plan", "new_plan"
    )
    return {"subscriptions": changed, "notifications": told, "audit": logged}


def scan_permission(users: DataFrame, subs: DataFrame, used: DataFrame) -> DataFrame:
    """Whether each user may scan now, and if not, why. ``used``: (user_id, scans_used) of the current month."""
    joined = add_defaults(users, subs).join(used, "user_id", "left")
    n, limit = F.coalesce("scans_used", F.lit(0)), limit_of(F.col("plan"))
    idle = ~F.col("status").isin("ACTIVE", "TRIALING")
    over = (F.col("plan") != "ENTERPRISE") & (n >= limit)
    return joined.select(
        "user_id",
        "plan",
        "status",
        n.alias("scans_used"),
        (~idle & ~over).alias("allowed"),
        F.when(idle, "Subscription is not active")
        .when(over, F.format_string("Monthly quota exceeded. You've used %d/%d scans.", n, limit))
        .alias("reason"),
    )


def erase_accounts(erased: DataFrame, children: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Child rows without those of the erased users; audit rows stay but lose the user."""
    gone = erased.select("user_id").distinct()
    kept = children.join(gone, "user_id", "left_anti")
    marked = audit.join(gone.withColumn("_gone", F.lit(True)), "user_id", "left")
    return kept, marked.withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).drop("_gone")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def latest_plan_state(webhooks: DataFrame) -> DataFrame:
    """Plan of each customer after its last billing event; a deletion means FREE."""
    last = webhooks.groupBy("customer_id").agg(
        F.max(F.struct("created_at", "event_id", "kind", "plan")).alias("e"), F.count("*").alias("events")
    )
    return last.select(
        "customer_id",
        F.when(F.col("e.kind") == "deleted", "FREE").otherwise(F.col("e.plan")).alias("plan"),
        F.col("e.kind").alias("last_kind"),
        "events",
    )


def newest(df: DataFrame, k: int, id_column: str) -> DataFrame:
    """The k newest rows of a log."""
    return df.orderBy(F.desc("created_at"), id_column).limit(k)


def paid_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("plan") != "FREE")


def artifacts(uploads: DataFrame, cleans: DataFrame, reports: DataFrame) -> DataFrame:
    """Upload, clean file and report of each file in one row; all three are hashed on the id."""
    return uploads.join(cleans, "file_id", "left").join(reports, "file_id", "left")


def month_later(at: Column) -> Column:
    """One calendar month on; days that the next month lacks run over into the month after it."""
    start = F.date_trunc("MONTH", at).cast("timestamp_ntz")
    return start + F.make_ym_interval(F.lit(0), F.lit(1)) + (at - start)


def iso_of_epoch(seconds: Column) -> Column:
    """Epoch seconds as an ISO-8601 text with milliseconds, null for null."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def billing_periods(subs: DataFrame) -> DataFrame:
    """(id, started) -> start and end of the first period, as instants and as texts."""
    end = month_later(F.col("started"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")).cast("bigint") / 1_000_000
    return subs.select(
        "id",
        F.col("started").alias("period_start"),
        end.alias("period_end"),
        iso_of_epoch(F.floor(seconds(F.col("started")))).alias("start_text"),
        iso_of_epoch(F.floor(seconds(end))).alias("end_text"),
    )
