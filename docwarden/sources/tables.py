"""The given tables, and the ledger-shaped views that the account queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema: no inference pass over the data."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_ledger(df: DataFrame, path: str, day_of: str = "created_at") -> None:
    """Append scan rows, one folder per day, so that history and retention read only the days they need."""
    df.withColumn("day", F.to_date(day_of)).write.mode("append").partitionBy("day").parquet(path)


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Scan ledger: one row per event, spread over three months."""
    return as_scans(table(spark, folder, "events"))


def as_scans(e: DataFrame) -> DataFrame:
    """Events, at rest or arriving, as scan rows."""
    raw_verdict = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "view", "benign")
        .when(F.col("event_type") == "click", "Benign")
        .when(F.col("event_type") == "purchase", "malicious")
    )
    return e.select(
        F.col("event_id").alias("scan_id"),
        "user_id",
        (F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("created_at"),
        raw_verdict.alias("raw_verdict"),
        F.least(F.greatest(F.col("value"), F.lit(0.0)) / F.lit(200.0), F.lit(1.0)).alias("risk_score"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Account dimension: mixed-case addresses, some of which differ only in case or spaces."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey")
    email = F.concat("c_mktsegment", F.lit("-"), (key % 700).cast("string"), F.lit("@mail.example"))
    return c.select(
        key.alias("user_id"),
        F.when(key % 2 == 0, F.lower(email)).otherwise(F.concat(F.lit(" "), email)).alias("email"),
        F.when(key % 3 == 0, "FREE").when(key % 3 == 1, "PRO").otherwise("ENTERPRISE").alias("plan"),
        F.when(key % 5 != 0, F.concat(F.lit("cus_"), key.cast("string"))).alias("billing_id"),
        "c_acctbal",
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Subscription rows for three quarters of the users; plan and status lag behind the account here and there."""
    u = users(spark, folder)
    key = F.col("user_id")
    return u.filter(key % 4 != 3).select(
        F.concat(F.lit("sub_"), key.cast("string")).alias("subscription_id"),
        "user_id",
        F.when(key % 11 == 0, "PRO").otherwise(F.col("plan")).alias("plan"),
        F.when(key % 13 == 0, "PAST_DUE").when(key % 13 == 1, "TRIALING").when(key % 13 == 2, "CANCELED")
        .otherwise("ACTIVE").alias("status"),
        F.when(key % 5 != 0, F.concat(F.lit("cus_"), key.cast("string"))).alias("billing_id"),
        F.when(F.col("plan") != "FREE", F.concat(F.lit("ext_"), key.cast("string"))).alias("external_id"),
    )


def notifications(spark: SparkSession, folder: str) -> DataFrame:
    """Notification rows from the event table."""
    return as_notifications(table(spark, folder, "events"))


def as_notifications(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("notification_id"),
        "user_id",
        F.upper("event_type").alias("type"),
        (F.col("event_id") % 4 == 0).alias("is_read"),
        F.col("ts").alias("created_at"),
    )


def webhooks(spark: SparkSession, folder: str) -> DataFrame:
    """Billing events per customer."""
    return as_webhooks(table(spark, folder, "events"))


def as_webhooks(e: DataFrame) -> DataFrame:
    e = e.filter(F.col("event_type") != "view")
    kind = (
        F.when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "error", "deleted")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("updated")
    )
    plan = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "PRO").otherwise("ENTERPRISE")
    return e.select(
        "event_id", F.col("ts").alias("created_at"), F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_id"),
        kind.alias("kind"), plan.alias("plan"),
    )
