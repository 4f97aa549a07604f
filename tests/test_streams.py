"""Streams in several batches give the rows of the batch form; late rows are left out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docwarden.operators import notices
from docwarden.plans import accounts as account_plans
from docwarden.sources import tables
from docwarden.streaming import jobs
from docwarden.streaming.sink import append_all, read_stream, upsert_all


@pytest.fixture(scope="module")
def parts(spark, folder, tmp_path_factory):
    """The events in five files, in order of time."""
    root = tmp_path_factory.mktemp("parts")
    e = tables.table(spark, folder, "events")
    n = e.count()
    for i in range(5):
        out = root / f"part{i}"
        part = e.filter((F.col("event_id") >= n * i // 5) & (F.col("event_id") < n * (i + 1) // 5))
        part.orderBy("ts").coalesce(1).write.parquet(str(out))
        # the source takes files by time of writing
    schema = e.schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(root))

    return e, stream


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def test_usage_in_batches(spark, parts):
    e, stream = parts
    daily = upsert_all(jobs.daily_usage(stream()), ["user_id", "day"])
    assert rows(daily) == rows(jobs.daily_usage(e))


def test_sliding_in_batches(spark, parts):
    e, stream = parts
    got = upsert_all(jobs.sliding_activity(stream()), ["event_type", "start"])
    assert rows(got) == rows(jobs.sliding_activity(e))


def test_sessions_in_batches(spark, parts):
    e, stream = parts
    got = append_all(jobs.sessions(stream()))
    closed = e.agg(F.max("ts")).first()[0]
    batch = jobs.sessions(e)
    limit = F.lit(closed).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")
    assert rows(got) == rows(batch.filter(F.col("end") <= limit))


def test_plan_state_in_batches(spark, parts):
    e, stream = parts
    got = upsert_all(jobs.plan_state(tables.as_webhooks(stream())), ["customer_id"])
    assert rows(got) == rows(jobs.plan_state(tables.as_webhooks(e)))


def test_exact_dedup_in_batches(spark, parts):
    e, stream = parts
    got = jobs.dedup_exactly(tables.as_notifications(stream()), seconds=86_400)
    expected = notices.dedup(tables.as_notifications(e), seconds=86_400)
    assert rows(got) == rows(expected.select(*got.columns))


def test_rough_dedup_is_a_subset(spark, parts):
    e, stream = parts
    got = append_all(jobs.dedup_roughly(tables.as_notifications(stream())))
    every = tables.as_notifications(e)
    assert got.join(every.select("notification_id"), "notification_id", "left_anti").isEmpty()
    assert got.select("user_id", "type").distinct().count() == every.select("user_id", "type").distinct().count()
    assert got.count() <= every.count()


def test_quota_alerts_in_batches(spark, parts, folder):
    e, stream = parts
    users = tables.users(spark, folder).select("user_id", "plan")
    plain = lambda df: df.select(F.col("event_id").alias("scan_id"), "user_id", F.col("ts").alias("created_at"))
    got = jobs.quota_alerts(plain(stream()), users)
    from docwarden.operators import ledger

    expected = ledger.quota_decisions(plain(e), users).filter("notice <> 'NONE'")
    assert rows(got) == rows(expected.select(*got.columns))


def test_codes_in_batches(spark, parts):
    e, stream = parts
    used, issued = "event_type <> 'signup'", "event_type = 'signup'"
    got = append_all(jobs.codes_used_in_time(stream().filter(issued), stream().filter(used), "2 hours"))
    a, b = e.filter(issued).alias("a"), e.filter(used).alias("b")
    when = (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr("INTERVAL 2 HOURS"))
    expected = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & when)
    assert got.count() == expected.count() > 0


def test_late_rows_are_left_out(spark, tmp_path):
    def put(name: str, values: list[tuple]) -> None:
        df = spark.createDataFrame(values, "event_id bigint, ts string, user_id bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint"
    state = str(tmp_path / "state")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        return upsert_all(jobs.daily_usage(s, late="1 day"), ["user_id", "day"], state)

    put("a", [(1, "2024-01-01 10:00:00", 1), (2, "2024-01-10 10:00:00", 1)])
    run()
    put("b", [(3, "2024-01-01 11:00:00", 1), (4, "2024-01-10 11:00:00", 1)])
    got = {str(r["day"])[:10]: r["scans"] for r in run().collect()}
    assert got == {"2024-01-01": 1, "2024-01-10": 2}


def test_a_repeated_run_adds_nothing(spark, folder, tmp_path):
    path = str(tmp_path / "log")
    first = append_all(jobs.log_webhooks(read_stream(spark, folder, "events")), path).count()
    assert append_all(jobs.log_webhooks(read_stream(spark, folder, "events")), path).count() == first


def test_stream_form_of_the_ledger_queries(spark, folder):
    from docwarden.plans import all_queries

    queries = all_queries()[0]
    assert rows(queries["stream_plan_state"](spark, folder)) == rows(account_plans.webhook_plan_state(spark, folder))


def test_files_are_scanned_as_they_arrive(spark, tmp_path):
    import fixtures as fx

    from docwarden.operators import rules
    from docwarden.sources.files import read_arriving_files, read_files

    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()

    def run():
        return append_all(jobs.scan_arrivals(read_arriving_files(spark, str(root), files_per_batch=1)), out)

    (root / "a.pdf").write_bytes(fx.PDF_SAFE)
    (root / "b.pdf").write_bytes(fx.PDF_LAUNCH)
    assert sorted(r["verdict"] for r in run().collect()) == ["benign", "malicious"]
    (root / "c.rtf").write_bytes(fx.RTF_OBJECT)
    got = run()
    assert got.count() == 3
    batch = rules.scan(read_files(spark, str(root)), with_archives=True)
    assert rows(got.select("file_id", "verdict")) == rows(batch.select("file_id", "verdict"))


def test_streams_read_tables_of_one_file_and_of_many(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    (tmp_path / "events.parquet.bak").mkdir()
    for at in (folder, str(tmp_path)):
        assert append_all(read_stream(spark, at, "events", 1)).exceptAll(events).count() == 0
        assert append_all(read_stream(spark, at, "events")).count() == events.count()
