"""Ordered, skewed and sequential computations against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docwarden.functions.ordered import group_share, next_greater, quantile_slices, running_number, top_per_key
from docwarden.functions.skew import attach_by_key
from docwarden.operators import accounts, cleaning, ensemble, learning, ledger, notices
from docwarden.operators.learning import metrics, roc_auc
from docwarden.sources import tables

START = dt.datetime(2024, 1, 1)


def moments(n: int, hours: float, seed: int) -> list[dt.datetime]:
    rnd = random.Random(seed)
    return [START + dt.timedelta(seconds=rnd.randrange(int(hours * 3600))) for _ in range(n)]


def skewed_scans(n: int = 3000) -> list[tuple]:
    """User 1 holds more than a third of all rows; many instants are equal."""
    rnd = random.Random(7)
    return [(i, 1 if rnd.random() < 0.4 else rnd.randrange(2, 40), t) for i, t in enumerate(moments(n, 24 * 60, 1))]


def test_running_number(spark):
    rows = skewed_scans()
    df = spark.createDataFrame(rows, "scan_id bigint, user_id bigint, created_at timestamp_ntz")
    for unit in ("HOUR", "DAY", "YEAR"):
        got = running_number(df, ["user_id"], ["created_at", "scan_id"], F.date_trunc(unit, F.col("created_at")), "n").collect()
        seen: Counter = Counter()
        expected = {}
        for scan, user, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            seen[user] += 1
            expected[scan] = seen[user]
        assert {r["scan_id"]: r["n"] for r in got} == expected


def test_running_number_has_no_task_per_key(spark):
    df = spark.createDataFrame(skewed_scans(50), "scan_id bigint, user_id bigint, created_at timestamp_ntz")
    out = running_number(df, ["user_id"], ["created_at"], F.date_trunc("DAY", F.col("created_at")), "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # rows are numbered inside (user, slice); only the totals are ordered per user
    assert "row_number()" in plan and "_slice" in plan.split("row_number()")[1][:400]


@pytest.mark.parametrize("slices", [2, 16, 512])
def test_quantile_slices_keep_the_order(spark, slices):
    rnd = random.Random(slices)
    df = spark.createDataFrame([(i, 0.001 * rnd.random() ** 4) for i in range(2000)], "id bigint, p double")
    cut = quantile_slices(df, F.col("p"), "s", slices).orderBy("p").collect()
    assert [r["s"] for r in cut] == sorted(r["s"] for r in cut)
    assert max(Counter(r["s"] for r in cut).values()) <= 2 * 2000 / slices + 10


def test_next_greater(spark):
    rnd = random.Random(11)
    rows = sorted({(rnd.randrange(3) if rnd.random() < 0.5 else 0, rnd.randrange(4000)) for _ in range(1200)})
    df = spark.createDataFrame(rows, "k bigint, t bigint")
    got = {(r["k"], r["t"]): r["n"] for r in next_greater(df, ["k"], "t", 100, "n").collect()}
    assert got == {(k, t): min((u for j, u in rows if j == k and u > t + 100), default=None) for k, t in rows}


def test_group_share(spark):
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(500)], "id bigint, label boolean")
    rows = group_share(df, ["label"], "id", "share").collect()
    for label in (True, False):
        shares = sorted(r["share"] for r in rows if r["label"] == label)
        assert shares == pytest.approx([(i + 1) / len(shares) for i in range(len(shares))])


def test_attach_by_key_with_a_hot_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 900}") for i in range(6000)], "id bigint, k string")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = attach_by_key(left, right, ["k"], "n", 6000)
    assert out.count() == 6000
    assert {(r["k"], r["n"]) for r in out.filter("k = 'hot'").distinct().select("k", "n").collect()} == {("hot", 2000)}


# ---- the one-hour rule -------------------------------------------------------------------------------------


def accepted(rows: list[tuple], seconds: int) -> set[int]:
    last: dict = {}
    kept = set()
    for notice, user, kind, _, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if (user, kind) not in last or (at - last[user, kind]).total_seconds() > seconds:
            last[user, kind] = at
            kept.add(notice)
    return kept


@pytest.mark.parametrize("fold_rows", [0, 40, 100_000])
@pytest.mark.parametrize("hours,n", [(2000, 300), (60, 600), (8, 400)])
def test_notice_rule(spark, hours, n, fold_rows):
    rnd = random.Random(n)
    rows = [
        (i, 1 if rnd.random() < 0.5 else rnd.randrange(2, 5), rnd.choice(["A", "B"]), False, t) for i, t in enumerate(moments(n, hours, n))
    ]
    # exactly one hour later is still too soon, a second more is not
    rows += [(n, 9, "A", False, START), (n + 1, 9, "A", False, START + dt.timedelta(hours=1)), (n + 2, 9, "A", False, START + dt.timedelta(seconds=3601))]
    df = spark.createDataFrame(rows, "notification_id bigint, user_id bigint, type string, is_read boolean, created_at timestamp_ntz")
    got = {r["notification_id"] for r in notices.dedup(df, fold_rows=fold_rows).collect()}
    assert got == accepted(rows, 3600)


def test_mark_and_inbox(spark):
    rows = [(i, i % 3, "X", i % 4 == 0, START + dt.timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "notification_id bigint, user_id bigint, type string, is_read boolean, created_at timestamp_ntz")
    box = notices.inbox(df).collect()
    per_user = Counter(r["user_id"] for r in box)
    assert set(per_user.values()) == {50}
    first = [r for r in box if r["user_id"] == 1 and r["rank"] == 1][0]
    assert not first["is_read"] and first["unread_count"] == 50
    users = spark.createDataFrame([(1,), (1,)], "user_id bigint")
    marked = notices.mark_read(df, "2024-02-01 00:00:00", users=users).collect()
    assert len(marked) == 300 and all(r["is_read"] for r in marked if r["user_id"] == 1)
    assert sum(r["read_at"] is not None for r in marked) == sum(1 for i, u, _, read, _ in rows if u == 1 and not read)


# ---- quota -------------------------------------------------------------------------------------------------


def test_quota_decisions(spark):
    rows = skewed_scans()
    scans = spark.createDataFrame(rows, "scan_id bigint, user_id bigint, created_at timestamp_ntz")
    plans = {u: ("FREE", "PRO", "ENTERPRISE")[u % 3] for u in range(1, 40)}
    users = spark.createDataFrame(list(plans.items()), "user_id bigint, plan string")
    limits = {"FREE": 3, "PRO": 100, "ENTERPRISE": -1}
    seen: Counter = Counter()
    expected = {}
    for scan, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[user, at.year, at.month] += 1
        n, limit = seen[user, at.year, at.month], limits[plans[user]]
        allowed = limit == -1 or n <= limit
        share = n / limit * 100
        notice = "NONE" if limit == -1 or not allowed or share < 80 else "QUOTA_WARNING" if share < 100 else "QUOTA_EXCEEDED"
        expected[scan] = (n, allowed, notice)
    got = {r["scan_id"]: (r["scan_no"], r["allowed"], r["notice"]) for r in ledger.quota_decisions(scans, users).collect()}
    assert got == expected


def test_usage_merge_is_incremental(spark):
    schema = "subscription_id string, user_id bigint, year int, month int, scans_used bigint, scans_limit int, api_calls_used int, api_calls_limit int, storage_limit_mb int"
    old = spark.createDataFrame([("s", 1, 2024, 1, 5, 3, 0, 100, 100), ("t", 2, 2024, 1, 1, 3, 0, 100, 100)], schema)
    new = spark.createDataFrame([("s", 1, 2024, 1, 2, 100, 0, 5000, 10000)], schema)
    got = {r["subscription_id"]: (r["scans_used"], r["scans_limit"]) for r in ledger.merge_usage(old, new).collect()}
    assert got == {"s": (7, 100), "t": (1, 3)}


def test_top_k_limits_before_the_exchange(spark, folder):
    out = ledger.latest_per_user(tables.scans(spark, folder), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # per input split, per group of splits, per user
    assert plan.count("WindowGroupLimit") >= 3


def test_top_per_key_on_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [(i, 0 if rnd.random() < 0.6 else rnd.randrange(1, 6), rnd.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, v bigint").repartition(16, "id")
    got = {(r["k"], r["rank"]): r["id"] for r in top_per_key(df, ["k"], [F.desc("v"), "id"], 7, "rank").collect()}
    expected = {}
    for k in range(6):
        for rank, row in enumerate(sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))[:7], 1):
            expected[k, rank] = row[0]
    assert got == expected


def test_signal_aliases(spark):
    df = spark.sql("SELECT map('P_LGBM', 0.5D, 'P_RULES', 0.25D, 'rules', 9D, 'x', 1D) AS m")
    assert df.select(ensemble.signal_aliases(F.col("m")).alias("m")).first()["m"] == {
        "P_LGBM": 0.5, "P_RULES": 0.25, "rules": 0.25, "x": 1.0, "lgbm": 0.5,
    }


def test_page_bounds(spark, folder):
    s = tables.scans(spark, folder)
    with pytest.raises(ValueError):
        ledger.page(s, limit=101)
    assert ledger.page(s, limit=7, offset=3).count() == 7


def test_duplicate_users(spark):
    rows = [(1, "A@x", "FREE"), (2, " a@X ", "PRO"), (3, "b@x", "PRO"), (4, "a@x", "FREE")]
    users = spark.createDataFrame(rows, "user_id bigint, email string, plan string")
    got = {r["user_id"]: (r["previous_id"], r["previous_plan"]) for r in accounts.duplicate_users(users).collect()}
    assert got == {2: (1, "FREE"), 4: (1, "FREE")}


def test_domains(spark, folder):
    known = {"PENDING", "BENIGN", "MALICIOUS", "SUSPICIOUS", "ERROR"}
    assert {r[0] for r in ledger.ledger(tables.scans(spark, folder)).select("verdict").distinct().collect()} <= known
    assert {r[0] for r in tables.users(spark, folder).select("plan").distinct().collect()} == {"FREE", "PRO", "ENTERPRISE"}


# ---- learning ----------------------------------------------------------------------------------------------


def test_metrics_and_auc(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), rnd.choice([1, 2, 6]))) for _ in range(800)]
    df = spark.createDataFrame(rows, "label int, prob double")
    wins = sum((p > q) + 0.5 * (p == q) for y, p in rows if y for z, q in rows if not z)
    pairs = sum(y for y, _ in rows) * sum(1 - y for y, _ in rows)
    assert roc_auc(df).first()["roc_auc"] == pytest.approx(wins / pairs)
    m = metrics(df).first()
    tp = sum(y == 1 and p >= 0.5 for y, p in rows)
    fp = sum(y == 0 and p >= 0.5 for y, p in rows)
    fn = sum(y == 1 and p < 0.5 for y, p in rows)
    assert (m["tp"], m["fp"], m["fn"]) == (tp, fp, fn)
    assert m["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_single_class_is_handled(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, prob double")
    assert roc_auc(df).first()["roc_auc"] != roc_auc(df).first()["roc_auc"]  # NaN
    m = metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    assert learning.fit_calibration(df) is None
    assert learning.calibrated(None, df).first()["calibrated_prob"] == 0.2


def test_splits_cover_and_are_disjoint(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "id bigint, y int")
    rows = cleaning.split_70_15_15(df, "y", "id").collect()
    assert len(rows) == len({r["id"] for r in rows}) == 1000
    for y, n in ((1, 200), (0, 800)):
        sizes = Counter(r["split"] for r in rows if r["y"] == y)
        assert sizes == {"train": n * 7 // 10, "val": n * 15 // 100, "test": n * 15 // 100}


def test_models_learn_and_calibrate(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        y = int(rnd.random() < 0.4)
        rows.append((i, y, rnd.gauss(2 * y, 1), rnd.random()))
    df = spark.createDataFrame(rows, "id bigint, label int, a double, b double")
    train, held = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    for model in (learning.fit_boosted(train, ["a", "b"], rounds=5), learning.fit_forest(train, ["a", "b"], trees=10)):
        scored = learning.score(model, held)
        assert roc_auc(scored).first()["roc_auc"] > 0.8
    for method in ("sigmoid", "isotonic"):
        out = learning.calibrated(learning.fit_calibration(scored, method=method), scored)
        assert out.filter("calibrated_prob < 0 or calibrated_prob > 1 or calibrated_prob is null").isEmpty()
        assert metrics(out, prob="calibrated_prob").first()["log_loss"] < 0.7
    path = str(tmp_path / "m")
    learning.save_model(spark, model, path, ["a", "b"])
    assert learning.load_columns(spark, path) == ["a", "b"]
    again = learning.score(learning.load_model(path), held)
    assert sorted(r["prob"] for r in again.collect()) == pytest.approx(sorted(r["prob"] for r in scored.collect()))


def test_heads_on_vectors(spark, folder):
    e = tables.table(spark, folder, "embeddings").withColumn("label", (F.col("label") >= 5).cast("int"))
    for hidden in (None, 8):
        out = learning.score_head(learning.fit_head(e, hidden=hidden), e)
        assert out.count() == e.count()
        assert roc_auc(out).first()["roc_auc"] > 0.6


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(int(i < 30),) for i in range(100)], "y int")
    sums = defaultdict(float)
    for r in learning.with_class_weight(df, "y").collect():
        sums[r["y"]] += r["weight"]
    assert sums[0] == pytest.approx(50) and sums[1] == pytest.approx(50)


def test_labels_and_headers(spark):
    assert cleaning.clean_header("  File \t ID ") == "file_id"
    assert cleaning.find_label(["a", "My_Target", "target_2"]) == "target_2"
    assert cleaning.find_label(["a", "b"], " B ") == "b"
    with pytest.raises(ValueError):
        cleaning.find_label(["a", "b"])
    df = spark.createDataFrame([("True ", 1.9, True, 5, "x")], "label string, v double, flag boolean, id bigint, name string")
    row = df.select(cleaning.label_value(df, "label").alias("a"), cleaning.label_value(df, "v").alias("b")).first()
    assert (row["a"], row["b"]) == (1, 1)
    assert cleaning.numeric_features(df, "label") == ["v", "flag"]


# ---- scores ------------------------------------------------------------------------------------------------


def test_scores(spark):
    rows = [(1, 0.9, 0.8, None, None, 1, 0, 0), (2, 0.1, 0.1, 0.3, None, 0, 1, 2)]
    df = spark.createDataFrame(rows, "file_id bigint, p_dl double, p_lgbm double, p_rf double, p_et double, pdf_has_javascript int, has_vba_project int, embedded_files_count int")
    got = {r["file_id"]: r for r in ensemble.ensemble(df).collect()}
    assert got[1]["p_tree"] == 0.5 and got[1]["p_rules"] == 0.5
    assert got[1]["risk"] == pytest.approx(0.35 * 0.9 + 0.35 * 0.8 + 0.2 * 0.5 + 0.1 * 0.5)
    assert got[1]["verdict"] == "malicious" and got[2]["verdict"] == "benign"
    assert got[2]["p_rules"] == pytest.approx(0.6)
    shown = df.select("file_id", ensemble.threats(set(df.columns)).alias("t")).collect()
    assert [f["threat_type"] for f in shown[1]["t"]] == ["Macro Function", "Embedded Content"]
    assert shown[1]["t"][1]["indicator"] == "2 embedded file(s)"


def test_weak_fields_of_findings(spark):
    df = spark.sql("SELECT array(named_struct('id', '', 'threat_type', 'RTF field', 'indicator', 'x', 'level', 'low')) AS f")
    row = df.select(ensemble.humanize(F.col("f"), {"id", "threat_type", "indicator", "level"}).alias("h")).first()["h"][0]
    assert (row["title"], row["message"], row["severity"]) == ("RTF field", "x", "low")
    assert row["explain"].startswith("RTF object/field")


def test_ensemble_report(spark, folder):
    import json

    from docwarden.plans import all_queries

    rows = all_queries()[0]["ensemble_report_json"](spark, folder).collect()
    assert len(rows) == tables.table(spark, folder, "documents").count()
    for r in rows:
        doc = json.loads(r["report"])
        assert doc["verdict"] == r["verdict"] == ("malicious" if doc["risk_score"] >= 0.5 else "benign")
        values = [abs(f["value"]) for f in doc["top_features"]]
        assert values == sorted(values, reverse=True)
        assert doc["explain_text"].startswith(f"The file was classified as **{r['verdict']}** with a risk score of ")
        assert doc["findings"] and doc["confidence"]["level"] in ("low", "medium", "high")
        assert doc["model_contributions"]["dl"] == pytest.approx(0.35 * doc["model_scores"]["p_dl"], abs=1e-4)


def test_month_later_runs_over(spark):
    import datetime

    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 31, 5)), (2, datetime.datetime(2023, 12, 15))], "id bigint, started timestamp_ntz")
    got = {r["id"]: r for r in accounts.billing_periods(df).collect()}
    assert got[1]["period_end"] == datetime.datetime(2024, 3, 2, 5)
    assert got[2]["end_text"] == "2024-01-15T00:00:00.000Z"
