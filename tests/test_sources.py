"""Readers, writers and stores on a local folder."""

from __future__ import annotations

import json

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from docwarden.operators import cleaning
from docwarden.sources import archives, files, json_features, tables


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "raw"
    for source, label, name, data in [
        ("office_pdf", "benign", "a.pdf", fx.PDF_SAFE), ("office_pdf", "malicious/deep", "b.PDF", fx.PDF_JS),
        ("office_pdf", "malicious", "c.exe", b"MZ"), ("office_pdf", "benign", "d.json", b"{}"),
        ("json_features", "benign", "e.json", b'{"features": {"worm": 0.5, "n": 3, "t": "7", "x": "abc", "b": true}}'),
        ("json_features", "malicious", "f.json", b"broken"), ("elsewhere", "benign", "g.pdf", b"%PDF"),
    ]:
        folder = root / source / label
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    return str(root)


def test_labelled_tree(spark, tree):
    rows = files.scan_labelled_tree(spark, tree).collect()
    got = {r["path"].rsplit("/", 1)[1]: (r["label"], r["source"], r["ext"]) for r in rows}
    assert got == {
        "a.pdf": (0, "office_pdf", ".pdf"), "b.PDF": (1, "office_pdf", ".pdf"),
        "e.json": (0, "json_features", ".json"), "f.json": (1, "json_features", ".json"),
    }


def test_size_limit_reaches_the_reader(spark, tree):
    df = files.read_files(spark, tree, max_bytes=10)
    rows = df.collect()
    assert {r["path"].rsplit("/", 1)[1] for r in rows if r["rejected"] is None} == {"c.exe", "d.json", "f.json", "g.pdf"}
    large = [r for r in rows if r["rejected"]]
    assert len(rows) == files.read_files(spark, tree).count() and all(r["content"] is None and r["length"] > 10 for r in large)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(length,10)" in plan


def test_feature_documents(spark, tree):
    docs = json_features.read_documents(spark, tree + "/json_features")
    rows = json_features.parse_features(docs.select(F.xxhash64("path").alias("file_id"), "json")).collect()
    assert {r["name"]: r["value"] for r in rows} == {"worm": 0.5, "n": 3.0, "t": 7.0, "b": 1.0}


def test_feature_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "benign", "t", 1.5, "2.5", "abc", None)], "file_id bigint, label string, type string, a double, b string, c string, d double")
    json_features.write_documents(df, str(tmp_path / "docs"))
    row = spark.read.json(str(tmp_path / "docs")).first()
    assert row["label"] == "benign" and json.loads(row["document"]) == {"features": {"a": 1.5, "b": 2.5}}


def test_csv_and_splits(spark, tmp_path):
    df = spark.createDataFrame([("h1", 1, "/p", "train", "office_pdf"), ("h2", 0, "/q", "val", "office_pdf")], "sha256 string, label int, file_path string, split string, source string")
    tables.write_csv(df.drop("source"), str(tmp_path / "m"))
    again = tables.read_csv(spark, str(tmp_path / "m"), "sha256 string, label int, file_path string, split string")
    assert sorted(map(tuple, again.collect())) == [("h1", 1, "/p", "train"), ("h2", 0, "/q", "val")]
    files.write_splits(df, str(tmp_path / "s"))
    only = spark.read.parquet(str(tmp_path / "s")).filter("split = 'val'")
    assert only.count() == 1 and (tmp_path / "s" / "split=val" / "source=office_pdf" / "label=0").is_dir()


def test_store_keeps_one_copy(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "file_id bigint, filename string, content binary"
    first = spark.createDataFrame([(1, "a", bytearray(b"x")), (2, "b", bytearray(b"x")), (3, "c", bytearray(b"y"))], schema)
    second = spark.createDataFrame([(4, "d", bytearray(b"y")), (5, "e", bytearray(b"z"))], schema)
    files.store_by_hash(first, path)
    files.store_by_hash(second, path)
    assert sorted(r["filename"] for r in spark.read.parquet(path).collect()) == ["a", "c", "e"]


def test_buckets_and_owner_check(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, "r"), (2, 8, "s")], "id bigint, user_id bigint, body string")
    files.write_bucket(df, str(tmp_path), "reports")
    stored = spark.read.parquet(str(tmp_path / "reports"))
    assert files.fetch_owned(stored, 1, 7).count() == 1 and files.fetch_owned(stored, 1, 8).isEmpty()
    with pytest.raises(ValueError):
        files.write_bucket(df, str(tmp_path), "other")


def test_ledger_folders(spark, folder, tmp_path):
    s = tables.scans(spark, folder)
    tables.append_ledger(s, str(tmp_path / "l"))
    tables.append_ledger(s, str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    assert stored.count() == 2 * s.count()
    plan = stored.filter("day = date'2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_archives_round_trip(spark):
    df = fx.frame(spark, {1: (".docx", fx.DOCX_MACRO), 2: (".docx", fx.CORRUPT), 3: (".docx", b"")})
    members = archives.explode_members(df)
    before = sorted((r["file_id"], r["pos"], r["member"], bytes(r["body"])) for r in members.collect())
    again = archives.explode_members(archives.rebuild_archives(members))
    assert sorted((r["file_id"], r["pos"], r["member"], bytes(r["body"])) for r in again.collect()) == before
    assert {r[0] for r in before} == {1}


def test_bounded_read(spark):
    df = spark.createDataFrame([(bytearray(b"abcdef"),), (None,)], "content binary")
    assert [bytes(r[0]) for r in df.select(files.bounded(F.col("content"), 4)).collect()] == [b"abcd", b""]


def test_align_and_union(spark):
    a = spark.createDataFrame([(1, 2.0)], "file_id bigint, x double")
    b = spark.createDataFrame([(2, 3)], "file_id bigint, y int")
    rows = {r["file_id"]: (r["x"], r["y"]) for r in cleaning.union_ragged([a, b]).collect()}
    assert rows == {1: (2.0, -1), 2: (-1.0, 3)}
    assert tuple(cleaning.align(a, ["y", "x"], 0.0).first()) == (1, 0.0, 2.0)
