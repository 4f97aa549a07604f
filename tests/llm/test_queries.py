"""Registered queries beside their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import numbers
import os
import random
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from docwarden.llm import ngram_rules
from docwarden.llm.queries import ORACLES, QUERIES
from docwarden.session import settle, shared_folder

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402



@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    assert sorted(map(key, rows_plain(got))) == sorted(map(key, rows_plain(want)))


def rows_plain(frame):
    def plain(x):
        if pd.isna(x):
            return None
        return float(x) if isinstance(x, numbers.Number) else x

    return [tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    extra = documents.withColumns({"score": documents.doc_id * 0, "kept": documents.doc_id, "n": documents.doc_id}).repartition(4)
    ids, docs = [], extra
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, folder))
        assert docs.columns == documents.columns
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert docs.exceptAll(documents.crossJoin(spark.range(2)).drop("id")).count() == 0, "rows are as they were"
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i in (r.doc_id for r in documents.select("doc_id").collect()) if quality.get(i) == 1]
    assert len(set(good) - set(ids[0])) <= 0.02 * len(good) and sum(quality.get(i) == 0 for i in ids[0]) <= 5
    texts = {r.doc_id: r.text for r in documents.collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
    stays = sorted(ids[2])
    assert len(stays) == len(set(stays)) and set(stays) <= set(ids[1])
    # nothing that stays has a near-copy that stays, and what goes has one that was there
    for x, a in enumerate(stays):
        for b in stays[x + 1 :]:
            if sets[a] & sets[b]:
                assert 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]), (a, b)
    for gone in set(ids[1]) - set(stays):
        assert any(5 * len(sets[gone] & sets[i]) >= 4 * len(sets[gone] | sets[i]) for i in ids[1] if i != gone)
    assert set(ids[3]) <= set(stays) and max(map(ids[3].count, set(ids[3]))) <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids[3]) and all(r.n_pieces == len(r.ids) > 0 for r in final)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_pieces) for r in whole) == sorted((r.doc_id, r.n_pieces) for r in final)
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_stages_on_awkward_rows(spark, folder):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns that stages use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    first = docs.first()
    odd = [
        (None, None, None, None, None), (9001, None, None, None, None), (9002, "", "", "", 0), (9003, " \n", "en", None, 2), (9004, "word " * 20_000, "en", "src0", 5),
        (None, first.text, first.lang, first.source, first.n_chars), (first.doc_id, first.text, first.lang, first.source, first.n_chars),
        (first.doc_id, "An other text of the same id that is no copy of the first one at all.", "en", "src1", 9),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"score": docs.doc_id, "kept": docs.text, "size": docs.doc_id, "digest": docs.text})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, folder).collect()
        assert all(r.asDict() for r in got)
        if name == "n-gram Jaccard join":
            same = [r.text for r in got if r.doc_id == first.doc_id]
            assert len(same) == len(set(same)) == 2 and sum(r.doc_id is None for r in got) == 2
        if name == "SentencePiece encoding and decoding":
            assert len(got) == len(odd) + 60 and {r.decoded_crc32 for r in got if r.doc_id in (9001, 9002)} == {0}


def written(folder):
    return {p for p in Path(folder).rglob("*.parquet") if p.is_file()}


def some_texts(n, words):
    rng = random.Random(3)
    kinds = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200)]
    return [" ".join(rng.choices(kinds, k=words)) for _ in range(n)]


def test_quality_rules_leave_texts_where_they_are(spark, tmp_path):
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(some_texts(400, 1500))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    before = written(shared_folder(spark))
    stays = corpus_pipeline.quality_rules(spark, docs, "").count()
    after = written(shared_folder(spark))
    new = [p for p in after if p not in before]
    assert stays > 300 and new
    assert not [p for p in new if "text" in pq.read_schema(p).names], "no text is written on the way"


@pytest.mark.parametrize("at_once", [ngram_rules.GROUPS_AT_ONCE, 0])
def test_quality_rules_keep_what_is_judged_good(spark, monkeypatch, at_once):
    """Row by row, with copies, repeated and missing ids, null and empty texts and languages, by either join."""
    good = some_texts(30, 60)
    strange = "zz qq xx vv " + " ".join("jkw"[i % 3] * (1 + i % 5) + str(i) for i in range(300))
    texts = [*good, good[0], strange, strange, "too short", "word " * 50, "", None, " \n"]
    rows = [(None if i % 9 == 4 else i // 2, t, lang, None if i % 5 else "src0", i) for i, t in enumerate(texts) for lang in ("en", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = ngram_rules.judge(docs.select("doc_id", "lang", "text", "n_chars"), carry=["n_chars"]).collect()
    verdicts = {(r.n_chars, r.lang): r.kept for r in judged}
    want = sorted((r for r in rows if verdicts[r[4], r[2] or ""]), key=str)
    monkeypatch.setattr(ngram_rules, "GROUPS_AT_ONCE", at_once)
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 0 < len(want) < len(rows) and {r[2] for r in want} == {"en", None, ""}
