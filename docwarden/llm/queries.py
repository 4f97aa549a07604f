"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm import (
    chat_repair, filter_audit, license_scan, line_crf, mixing, near_vectors, ngram_rules, piece_lattice, set_join, sharding, url_trust, warc, word_runs,
)
from docwarden.llm.common import WORD, table
from docwarden.llm.oracles import ORACLES  # noqa: F401
from docwarden.session import once, shared_folder

SHARDS = 8


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_sets(table(spark, sf_dir, "documents"))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = piece_lattice.encode(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "decoded_crc32")


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.shuffle_rows(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    # what a response holds is measured on what was read; a revisit has only its headers
    read = F.col("record_type") == "response"
    return back.select(
        warc.page_number("record_id").alias("page_id"),
        F.when(read, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(read, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


def op9_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score(docs.select("doc_id", "text"), field)
    return scored.select(
        "doc_id",
        line_crf.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= line_crf.CUT).cast("int").alias("predicted"),
    )


def op10_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.judge(table(spark, sf_dir, "documents"))


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by hash, repeat some of their words up to their end."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    split = once(docs.withColumn("g", F.floor(h / 10)), {"words": words})
    n = F.size("words")
    begin = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - begin) / (3 + F.col("g") % 8))).cast("int")
    bounds = once(split.withColumn("n", n), {"begin": F.when(n > 0, begin), "period": F.when(n > 0, period)})
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("begin") - 1), lambda i: F.get("words", F.col("begin") + i % F.col("period")))
    text = F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("words", F.lit(1), F.col("begin")), tail)).otherwise(F.col("text"))
    return bounds.select("doc_id", text.alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = once(word_runs.word_runs(_repeated(docs)), {"run": word_runs.greatest()})
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "run.start",
        "run.length",
        "run.period",
        F.floor(1000 * F.col("run.length") / F.col("run.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda p: p["start"])
    named = [F.transform(spans, lambda p: p["label"]) for spans in ("phrases", "matches")]
    joined = [F.array_join(F.array_sort(F.array_distinct(labels)), ",") for labels in (named[0], F.concat(*named))]
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined[0].alias("base_labels"),
        joined[1].alias("labels"),
        "score",
    )


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_set_join": op2_set_join,
    "op3_chat_repair": op3_chat_repair,
    "op4_url_trust": op4_url_trust,
    "op5_piece_lattice": op5_piece_lattice,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_warc": op7_warc,
    "op8_line_crf": op8_line_crf,
    "op9_hash_mix": op9_hash_mix,
    "op10_ngram_rules": op10_ngram_rules,
    "op11_word_runs": op11_word_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_scan": op13_license_scan,
}
