"""From raw documents to training pieces: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; other columns of their input do not matter, whatever their names. Rows without an id pass the
stages like others, but cannot be grouped with copies. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm import line_crf, mixing, ngram_rules, piece_lattice, set_join
from docwarden.llm.common import table
from docwarden.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-copies share four fifths of their five-word shingles.
SHINGLE, SIMILARITY = 5, (4, 5)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good.

    Null and empty texts are one empty line and are judged like it; repeated rows are judged alike; a text of any length is
    judged as a whole. Without labels of both kinds all documents stay.
    """
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.score(docs, field).filter(F.col("score") >= line_crf.CUT).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    Null and empty texts fail the base rules; a null language is judged with the empty one and stays null; repeated rows
    are judged alike, and count once in the language's model.
    """
    named = docs.select(*COLUMNS).withColumns(
        {"_lang": F.coalesce("lang", F.lit("")), "_digest": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))}
    )
    judged = ngram_rules.judge(named, carry=["_digest"])
    # a verdict is one of language and text: what goes is named by these, and texts are moved only where the names are too many to send
    goes = settle(judged.filter(~F.col("kept")).select(F.col("lang").alias("_lang"), "_digest").distinct())
    if goes.limit(ngram_rules.GROUPS_AT_ONCE + 1).count() <= ngram_rules.GROUPS_AT_ONCE:
        goes = F.broadcast(goes)
    return named.join(goes, ["_lang", "_digest"], "left_anti").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-copies.

    Null and empty texts have no copies; equal rows of one id stay once, rows of one id with different texts are documents
    of their own; rows without an id stay.
    """
    return set_join.firsts_of_groups(docs, SHINGLE, SIMILARITY).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice.

    Null and empty texts have no words and come along with their source's whole repeats; a null source is a source; rows with
    one id and text are taken together.
    """
    mixed = mixing.mix(docs, keep=COLUMNS).filter("copies > 0")
    return mixed.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the checksum of the text that they decode to.

    Null and empty texts have no pieces and the checksum 0; every row gives a row.
    """
    ids = piece_lattice.encode(docs)
    return ids.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "decoded_crc32")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL has neither the classifier nor the language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
