"""PDF bodies as object rows or as facts of the file, both from uncompressed objects.

Objects inside compressed streams cannot be seen; ``has_objstm`` tells that a file holds some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.session import once

OBJECT = r"(?s)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj"
# a dictionary with up to one level inside; possessive, so a missing end costs one pass
DICT = r"<<(?:[^<>]++|<<[^<>]*+>>|<[^<>]*+>)*+>>"


def object_rows(df: DataFrame) -> DataFrame:
    """(file_id, text) -> (file_id, seq, obj_no, body)."""
    text = F.col("text")
    both = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(OBJECT), 1).alias("no"), F.regexp_extract_all(text, F.lit(OBJECT), 3).alias("body")
    )
    return df.select("file_id", F.posexplode(both).alias("seq", "o")).select(
        "file_id", (F.col("seq") + 1).alias("seq"), F.col("o.no").cast("bigint").alias("obj_no"), F.col("o.body").alias("body")
    )


def _top_level(body: Column) -> Column:
    """Keys of the outer dictionary: strings, inner dictionaries and the action subtype are taken out."""
    flat = F.regexp_replace(F.trim(body), r"\([^()]*\)|<[0-9A-Fa-f\s]+>", "")
    flat = F.regexp_replace(flat, r"^\s*<<|>>\s*$", "")
    for _ in range(3):
        flat = F.regexp_replace(flat, r"<<[^<>]*>>", "")
    return flat


def _deep_threat(body: Column) -> Column:
    top = _top_level(body)
    is_dict = F.startswith(F.ltrim(F.regexp_replace(body, r"^\s+", "")), F.lit("<<")) & ~body.rlike(r"\bstream\b")
    keys = F.regexp_replace(top, r"/S\s*/[A-Za-z]+", "")
    return is_dict & (top.rlike(r"/S\s*/Launch\b") | keys.rlike(r"/(JS|JavaScript)\b"))


def with_pdf_facts(df: DataFrame, is_pdf: Column, source: str = "raw", out: str = "pdf") -> DataFrame:
    """Add a struct of what the structure rules need, computed inside the row: no explode, no shuffle.

    readable: a catalog object was found; open_subtype: action type of its OpenAction, given in place or by
    reference; has_aa; names_js; deep: some object holds a script or launch action; has_objstm. Null where
    ``is_pdf`` does not hold.
    """
    raw, nums, bodies, catalog = F.col(source), F.col("_nums"), F.col("_bodies"), F.col("_catalog")
    found = once(
        df,
        {
            "_nums": F.when(is_pdf, F.regexp_extract_all(raw, F.lit(OBJECT), 1)),
            "_bodies": F.when(is_pdf, F.regexp_extract_all(raw, F.lit(OBJECT), 3)),
        },
    )
    is_catalog = lambda b: b.rlike(r"/Type\s*/Catalog\b")
    rooted = once(found, {"_catalog": F.coalesce(F.try_element_at(F.filter(bodies, is_catalog), F.lit(1)), F.lit(""))})

    def value_of(key: str) -> Column:
        """Dictionary of a catalog key, in place or behind a reference."""
        inline = F.regexp_extract(catalog, key + r"\s*(" + DICT + ")", 1)
        number = F.regexp_extract(catalog, key + r"\s+(\d+)\s+\d+\s+R\b", 1)
        target = F.try_element_at(bodies, F.nullif(F.array_position(nums, number), F.lit(0)).cast("int"))
        return F.coalesce(F.nullif(inline, F.lit("")), target, F.lit(""))

    facts = F.struct(
        (catalog != "").alias("readable"),
        F.regexp_extract(value_of("/OpenAction"), r"/S\s*(/[A-Za-z]+)", 1).alias("open_subtype"),
        catalog.rlike(r"/AA\b").alias("has_aa"),
        value_of("/Names").rlike(r"/JavaScript\b").alias("names_js"),
        F.exists(bodies, _deep_threat).alias("deep"),
        F.contains(raw, F.lit("/ObjStm")).alias("has_objstm"),
        F.size(bodies).alias("n_objects"),
    )
    return once(rooted, {out: F.when(is_pdf, facts)}).drop("_nums", "_bodies", "_catalog")


def references(objects: DataFrame) -> DataFrame:
    """(file_id, obj_no, target, resolved, uses): a self-join on file and number, both sides hashed on the same key."""
    uses = objects.select(
        "file_id",
        "obj_no",
        F.explode(F.regexp_extract_all("body", F.lit(r"(\d+)\s+\d+\s+R\b"), 1).cast("array<bigint>")).alias("target"),
    )
    uses = uses.groupBy("file_id", "obj_no", "target").agg(F.count("*").alias("uses"))
    targets = objects.groupBy("file_id", F.col("obj_no").alias("target")).agg(F.count("*").alias("copies"))
    joined = uses.join(targets, ["file_id", "target"], "left")
    return joined.select(
        "file_id",
        "obj_no",
        "target",
        F.col("copies").isNotNull().alias("resolved"),
        (F.col("uses") * F.coalesce("copies", F.lit(1))).alias("uses"),
    )
