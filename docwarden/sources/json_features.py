"""Feature documents: one JSON object per file, numbers by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.session import once


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, json) of every JSON file below ``root``."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def parse_features(df: DataFrame) -> DataFrame:
    """(file_id, json) -> (file_id, name, value).

    An outer ``features`` object is unwrapped. Numbers and booleans are kept, texts when they are a number; all
    else, and every unreadable document, is left out.
    """
    parsed = once(df.select("file_id", "json"), {"doc": F.try_parse_json("json")})
    nested = once(parsed.select("file_id", "doc"), {"inner": F.try_variant_get("doc", "$.features", "variant")})
    body = F.when(F.startswith(F.schema_of_variant("inner"), F.lit("OBJECT")), F.col("inner")).otherwise(F.col("doc"))
    rows = once(nested, {"v": body}).select("file_id", "v").filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    cells = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
        "file_id", F.col("key").alias("name"), F.col("value").alias("cell"), F.schema_of_variant("value").alias("kind")
    )
    as_text = F.trim(F.col("cell").cast("string"))
    decimal = F.contains(as_text, F.lit(".")) & as_text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    whole = as_text.rlike(r"^[+-]?\d+$")
    value = (
        F.when(F.col("kind") == "BOOLEAN", (as_text == "true").cast("double"))
        .when(F.col("kind") == "STRING", F.when(decimal | whole, as_text.try_cast("double")))
        .when(F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)"), as_text.try_cast("double"))
    )
    return cells.select("file_id", "name", value.alias("value")).filter(F.col("value").isNotNull())


def widen(long: DataFrame, names: list[str], fill: float) -> DataFrame:
    """(file_id, name, value) -> one column per name. One partial aggregate, no pivot pass over the names."""
    return long.groupBy("file_id").agg(
        *[F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(fill)).alias(n) for n in names]
    )


def to_document(columns: list[str], skipped: tuple[str, ...] = ("type", "hash")) -> Column:
    """JSON document of a row's numeric cells; texts that are numbers count, nulls and other texts do not."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").try_cast("double").alias("value")) for c in columns if c not in skipped]
    )
    kept = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.to_json(F.struct(kept.alias("features")))


def write_documents(df: DataFrame, path: str, label: str = "label") -> None:
    """Feature documents, one folder per label."""
    columns = [c for c in df.columns if c not in ("file_id", label)]
    df.select("file_id", label, to_document(columns).alias("document")).write.mode("overwrite").partitionBy(label).json(path)
