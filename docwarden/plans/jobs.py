"""End-to-end jobs: scan, clean, scan again, report; training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.functions import text
from docwarden.operators import ensemble, features, rules, sanitize

REPORT_VERSION = 1


def reports(df: DataFrame, policy: str = "malicious_only", archives_too: bool = True) -> DataFrame:
    """(file_id, ext, content) -> (file_id, verdict, clean_sha256, report): the report is nested JSON."""
    r = sanitize.rescan(df, policy, archives_too)
    fields = {"id", "severity", "message"}
    before = rules.recommendations(F.col("verdict_before"), F.col("findings_before"))
    rule_score = F.least(rules.points_of(F.col("findings_before")) / F.lit(100.0), F.lit(1.0))
    shown = ensemble.display_signals(F.col("verdict_before"), rule_score, F.lit(0.0), F.col("risk_before"))
    document = F.struct(
        F.lit(REPORT_VERSION).alias("version"),
        F.concat(F.col("file_id").cast("string"), F.col("ext")).alias("filename"),
        F.sha2("original", 256).alias("original_sha256"),
        F.octet_length("original").alias("size_bytes"),
        text.human_size(F.octet_length("original")).alias("size_human"),
        text.mime_of(F.col("ext")).alias("content_type"),
        F.col("verdict_before").alias("verdict"),
        F.col("risk_before").alias("risk_score"),
        F.struct(*[v.alias(k) for k, v in shown.items()]).alias("signals"),
        ensemble.humanize(F.col("findings_before"), fields).alias("findings"),
        F.col("findings_before").alias("raw_findings"),
        F.struct(
            F.concat(F.sha2("original", 256), F.lit("_clean"), F.col("ext")).alias("filename"),
            F.sha2("clean", 256).alias("sha256"),
            F.col("risk_after").alias("risk_score"),
            F.col("verdict_after").alias("verdict"),
            F.col("findings_after").alias("findings"),
            F.col("delta_risk").alias("delta_risk"),
        ).alias("post_clean_scan"),
        before.alias("recommendations"),
        F.struct(F.col("engine").alias("engine"), F.col("changed").alias("changed")).alias("sanitizer"),
        F.col("sanitized").alias("sanitized"),
        F.struct(F.octet_length("clean").alias("size_bytes")).alias("clean_file"),
    )
    return r.select("file_id", F.col("verdict_before").alias("verdict"), F.sha2("clean", 256).alias("clean_sha256"), F.to_json(document).alias("report"))


def feature_table(files: DataFrame, json_features: DataFrame | None = None) -> DataFrame:
    """Training table: features of files and stored features of JSON documents, missing ones -1."""
    office = features.dispatch(files.select("file_id", "ext", "content"))
    office = office.withColumns({"source_is_json": F.lit(0), "source_is_office": F.lit(1)}).join(files.select("file_id", "label"), "file_id")
    if json_features is not None:
        stored = json_features.withColumns({"source_is_json": F.lit(1), "source_is_office": F.lit(0), "ext": F.lit(".json")})
        office = office.unionByName(stored, allowMissingColumns=True)
    return office.na.fill(-1)


def training_columns(df: DataFrame) -> list[str]:
    """Feature columns of a training table: all but label, type, id and split."""
    return [c for c in df.columns if c not in ("label", "ext", "file_id", "split")]


def ensemble_reports(files: DataFrame, scores: DataFrame, feature_columns: list[str]) -> DataFrame:
    """(file_id, name, ext, text, content) and (file_id, signals, meta, features) -> (file_id, verdict, report).

    The report of the four-model scan: scores and their shares, strongest features, snippets, threats, paragraph,
    confidence. Both sides have one row per file and are hashed on its id.
    """
    scored = ensemble.ensemble(scores)
    top = F.array_sort(
        F.array(*[F.struct((-F.abs(F.col(c).cast("double"))).alias("by"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in feature_columns])
    )
    signals = {k: F.col(f"s_{k}") for k in ("dl", "lgbm", "tree", "rules")}
    threat_list = ensemble.threats(set(scores.columns))
    told = scored.select(
        "file_id",
        "verdict",
        "risk",
        F.struct(*[v.alias(f"p_{k}") for k, v in signals.items()]).alias("model_scores"),
        F.struct(*[F.col(f"contrib_{k}").alias(k) for k in signals]).alias("model_contributions"),
        F.transform(F.slice(top, 1, 6), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"), F.bround(f["value"], 4).alias("est_contribution"))).alias("top_features"),
        threat_list.alias("findings"),
        ensemble.narrative(F.col("verdict"), F.col("risk"), signals, threat_list).alias("explain_text"),
        F.struct(*[v.alias(k) for k, v in ensemble.confidence(list(signals.values())).items()]).alias("confidence"),
    )
    facts = files.select(
        "file_id",
        F.struct(
            F.col("name").alias("file"),
            F.octet_length("content").alias("size_bytes"),
            text.human_size(F.octet_length("content")).alias("size_human"),
            F.sha2("content", 256).alias("sha256"),
            text.mime_of(F.col("ext")).alias("mime_type"),
        ).alias("meta"),
        features.snippet_array(F.col("text")).alias("suspicious_snippets"),
    )
    document = F.struct(
        "meta",
        "verdict",
        F.bround("risk", 3).alias("risk_score"),
        ensemble.report_severity(F.col("risk")).alias("severity"),
        "model_scores",
        "model_contributions",
        "top_features",
        "suspicious_snippets",
        "findings",
        "explain_text",
        "confidence",
    )
    return told.join(facts, "file_id").select("file_id", "verdict", F.to_json(document).alias("report"))


def write_reports(reports_df: DataFrame, path: str) -> None:
    """One JSON document per line, the documents as they are."""
    reports_df.select("report").write.mode("append").text(path)
