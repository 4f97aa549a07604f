"""Deterministic rules, points, verdicts.

All rules of a file are evaluated inside its row: the findings array is built by expressions, so the scan of a
corpus reads it once and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.bytes import byte_entropy
from docwarden.operators import features
from docwarden.session import once
from docwarden.sources import archives
from docwarden.sources.pdf_objects import with_pdf_facts


def suspicious_hits(low: Column) -> Column:
    """Distinct suspicious strings in a lower-cased text, sorted."""
    found = [F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in fixed.SUSPICIOUS_STRINGS]
    return F.array_sort(F.array_compact(F.array(*found)))


def _finding(rule: str, message: Column | None = None) -> Column:
    shown = F.lit(fixed.RULE_MESSAGES[rule]) if message is None else message
    return F.struct(
        F.lit(rule).alias("id"), F.lit(fixed.RULE_SEVERITY[rule]).alias("severity"), shown.alias("message")
    )


def points_of(findings: Column) -> Column:
    """Sum of the points of an array of findings."""
    value = F.create_map(*[x for k, v in fixed.RULE_POINTS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(findings, F.lit(0), lambda acc, f: acc + F.coalesce(F.try_element_at(value, f["id"]), F.lit(0)))


def findings(df: DataFrame, entropy_limit: float = fixed.HIGH_ENTROPY_BITS) -> DataFrame:
    """(file_id, ext, content [, has_vba_project, embedded_ole_count, entropy_bits]) -> findings, points, rule_score.

    Optional columns that are absent count as 0, which also leaves their rules silent.
    """
    have = set(df.columns)
    raw, ext, hits, facts = F.col("raw"), F.col("ext"), F.col("hits"), F.col("pdf")
    extra = {c: F.lit(0.0) for c in ("has_vba_project", "embedded_ole_count", "entropy_bits") if c not in have}
    viewed = once(df.withColumns(extra), {"raw": text.latin1(F.col("content"))})
    hit = once(once(viewed, {"low": F.lower(raw)}), {"hits": suspicious_hits(F.col("low"))}).drop("low")
    base = with_pdf_facts(hit, ext == ".pdf")
    readable = F.coalesce(facts["readable"], F.lit(False))
    subtype = facts["open_subtype"]
    is_office = ext.isin(*fixed.OFFICE_RULE_EXTS)
    rtf_bad = raw.rlike("(?i)" + "|".join(fixed.RTF_CONTROL_PATTERNS))
    bits = F.coalesce(F.col("entropy_bits"), F.lit(0.0))
    in_order = [
        F.when(
            F.size(hits) > 0,
            _finding(
                "suspicious_strings",
                F.concat(F.lit(fixed.RULE_MESSAGES["suspicious_strings"]), F.array_join(F.slice(hits, 1, 5), ", ")),
            ),
        ),
        F.when(
            readable & subtype.isin(*fixed.LAUNCH_SUBTYPES),
            _finding("pdf_exploit_action", F.format_string(fixed.RULE_MESSAGES["pdf_exploit_action"], subtype)),
        ).when(readable & (subtype == "/JavaScript"), _finding("pdf_js_auto")),
        F.when(readable & facts["has_aa"], _finding("pdf_aa_action")),
        F.when(readable & facts["names_js"], _finding("pdf_names_js")),
        F.when(readable & facts["deep"], _finding("pdf_deep_js")),
        F.when(
            (ext == ".pdf") & ~readable & text.has_any(raw, fixed.PDF_FALLBACK_PATTERNS), _finding("pdf_regex_match")
        ),
        F.when(is_office & (F.col("has_vba_project") == 1.0), _finding("office_macro")),
        F.when(is_office & (F.col("embedded_ole_count") > 0), _finding("office_ole")),
        F.when((ext == ".rtf") & rtf_bad, _finding("rtf_exploit")),
        F.when(
            bits > entropy_limit,
            _finding("high_entropy", F.format_string(fixed.RULE_MESSAGES["high_entropy"], F.format_number(bits, 2))),
        ),
    ]
    scored = once(base, {"findings": F.array_compact(F.array(*in_order))}).drop("raw", "hits", "pdf")
    scored = scored.withColumn("points", points_of(F.col("findings")))
    return scored.withColumn("rule_score", F.least(F.col("points") / F.lit(100.0), F.lit(1.0)))


def verdict_columns(findings_col: Column, rule_score: Column, model_prob: Column) -> dict[str, Column]:
    """Verdict and risk: a critical finding decides, then the rules, then the model."""
    critical = F.exists(findings_col, lambda f: f["severity"] == "critical")
    verdict = (
        F.when(critical, "malicious")
        .when(rule_score >= 0.60, "malicious")
        .when(rule_score >= 0.30, "suspicious")
        .when(model_prob >= 0.75, "malicious")
        .when(model_prob >= 0.50, "suspicious")
        .otherwise("benign")
    )
    return {"verdict": verdict, "risk_score": F.when(critical, 1.0).otherwise(F.greatest(rule_score, model_prob))}


def evidence_verdict(findings_col: Column, risk: Column) -> Column:
    """The alternative policy: script or macro evidence, then severity, then a very sure model."""
    hard = F.exists(findings_col, lambda f: f["id"].isin("pdf_js_auto", "pdf_names_js", "pdf_deep_js", "office_macro"))
    high = F.exists(findings_col, lambda f: f["severity"].isin("high", "critical"))
    medium = F.exists(findings_col, lambda f: f["severity"] == "medium")
    return (
        F.when(hard | high | (medium & (risk > 0.70)) | (risk > 0.85), "malicious").otherwise("benign")
    )


def recommendations(verdict: Column, findings_col: Column) -> Column:
    """Advice texts; the macro and script advice looks for its mark anywhere in the findings."""

    def mentions(mark: str) -> Column:
        return F.exists(findings_col, lambda f: F.contains(F.concat_ws(" ", f["id"], f["severity"], f["message"]), F.lit(mark)))

    bad = verdict == "malicious"
    texts = fixed.RECOMMENDATIONS
    return F.array_compact(
        F.array(
            F.when(bad, texts[0]),
            F.when(bad, texts[1]),
            F.when(mentions("office_macro"), texts[2]),
            F.when(mentions("pdf_js"), texts[3]),
        )
    )


def scan(df: DataFrame, model: DataFrame | None = None, with_archives: bool = False, with_entropy: bool = True) -> DataFrame:
    """Verdict, risk, findings and recommendations of every file.

    ``model`` may bring (file_id, model_prob); without it the model is silent. ``with_archives`` opens the
    office archives; without it their rules stay silent. A file whose content is missing keeps its row: ``ok`` is false and
    ``error`` says why.
    """
    if with_archives:
        office = F.when(F.col("ext").isin(*fixed.OFFICE_RULE_EXTS), F.col("content"))
        df = once(df, {"_names": archives.member_names(office)})
        df = df.withColumns(features.archive_facts(F.col("_names"))).drop("_names")
    if with_entropy:
        df = df.withColumn("entropy_bits", byte_entropy(F.col("content")))
    found = findings(df)
    if model is not None:
        found = found.join(model.select("file_id", "model_prob"), "file_id", "left").na.fill(0.0, ["model_prob"])
    elif "model_prob" not in found.columns:
        found = found.withColumn("model_prob", F.lit(0.0))
    decided = found.withColumns(verdict_columns(F.col("findings"), F.col("rule_score"), F.col("model_prob")))
    return isolate_failures(decided.withColumn("recommendations", recommendations(F.col("verdict"), F.col("findings"))))


def isolate_failures(df: DataFrame) -> DataFrame:
    """Rows whose content could not be read become benign with score 0, ``ok`` false and a reason; the job goes on."""
    failed = F.col("content").isNull()
    return df.withColumns(
        {
            "ok": ~failed,
            "verdict": F.when(failed, "benign").otherwise(F.col("verdict")),
            "risk_score": F.when(failed, 0.0).otherwise(F.col("risk_score")),
            "error": F.when(failed, "scan failure: content missing"),
        }
    )
