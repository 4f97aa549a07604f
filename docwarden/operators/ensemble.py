"""Scores around the verdict: blends, bands, tags, explanations, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.session import once


def _n(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def rules_prob(columns: set[str]) -> Column:
    """Additive evidence score from meta and features, clamped to 0..1."""
    parts = (
        ("pdf_has_javascript", 0.5),
        ("has_vba_project", 0.4),
        ("embedded_files_count", 0.2),
        ("pdf_openaction", 0.1),
        ("ooxml_has_external_rel", 0.1),
    )
    score = F.lit(0.0)
    for name, weight in parts:
        if name in columns:
            score = score + F.when(_n(name) > 0, F.lit(weight)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def blend(dl: Column, lgbm: Column, tree: Column, rules: Column) -> Column:
    """Weighted mean of the four signals."""
    w = fixed.BLEND_WEIGHTS
    # plain left-to-right addition: the built-in sum compensates, and its last bit would differ
    total = w["dl"] + w["lgbm"] + w["tree"] + w["rules"]
    return (dl * w["dl"] + lgbm * w["lgbm"] + tree * w["tree"] + rules * w["rules"]) / F.lit(total)


def tree_prob(forest: Column, extra: Column) -> Column:
    """Mean of the tree scores that are there; 0.5 when none is."""
    both = F.array_compact(F.array(forest, extra))
    total = F.aggregate(both, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(both) > 0, total / F.size(both)).otherwise(F.lit(0.5))


def tree_prob_weighted(calibrated_forest: Column, extra: Column) -> Column:
    return calibrated_forest * 0.6 + extra * 0.4


def ensemble(df: DataFrame) -> DataFrame:
    """Needs p_dl, p_lgbm, p_rf, p_et and the meta columns; adds scores, verdict and contributions."""
    cols = set(df.columns)
    scored = df.withColumns({"p_tree": tree_prob(F.col("p_rf"), F.col("p_et")), "p_rules": rules_prob(cols)})
    scored = scored.withColumn("risk", blend(F.col("p_dl"), F.col("p_lgbm"), F.col("p_tree"), F.col("p_rules")))
    # Python rounds halves to even, and so does bround
    rounded = {f"s_{k}": F.bround(F.col(f"p_{k}"), 3) for k in ("dl", "lgbm", "tree", "rules")}
    return scored.withColumns(
        {"verdict": F.when(F.col("risk") >= 0.5, "malicious").otherwise("benign"), **rounded}
    ).withColumns({f"contrib_{k}": F.bround(F.col(f"s_{k}") * w, 4) for k, w in fixed.BLEND_WEIGHTS.items()})


def report_severity(prob: Column) -> Column:
    return F.when(prob >= 0.90, "critical").when(prob >= 0.70, "high").when(prob >= 0.40, "medium").otherwise("low")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.71, "CRITICAL").when(score >= 0.50, "HIGH").when(score >= 0.21, "MEDIUM").otherwise("LOW")


def confidence(scores: list[Column]) -> dict[str, Column]:
    """How far the signals lie apart, and in words."""
    spread = F.greatest(*scores) - F.least(*scores)
    level = F.when(spread > 0.45, "low").when(spread > 0.25, "medium").otherwise("high")
    why = (
        F.when(spread > 0.45, "Models disagree strongly")
        .when(spread > 0.25, "Some disagreements among models")
        .otherwise("Models broadly agree")
    )
    return {"level": level, "spread": F.bround(spread, 3), "why": why}


def tags_and_severity(df: DataFrame, prob: str = "prob", with_launch: bool = True) -> DataFrame:
    """Tags in fixed order, severity 0..100 with boosts, and whether to sanitise. Absent features count as 0."""
    have = set(df.columns)

    def positive(*names: str) -> Column:
        found = F.lit(False)
        for name in names:
            if name in have:
                found = found | (_n(name) > 0)
        return found

    links = F.lit(0.0)
    for name in ("url_count", "url_count_general", "pdf_uri_count", "rtf_url_count"):
        if name in have:
            links = links + _n(name)
    macro = positive("vba_module_count", "macro_size")
    activex = positive("has_activex")
    ole = positive("ole_object_count", "rtf_has_ole_packager_hint")
    script, auto = positive("pdf_has_js"), positive("pdf_has_openaction")
    tags = F.array_compact(
        F.array(
            F.when(macro, "VBA macros detected"),
            F.when(activex, "ActiveX controls"),
            F.when(ole, "Embedded OLE objects"),
            F.when(positive("token_CreateObject", "token_Shell", "token_WScript"), "Suspicious automation APIs"),
            F.when(script, "PDF JavaScript"),
            F.when(auto, "Auto-execute action"),
            F.when(positive("pdf_has_launch") if with_launch else F.lit(False), "Launch action"),
            F.when(links > 10, "Unusually many links").when(links > 0, "Contains links"),
        )
    )

    def boost(value: Column, when: Column, by: float) -> Column:
        return F.when(when, F.least(F.lit(1.0), value + by)).otherwise(value)

    sev = boost(F.col(prob), auto | script | activex, 0.2)
    sev = boost(boost(sev, macro, 0.1), ole, 0.1)
    severity = F.bround(sev * 100, 0).cast("int")
    return df.withColumns(
        {"tags": tags, "severity": severity, "sanitize": (severity >= 40) | macro | script | ole}
    )


HINTS = (
    "vba_module_count", "has_activex", "ole_object_count", "macro_size", "pdf_has_js", "pdf_has_openaction",
    "suspicious_token_count",
)


def feature_hints(columns: set[str]) -> Column:
    """(name, value) pairs of the telling features that the row has, by name."""
    pairs = [
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")))
        for n in HINTS
        if n in columns
    ]
    return F.array_sort(F.array_compact(F.array(*pairs)))


def top_features(df: DataFrame, columns: list[str], k: int = 6) -> DataFrame:
    """The k features of each file with the largest magnitude. Ranked inside the row, so nothing is exchanged."""
    df = once(df.select("file_id", *columns), {c: F.col(c).cast("double") for c in columns})
    entries = F.array(
        *[
            F.struct((-F.abs(F.col(c))).alias("by"), F.lit(c).alias("name"), F.col(c).alias("value"))
            for c in columns
        ]
    )
    best = F.slice(F.array_sort(entries), 1, k)
    return df.select("file_id", F.posexplode(best).alias("rank", "f")).select(
        "file_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("f.name").alias("name"),
        F.col("f.value").alias("value"),
        F.bround("f.value", 4).alias("est_contribution"),
    )


def signed_contributions(df: DataFrame, weights: dict[str, float], k: int = 6) -> DataFrame:
    """The k strongest positive and negative terms of a linear score."""
    entries = F.array(*[F.struct((F.col(c).cast("double") * w).alias("value"), F.lit(c).alias("name")) for c, w in weights.items()])

    def best(sign: int) -> Column:
        kept = F.filter(entries, lambda e: e["value"] * sign > 0)
        keyed = F.transform(kept, lambda e: F.struct((e["value"] * -sign).alias("by"), e["name"].alias("name"), e["value"].alias("value")))
        return F.slice(F.array_sort(keyed), 1, k)

    sides = F.concat(
        F.transform(best(1), lambda e, i: F.struct(F.lit("positive").alias("side"), (i + 1).alias("rank"), e["name"].alias("name"), e["value"].alias("value"))),
        F.transform(best(-1), lambda e, i: F.struct(F.lit("negative").alias("side"), (i + 1).alias("rank"), e["name"].alias("name"), e["value"].alias("value"))),
    )
    return df.select("file_id", F.inline(sides))


def threats(columns: set[str]) -> Column:
    """Threat findings of the ensemble report; a clean file gets the one entry that says so."""

    def entry(kind: str, indicator: Column | None = None) -> Column:
        name, severity, shown, action = fixed.THREATS[kind]
        return F.struct(
            F.lit(name).alias("threat_type"),
            F.lit(severity).alias("severity"),
            (F.lit(shown) if indicator is None else indicator).alias("indicator"),
            F.lit(action).alias("action_taken"),
        )

    found = []
    for kind in ("pdf_has_javascript", "has_vba_project"):
        if kind in columns:
            found.append(F.when(_n(kind) > 0, entry(kind)))
    if "embedded_files_count" in columns:
        shown = F.format_string(fixed.THREATS["embedded_files_count"][2], _n("embedded_files_count").cast("int"))
        found.append(F.when(_n("embedded_files_count") > 0, entry("embedded_files_count", shown)))
    if not found:
        return F.array(entry("none"))
    some = F.array_compact(F.array(*found))
    return F.when(F.size(some) > 0, some).otherwise(F.array(entry("none")))


def humanize(findings: Column, fields: set[str]) -> Column:
    """Findings as (title, message, severity, explain), each from the first field that is filled."""

    def first(f: Column, names: tuple[str, ...], default: str) -> Column:
        return F.coalesce(*[F.nullif(f[n], F.lit("")) for n in names if n in fields], F.lit(default))

    def one(f: Column) -> Column:
        title = first(f, ("id", "threat_type", "title", "name", "type"), "Indicator")
        message = first(f, ("message", "indicator", "description", "details"), "")
        severity = first(f, ("severity", "sev", "level"), "info")
        low = F.lower(F.concat(title, F.lit(" "), message))

        def says(*words: str) -> Column:
            return text.has_any(low, words)

        explain = (
            F.when(says("vba", "macro"), fixed.EXPLANATIONS["macro"])
            .when(says("javascript", "/openaction", "/js"), fixed.EXPLANATIONS["javascript"])
            .when(says("embedded") & says("object", "file"), fixed.EXPLANATIONS["embedded"])
            .when(says("rtf") & says("object", "field"), fixed.EXPLANATIONS["rtf"])
        )
        return F.struct(title.alias("title"), message.alias("message"), severity.alias("severity"), explain.alias("explain"), f.alias("raw"))

    return F.transform(findings, one)


def narrative(verdict: Column, risk: Column, scores: dict[str, Column], threat_list: Column) -> Column:
    """One paragraph: verdict, signals, reasons."""
    head = F.format_string("The file was classified as **%s** with a risk score of %s.", verdict, text.fixed2(risk))
    names = {"dl": "DL", "lgbm": "LGBM", "tree": "Tree", "rules": "Rules"}
    signals = F.concat(
        F.lit("Model signals: "),
        F.concat_ws(", ", *[F.concat(F.lit(names[k] + "="), text.fixed2(c)) for k, c in scores.items()]),
        F.lit("."),
    )
    why = F.array_join(F.transform(threat_list, lambda f: F.concat(f["threat_type"], F.lit(" ("), f["indicator"], F.lit(")"))), "; ")
    return F.concat_ws(" ", head, signals, F.concat(F.lit("Key reasons: "), why, F.lit(".")))


def display_signals(verdict: Column, rule_score: Column, model_prob: Column, risk: Column) -> dict[str, Column]:
    """Bars for display only. A verdict without rule points shows a floor; tree and dl are shown from the others."""
    rules = (
        F.when((rule_score == 0.0) & (verdict == "suspicious"), F.lit(0.45))
        .when((rule_score == 0.0) & (verdict == "malicious"), F.lit(0.75))
        .otherwise(rule_score)
    )
    tree = F.when(model_prob > 0, model_prob * 0.92).when(rules > 0, rules * 0.8).otherwise(F.lit(0.0))
    return {"rules": rules, "lgbm": model_prob, "tree": tree, "dl": risk, "composite": risk}


def signal_aliases(signals: Column) -> Column:
    """Signal map with the short names beside the long ones; a short name that is there already is overwritten."""
    names = {"P_LGBM": "lgbm", "P_TREE": "tree", "P_DL": "dl", "P_RULES": "rules"}
    pairs = F.array_compact(
        F.array(
            *[
                F.when(F.map_contains_key(signals, long), F.struct(F.lit(short).alias("key"), F.element_at(signals, long).alias("value")))
                for long, short in names.items()
            ]
        )
    )
    extra = F.map_from_entries(pairs)
    return F.map_concat(F.map_filter(signals, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def normalise_verdict(verdict: Column, risk: Column, upper: bool = True) -> Column:
    """A missing verdict, or one that tells of a scan error, is decided by the score."""
    by_score = F.when(F.coalesce(risk, F.lit(0.0)) >= 0.5, "malicious").otherwise("benign")
    filled = F.when(verdict.isNull() | (verdict == "scan_error"), by_score).otherwise(verdict)
    return F.upper(filled) if upper else F.lower(filled)


def effective_result(df: DataFrame) -> DataFrame:
    """What a reader sees: the clean scan's score and verdict once sanitised, else the original's."""
    done = F.coalesce(F.col("sanitized"), F.lit(False))
    original = F.coalesce("risk_score", F.lit(0.0))
    clean = F.coalesce("clean_risk_score", original)

    def verdict(name: str, score: Column) -> Column:
        return F.lower(F.coalesce(F.col(name), F.when(score >= 0.5, "malicious").otherwise("benign")))

    score = F.when(done, clean).otherwise(original)
    return df.withColumns(
        {
            "shown_score": score,
            "shown_verdict": F.when(done, verdict("clean_verdict", clean)).otherwise(verdict("verdict", original)),
            "shown_percent": text.percent(score),
            "shown_level": risk_level(score),
        }
    )
