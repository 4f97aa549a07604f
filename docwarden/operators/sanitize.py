"""Removal of active content, and what was removed.

Every format is rewritten inside its row: text by expressions, PDFs and archives by functions of their bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.vocabulary import prefix_pattern
from docwarden.operators import archive_clean, pdf_clean, rules
from docwarden.session import once
from docwarden.sources.pdf_objects import DICT

# ---- keywords ----------------------------------------------------------------------------------------------


def scrub(value: Column, terms: tuple[str, ...]) -> Column:
    """Every term deleted in one pass, longest first, in any case."""
    return F.regexp_replace(value, F.lit(prefix_pattern(terms)), F.lit(""))


def scrub_hits(df: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(file_id, text) -> (term, hits, files): which terms the scrub deletes, counted in lower case."""
    found = F.transform(F.regexp_extract_all(F.col("text"), F.lit(prefix_pattern(terms)), 0), F.lower)
    rows = once(df.select("text"), {"found": found}).select("found")
    # counted inside the row: one row per file and term goes into the only exchange
    counted = F.transform(
        F.array_distinct("found"),
        lambda t: F.struct(t.alias("term"), F.size(F.filter("found", lambda x: x == t)).alias("n")),
    )
    return rows.select(F.inline(counted)).groupBy("term").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))


# ---- RTF ---------------------------------------------------------------------------------------------------


def rtf_light(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, fixed.RTF_LIGHT_BLOCK, ""), fixed.RTF_LIGHT_WORDS, "")


def rtf_full(df: DataFrame, source: str = "text") -> DataFrame:
    """Add ``clean`` and ``removed``: the steps run in order and each one sees what the earlier ones left."""
    df = df.withColumn("clean", F.col(source))
    for label, pattern in fixed.RTF_FULL_STEPS:
        df = df.withColumn(f"_{label}", F.col("clean").rlike(pattern)).withColumn(
            "clean", F.regexp_replace("clean", pattern, " ")
        )
    labels = [label for label, _ in fixed.RTF_FULL_STEPS]
    removed = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{x}"), F.lit(x)) for x in labels])))
    return df.withColumns(
        {"removed": removed, "clean": F.regexp_replace("clean", fixed.RTF_FULL_WORDS, "")}
    ).drop(*[f"_{x}" for x in labels])


# ---- PDF ---------------------------------------------------------------------------------------------------

_VALUE = r"(?:" + DICT + r"|\[[^\]]*\]|\d+\s+\d+\s+R\b|\((?:[^()\\]|\\.)*+\)|<[0-9A-Fa-f\s]*>|/[\w.#-]+|[\w.+-]+)"


def _key_pattern(keys: tuple[str, ...]) -> str:
    # the subtype of an action is a value: it is matched first and put back
    names = "|".join(k[1:] for k in sorted(keys, key=len, reverse=True))
    return r"(?s)(/S\s*/[A-Za-z]+)|/(" + names + r")\b\s*" + _VALUE


def pdf_strip_keys(value: Column, keys: tuple[str, ...] = fixed.PDF_STRIP_KEYS) -> Column:
    """Keys taken out together with their values."""
    return F.regexp_replace(value, F.lit(_key_pattern(keys)), F.lit("$1"))


_BAD_ACTION = (
    r"(?s)/A\s*(<<[^<>]*?(?:<[^<>]*+>[^<>]*?)*?/S\s*/("
    + "|".join(k[1:] for k in fixed.PDF_STRIP_ACTIONS)
    + r")\b(?:[^<>]++|<<[^<>]*+>>|<[^<>]*+>)*+>>)"
)


def pdf_strip(df: DataFrame, source: str = "text", keys: tuple[str, ...] = fixed.PDF_STRIP_KEYS) -> DataFrame:
    """Add ``clean``, ``removed`` (distinct, sorted) and the counters ``js`` and ``actions``."""
    taken = F.filter(F.regexp_extract_all(F.col(source), F.lit(_key_pattern(keys)), 2), lambda k: k != "")
    df = df.withColumn("_keys", taken).withColumn("_clean", pdf_strip_keys(F.col(source), keys))
    df = df.withColumn("_acts", F.regexp_extract_all("_clean", F.lit(_BAD_ACTION), 2))
    is_js = lambda k: F.contains(k, F.lit("JS")) | F.contains(k, F.lit("Script"))
    labels = F.concat(
        F.transform("_keys", lambda k: F.concat(F.lit("/"), k)), F.transform("_acts", lambda k: F.concat(F.lit("/A/"), k))
    )
    return df.withColumns(
        {
            "clean": F.regexp_replace("_clean", F.lit(_BAD_ACTION), F.lit("")),
            "removed": F.array_sort(F.array_distinct(labels)),
            "js": F.size(F.filter("_keys", is_js)),
            "actions": F.size(F.filter("_keys", lambda k: ~is_js(k))) + F.size("_acts"),
        }
    ).drop("_keys", "_clean", "_acts")


# ---- OOXML -------------------------------------------------------------------------------------------------


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def drops_light(member: Column) -> Column:
    """Macro parts and anything in an embeddings folder."""
    return (
        F.endswith(member, F.lit("vbaProject.bin"))
        | F.endswith(member, F.lit("vbaProjectSignature.bin"))
        | F.contains(F.lower(member), F.lit("/embeddings/"))
    )


def drops_full(member: Column) -> Column:
    """Macro parts, five folders, document properties, comments and tracked changes."""
    name = F.lower(member)
    return _any(
        [F.endswith(name, F.lit("vbaproject.bin"))]
        + [F.contains(name, F.lit(f)) for f in fixed.OOXML_DROP_FOLDERS]
        + [F.endswith(name, F.lit(p)) for p in fixed.OOXML_DROP_PROPS]
        + [F.contains(name, F.lit(w)) for w in fixed.OOXML_DROP_NAMES]
    )


def attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, r"\b" + name + r"""\s*=\s*["']([^"']*)["']""", 1)


def is_external(rel: Column, light: bool = False) -> Column:
    """Whether a relationship leaves the package."""
    mode, target = attribute(rel, "TargetMode"), attribute(rel, "Target")
    if light:
        return (mode == "External") | F.contains(target, F.lit("externalLink"))
    goal, kind = F.trim(F.lower(target)), F.trim(F.lower(attribute(rel, "Type")))
    return _any(
        [
            mode == "External",
            F.contains(goal, F.lit("externallink")),
        ]
        + [F.endswith(kind, F.lit(s)) for s in fixed.EXTERNAL_KINDS]
        + [F.startswith(goal, F.lit(s)) for s in fixed.UNSAFE_SCHEMES]
    )


def external_relationships(members: DataFrame, light: bool = False) -> DataFrame:
    """(file_id, member, target, mode) of every relationship that leaves its package."""
    rels = members.filter(F.endswith(F.lower("member"), F.lit(".rels")))
    found = F.regexp_extract_all(text.utf8_ignore(F.col("body")), F.lit(archive_clean.RELATIONSHIP), 0)
    rows = rels.select("file_id", "member", F.explode(F.filter(found, lambda r: is_external(r, light))).alias("rel"))
    return rows.select("file_id", "member", attribute(F.col("rel"), "Target").alias("target"), attribute(F.col("rel"), "TargetMode").alias("mode"))


def ooxml_clean(df: DataFrame, mode: str = "light", terms: tuple[str, ...] | None = None) -> DataFrame:
    """(file_id, content) -> (file_id, clean, removed), one row per row; an unreadable archive has none."""
    done = once(df.select("file_id", "content"), {"_zip": archive_clean.cleaned(F.col("content"), mode, terms)})
    return done.filter(F.col("_zip.clean").isNotNull()).select("file_id", "_zip.clean", "_zip.removed")


# ---- dispatch ----------------------------------------------------------------------------------------------


def sanitize(
    df: DataFrame, policy: str = "malicious_only", archives_too: bool = True, mode: str = "light", terms: tuple[str, ...] | None = None
) -> DataFrame:
    """Clean content of scanned files: (file_id, ext, content, verdict) -> + clean, changed, removed, engine, notes, sanitized.

    ``malicious_only`` leaves every other file as it is; ``always`` cleans all. A type without a cleaner, and a
    file that its cleaner cannot read, keep their content: ``engine``, ``notes`` and ``sanitized`` say what a cleaner
    returned, not what it was asked for. Every file is cleaned in its row: the input runs once and nothing is exchanged.

    ``light`` takes script and launch keys out of PDFs, objects and fields out of RTF, and macros, embeddings and
    external relationships out of archives; ``full`` follows the PDF's objects from its catalog, takes all steps of the
    RTF list, and also drops properties, comments and active elements of archives, with the keywords where ``terms`` is
    given. PDFs whose objects cannot be told take the pattern rule.
    """
    if policy not in ("malicious_only", "always"):
        raise ValueError(f"unknown policy {policy}")
    if mode not in ("light", "full"):
        raise ValueError(f"unknown mode {mode}")
    ext, content, full = F.col("ext"), F.col("content"), mode == "full"
    due = F.lit(True) if policy == "always" else F.coalesce(F.col("verdict") == "malicious", F.lit(False))
    parsed = {"_pdf": pdf_clean.cleaned(F.when(due & (ext == ".pdf"), content), "scoped" if full else "everywhere")}
    if archives_too:
        # every type whose archive rules can find something can also be cleaned
        parsed["_zip"] = archive_clean.cleaned(F.when(due & ext.isin(*fixed.OFFICE_RULE_EXTS), content), mode, terms)
    out = once(df, parsed)
    raw = text.latin1(content)
    stripped = F.regexp_replace(pdf_strip_keys(raw), F.lit(_BAD_ACTION), F.lit(""))
    if full:
        out = rtf_full(out.withColumn("_raw", F.when(due & (ext == ".rtf"), raw)), "_raw").withColumnsRenamed({"clean": "_rtf", "removed": "_labels"})
    else:
        out = out.withColumns({"_raw": F.lit(None).cast("string"), "_rtf": rtf_light(raw), "_labels": F.array().cast("array<string>")})
    clean = F.when(due & (ext == ".pdf"), F.coalesce("_pdf.clean", F.encode(stripped, "ISO-8859-1"))).when(
        due & (ext == ".rtf"), F.encode("_rtf", "ISO-8859-1")
    )
    removed = F.when(due & (ext == ".pdf"), F.col("_pdf.removed")).when(due & (ext == ".rtf"), F.col("_labels"))
    if archives_too:
        clean, removed = F.coalesce(clean, "_zip.clean"), F.coalesce(removed, "_zip.removed")
    out = out.withColumns({"_clean": clean, "removed": F.coalesce(removed, F.array().cast("array<string>"))})
    cleaner = F.when(ext == ".pdf", "pdf_strip").when(ext == ".rtf", "rtf_convert").otherwise("ooxml_purge")
    engine = F.when(~due, "none").when(F.col("_clean").isNotNull(), cleaner).otherwise("passthrough")
    out = out.withColumn("engine", engine).withColumn("clean", F.coalesce("_clean", "content"))
    kept = F.when(F.col("engine") == "passthrough", "Unsupported type or sanitizer failed; original retained")
    out = out.withColumn("notes", kept).drop("_clean", "_pdf", "_zip", "_raw", "_rtf", "_labels")
    return out.withColumns(
        {"changed": F.sha2("clean", 256) != F.sha2("content", 256), "sanitized": due & (F.col("engine") != "passthrough")}
    )


def mark_unchanged(clean: Column, original: Column, marker: str = "\n% sanitized\n") -> Column:
    """A cleaned file always differs from its original: an unchanged one gets a harmless comment."""
    return F.when(F.sha2(clean, 256) == F.sha2(original, 256), F.concat(clean, F.lit(marker.encode()).cast("binary"))).otherwise(clean)


def rescan(df: DataFrame, policy: str = "malicious_only", archives_too: bool = True, with_entropy: bool = True) -> DataFrame:
    """Scan, clean, scan again, in one row per file: verdict and risk before and after, and their difference.

    All rules are on; archives and entropy may be left out.
    """
    first = rules.scan(df, with_archives=archives_too, with_entropy=with_entropy)
    kept = first.select(
        "file_id", "ext", "content", "verdict",
        F.col("risk_score").alias("risk_before"), F.col("findings").alias("findings_before"),
    )
    cleaned = sanitize(kept, policy, archives_too)
    second = cleaned.withColumnsRenamed({"verdict": "verdict_before", "content": "original"}).withColumnRenamed("clean", "content")
    measured = ("entropy_bits", "has_vba_project", "embedded_ole_count")
    second = second.drop(*[c for c in measured if c in second.columns])
    again = rules.scan(second, with_archives=archives_too, with_entropy=with_entropy)
    return again.select(
        "file_id", "ext", "original", F.col("content").alias("clean"), "engine", "changed", "sanitized",
        "verdict_before", "risk_before", "findings_before",
        F.col("verdict").alias("verdict_after"), F.col("risk_score").alias("risk_after"), F.col("findings").alias("findings_after"),
        (F.col("risk_score") - F.col("risk_before")).alias("delta_risk"), "recommendations",
    )
