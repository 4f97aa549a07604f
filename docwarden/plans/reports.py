"""Queries on scores, explanations, scrubbing and the second scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.vocabulary import prefix_pattern, scrub_terms
from docwarden.operators import ensemble, features, rules, sanitize
from docwarden.plans import sql
from docwarden.plans.files import IS_RTF, OOXML
from docwarden.plans.registry import query
from docwarden.session import spread
from docwarden.sources import archives, corpus
from docwarden.sources.tables import scans, table


def model_scores(df: DataFrame) -> DataFrame:
    """(file_id, model_prob): a stand-in score that any trained model would be joined in place of."""
    return df.select("file_id", ((F.col("file_id") % 100) / F.lit(100.0)).alias("model_prob"))


_PROB = "(file_id % 100) / 100.0::DOUBLE"


@query(
    "model_cascade",
    f"""WITH {sql.CORPUS}, {sql.RULES}
SELECT file_id, greatest(risk_score, {_PROB}) AS risk_score, CASE WHEN points >= 60 THEN 'malicious' WHEN points >= 30 THEN 'suspicious'
  WHEN {_PROB} >= 0.75 THEN 'malicious' WHEN {_PROB} >= 0.5 THEN 'suspicious' ELSE 'benign' END AS verdict FROM decided""",
)
def model_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Rules first, then the model, which is joined by file id."""
    c = corpus.text_corpus(spark, folder).drop("text")
    return rules.scan(c, model=model_scores(c), with_entropy=False).select("file_id", "risk_score", "verdict")


@query(
    "evidence_verdict",
    f"""WITH {sql.CORPUS}, {sql.RULES}, r AS (SELECT *, greatest(risk_score, {_PROB}) AS risk FROM decided)
SELECT file_id, CASE WHEN pdf_hit OR rtf_hit OR (len(hits) > 0 AND risk > 0.7) OR risk > 0.85 THEN 'malicious' ELSE 'benign' END
  AS verdict FROM r""",
)
def evidence_verdict(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.text_corpus(spark, folder).drop("text").withColumn("model_prob", (F.col("file_id") % 100) / F.lit(100.0))
    s = rules.scan(c, with_entropy=False)
    return s.select("file_id", rules.evidence_verdict(F.col("findings"), F.col("risk_score")).alias("verdict"))


@query(
    "pdf_recommendations",
    f"""WITH {sql.PDF_CORPUS}, s AS (SELECT *, len({sql.SUSPICIOUS}) > 0 AS hit FROM corpus)
SELECT file_id, concat_ws(' | ', CASE WHEN plant IN (1, 2, 3, 5, 6, 7) THEN '{fixed.RECOMMENDATIONS[0]} | {fixed.RECOMMENDATIONS[1]}' END,
  CASE WHEN plant = 1 THEN '{fixed.RECOMMENDATIONS[3]}' END) AS advice FROM s""",
)
def pdf_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    s = rules.scan(corpus.pdf_corpus(spark, folder).drop("text"), with_entropy=False)
    return s.select("file_id", F.array_join("recommendations", " | ").alias("advice"))


@query(
    "tags_severity",
    f"""WITH {sql.CORPUS}, f AS (
  SELECT file_id, {_PROB} AS prob, {sql.urls('text')} AS links,
    ext = '.pdf' AND starts_with(text, '%PDF') AS pdf, ext = '.rtf' AND {IS_RTF} AS rtf, text FROM corpus),
g AS (
  SELECT file_id, prob, links + CASE WHEN pdf THEN {sql.total_of('text', fixed.PDF_URI_TOKENS)} ELSE 0 END
      + CASE WHEN rtf THEN {sql.urls('text')} ELSE 0 END AS links,
    pdf AND {sql.any_of('text', fixed.PDF_JS_TOKENS)} AS js, pdf AND {sql.any_of('text', fixed.PDF_OPEN_TOKENS)} AS auto,
    pdf AND contains(text, '/Launch') AS launch,
    rtf AND contains(text, '\\objdata') AND (contains(text, 'Package') OR contains(upper(text), 'D0CF')) AS ole FROM f),
s AS (SELECT *, CASE WHEN js OR auto THEN least(1.0::DOUBLE, prob + 0.2) ELSE prob END AS s1 FROM g),
t AS (SELECT *, CAST(round_even((CASE WHEN ole THEN least(1.0::DOUBLE, s1 + 0.1) ELSE s1 END) * 100, 0) AS INTEGER) AS severity FROM s)
SELECT file_id, severity, severity >= 40 OR js OR ole AS sanitize, concat_ws('; ',
  CASE WHEN ole THEN 'Embedded OLE objects' END, CASE WHEN js THEN 'PDF JavaScript' END, CASE WHEN auto THEN 'Auto-execute action' END,
  CASE WHEN launch THEN 'Launch action' END, CASE WHEN links > 10 THEN 'Unusually many links' WHEN links > 0 THEN 'Contains links' END) AS tags
FROM t""",
)
def tags_severity(spark: SparkSession, folder: str) -> DataFrame:
    f = features.dispatch(corpus.text_corpus(spark, folder)).withColumn("prob", (F.col("file_id") % 100) / F.lit(100.0))
    t = ensemble.tags_and_severity(f)
    return t.select("file_id", "severity", "sanitize", F.array_join("tags", "; ").alias("tags"))


@query(
    "severity_bands",
    f"""WITH {sql.SCANS}
SELECT CASE WHEN risk_score >= 0.9 THEN 'critical' WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN risk_score >= 0.71 THEN 'CRITICAL' WHEN risk_score >= 0.5 THEN 'HIGH' WHEN risk_score >= 0.21 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  count(*) AS scans FROM ledger GROUP BY ALL""",
)
def severity_bands(spark: SparkSession, folder: str) -> DataFrame:
    s = scans(spark, folder)
    return s.groupBy(
        ensemble.report_severity(F.col("risk_score")).alias("severity"), ensemble.risk_level(F.col("risk_score")).alias("level")
    ).agg(F.count("*").alias("scans"))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: four raw signals (two tree scores, either of which may be missing) and the meta facts."""
    d = table(spark, folder, "documents")
    n, c = F.col("doc_id"), F.col("n_chars")

    def share(value, base: int):
        return (value % base) / F.lit(100.0)

    return d.select(
        n.alias("file_id"),
        c.alias("size"),
        share(c, 101).alias("p_dl"),
        share(n * 7 + c, 101).alias("p_lgbm"),
        F.when(n % 3 != 0, share(n * 11, 101)).alias("p_rf"),
        F.when(n % 5 != 0, share(n * 13 + c, 101)).alias("p_et"),
        (n % 4 == 1).cast("int").alias("pdf_has_javascript"),
        (n % 6 == 2).cast("int").alias("has_vba_project"),
        (n % 5 * (n % 2)).cast("int").alias("embedded_files_count"),
        (n % 7 == 3).cast("int").alias("pdf_openaction"),
        (n % 9 == 4).cast("int").alias("ooxml_has_external_rel"),
    )


_SIGNALS = """sig AS (
  SELECT doc_id AS file_id, n_chars AS size, (n_chars % 101) / 100.0::DOUBLE AS p_dl, ((doc_id * 7 + n_chars) % 101) / 100.0::DOUBLE AS p_lgbm,
    CASE WHEN doc_id % 3 <> 0 THEN ((doc_id * 11) % 101) / 100.0::DOUBLE END AS p_rf,
    CASE WHEN doc_id % 5 <> 0 THEN ((doc_id * 13 + n_chars) % 101) / 100.0::DOUBLE END AS p_et,
    doc_id % 4 = 1 AS js, doc_id % 6 = 2 AS vba, doc_id % 5 * (doc_id % 2) AS embedded, doc_id % 7 = 3 AS oa, doc_id % 9 = 4 AS rel
  FROM documents),
tree AS (
  SELECT *, CASE WHEN p_rf IS NULL AND p_et IS NULL THEN 0.5::DOUBLE WHEN p_rf IS NULL THEN p_et WHEN p_et IS NULL THEN p_rf
      ELSE (p_rf + p_et) / 2 END AS p_tree,
    least(1.0::DOUBLE, CASE WHEN js THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN vba THEN 0.4::DOUBLE ELSE 0 END
      + CASE WHEN embedded > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN oa THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN rel THEN 0.1::DOUBLE ELSE 0 END) AS p_rules
  FROM sig),
blended AS (
  SELECT *, (p_dl * 0.35::DOUBLE + p_lgbm * 0.35::DOUBLE + p_tree * 0.2::DOUBLE + p_rules * 0.1::DOUBLE)
    / (0.35::DOUBLE + 0.35::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE) AS risk FROM tree),
named AS (
  SELECT *, CASE WHEN risk >= 0.5 THEN 'malicious' ELSE 'benign' END AS verdict,
    CASE WHEN NOT js AND NOT vba AND embedded = 0 THEN 'No active threats (No dangerous constructs found)' ELSE
      concat_ws('; ', CASE WHEN js THEN 'JavaScript Code (PDF /JavaScript or /OpenAction detected)' END,
        CASE WHEN vba THEN 'Macro Function (vbaProject.bin present)' END,
        CASE WHEN embedded > 0 THEN 'Embedded Content (' || embedded || ' embedded file(s))' END) END AS threats
  FROM blended)"""


@query(
    "ensemble_blend",
    f"""WITH {_SIGNALS}
SELECT file_id, round(risk, 9) AS risk, round(p_tree, 9) AS p_tree, round(p_rules, 9) AS p_rules,
  round(0.35::DOUBLE * p_dl, 4) AS contrib_dl, round(0.35::DOUBLE * p_lgbm, 4) AS contrib_lgbm,
  round(0.2::DOUBLE * p_tree, 4) AS contrib_tree, round(0.1::DOUBLE * p_rules, 4) AS contrib_rules,
  CASE WHEN risk >= 0.9 THEN 'critical' WHEN risk >= 0.7 THEN 'high'
    WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM named""",
)
def ensemble_blend(spark: SparkSession, folder: str) -> DataFrame:
    e = ensemble.ensemble(signals(spark, folder))
    return e.select(
        "file_id", F.round("risk", 9).alias("risk"), F.round("p_tree", 9).alias("p_tree"), F.round("p_rules", 9).alias("p_rules"),
        "contrib_dl", "contrib_lgbm", "contrib_tree", "contrib_rules", ensemble.report_severity(F.col("risk")).alias("severity"),
    )


@query(
    "confidence",
    f"""WITH {_SIGNALS}, r AS (SELECT file_id, round(p_dl, 3) AS a, round(p_lgbm, 3) AS b, round(p_tree, 3) AS c, round(p_rules, 3) AS d FROM named),
s AS (SELECT file_id, greatest(a, b, c, d) - least(a, b, c, d) AS spread FROM r)
SELECT file_id, round(spread, 3) AS spread, CASE WHEN spread > 0.45 THEN 'low' WHEN spread > 0.25 THEN 'medium' ELSE 'high' END AS level,
  CASE WHEN spread > 0.45 THEN 'Models disagree strongly' WHEN spread > 0.25 THEN 'Some disagreements among models'
    ELSE 'Models broadly agree' END AS why  FROM s""",
)
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    e = ensemble.ensemble(signals(spark, folder))
    told = ensemble.confidence([F.col(f"s_{k}") for k in ("dl", "lgbm", "tree", "rules")])
    return e.select("file_id", *[v.alias(k) for k, v in told.items()])


@query(
    "narrative",
    f"""WITH {_SIGNALS}
SELECT file_id, format('The file was classified as **{{}}** with a risk score of {{:.2f}}. {{}} Key reasons: {{}}.', verdict, risk,
  format('Model signals: DL={{:.2f}}, LGBM={{:.2f}}, Tree={{:.2f}}, Rules={{:.2f}}.', p_dl, p_lgbm, round(p_tree, 3), round(p_rules, 3)), threats) AS explain
FROM named""",
)
def narrative(spark: SparkSession, folder: str) -> DataFrame:
    """Report paragraph of each file."""
    e = ensemble.ensemble(signals(spark, folder))
    scores = {k: F.col(f"s_{k}") for k in ("dl", "lgbm", "tree", "rules")}
    told = ensemble.narrative(F.col("verdict"), F.col("risk"), scores, ensemble.threats(set(e.columns)))
    return e.select("file_id", told.alias("explain"))


@query(
    "threat_list",
    f"WITH {_SIGNALS} SELECT file_id, threats, CASE WHEN js OR vba THEN 'high' WHEN embedded > 0 THEN 'medium' ELSE 'low' END AS worst FROM named",
)
def threat_list(spark: SparkSession, folder: str) -> DataFrame:
    s = signals(spark, folder)
    s = s.withColumn("t", ensemble.threats(set(s.columns)))
    shown = F.array_join(F.transform("t", lambda f: F.concat(f["threat_type"], F.lit(" ("), f["indicator"], F.lit(")"))), "; ")
    return s.select("file_id", shown.alias("threats"), F.element_at("t", 1)["severity"].alias("worst"))


@query(
    "top_features",
    """WITH v AS (SELECT doc_id AS file_id, unnest(['size', 'digits', 'spaces', 'lines', 'uppers', 'shift', 'score', 'zero']) AS name,
  unnest([n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^ ]', '', 'g')),
    length(regexp_replace(text, '[^\\n]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), -(doc_id % 300), doc_id % 17, 0]) AS value FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY abs(value) DESC, name) AS rank FROM v)
SELECT file_id, CAST(rank AS INTEGER) AS rank, name, CAST(value AS DOUBLE) AS value, CAST(value AS DOUBLE) AS est_contribution FROM r WHERE rank <= 6""",
)
def top_features(spark: SparkSession, folder: str) -> DataFrame:
    d = spread(table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id")

    def kept(pattern: str):
        return F.length(F.regexp_replace("text", pattern, ""))

    v = d.select(
        F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size"), kept("[^0-9]").alias("digits"), kept("[^ ]").alias("spaces"),
        kept("[^\n]").alias("lines"), kept("[^A-Z]").alias("uppers"), (-(F.col("doc_id") % 300)).alias("shift"),
        (F.col("doc_id") % 17).alias("score"), F.lit(0).alias("zero"),
    )
    return ensemble.top_features(v, ["size", "digits", "spaces", "lines", "uppers", "shift", "score", "zero"])


@query(
    "signed_contributions",
    f"""WITH {_SIGNALS}, v AS (SELECT file_id, unnest(['p_dl', 'p_lgbm', 'size', 'embedded_files_count']) AS name,
  unnest([p_dl * 2.0::DOUBLE, p_lgbm * -1.5::DOUBLE, size * 0.001::DOUBLE, embedded * -0.25::DOUBLE]) AS value FROM sig),
r AS (SELECT *, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS side FROM v WHERE value <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY file_id, side ORDER BY abs(value) DESC, name) AS rank FROM r)
SELECT file_id, side, CAST(rank AS INTEGER) AS rank, name, value FROM q WHERE rank <= 6""",
)
def signed_contributions(spark: SparkSession, folder: str) -> DataFrame:
    weights = {"p_dl": 2.0, "p_lgbm": -1.5, "size": 0.001, "embedded_files_count": -0.25}
    return ensemble.signed_contributions(signals(spark, folder), weights)


@query(
    "display_signals",
    f"""WITH {sql.CORPUS}, {sql.RULES}, v AS (SELECT file_id, risk_score AS rs, {_PROB} AS mp, points,
  greatest(risk_score, {_PROB}) AS risk, CASE WHEN points >= 60 THEN 'malicious' WHEN points >= 30 THEN 'suspicious'
  WHEN {_PROB} >= 0.75 THEN 'malicious' WHEN {_PROB} >= 0.5 THEN 'suspicious' ELSE 'benign' END AS verdict FROM decided),
w AS (SELECT *, CASE WHEN rs = 0 AND verdict = 'suspicious' THEN 0.45::DOUBLE WHEN rs = 0 AND verdict = 'malicious' THEN 0.75::DOUBLE ELSE rs END AS rules FROM v)
SELECT file_id, rules, mp AS lgbm, round(CASE WHEN mp > 0 THEN mp * 0.92::DOUBLE WHEN rules > 0 THEN rules * 0.8::DOUBLE ELSE 0 END, 9) AS tree,
  risk AS dl, risk AS composite FROM w""",
)
def display_signals(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.text_corpus(spark, folder).drop("text").withColumn("model_prob", (F.col("file_id") % 100) / F.lit(100.0))
    s = rules.scan(c, with_entropy=False)
    shown = ensemble.display_signals(F.col("verdict"), F.col("rule_score"), F.col("model_prob"), F.col("risk_score"))
    return s.select("file_id", *[v.alias(k) for k, v in shown.items()]).withColumn("tree", F.round("tree", 9))


@query(
    "effective_result",
    f"""WITH {sql.SCANS}, s AS (SELECT scan_id, risk_score, lower(raw_verdict) AS v, scan_id % 3 = 0 AS sanitized,
  CASE WHEN scan_id % 2 = 0 THEN risk_score / 2 END AS c FROM scans),
t AS (SELECT *, CASE WHEN sanitized THEN coalesce(c, risk_score) ELSE risk_score END AS shown_score FROM s)
SELECT scan_id, shown_score, CAST(floor(shown_score * 100 + 0.5) AS INTEGER) AS shown_percent,
  CASE WHEN shown_score >= 0.71 THEN 'CRITICAL' WHEN shown_score >= 0.5 THEN 'HIGH' WHEN shown_score >= 0.21 THEN 'MEDIUM' ELSE 'LOW' END AS shown_level,
  CASE WHEN sanitized OR v IS NULL THEN CASE WHEN shown_score >= 0.5 THEN 'malicious' ELSE 'benign' END ELSE v END AS shown_verdict FROM t""",
)
def effective_result(spark: SparkSession, folder: str) -> DataFrame:
    s = scans(spark, folder).withColumns(
        {
            "verdict": F.col("raw_verdict"),
            "sanitized": F.col("scan_id") % 3 == 0,
            "clean_risk_score": F.when(F.col("scan_id") % 2 == 0, F.col("risk_score") / 2),
            "clean_verdict": F.lit(None).cast("string"),
        }
    )
    return ensemble.effective_result(s).select("scan_id", "shown_score", "shown_percent", "shown_level", "shown_verdict")


@query(
    "verdict_normalised",
    f"WITH {sql.SCANS} SELECT verdict, count(*) AS scans, sum(k)::BIGINT AS k FROM ledger GROUP BY verdict",
)
def verdict_normalised(spark: SparkSession, folder: str) -> DataFrame:
    s = scans(spark, folder)
    verdict = ensemble.normalise_verdict(F.col("raw_verdict"), F.col("risk_score"))
    return s.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("scans"), F.sum("k").alias("k"))


_EXPLAIN = f"""CASE WHEN contains(low, 'vba') OR contains(low, 'macro') THEN {sql.lit(fixed.EXPLANATIONS['macro'])}
  WHEN contains(low, 'javascript') OR contains(low, '/openaction') OR contains(low, '/js') THEN {sql.lit(fixed.EXPLANATIONS['javascript'])}
  WHEN contains(low, 'embedded') AND (contains(low, 'object') OR contains(low, 'file')) THEN {sql.lit(fixed.EXPLANATIONS['embedded'])}
  WHEN contains(low, 'rtf') AND (contains(low, 'object') OR contains(low, 'field')) THEN {sql.lit(fixed.EXPLANATIONS['rtf'])} END"""


@query(
    "humanized",
    f"""WITH {sql.CORPUS}, {sql.RULES}, f AS (
  SELECT file_id, f1 AS title, 'medium' AS severity, 'Suspicious strings found: ' || array_to_string(hits[1:5], ', ') AS message FROM decided WHERE f1 IS NOT NULL
  UNION ALL SELECT file_id, f2, 'high', {sql.lit(fixed.RULE_MESSAGES['pdf_regex_match'])} FROM decided WHERE f2 IS NOT NULL
  UNION ALL SELECT file_id, f3, 'high', {sql.lit(fixed.RULE_MESSAGES['rtf_exploit'])} FROM decided WHERE f3 IS NOT NULL),
g AS (SELECT *, lower(title || ' ' || message) AS low FROM f)
SELECT file_id, title, message, severity, {_EXPLAIN} AS explain FROM g""",
)
def humanized(spark: SparkSession, folder: str) -> DataFrame:
    s = rules.findings(corpus.text_corpus(spark, folder).drop("text"))
    nice = ensemble.humanize(F.col("findings"), {"id", "severity", "message"})
    return s.select("file_id", F.explode(nice).alias("f")).select("file_id", "f.title", "f.message", "f.severity", "f.explain")


@query(
    "human_sizes",
    """WITH s AS (SELECT doc_id AS file_id, n_chars * (doc_id % 1000 + 1) * (doc_id % 1000 + 1) AS n FROM documents)
SELECT file_id, n AS size_bytes, CASE WHEN n < 1024 THEN format('{:.2f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f} KB', n / 1024.0::DOUBLE)
  WHEN n < 1073741824 THEN format('{:.2f} MB', n / 1048576.0::DOUBLE) ELSE format('{:.2f} GB', n / 1073741824.0::DOUBLE) END AS size_human FROM s""",
)
def human_sizes(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    k = F.col("doc_id") % 1000 + 1
    n = F.col("n_chars") * k * k
    return d.select(F.col("doc_id").alias("file_id"), n.alias("size_bytes"), text.human_size(n).alias("size_human"))


@query("report_json")
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """Nested report of each file as one JSON document, with the scan of the cleaned content inside."""
    from docwarden.plans.jobs import reports

    return reports(corpus.text_corpus(spark, folder).drop("text"))


@query("ensemble_report_json")
def ensemble_report_json(spark: SparkSession, folder: str) -> DataFrame:
    """The four-model report of each file as one JSON document."""
    from docwarden.plans.jobs import ensemble_reports

    files = corpus.text_corpus(spark, folder).withColumn("name", F.concat(F.col("file_id").cast("string"), F.col("ext")))
    return ensemble_reports(files, signals(spark, folder), ["size", "embedded_files_count", "pdf_openaction", "p_dl"])


# ---- scrubbing ---------------------------------------------------------------------------------------------

_TERMS = sql.lit(prefix_pattern(scrub_terms(".pdf")))


@query(
    "scrub_text",
    f"""WITH {sql.CORPUS}, s AS (SELECT file_id, text, regexp_replace(text, {_TERMS}, '', 'g') AS clean FROM corpus)
SELECT file_id, sha256(encode(clean)) AS clean_sha256, CAST(strlen(clean) AS INTEGER) AS clean_size, clean <> text AS changed FROM s""",
)
def scrub_text(spark: SparkSession, folder: str) -> DataFrame:
    """The whole vocabulary, over the whole texts, in one pass."""
    c = corpus.text_corpus(spark, folder)
    s = c.select("file_id", "text", sanitize.scrub(F.col("text"), scrub_terms(".pdf")).alias("clean"))
    return s.select(
        "file_id", F.sha2(F.encode("clean", "UTF-8"), 256).alias("clean_sha256"), F.octet_length("clean").alias("clean_size"),
        (F.col("clean") != F.col("text")).alias("changed"),
    )


@query(
    "scrub_terms",
    f"""WITH {sql.CORPUS}, h AS (SELECT file_id, lower(unnest(regexp_extract_all(text, {_TERMS}))) AS term FROM corpus)
SELECT term, count(*) AS hits, count(DISTINCT file_id) AS files FROM h GROUP BY term""",
)
def scrub_term_hits(spark: SparkSession, folder: str) -> DataFrame:
    return sanitize.scrub_hits(corpus.text_corpus(spark, folder), scrub_terms(".pdf"))


def _duck(pattern: str) -> str:
    """The same pattern without possessive quantifiers, which the other engine does not need or have."""
    return sql.lit(pattern.replace("++", "+").replace("*+", "*"))


_LIGHT = f"regexp_replace(regexp_replace(text, {_duck(fixed.RTF_LIGHT_BLOCK)}, '', 'g'), {_duck(fixed.RTF_LIGHT_WORDS)}, '', 'g')"


def _full_sql() -> str:
    ctes, previous = [], "corpus"
    for i, (_, pattern) in enumerate(fixed.RTF_FULL_STEPS):
        src = "text" if i == 0 else f"t{i - 1}"
        ctes.append(
            f"s{i} AS (SELECT *, regexp_matches({src}, {_duck(pattern)}) AS b{i}, regexp_replace({src}, {_duck(pattern)}, ' ', 'g') AS t{i} FROM {previous})"
        )
        previous = f"s{i}"
    last = len(fixed.RTF_FULL_STEPS) - 1
    labels = ", ".join(f"CASE WHEN b{i} THEN '{label}' END" for i, (label, _) in enumerate(fixed.RTF_FULL_STEPS))
    return f"""{', '.join(ctes)}
SELECT file_id, md5({_LIGHT}) AS light_md5, md5(regexp_replace(t{last}, {_duck(fixed.RTF_FULL_WORDS)}, '', 'g')) AS full_md5,
  array_to_string(list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)), ',') AS removed FROM s{last}"""


@query("rtf_strip", f"WITH {sql.CORPUS}, {_full_sql()}")
def rtf_strip(spark: SparkSession, folder: str) -> DataFrame:
    c = sanitize.rtf_full(corpus.text_corpus(spark, folder))
    return c.select(
        "file_id", F.md5(sanitize.rtf_light(F.col("text"))).alias("light_md5"), F.md5("clean").alias("full_md5"),
        F.array_join("removed", ",").alias("removed"),
    )


_PDF_STRIPPED = f"""{sql.PDF_CORPUS}, k AS (SELECT file_id, text, list_filter(regexp_extract_all(text, {_duck(sanitize._key_pattern(fixed.PDF_STRIP_KEYS))}, 2), lambda x: x <> '') AS keys,
  regexp_replace(text, {_duck(sanitize._key_pattern(fixed.PDF_STRIP_KEYS))}, '\\1', 'g') AS once FROM corpus),
a AS (SELECT *, regexp_extract_all(once, {_duck(sanitize._BAD_ACTION)}, 2) AS acts, regexp_replace(once, {_duck(sanitize._BAD_ACTION)}, '', 'g') AS clean FROM k)"""
_PDF_REMOVED = "list_distinct(list_concat(list_transform(keys, lambda x: '/' || x), list_transform(acts, lambda x: '/A/' || x)))"


@query(
    "pdf_strip",
    f"""WITH {_PDF_STRIPPED}
SELECT file_id, md5(clean) AS clean_md5, CAST(len(list_filter(keys, lambda x: contains(x, 'JS') OR contains(x, 'Script'))) AS INTEGER) AS js,
  CAST(len(list_filter(keys, lambda x: NOT (contains(x, 'JS') OR contains(x, 'Script')))) + len(acts) AS INTEGER) AS actions,
  array_to_string(list_sort({_PDF_REMOVED}), ',') AS removed FROM a""",
)
def pdf_strip(spark: SparkSession, folder: str) -> DataFrame:
    s = sanitize.pdf_strip(corpus.pdf_corpus(spark, folder))
    return s.select("file_id", F.md5("clean").alias("clean_md5"), "js", "actions", F.array_join("removed", ",").alias("removed"))


@query(
    "pdf_strip_catalog",
    f"""WITH {sql.PDF_CORPUS}
SELECT file_id, md5(regexp_replace(text, {_duck(sanitize._key_pattern(fixed.PDF_CATALOG_KEYS))}, '\\1', 'g')) AS clean_md5 FROM corpus""",
)
def pdf_strip_catalog(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.pdf_corpus(spark, folder)
    return c.select("file_id", F.md5(sanitize.pdf_strip_keys(F.col("text"), fixed.PDF_CATALOG_KEYS)).alias("clean_md5"))


@query(
    "removed_summary",
    f"""WITH {_PDF_STRIPPED}, l AS (SELECT file_id, unnest({_PDF_REMOVED}) AS label FROM a)
SELECT label, count(*) AS files FROM l GROUP BY label""",
)
def removed_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = sanitize.pdf_strip(corpus.pdf_corpus(spark, folder))
    labels = s.select(F.explode("removed").alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("files"))


_DROP_LIGHT = "(member LIKE '%vbaProject.bin' OR member LIKE '%vbaProjectSignature.bin' OR contains(lower(member), '/embeddings/'))"
_DROP_FULL = (
    "(lower(member) LIKE '%vbaproject.bin' OR "
    + " OR ".join(f"contains(lower(member), '{f}')" for f in fixed.OOXML_DROP_FOLDERS)
    + " OR "
    + " OR ".join(f"lower(member) LIKE '%{p}'" for p in fixed.OOXML_DROP_PROPS)
    + " OR contains(lower(member), '/comments') OR contains(lower(member), 'trackchanges'))"
)


@query(
    "ooxml_drop",
    f"""WITH {OOXML} SELECT file_id, pos, member, {_DROP_LIGHT} AS dropped_light, {_DROP_FULL} AS dropped_full FROM members""",
)
def ooxml_drop(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.ooxml_corpus(spark, folder)
    m = c.select("file_id", F.posexplode(archives.member_names(F.col("content"))).alias("at", "member"))
    name = F.col("member")
    return m.withColumn("pos", F.col("at") + 1).select("file_id", "pos", "member", sanitize.drops_light(name).alias("dropped_light"), sanitize.drops_full(name).alias("dropped_full"))


@query(
    "external_rels",
    f"""WITH {OOXML}, r AS (SELECT * FROM (VALUES ('http://i.example/p.png', 'External'), ('#a', ''), ('FILE:///c:/x', ''),
  ('externalLinks/externalLink1.xml', '')) AS t(target, mode))
SELECT file_id, member, target, mode FROM members, r WHERE member = '_rels/.rels'""",
)
def external_rels(spark: SparkSession, folder: str) -> DataFrame:
    return sanitize.external_relationships(archives.explode_members(corpus.ooxml_corpus(spark, folder)))


@query(
    "ooxml_rebuild",
    f"""WITH {OOXML}, n AS (
  SELECT file_id, pos, member, lower(member) AS ln, body FROM members WHERE NOT {_DROP_FULL}),
c AS (SELECT file_id, pos, member, CASE
  WHEN pos = 1 THEN '<Types><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/main+xml"/></Types>'
  WHEN pos = 2 THEN regexp_replace(body, '<Relationship Id="r[2345]"[^>]*/>', '', 'g')
  WHEN pos = 3 THEN replace(body, '<w:hyperlink r:id=''r3''/>', '') ELSE body END AS body FROM n)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) AS INTEGER) AS pos, member, md5(body) AS body_md5 FROM c""",
)
def ooxml_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """Archives are opened, filtered, rewritten, packed, and opened again."""
    clean = sanitize.ooxml_clean(corpus.ooxml_corpus(spark, folder), mode="full")
    m = archives.explode_members(clean.select("file_id", F.col("clean").alias("content")))
    return m.select("file_id", "pos", "member", F.md5("body").alias("body_md5"))


@query(
    "ooxml_removed",
    f"""WITH {OOXML}
SELECT file_id, CASE WHEN {_DROP_FULL} THEN 'drop:' || member WHEN pos = 2 THEN 'rels:' || member ELSE 'xml:' || member || ':1' END AS label
FROM members WHERE {_DROP_FULL} OR pos IN (2, 3)""",
)
def ooxml_removed(spark: SparkSession, folder: str) -> DataFrame:
    clean = sanitize.ooxml_clean(corpus.ooxml_corpus(spark, folder), mode="full")
    return clean.select("file_id", F.explode("removed").alias("label"))


_KEYS = _duck(sanitize._key_pattern(fixed.PDF_STRIP_KEYS))
_CLEANED = f"""cleaned AS (
  SELECT file_id, ext, text AS original, verdict AS verdict_before, risk_score AS risk_before,
    CASE WHEN verdict = 'malicious' AND ext = '.pdf' THEN regexp_replace(regexp_replace(text, {_KEYS}, '\\1', 'g'), {_duck(sanitize._BAD_ACTION)}, '', 'g')
      WHEN verdict = 'malicious' AND ext = '.rtf' THEN {_LIGHT} ELSE text END AS text FROM decided)"""


@query(
    "sanitize_policy",
    f"""WITH {sql.CORPUS}, {sql.RULES}, {_CLEANED}
SELECT file_id, verdict_before AS verdict, text <> original AS changed, sha256(encode(text)) AS clean_sha256,
  CASE WHEN verdict_before <> 'malicious' THEN 'none' WHEN ext = '.pdf' THEN 'pdf_strip' 
    WHEN ext = '.rtf' THEN 'rtf_convert' ELSE 'passthrough' END AS engine,
  verdict_before = 'malicious' AND ext IN ('.pdf', '.rtf') AS sanitized,
  CASE WHEN verdict_before = 'malicious' AND ext NOT IN ('.pdf', '.rtf') THEN 'Unsupported type or sanitizer failed; original retained' END AS notes
FROM cleaned""",
)
def sanitize_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Malicious files are cleaned, all others pass unchanged; a file that is no archive is kept as it is."""
    s = rules.scan(corpus.text_corpus(spark, folder).drop("text"), with_entropy=False)
    done = sanitize.sanitize(s.select("file_id", "ext", "content", "verdict"))
    return done.select("file_id", "verdict", "changed", F.sha2("clean", 256).alias("clean_sha256"), "engine", "sanitized", "notes")


@query(
    "rescan_delta",
    f"""WITH {sql.CORPUS}, {sql.RULES}, {_CLEANED}, again AS (
  WITH corpus AS (SELECT file_id, ext, text FROM cleaned), {sql.RULES} SELECT file_id, verdict, risk_score FROM decided)
SELECT file_id, verdict_before, verdict AS verdict_after, risk_before, risk_score AS risk_after, round(risk_score - risk_before, 9) AS delta_risk
FROM cleaned JOIN again USING (file_id)""",
)
def rescan_delta(spark: SparkSession, folder: str) -> DataFrame:
    # the SQL has the text rules: this corpus holds no archive that opens
    r = sanitize.rescan(corpus.text_corpus(spark, folder).drop("text"), archives_too=False, with_entropy=False)
    return r.select("file_id", "verdict_before", "verdict_after", "risk_before", "risk_after", F.round("delta_risk", 9).alias("delta_risk"))
