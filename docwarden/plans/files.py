"""Queries on files, features, rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.bytes import byte_entropy, chunk_entropy_p95
from docwarden.operators import features, rules
from docwarden.plans import sql
from docwarden.plans.registry import query
from docwarden.sources import archives, corpus, pdf_objects
from docwarden.sources.tables import table


@query(
    "flagship_verdicts",
    f"""WITH {sql.CORPUS}, {sql.RULES}
SELECT verdict, count(*) AS files, CAST(sum(points) AS BIGINT) AS points, round(avg(risk_score), 6) AS avg_risk
FROM decided GROUP BY verdict""",
)
def flagship_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    scanned = rules.scan(corpus.text_corpus(spark, folder).drop("text"), with_entropy=False)
    return scanned.groupBy("verdict").agg(
        F.count("*").alias("files"), F.sum("points").alias("points"), F.round(F.avg("risk_score"), 6).alias("avg_risk")
    )


@query(
    "file_hash",
    f"""WITH {sql.CORPUS}
SELECT file_id, sha256(encode(text)) AS sha256, CAST(strlen(text) AS INTEGER) AS size_bytes FROM corpus""",
)
def file_hash(spark: SparkSession, folder: str) -> DataFrame:
    return features.hashes(corpus.text_corpus(spark, folder))


@query(
    "entropy_doc",
    f"""WITH {sql.CORPUS}, {sql.BYTES}
SELECT file_id, round(abs(log2(sum(k)) - sum(k * log2(k)) / sum(k)), 6) AS entropy
FROM (SELECT file_id, byte, CAST(count(*) AS DOUBLE) AS k FROM bytes GROUP BY ALL) GROUP BY file_id""",
)
def entropy_doc(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.text_corpus(spark, folder)
    return c.select("file_id", F.round(byte_entropy(F.col("content")), 6).alias("entropy"))


@query(
    "entropy_normalised",
    f"""WITH {sql.CORPUS}, {sql.BYTES}
SELECT file_id, round(least(1.0::DOUBLE, abs(log2(sum(k)) - sum(k * log2(k)) / sum(k)) / 8), 6) AS entropy
FROM (SELECT file_id, byte, CAST(count(*) AS DOUBLE) AS k FROM bytes GROUP BY ALL) GROUP BY file_id""",
)
def entropy_normalised(spark: SparkSession, folder: str) -> DataFrame:
    e = features.normalised_entropy(corpus.text_corpus(spark, folder))
    return e.select("file_id", F.round("entropy", 6).alias("entropy"))


@query(
    "entropy_chunk_p95",
    f"""WITH {sql.CORPUS}, {sql.BYTES}, {sql.chunk_p95('e')}
SELECT file_id, round(p95, 6) AS entropy_p95 FROM e""",
)
def entropy_chunk_p95(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.text_corpus(spark, folder)
    return c.select("file_id", F.round(chunk_entropy_p95(F.col("content")), 6).alias("entropy_p95"))


@query(
    "byte_histogram",
    f"""WITH {sql.CORPUS}, {sql.BYTES}
SELECT CAST(('0x' || byte) AS INTEGER) AS byte, count(*) AS occurrences FROM bytes GROUP BY byte""",
)
def byte_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """256-bin histogram of the corpus: bytes are counted inside each row before anything is exchanged."""
    return features.byte_histogram(corpus.text_corpus(spark, folder))


@query("url_count", f"SELECT page_id AS file_id, {sql.urls('html')} AS url_count, {sql.urls('url')} AS in_name FROM pages")
def url_count(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages")
    return p.select(
        F.col("page_id").alias("file_id"), text.url_count(F.col("html")).alias("url_count"), text.url_count(F.col("url")).alias("in_name")
    )


@query(
    "token_total",
    f"WITH {sql.CORPUS} SELECT file_id, {sql.total_of('text', fixed.OFFICE_TOKENS)} AS suspicious_token_count FROM corpus",
)
def token_total(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.text_corpus(spark, folder)
    return c.select("file_id", text.token_total(F.col("text"), fixed.OFFICE_TOKENS).alias("suspicious_token_count"))


_FLAGS = ", ".join(f"CAST(ext = '{e}' AS INTEGER) AS ext_is_{e[1:]}" for e in fixed.SUPPORTED_EXTS)


@query(
    "feat_general",
    f"""WITH {sql.CORPUS}, {sql.BYTES}, {sql.chunk_p95('e')}
SELECT file_id, CAST(strlen(text) AS INTEGER) AS file_size, round(p95, 6) AS entropy_p95,
  {sql.total_of('text', fixed.OFFICE_TOKENS)} AS suspicious_token_count, {sql.urls('text')} AS url_count_general, {_FLAGS}
FROM corpus JOIN e USING (file_id)""",
)
def feat_general(spark: SparkSession, folder: str) -> DataFrame:
    g = features.general(corpus.text_corpus(spark, folder))
    return g.withColumn("entropy_p95", F.round("entropy_p95", 6))


_PDF = f"""CAST({sql.any_of('text', fixed.PDF_JS_TOKENS)} AS INTEGER) AS pdf_has_js,
  CAST({sql.any_of('text', fixed.PDF_OPEN_TOKENS)} AS INTEGER) AS pdf_has_openaction,
  CAST(contains(text, '/Launch') AS INTEGER) AS pdf_has_launch,
  {sql.total_of('text', fixed.PDF_URI_TOKENS)} AS pdf_uri_count,
  {sql.total_of('text', fixed.PDF_EMBED_TOKENS)} AS pdf_embedded_file_count,
  {sql.count_of('text', ' obj')} AS pdf_object_count, {sql.count_of('text', 'stream')} AS pdf_stream_count,
  {sql.count_of('text', 'xref')} AS pdf_xref_count, round(p95, 6) AS pdf_entropy_p95"""


@query(
    "feat_pdf",
    f"""WITH {sql.CORPUS}, {sql.BYTES}, {sql.chunk_p95('e')}
SELECT file_id, {_PDF} FROM corpus JOIN e USING (file_id) WHERE starts_with(text, '%PDF')
UNION ALL SELECT file_id, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM corpus WHERE NOT starts_with(text, '%PDF')""",
)
def feat_pdf(spark: SparkSession, folder: str) -> DataFrame:
    f = features.pdf(corpus.text_corpus(spark, folder))
    return f.withColumn("pdf_entropy_p95", F.round("pdf_entropy_p95", 6))


IS_RTF = r"regexp_matches(text, '^[ \t\n\r\x0b\f]*\{\\rtf')"
_RTF = f"""{sql.count_of('text', chr(92) + 'objdata')} AS rtf_objdata_count, {sql.count_of('text', chr(92) + 'object')} AS rtf_object_count,
  {sql.count_of('text', chr(92) + 'field')} AS rtf_field_count, {sql.count_of('text', chr(92) + 'pict')} AS rtf_pict_count,
  {sql.count_of('text', chr(92) + 'link')} AS rtf_link_count, {sql.urls('text')} AS rtf_url_count,
  CAST(contains(lower(text), 'javascript') AS INTEGER) AS rtf_js_like,
  CAST(contains(lower(text), 'shell') OR contains(lower(text), 'cmd.exe') AS INTEGER) AS rtf_shell_like,
  round(p95, 6) AS rtf_entropy_p95,
  CAST(contains(text, '\\objdata') AND (contains(text, 'Package') OR contains(upper(text), 'D0CF')) AS INTEGER)
    AS rtf_has_ole_packager_hint"""


@query(
    "feat_rtf",
    f"""WITH {sql.CORPUS}, {sql.BYTES}, {sql.chunk_p95('e')}
SELECT file_id, {_RTF} FROM corpus JOIN e USING (file_id) WHERE {IS_RTF}
UNION ALL SELECT file_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM corpus WHERE NOT {IS_RTF}""",
)
def feat_rtf(spark: SparkSession, folder: str) -> DataFrame:
    f = features.rtf(corpus.text_corpus(spark, folder))
    return f.withColumn("rtf_entropy_p95", F.round("rtf_entropy_p95", 6))


@query(
    "feat_xls",
    """WITH o AS (SELECT doc_id AS file_id, doc_id % 2 = 0 AS ole, text || CASE WHEN doc_id % 3 = 0
  THEN ' VBA Attribute VB_Name VBA' ELSE '' END AS text FROM documents)
SELECT file_id, CAST(ole AS INTEGER) AS xls_is_ole, CAST(ole AND contains(text, 'VBA') AS INTEGER) AS xls_has_vba_hint,
  CASE WHEN ole THEN """
    + sql.total_of("text", ("VBA", "Attribute VB_Name"))
    + " ELSE 0 END AS xls_vba_token_count FROM o",
)
def feat_xls(spark: SparkSession, folder: str) -> DataFrame:
    return features.xls(corpus.ole_corpus(spark, folder))


@query(
    "feat_dispatch",
    f"""WITH {sql.CORPUS}, {sql.BYTES}, {sql.chunk_p95('e')}, x AS (SELECT * FROM corpus JOIN e USING (file_id)),
p AS (SELECT file_id, {_PDF} FROM x WHERE ext = '.pdf' AND starts_with(text, '%PDF')),
r AS (SELECT file_id, {_RTF} FROM x WHERE ext = '.rtf' AND {IS_RTF})
SELECT x.file_id, x.ext, round(p95, 6) AS entropy_p95, {sql.total_of('text', fixed.OFFICE_TOKENS)} AS suspicious_token_count,
  CASE WHEN ext = '.pdf' THEN coalesce(pdf_object_count, 0) ELSE -1 END AS pdf_object_count,
  CASE WHEN ext = '.pdf' THEN coalesce(pdf_has_openaction, 0) ELSE -1 END AS pdf_has_openaction,
  CASE WHEN ext = '.pdf' THEN coalesce(pdf_entropy_p95, 0) ELSE -1 END AS pdf_entropy_p95,
  CASE WHEN ext = '.rtf' THEN coalesce(rtf_object_count, 0) ELSE -1 END AS rtf_object_count,
  CASE WHEN ext = '.rtf' THEN coalesce(rtf_js_like, 0) ELSE -1 END AS rtf_js_like,
  CASE WHEN ext = '.xls' THEN 0 ELSE -1 END AS xls_is_ole,
  CAST(CASE WHEN ext IN ('.docx', '.xlsx', '.pptx') THEN 0 ELSE -1 END AS BIGINT) AS zip_member_count
FROM x LEFT JOIN p USING (file_id) LEFT JOIN r USING (file_id)""",
)
def feat_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Feature table of the mixed corpus, groups that do not apply filled with -1."""
    shown = (
        "pdf_object_count", "pdf_has_openaction", "pdf_entropy_p95", "rtf_object_count", "rtf_js_like", "xls_is_ole",
        "zip_member_count",
    )
    d = features.dispatch(corpus.text_corpus(spark, folder)).na.fill(-1)
    return d.select("file_id", "ext", "entropy_p95", "suspicious_token_count", *shown).withColumns(
        {c: F.round(c, 6) for c in ("entropy_p95", "pdf_entropy_p95")}
    )


@query(
    "runtime_meta",
    f"""WITH {sql.CORPUS}, {sql.BYTES}, e AS (
  SELECT file_id, round(least(1.0::DOUBLE, abs(log2(sum(k)) - sum(k * log2(k)) / sum(k)) / 8), 6) AS entropy
  FROM (SELECT file_id, byte, CAST(count(*) AS DOUBLE) AS k FROM bytes GROUP BY ALL) GROUP BY file_id),
t AS (SELECT *, ext = '.pdf' OR (strlen(text) > 100 AND contains(text[:100], '%PDF')) AS is_pdf FROM corpus),
u AS (SELECT *, NOT is_pdf AND ext NOT IN ('.docx', '.xlsx', '.pptx')
  AND (ext = '.rtf' OR (strlen(text) > 6 AND starts_with(text, '{{\\rtf1'))) AS is_rtf FROM t)
SELECT file_id, CAST(strlen(text) AS DOUBLE) AS size_bytes, entropy,
  CAST(is_pdf AND {sql.any_of('text', fixed.PDF_MARKER_TOKENS)} AS DOUBLE) AS pdf_has_javascript,
  CAST(CASE WHEN is_pdf THEN {sql.total_of('text', fixed.PDF_PAGE_TOKENS)} ELSE 0 END AS DOUBLE) AS page_count,
  CAST(is_rtf AND (contains(text, '\\objdata') OR contains(text, '\\object')) AS DOUBLE) AS has_embedded_objects,
  0.0::DOUBLE AS has_vba_project, 0.0::DOUBLE AS embedded_ole_count
FROM u JOIN e USING (file_id)""",
)
def runtime_meta(spark: SparkSession, folder: str) -> DataFrame:
    m = features.runtime_meta(corpus.text_corpus(spark, folder))
    return m.withColumn("entropy", F.round("entropy", 6))


_CUTS = ", ".join(
    f"{{'kw': {sql.lit(k)}, 'pos': strpos(lower(text), {sql.lit(k)})}}" for k in fixed.SNIPPET_KEYWORDS
)


@query(
    "snippets",
    f"""WITH {sql.CORPUS}, hits AS (SELECT file_id, text, unnest([{_CUTS}], recursive := true) FROM corpus)
SELECT file_id, kw AS keyword, trim(replace(substring(text, greatest(pos - 40, 1),
  pos + length(kw) + 79 - greatest(pos - 40, 1) + 1), chr(10), ' '), E' \\t\\n\\r\\x0b\\x0c') AS snippet
FROM hits WHERE pos > 0""",
)
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return features.snippets(corpus.text_corpus(spark, folder))


_WS = sql.lit("[" + fixed.WHITESPACE_CLASS + "]+")


@query(
    "rtf_text",
    f"""WITH {sql.CORPUS}
SELECT file_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\{{\\\\[^}}]+\\}}', ' ', 'g'),
  '\\\\[a-zA-Z]+-?\\d*', ' ', 'g'), {_WS}, ' ', 'g')) AS plain FROM corpus""",
)
def rtf_text(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.text_corpus(spark, folder)
    return c.select("file_id", features.rtf_plain_text(F.col("text")).alias("plain"))


def _ooxml_cte() -> str:
    """Members of the derived archives, as the writer was told to make them."""
    root = sql.pick(corpus.OOXML_ROOTS, "doc_id")
    n = len(corpus.OOXML_PLANTS)
    parts = [
        f"SELECT doc_id AS file_id, 1 AS pos, '[Content_Types].xml' AS member, {sql.lit(corpus.CONTENT_TYPES)} AS body FROM documents",
        f"SELECT doc_id, 2, '_rels/.rels', {sql.lit(corpus.RELS)} FROM documents",
        f"""SELECT doc_id, 3, {root} || {sql.pick(corpus.OOXML_MAIN, 'doc_id')}, '<w:document><w:p><w:t>' ||
          replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</w:t></w:p><w:hyperlink r:id=''r3''/></w:document>' FROM documents""",
    ]
    for i, extra in enumerate(corpus.OOXML_PLANTS):
        for j, (name, before, after) in enumerate(extra):
            parts.append(
                f"SELECT doc_id, {4 + j}, {root} || {sql.lit(name)}, {sql.lit(before)} || text || {sql.lit(after)} "
                f"FROM documents WHERE doc_id % {n} = {i}"
            )
    return "members AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE file_id % 50 <> 49)"


OOXML = _ooxml_cte()
_XML = "regexp_matches(lower(member), '\\.(xml|rels|vml)$')"


@query(
    "feat_ooxml",
    f"""WITH {OOXML}, m AS (
  SELECT file_id, pos, member, body, lower(member) AS ln, {_XML} AS xml FROM members),
c AS (
  SELECT file_id, count(*) AS zip_member_count,
    CAST(sum(CASE WHEN xml THEN {sql.count_of('body', 'CreateObject')} ELSE 0 END) AS BIGINT) AS "token_CreateObject",
    CAST(sum(CASE WHEN xml THEN {sql.count_of('body', 'Shell')} ELSE 0 END) AS BIGINT) AS "token_Shell",
    CAST(sum(CASE WHEN xml THEN {sql.count_of('body', 'WScript')} ELSE 0 END) AS BIGINT) AS "token_WScript",
    CAST(sum(CASE WHEN xml THEN {sql.urls('body')} ELSE 0 END) AS BIGINT) AS url_count,
    CAST(max(CASE WHEN contains(ln, 'activex') OR contains(ln, 'control') OR (xml AND (contains(lower(body), 'classid')
      OR contains(lower(body), 'activex'))) THEN 1 ELSE 0 END) AS INTEGER) AS has_activex,
    count(*) FILTER (regexp_matches(ln, '^(word|xl|ppt)/embeddings/')) AS ole_object_count,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (ln LIKE '%vbaproject%'), '') AS code
  FROM m GROUP BY file_id),
corpus AS (SELECT file_id, code AS text FROM c), {sql.BYTES}, {sql.chunk_p95('e', 2048)}
SELECT d.doc_id AS file_id, coalesce(CASE WHEN code <> '' THEN {sql.count_of('code', 'Attribute VB_Name')} END, 0) AS vba_module_count,
  coalesce(has_activex, 0) AS has_activex, coalesce(ole_object_count, 0) AS ole_object_count,
  CAST(coalesce(strlen(code), 0) AS INTEGER) AS macro_size, round(coalesce(p95, 0), 6) AS macro_entropy_p95,
  coalesce("token_CreateObject", 0) AS "token_CreateObject", coalesce("token_Shell", 0) AS "token_Shell",
  coalesce("token_WScript", 0) AS "token_WScript", coalesce(url_count, 0) AS url_count,
  coalesce(zip_member_count, 0) AS zip_member_count
FROM documents d LEFT JOIN c ON c.file_id = d.doc_id LEFT JOIN e ON e.file_id = d.doc_id""",
)
def feat_ooxml(spark: SparkSession, folder: str) -> DataFrame:
    """Real archives are built from the texts, some are cut, and all are opened again."""
    f = features.ooxml(corpus.ooxml_corpus(spark, folder))
    return f.withColumn("macro_entropy_p95", F.round("macro_entropy_p95", 6))


@query(
    "archive_members",
    f"""WITH {OOXML} SELECT file_id, pos, member, sha256(encode(body)) AS body_sha256 FROM members""",
)
def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    m = archives.explode_members(corpus.ooxml_corpus(spark, folder))
    return m.select("file_id", "pos", "member", F.sha2("body", 256).alias("body_sha256"))


@query(
    "office_text",
    f"""WITH {OOXML} SELECT doc_id AS file_id, CASE WHEN trim(text) = '' THEN '' ELSE text END AS text
FROM documents WHERE doc_id % 50 <> 49""",
)
def office_text(spark: SparkSession, folder: str) -> DataFrame:
    return features.office_text(archives.explode_members(corpus.ooxml_corpus(spark, folder)))


@query(
    "sniffed_types",
    f"""WITH {sql.CORPUS}
SELECT file_id, CASE WHEN starts_with(text, '%PDF') THEN '.pdf' WHEN {IS_RTF} THEN '.rtf' END AS sniffed_ext FROM corpus
UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 50 <> 49 THEN {sql.pick(corpus.OOXML_EXTS, 'doc_id')} END FROM documents
UNION ALL SELECT -1000000000 - doc_id, CASE WHEN doc_id % 2 = 0 THEN '.xls' WHEN starts_with(text, '%PDF') THEN '.pdf' WHEN {IS_RTF} THEN '.rtf' END
FROM documents""",
)
def sniffed_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types of the text, archive and spreadsheet corpora from their bytes alone."""
    texts = corpus.text_corpus(spark, folder).select("file_id", "content")
    packed = corpus.ooxml_corpus(spark, folder).select((-1 - F.col("file_id")).alias("file_id"), "content")
    ole = corpus.ole_corpus(spark, folder).select((-1000000000 - F.col("file_id")).alias("file_id"), "content")
    return features.sniff_ext(texts.unionByName(packed).unionByName(ole))


_OBJ = r"(?s)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj"


@query(
    "pdf_objects",
    f"""WITH {sql.PDF_CORPUS}
SELECT file_id, CAST(generate_subscripts(no, 1) AS INTEGER) AS seq, CAST(unnest(no) AS BIGINT) AS obj_no,
  md5(unnest(body)) AS body_md5
FROM (SELECT file_id, regexp_extract_all(text, '{_OBJ}', 1) AS no, regexp_extract_all(text, '{_OBJ}', 3) AS body FROM corpus)""",
)
def pdf_object_rows(spark: SparkSession, folder: str) -> DataFrame:
    o = pdf_objects.object_rows(corpus.pdf_corpus(spark, folder))
    return o.select("file_id", "seq", "obj_no", F.md5("body").alias("body_md5"))


@query(
    "pdf_references",
    f"""WITH {sql.PDF_CORPUS}, o AS (
  SELECT file_id, CAST(unnest(no) AS BIGINT) AS obj_no, unnest(body) AS body
  FROM (SELECT file_id, regexp_extract_all(text, '{_OBJ}', 1) AS no, regexp_extract_all(text, '{_OBJ}', 3) AS body FROM corpus)),
r AS (SELECT file_id, obj_no, CAST(unnest(regexp_extract_all(body, '(\\d+)\\s+\\d+\\s+R\\b', 1)) AS BIGINT) AS target FROM o)
SELECT r.file_id, r.obj_no, r.target, t.obj_no IS NOT NULL AS resolved, CAST(count(*) AS BIGINT) AS uses
FROM r LEFT JOIN o t ON t.file_id = r.file_id AND t.obj_no = r.target GROUP BY ALL""",
)
def pdf_references(spark: SparkSession, folder: str) -> DataFrame:
    """Indirect references of each object, and whether the file holds the target."""
    objects = pdf_objects.object_rows(corpus.pdf_corpus(spark, folder))
    return pdf_objects.references(objects)


# by plant: action points and ids in the order of the rules
_PDF_FACTS = """facts AS (SELECT * FROM (VALUES
  (0, 0, ''), (1, 110, 'pdf_js_auto,pdf_deep_js'), (2, 80, 'pdf_exploit_action'), (3, 110, 'pdf_names_js,pdf_deep_js'),
  (4, 40, 'pdf_aa_action'), (5, 80, 'pdf_exploit_action'), (6, 60, 'pdf_deep_js'), (7, 110, 'pdf_names_js,pdf_deep_js'))
  AS t(plant, pts, ids))"""


@query(
    "pdf_action_rules",
    f"""WITH {sql.PDF_CORPUS}, {_PDF_FACTS}, h AS (
  SELECT file_id, pts + CASE WHEN len({sql.SUSPICIOUS}) > 0 THEN 15 ELSE 0 END AS points, plant IN (2, 5) AS critical,
    concat_ws(',', CASE WHEN len({sql.SUSPICIOUS}) > 0 THEN 'suspicious_strings' END, nullif(ids, '')) AS finding_ids
  FROM corpus JOIN facts USING (plant))
SELECT file_id, CAST(points AS INTEGER) AS points, finding_ids,
  CASE WHEN critical OR points >= 60 THEN 'malicious' WHEN points >= 30 THEN 'suspicious' ELSE 'benign' END AS verdict,
  CASE WHEN critical THEN 1.0::DOUBLE ELSE least(points / 100.0::DOUBLE, 1.0::DOUBLE) END AS risk_score
FROM h""",
)
def pdf_action_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Structure rules on well-formed PDFs; the expected findings follow from what was planted."""
    s = rules.scan(corpus.pdf_corpus(spark, folder).drop("text"), with_entropy=False)
    ids = F.array_join(F.transform("findings", lambda f: f["id"]), ",")
    return s.select("file_id", "points", ids.alias("finding_ids"), "verdict", "risk_score")


@query(
    "office_rules",
    f"""SELECT doc_id AS file_id,
  concat_ws(',', CASE WHEN ok AND doc_id % 7 IN (1, 6) THEN 'office_macro' END, CASE WHEN ok AND doc_id % 7 = 2 THEN 'office_ole' END) AS finding_ids,
  CASE WHEN ok AND doc_id % 7 IN (1, 6) THEN 'malicious' ELSE 'benign' END AS verdict
FROM (SELECT doc_id, doc_id % 50 <> 49 AS ok FROM documents)""",
)
def office_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Macro and embedded-object rules on real archives; the bytes themselves may hit a string rule by chance."""
    s = rules.scan(corpus.ooxml_corpus(spark, folder), with_archives=True, with_entropy=False)
    ids = F.transform(F.filter("findings", lambda f: F.startswith(f["id"], F.lit("office_"))), lambda f: f["id"])
    return s.select("file_id", F.array_join(ids, ",").alias("finding_ids"), "verdict")


@query(
    "rule_points",
    f"""WITH {sql.CORPUS}, {sql.RULES}
SELECT finding, count(*) AS files, CAST(sum(pts) AS BIGINT) AS points FROM (
  SELECT unnest([f1, f2, f3]) AS finding, unnest([15, 65, 70]) AS pts FROM decided) WHERE finding IS NOT NULL GROUP BY finding""",
)
def rule_points(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.findings(corpus.text_corpus(spark, folder).drop("text"))
    rows = found.select(F.explode("findings").alias("f")).select(F.col("f.id").alias("finding"))
    points = rules.points_of(F.array(F.struct(F.col("finding").alias("id"))))
    return rows.withColumn("p", points).groupBy("finding").agg(F.count("*").alias("files"), F.sum("p").alias("points"))


@query(
    "scan_findings",
    f"""WITH {sql.CORPUS}, {sql.RULES}
SELECT file_id, verdict, risk_score, points, coalesce(nullif(array_to_string(hits[1:5], ', '), ''), '') AS first_hits,
  concat_ws(' | ', CASE WHEN verdict = 'malicious' THEN '{fixed.RECOMMENDATIONS[0]} | {fixed.RECOMMENDATIONS[1]}' END)
  AS advice FROM decided""",
)
def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    s = rules.scan(corpus.text_corpus(spark, folder).drop("text"), with_entropy=False)
    strings = F.transform(F.filter("findings", lambda f: f["id"] == "suspicious_strings"), lambda f: f["message"])
    text_of = F.coalesce(F.try_element_at(strings, F.lit(1)), F.lit(""))
    return s.select(
        "file_id", "verdict", "risk_score", "points",
        F.replace(text_of, F.lit(fixed.RULE_MESSAGES["suspicious_strings"]), F.lit("")).alias("first_hits"),
        F.array_join("recommendations", " | ").alias("advice"),
    )


def _hits_sql(rows: str) -> str:
    return f"""WITH corpus AS ({rows}), h AS (SELECT file_id, {sql.SUSPICIOUS} AS hits FROM corpus)
SELECT file_id, CASE WHEN len(hits) > 0 THEN 15 ELSE 0 END AS points, array_to_string(hits, ', ') AS hits, 'benign' AS verdict FROM h"""


def _string_scan(files: DataFrame) -> DataFrame:
    s = rules.scan(files, with_entropy=False)
    hits = rules.suspicious_hits(F.lower(text.latin1(F.col("content"))))
    return s.select("file_id", "points", F.array_join(hits, ", ").alias("hits"), "verdict")


@query("pages_scan", _hits_sql("SELECT page_id AS file_id, html AS text FROM pages"))
def pages_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as files named by their address."""
    p = table(spark, folder, "pages")
    return _string_scan(
        p.select(F.col("page_id").alias("file_id"), text.split_ext(F.col("url")).alias("ext"), F.encode("html", "UTF-8").alias("content"))
    )


@query(
    "conversations_scan",
    _hits_sql("SELECT conv_id * 100000 + turn AS file_id, text || CASE WHEN turn % 5 = 2 THEN ' PowerShell eval(x)' ELSE '' END AS text FROM conversations"),
)
def conversations_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations as text files, every fifth with planted words."""
    c = table(spark, folder, "conversations")
    body = F.concat("text", F.when(F.col("turn") % 5 == 2, " PowerShell eval(x)").otherwise(""))
    return _string_scan(
        c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("file_id"), F.lit(".txt").alias("ext"), F.encode(body, "UTF-8").alias("content"))
    )
