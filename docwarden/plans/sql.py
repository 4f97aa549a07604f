"""Pieces of checking SQL: literals from the shared tuples, and the derived corpora as common table expressions."""

from __future__ import annotations

from collections.abc import Iterable

from docwarden.functions import fixed
from docwarden.sources import corpus


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lits(values: Iterable[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values: list[str] | tuple[str, ...], number: str) -> str:
    return f"{lits(values)}[1 + {number} % {len(values)}]"


def count_of(text: str, token: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {lit(token)}, ''))) / {len(token)} AS INTEGER)"


def total_of(text: str, tokens: Iterable[str]) -> str:
    return "(" + " + ".join(count_of(text, t) for t in tokens) + ")"


def any_of(text: str, tokens: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" for t in tokens) + ")"


def urls(text: str) -> str:
    return f"CAST(length(regexp_extract_all({text}, {lit(fixed.URL_PATTERN)})) AS INTEGER)"


CORPUS = f"""corpus AS (
  SELECT doc_id AS file_id, {pick(fixed.SUPPORTED_EXTS, 'doc_id')} AS ext,
         {pick([a for a, _ in corpus.PLANTS], 'doc_id')} || text || {pick([b for _, b in corpus.PLANTS], 'doc_id')} AS text
  FROM documents)"""

# bytes as hex pairs, one row each: (file_id, off, byte)
BYTES = """bytes AS (
  SELECT file_id, unnest(pairs) AS byte, generate_subscripts(pairs, 1) - 1 AS off
  FROM (SELECT file_id, regexp_extract_all(hex(encode(text)), '..') AS pairs FROM corpus))"""


def chunk_p95(name: str, chunk: int = 4096, source: str = "bytes") -> str:
    """CTE (file_id, p95) of chunk entropies."""
    return f"""{name} AS (
  SELECT file_id, quantile_cont(h, 0.95) AS p95 FROM (
    SELECT file_id, part, abs(log2(sum(k)) - sum(k * log2(k)) / sum(k)) AS h FROM (
      SELECT file_id, off // {chunk} AS part, byte, CAST(count(*) AS DOUBLE) AS k FROM {source} GROUP BY ALL)
    GROUP BY ALL)
  GROUP BY ALL)"""


PDF_CORPUS = f"""corpus AS (
  SELECT doc_id AS file_id, '.pdf' AS ext, doc_id % {len(corpus.PDF_PLANTS)} AS plant,
    '%PDF-1.4' || chr(10) || '1 0 obj' || chr(10) || '<< /Type /Catalog /Pages 2 0 R ' ||
    {pick([a for a, _ in corpus.PDF_PLANTS], 'doc_id')} || ' >>' || chr(10) || 'endobj' || chr(10) ||
    '2 0 obj' || chr(10) || '<< /Type /Pages /Kids [3 0 R] /Count 1 >>' || chr(10) || 'endobj' || chr(10) ||
    '3 0 obj' || chr(10) || '<< /Length ' || strlen(text) || ' >>' || chr(10) || 'stream' || chr(10) || text ||
    chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10) ||
    {pick([b for _, b in corpus.PDF_PLANTS], 'doc_id')} ||
    'trailer' || chr(10) || '<< /Root 1 0 R >>' || chr(10) || '%%EOF' || chr(10) AS text
  FROM documents)"""

SUSPICIOUS = f"list_sort(list_filter({lits(fixed.SUSPICIOUS_STRINGS)}, lambda w: contains(lower(text), w)))"

# the rules on the text corpus: no archive opens, no PDF has a catalog
RULES = f"""rules AS (
  SELECT file_id, ext, text, {SUSPICIOUS} AS hits,
    ext = '.pdf' AND {any_of('text', fixed.PDF_FALLBACK_PATTERNS)} AS pdf_hit,
    ext = '.rtf' AND regexp_matches(text, {lit('(?i)' + '|'.join(fixed.RTF_CONTROL_PATTERNS))}) AS rtf_hit
  FROM corpus),
scored AS (
  SELECT *, CASE WHEN len(hits) > 0 THEN 15 ELSE 0 END + CASE WHEN pdf_hit THEN 65 ELSE 0 END
    + CASE WHEN rtf_hit THEN 70 ELSE 0 END AS points,
    CASE WHEN len(hits) > 0 THEN 'suspicious_strings' END AS f1,
    CASE WHEN pdf_hit THEN 'pdf_regex_match' END AS f2,
    CASE WHEN rtf_hit THEN 'rtf_exploit' END AS f3
  FROM rules),
decided AS (
  SELECT *, least(points / 100.0::DOUBLE, 1.0::DOUBLE) AS risk_score,
    CASE WHEN points >= 60 THEN 'malicious' WHEN points >= 30 THEN 'suspicious' ELSE 'benign' END AS verdict
  FROM scored)"""

SCANS = """scans AS (
  SELECT event_id AS scan_id, user_id, ts + to_months(CAST(event_id % 3 AS INTEGER)) AS created_at,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'benign' WHEN 'click' THEN 'Benign'
      WHEN 'purchase' THEN 'malicious' END AS raw_verdict,
    least(greatest(value, 0) / 200.0::DOUBLE, 1.0::DOUBLE) AS risk_score, event_type,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
ledger AS (
  SELECT *, upper(coalesce(raw_verdict, CASE WHEN risk_score >= 0.5 THEN 'malicious' ELSE 'benign' END)) AS verdict
  FROM scans)"""

USERS = """users AS (
  SELECT c_custkey AS user_id,
    CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment || '-' || c_custkey % 700 || '@mail.example')
      ELSE ' ' || c_mktsegment || '-' || c_custkey % 700 || '@mail.example' END AS email,
    CASE c_custkey % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'PRO' ELSE 'ENTERPRISE' END AS plan,
    CASE WHEN c_custkey % 5 <> 0 THEN 'cus_' || c_custkey END AS billing_id, c_acctbal
  FROM customer),
limits AS (SELECT * FROM (VALUES ('FREE', 3, 100, 100), ('PRO', 100, 5000, 10000), ('ENTERPRISE', -1, -1, -1))
  AS t(plan, scans, api_calls, storage_mb))"""

SUBSCRIPTIONS = """subs AS (
  SELECT 'sub_' || user_id AS subscription_id, user_id,
    CASE WHEN user_id % 11 = 0 THEN 'PRO' ELSE plan END AS plan,
    CASE user_id % 13 WHEN 0 THEN 'PAST_DUE' WHEN 1 THEN 'TRIALING' WHEN 2 THEN 'CANCELED' ELSE 'ACTIVE' END AS status,
    billing_id, CASE WHEN plan <> 'FREE' THEN 'ext_' || user_id END AS external_id
  FROM users WHERE user_id % 4 <> 3)"""
