"""SQL for the operators that SQL can express, written for DuckDB and independent of the Spark code's steps."""

from __future__ import annotations

from itertools import permutations

from docwarden.llm import mixing, sharding, url_trust

WORDS = r"'[^\x20\x09-\x0D]+'"


def _url_trust() -> str:
    hosts = r"translate(coalesce(regexp_extract({}, '^(?:.|\n)*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    by_length = sorted(url_trust.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in by_length
    )
    steps, last = [], "seeds"
    for i in range(url_trust.ROUNDS):
        steps.append(
            f"r{i} AS (SELECT kind, host, sum(rank) AS rank FROM ("
            f"SELECT f.kind, f.b AS host, p.rank * f.share * {url_trust.DAMPING} AS rank FROM {last} p JOIN flows f ON p.kind = f.kind AND p.host = f.a "
            f"UNION ALL SELECT kind, host, rank * (1 - {url_trust.DAMPING}) FROM seeds) GROUP BY 1, 2)"
        )
        last = f"r{i}"
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']?([^\"''\s>]+)"
    return rf"""
WITH parsed AS (
  SELECT page_id, html, {hosts.format('url')} AS host,
         coalesce(regexp_extract(url, '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {fits} END AS hit FROM parsed
), hosts AS (
  SELECT host, avg(CASE WHEN hit LIKE '% allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN hit LIKE '% block' THEN 1.0 ELSE 0.0 END) AS d
  FROM ruled GROUP BY host
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM ruled
), edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, {hosts.format("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst FROM links)
  WHERE dst <> '' AND dst <> src GROUP BY 1, 2
), both_ways AS (
  SELECT 0 AS kind, src AS a, dst AS b, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges
), flows AS (
  SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS share FROM both_ways
), seeds AS (
  SELECT 0 AS kind, host, t AS rank FROM hosts WHERE t > 0 UNION ALL SELECT 1, host, d FROM hosts WHERE d > 0
), {', '.join(steps)},
scores AS (
  SELECT host, sum(CASE WHEN kind = 0 THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 1 THEN rank ELSE 0 END) AS distrust
  FROM {last} GROUP BY host
)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule,
       CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 2)
            WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {url_trust.RATIO} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


# the remainders of single bytes, then one step per byte of the text's UTF-8
_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::BIGINT)"
_CRC32 = (
    f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: xor(c >> 8, "
    "t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
)
CRC32 = _CRC32.format("text")


def _shards(shards: int = 8) -> str:
    network = "SELECT rn, half, mask, total, x >> half AS l, x & mask AS r FROM walk WHERE NOT inside"
    for key in sharding.round_keys(0):
        mixed = f"(r * {sharding.MULTIPLIER} + {key})"
        network = f"SELECT rn, half, mask, total, r AS l, xor(l, (xor({mixed}, {mixed} >> 15)) & mask) AS r FROM ({network})"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT {_TABLE} AS t
), sized AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size, text FROM documents
), numbered AS (
  SELECT doc_id, size, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, size) - 1 AS rn FROM sized
), total AS (
  SELECT count(*) AS total, greatest(1, ceil(log2(greatest(count(*), 1)) / 2))::INT AS half FROM sized
), walk AS (
  SELECT rn, half, (1::BIGINT << half) - 1 AS mask, total, rn::BIGINT AS x, false AS inside FROM numbered, total
  UNION ALL
  SELECT rn, half, mask, total, (l << half) | r AS x, ((l << half) | r) < total AS inside FROM ({network})
)
SELECT doc_id, size, CASE WHEN text IS NOT NULL THEN {CRC32} END AS text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, x // {shards} AS slot, NULL::INT AS grown_shard
FROM walk JOIN numbered USING (rn), crc_table WHERE inside
"""


WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


def _mix() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size, source AS src,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), per AS (
  SELECT key, sum(size)::BIGINT AS source_size, [{weights}][(row_number() OVER (ORDER BY key) - 1) % {len(mixing.WEIGHTS)} + 1] AS w
  FROM sized GROUP BY key
), level AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at FROM per
), water AS (
  SELECT l.full_at, l.key, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)
         - (SELECT coalesce(sum(2 * source_size), 0) FROM level b WHERE (b.full_at, b.key) < (l.full_at, l.key)))
         / (SELECT sum(w) FROM level a WHERE (a.full_at, a.key) >= (l.full_at, l.key)) AS share
  FROM level l
), found AS (
  SELECT arg_min(share, full_at) AS share FROM water WHERE share <= full_at
), planned AS (
  SELECT key, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT share FROM found) * w, 2.0::DOUBLE * source_size)) AS target FROM per
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM planned
), needs AS (
  SELECT *, target - whole * source_size AS need FROM parts
), by_hash AS (
  SELECT key, h, sum(size) AS n FROM sized GROUP BY 1, 2
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY key ORDER BY h) AS upto FROM by_hash
), edge AS (
  SELECT key, min(h) AS h FROM running JOIN needs USING (key) WHERE upto > need GROUP BY key
), cut AS (
  SELECT n.key, CASE WHEN e.h IS NULL THEN (1::BIGINT << 60) - 1 WHEN 2 * (n.need - (r.upto - r.n)) >= r.n THEN e.h ELSE e.h - 1 END AS threshold
  FROM needs n LEFT JOIN edge e USING (key) LEFT JOIN running r ON r.key = e.key AND r.h = e.h
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN h <= threshold AND need > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN needs USING (key) JOIN cut USING (key)
"""


SETS = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents UNION SELECT b.y, r.r FROM reach r JOIN both_ways b ON b.x = r.x
)
SELECT r.x AS doc_id, s.n AS n_shingles, min(r.r) AS component_id FROM reach r JOIN sizes s ON s.doc_id = r.x GROUP BY 1, 2
"""


RUNS = rf"""
WITH crc_table AS (
  SELECT {_TABLE} AS t
), hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w, {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents, crc_table
), planned AS (
  SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), repeated AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i:
           CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w
  FROM planned
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM repeated
), alike AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike
), spans AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM spans GROUP BY ALL
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         arg_min(struct_pack(start := start, length := length, period := period), (-length, start, period)) AS best
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM places ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _audit() -> str:
    steps = ", ".join(f"('{''.join(o)}', {i + 1}, '{o[i]}', '{''.join(o[:i])}')" for o in permutations("ABCDE") for i in range(5))
    fails = {
        "A": "len(w) < 200",
        "B": "100 * len(list_distinct(w)) < 50 * len(w)",
        "C": "100 * (length(txt) - length(regexp_replace(txt, '[A-Z]', '', 'g'))) > 2 * length(txt)",
        "D": "regexp_matches(txt, '[#$%&*|]')",
        "E": "doc_id > min(doc_id) OVER (PARTITION BY txt)",
    }
    judged = ", ".join(f"coalesce({condition}, false) AS {letter}" for letter, condition in fails.items())
    hit = " OR ".join(f"(own = '{x}' AND {x})" for x in fails)
    earlier = " OR ".join(f"(contains(before, '{x}') AND {x})" for x in fails)
    others = " + ".join(f"{x}::INT" for x in fails)
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents
), judged AS (
  SELECT doc_id, part, {judged} FROM words
), marked AS (
  SELECT j.*, coalesce(good, false) AS good, coalesce(toxic, false) AS bad
  FROM judged j LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), combined AS (
  SELECT part, A, B, C, D, E, good, bad, count(*) AS n FROM marked GROUP BY ALL
), steps(filter_order, step, own, before) AS (
  VALUES {steps}
), counted AS (
  SELECT part, filter_order, step, own, n, good, bad, ({hit}) AS fails, ({earlier}) AS gone, {others} AS failing FROM combined, steps
), summed AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND failing = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails AND NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM summed
"""


ORACLES = {
    "op2_set_join": SETS,
    "op4_url_trust": _url_trust(),
    "op6_feistel_shards": _shards(),
    "op7_warc": WARC,
    "op9_hash_mix": _mix(),
    "op11_word_runs": RUNS,
    "op12_filter_audit": _audit(),
}
