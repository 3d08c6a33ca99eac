"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import secret_scan

def _lowered(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _host(x: str) -> str:
    return "coalesce(" + _lowered(rf"regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"


def _path(x: str) -> str:
    return rf"coalesce(regexp_extract({x}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _key(x: str) -> str:
    parts = r"'(?s)^(.*?://[^/?#]*)([^#]*)'"
    return f"CASE WHEN contains({x}, '://') THEN {_lowered(f'regexp_extract({x}, {parts}, 1)')} || regexp_extract({x}, {parts}, 2) END"


_RULE = "(SELECT max_by(h || r.p, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p))"

#: Components by the closure of the links.
OP1 = rf"""
WITH RECURSIVE r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
page AS (SELECT page_id, url, html, {_host("url")} AS host, {_path("url")} AS path, {_key("url")} AS u FROM pages),
own AS (SELECT page_id, host, path, u, {_RULE} AS rule FROM page),
found AS (
  SELECT url, u AS src, trim(replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))), '&amp;', '&')) AS ref,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder
  FROM page WHERE u IS NOT NULL AND html IS NOT NULL
), target AS (
  SELECT src, CASE WHEN contains(ref, '://') THEN ref WHEN starts_with(ref, '//') THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || ref WHEN starts_with(ref, '/') THEN root || ref
    WHEN ends_with(folder, '/') AND folder <> regexp_extract(url, '(?s)^(.*?://)', 1) THEN folder || ref ELSE root || '/' || ref END AS t
  FROM found WHERE ref <> ''
), link AS (SELECT src, dst FROM (SELECT src, {_key("t")} AS dst FROM target) WHERE src <> dst),
edge AS (SELECT src, dst FROM link UNION SELECT dst, src FROM link),
reach(a, b) AS (SELECT src, src FROM edge UNION SELECT a, dst FROM reach JOIN edge ON b = src),
node AS (SELECT b, {_host("b")} AS host, {_path("b")} AS path FROM (SELECT DISTINCT b FROM reach)),
blocked AS (SELECT DISTINCT a FROM reach WHERE b IN (SELECT b FROM (SELECT b, {_RULE} AS rule FROM node) AS n JOIN r ON h || r.p = n.rule WHERE v = 'block'))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN (SELECT v FROM r WHERE h || r.p = rule) WHEN u IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM own
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT m FROM win),
pos AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w FROM d, sizes, LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i) WHERE len(ws) >= m
), hit AS (SELECT doc_id, pos.m, i, item_id FROM pos JOIN win USING (m, w)),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = r"""
WITH r AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT d, h >> (60 - d) AS b, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows, min(h) = max(h) AS one FROM r, range(0, 61) AS t(d) GROUP BY ALL
), l AS (
  SELECT r.*, (SELECT min(s.d) FROM s WHERE s.b = r.h >> (60 - s.d) AND (s.shard_bytes <= 262144 OR s.one)) AS depth FROM r
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows, shard_bytes > 262144 AS oversized
FROM l JOIN s ON s.d = l.depth AND s.b = l.h >> (60 - l.depth)
"""

OP5 = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM w
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.c + b.c - i)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS doc_id, x AS met FROM both_ways UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON b.x = r.met)
SELECT doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(met) AS m FROM r GROUP BY 1) USING (doc_id)
"""

OP8 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""


def _op10() -> str:
    """Positions from the lengths of the pieces between marked matches."""
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        pattern = f"({r.head})({r.body})".replace("'", "''").replace("(?:", "(?:")
        measured = "length(m) - strpos(m, chr(3))" if r.measured == "body" else "length(m) - 1"
        parts.append(f"""
SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, s AS start, s + length(m) - 1 AS "end" FROM (
  SELECT doc_id, k, split_part(p, chr(2), 1) AS m, {measured} AS got,
    sum(length(p) - CASE WHEN k > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - (length(p) - CASE WHEN k > 1 THEN 2 ELSE 0 END) AS s
  FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS k FROM (
    SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\1' || chr(3) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM d))
) WHERE k > 1 AND got >= {r.least}""")
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x01-\\x03]', chr(4), 'g') AS t FROM documents),
s AS ({union}),
a AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, ord) AS spans,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, ord) FILTER (ord < 3) AS base
  FROM s GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
""".replace("\\\\1'", "\\1'").replace("\\\\2'", "\\2'").replace("\\\\x", "\\x")


ORACLES: dict[str, str] = {"op1_url_filter": OP1, "op3_decontam": OP3, "op4_sharding": OP4, "op5_warc": OP5, "op7_ngram_join": OP7, "op8_exact_dedup": OP8, "op10_secret_scan": _op10()}
