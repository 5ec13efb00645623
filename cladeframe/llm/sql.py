"""DuckDB SQL for the queries that SQL can express."""

from cladeframe.llm.secret_scan import duckdb_sql
from cladeframe.llm.url_filter import duckdb_sql as url_sql

SQL = {}

SQL["op4_secret_scans"] = duckdb_sql()
SQL["op7_url_filters"] = url_sql()
SQL["url_redirect_classes"] = url_sql(
    redirects="SELECT url AS src, regexp_replace(regexp_replace(url, '^([^:]*://[^/]*)/en/', '\\1/de/'), '^([^:]*://[^/]*)/es/', '\\1/fr/') AS dst FROM pages"
)

SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), least AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE doc_id > m
), lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws
              ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""

SQL["op3_chat_formatting"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, conv_id, turn IS NULL AS last, turn,
         coalesce(nullif(role, ''), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body
  FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), v AS (
  SELECT t.*, perspective, CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY last, turn, role, body, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a
  FROM v
)
SELECT conv_id, perspective, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY last, turn, role, body, k) AS rendered,
       coalesce(string_agg(a || ':' || (a + length(body)), ',' ORDER BY last, turn, role, body, k) FILTER (role = perspective), '') AS masks
FROM p GROUP BY conv_id, perspective
"""

SQL["op12_prefix_trie"] = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
                         lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc_table
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN o ON o.conv_id = base WHERE p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE p > h
), s AS (
  SELECT conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, p) AS turns FROM rebuilt GROUP BY conv_id) USING (conv_id)
), n AS (
  SELECT turns[1:d] AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(turns)) AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s) GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(kids, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(k[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM n LEFT JOIN (SELECT k[1:depth - 1] AS above, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL) u ON u.above = n.k
), sums AS (
  SELECT k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM m) GROUP BY ALL
)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN sums ON sums.k = m.k LEFT JOIN m p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.k = m.k[1:m.depth - 1]
"""
