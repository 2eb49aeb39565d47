"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_quality_rules"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid
), f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), g AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_alpha < n_words
         OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * n_lines
         OR 2 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*\z'))) > n_lines) AS kept
FROM g
"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op4_benchmark_decontamination"] = f"""
WITH b AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w FROM documents
), dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s)
), hit AS (
  SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

SQL["op7_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i - 1 AS line_no, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), occ AS (
  SELECT doc_id, line_no, w, array_to_string(w, ' ') AS line FROM l WHERE len(w) >= 1
), u AS (
  SELECT line, any_value(w) AS w, min((doc_id, line_no)) AS first FROM occ GROUP BY line
), v AS (
  SELECT line, len(w) AS n, i, first, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= 5)
), near AS (
  SELECT a.line FROM v a JOIN v b ON a.g = b.g AND a.i = b.i AND a.n = b.n WHERE b.first < a.first
  UNION SELECT a.line FROM v a JOIN u b ON a.g = b.line AND len(b.w) >= 5 WHERE b.first < a.first
  UNION SELECT b.line FROM v a JOIN u b ON a.g = b.line AND len(b.w) >= 5 WHERE a.first < b.first
), gone AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed
  FROM occ JOIN u USING (line)
  WHERE (occ.doc_id, occ.line_no) <> u.first OR line IN (SELECT line FROM near)
  GROUP BY doc_id
)
SELECT doc_id, len(ls) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN gone USING (doc_id)
"""

SQL["op3_sharding"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) AS bytes,
         lpad(bin(('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:15])::BIGINT), 60, '0') AS a
  FROM documents
), p AS (
  SELECT rid, doc_id, bytes, b, a[1:b] AS prefix FROM d, (SELECT unnest(range(0, 41)) AS b)
), s AS (
  SELECT b, prefix, sum(bytes) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY b, prefix
), m AS (
  SELECT rid, doc_id, bytes, min(b) AS b, min_by(prefix, b) AS shard, min_by(shard_bytes, b) AS shard_bytes, min_by(shard_rows, b) AS shard_rows
  FROM p JOIN s USING (b, prefix) WHERE shard_bytes <= 1048576 OR shard_rows = 1 GROUP BY rid, doc_id, bytes
)
SELECT doc_id, bytes, shard, b AS shard_bits, shard_bytes::BIGINT AS shard_bytes, shard_rows FROM m
"""

_CANONICAL = r"""CASE WHEN host <> '' AND host <> 'www.' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END"""

SQL["op5_url_filters"] = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3)[2:], '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=.*)?$'))) AS q
  FROM pages
), c AS (
  SELECT *, {_CANONICAL} AS c FROM p
), r(word, h, t) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), f AS (
  SELECT page_id, c.host, c.path, max_by(h || t, length(h || t)) AS rule, max_by(word, length(h || t)) AS word
  FROM c JOIN r ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, t) GROUP BY 1, 2, 3
), listed AS (
  SELECT DISTINCT c FROM c WHERE page_id % 100 = 0 AND c IS NOT NULL
)
SELECT c.page_id, c.host, c.path, rule, coalesce(word, CASE WHEN listed.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id = f.page_id LEFT JOIN listed ON c.c = listed.c
"""


def _clustering(rounds: int = 5) -> str:
    """The rounds written out one after the other."""
    parts = ["""WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS (
  SELECT c, v FROM (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS c, v FROM k WHERE vec_id IS NOT NULL) WHERE c < 40
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT rid, min({{'d': d, 'c': c}}) AS m FROM (
    SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - q.v[i]) * (k.v[i] - q.v[i])))::BIGINT AS d FROM k, c{i} q) GROUP BY rid
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (
  SELECT c, coalesce(w, v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS w FROM (
      SELECT m.c AS c, j, sum(v[j])::HUGEINT AS s, count(*) AS n FROM k JOIN a{i} USING (rid), (SELECT unnest(range(1, 65)) AS j) GROUP BY m.c, j) GROUP BY c) USING (c)
)""")
    return ", ".join(parts) + f"""
SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN k USING (rid) JOIN c{rounds} q ON q.c = m.c
"""


SQL["op11_centroid_clustering"] = _clustering()
