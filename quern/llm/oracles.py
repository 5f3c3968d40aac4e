"""DuckDB SQL for the queries that SQL can express: plain definitions, over whole tables."""

_SHA = "lower(sha256({}))"

SUFFIX_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
  w AS (SELECT r, i, md5(b[i:i + 399]) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
  c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
  s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w JOIN c USING (k)),
  g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s),
  spans AS (SELECT r, min(i) AS a, max(i) + 399 AS e FROM g GROUP BY r, g),
  cuts AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
  t AS (SELECT r, count(*) AS spans, sum(e - a + 1) AS gone, max(e) AS last, string_agg(hex(b[before + 1:a - 1]), '' ORDER BY a) AS h FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, {_SHA.format("CASE WHEN h IS NULL THEN b ELSE unhex(h || hex(b[last + 1:octet_length(b)])) END")} AS kept_sha256 FROM d LEFT JOIN t USING (r)"""

SUBSTRING_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  w AS (SELECT r, i, ws[i] AS b, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS k FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
  c AS (SELECT k, 1 AS twice FROM w WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
  m AS (SELECT r, i, b, max(coalesce(twice, 0)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN c USING (k)),
  a AS (SELECT r, count(*) AS n, sum(gone) AS x, string_agg(b, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(x, 0) AS BIGINT) AS n_removed, {_SHA.format("coalesce(kept, '')")} AS kept_sha256 FROM d LEFT JOIN a USING (r)"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

DECONTAMINATE = f"""WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
  win AS (SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
  sizes AS (SELECT DISTINCT n FROM win),
  dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
  hit AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
  words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
  items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, {_SHA.format("coalesce(ids, '')")} AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

#: Exact: the forest finds all links of these tables (its recall is measured in the tests).
EMBEDDINGS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  link AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.98),
  reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
  comp AS (SELECT reach.a AS r, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.b GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.r) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept FROM v JOIN comp USING (r)"""
