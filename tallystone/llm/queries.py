"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .decontamination import op3_decontaminate
from .line_dedup import op4_line_spread
from .mixing import op10_curriculum_mix
from .mtree import op1_mtree_top_k
from .secrets import op5_secret_scan
from .sharding import op8_tiered_shards
from .simhash import op2_simhash_dedup
from .token_counts import op7_token_counts
from .toxicity import op6_toxicity
from .url_filter import op9_url_cascade

OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), keys AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM keys
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path <> '' AND substr(md5(host || path), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP4_SQL = """
WITH lines AS (
  SELECT d.doc_id, d.source, u.n, u.line, regexp_replace(u.line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS k
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS n) u
), shared AS (
  SELECT k FROM lines WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= 6
), marked AS (SELECT doc_id, n, line, k IN (SELECT k FROM shared) AS gone FROM lines)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
OP1_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP3_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) u WHERE len(w) > 0
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM docs, (SELECT DISTINCT k FROM windows) l, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) u WHERE len(w) >= k
), hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, s)
), marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""

QUERIES = {
    "op1_mtree_top_k": op1_mtree_top_k,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_spread": op4_line_spread,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_tiered_shards": op8_tiered_shards,
    "op9_url_cascade": op9_url_cascade,
    "op10_curriculum_mix": op10_curriculum_mix,
}

ORACLE_SQL = {
    "op1_mtree_top_k": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_line_spread": OP4_SQL,
    "op9_url_cascade": OP9_SQL,
}
