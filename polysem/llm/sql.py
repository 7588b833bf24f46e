"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


OP1 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         'sha256:' || sha256(coalesce(html, '')) AS digest,
         regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)),
              '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host,
         regexp_extract(rest, '^[^/?]*(/[^?]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))) AS params
  FROM p
), c AS (
  SELECT page_id, body, tag, digest, CASE WHEN rest <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url
  FROM q
), s AS (
  SELECT page_id * 4 AS record_id, url, (page_id * 7919) % 1000000 AS ts, tag, digest, octet_length(encode(body)) AS size
  FROM c QUALIFY row_number() OVER (PARTITION BY url, (page_id * 7919) % 1000000 ORDER BY page_id DESC) = 1
), r AS (
  SELECT page_id * 4 + 1 AS record_id, url, (page_id * 7919 + 250007) % 1000000 AS ts,
         CASE WHEN page_id % 5 = 0 THEN '"new"' ELSE 'W/' || tag END AS etag, NULL AS modified, NULL AS digest,
         't' || (page_id * 7919 + 260007) % 1000000 AS expires, NULL AS cache FROM c
  UNION ALL
  SELECT page_id * 4 + 2, url, (page_id * 7919 + 500009) % 1000000, NULL, 't' || (page_id * 7919) % 1000000, NULL,
         NULL, 'no-cache' FROM c
  UNION ALL
  SELECT page_id * 4 + 3, url, (page_id * 7919 + 750011) % 1000000, NULL, NULL, digest, NULL, NULL FROM c
), m AS (
  SELECT r.record_id, r.url AS canonical_url, s.record_id AS target_id, r.ts - s.ts AS age, r.ts, r.etag, r.expires,
         r.cache, s.ts AS s_ts, s.tag, s.digest, s.size,
         CASE WHEN s.ts IS NULL THEN 'orphan'
              WHEN r.etag IS NOT NULL THEN CASE WHEN regexp_replace(r.etag, '^W/', '') = s.tag THEN 'resolved' ELSE 'mismatch' END
              WHEN r.modified IS NOT NULL THEN CASE WHEN r.modified = 't' || s.ts THEN 'resolved' ELSE 'mismatch' END
              ELSE CASE WHEN r.digest = s.digest THEN 'resolved' ELSE 'mismatch' END END AS outcome
  FROM r ASOF LEFT JOIN s ON r.url = s.url AND r.ts > s.ts
)
SELECT record_id, canonical_url, target_id, age, outcome,
       CASE WHEN outcome = 'resolved' THEN
         'cache-control: ' || coalesce(cache, 'max-age=60') || chr(10) || 'content-length: ' || size || chr(10)
         || 'date: t' || ts || chr(10) || 'etag: ' || coalesce(etag, tag) || chr(10)
         || coalesce('expires: ' || expires || chr(10), '') || 'last-modified: t' || s_ts || chr(10)
         || 'warc-payload-digest: ' || digest END AS merged
FROM m
"""


OP11 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


OP13 = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), n AS (
  SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), g AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n
), t AS (
  SELECT doc_id, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY doc_id, w
), f AS (
  SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, g GROUP BY w, n_docs
), s AS (
  SELECT item_id, doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (w) JOIN t USING (w) JOIN n USING (doc_id), g GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1, "op3_exact_dedup": OP3, "op11_hard_negatives": OP11, "op13_best_position": OP13}
