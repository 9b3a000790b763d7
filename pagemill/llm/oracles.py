"""SQL for the queries that SQL can express."""

from __future__ import annotations

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_WARC = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS payload, sha1(COALESCE(html, '')) AS hex FROM pages
), f AS (
  SELECT hex, min(page_id) AS first FROM p GROUP BY hex
), b AS (
  SELECT hex, first,
    list_aggregate(list_transform(range(0, 40), lambda i:
      lpad(bin(instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4, '0')), 'string_agg', '') AS bits
  FROM f
), d AS (
  SELECT hex, first, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
        + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
        + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), 'string_agg', '') AS digest
  FROM b
)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN p.page_id = d.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = d.first THEN NULL ELSE d.first END AS refers_to
FROM p JOIN d USING (hex)
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(COALESCE(CAST(doc_id AS VARCHAR), '~')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place,
    CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total
  FROM s
), w AS (
  SELECT *, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM p
), o AS (
  SELECT *,
    COALESCE(CAST(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
    CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_weight
  FROM w
), c AS (
  SELECT *, 2 * source_size * rest_weight <= (total - before) * weight AS cut FROM o
), t AS (
  SELECT source, place, source_size, CASE WHEN cut THEN CAST(2 * source_size AS DOUBLE)
    ELSE (total - CAST(sum(CASE WHEN cut THEN 2 * source_size ELSE 0 END) OVER () AS BIGINT)) * weight
      / CAST(sum(CASE WHEN cut THEN 0 ELSE weight END) OVER () AS BIGINT) END AS target
  FROM c
), k AS (
  SELECT d.doc_id, d.size, t.*, CAST(round(t.target) AS BIGINT) AS due,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS passes FROM k
), x AS (
  SELECT *, CAST(passes * size + least(greatest(due - passes * source_size - start, 0), size) AS BIGINT) AS taken,
    CASE place WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS a,
    CASE place WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS b
  FROM n
), y AS (
  SELECT *, least(start / greatest(due, 1), CAST(1 AS DOUBLE)) * (a + b) AS y FROM x
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN y / (a + sqrt(a * a + (b - a) * y)) END AS first_position
FROM y
"""

_HARD = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), t AS (
  SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM w WHERE len(w) > 0
), o AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM t
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3
), s AS (
  SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), c AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL
)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank,
  c.phrase, a, l, r, n, score
FROM c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase JOIN n ON n.lang = c.lang
WHERE g.f IS NULL OR 100 * g.f < 50 * a
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": _TOP_K, "op4_warc_chunks": _WARC, "op9_curriculum_mix": _MIX, "op11_hard_negatives": _HARD, "op12_phrase_growth": _PHRASES}
