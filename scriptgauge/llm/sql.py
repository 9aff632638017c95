"""DuckDB counterparts of the queries that SQL can express."""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id, count(*) OVER (PARTITION BY hex) AS n FROM hashed
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + (
    (('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN n = 1 OR first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM grouped
"""

VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), counted AS (SELECT x, count(*) AS n FROM links GROUP BY x), first AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, f.y AS component_id, e.vec_id = f.y AS kept
FROM embeddings e JOIN first f ON f.x = e.vec_id LEFT JOIN counted c ON c.x = e.vec_id
"""

SQL = {"op1_warc_round_trip": WARC, "op2_vector_near_duplicates": VECTORS}
