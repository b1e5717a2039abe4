"""DuckDB SQL for queries that SQL can express."""

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= 1000
""",
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL["op12_filter_audit"] = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), s AS (
  SELECT part, good, toxic,
    concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS failed
  FROM f
), k AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM s GROUP BY 1, 2
), p AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || x FROM p, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o AS filter_order, step::INTEGER AS step, o[step] AS own, o[1:step - 1] AS earlier
  FROM p, range(1, 6) AS r(step) WHERE length(o) = 5
), m AS (
  SELECT *, contains(failed, own) AS fails, translate(failed, earlier, '') <> failed AS gone FROM k, steps
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


def _code_round(i: int) -> str:
    """Codebook ``b{i}`` from ``b{i - 1}``: every entry the floored mean of its parts."""
    return rf"""
n{i} AS (
  SELECT part, r, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT q.part, q.r, b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
    FROM q JOIN b{i - 1} b ON q.part = b.part
  ) GROUP BY 1, 2
), m{i} AS (
  SELECT n.part, n.e, count(*) AS c, sum(q.x[1]) AS s1, sum(q.x[2]) AS s2, sum(q.x[3]) AS s3, sum(q.x[4]) AS s4
  FROM n{i} n JOIN q ON q.part = n.part AND q.r = n.r GROUP BY 1, 2
), b{i} AS (
  SELECT b.part, b.e, CASE WHEN c IS NULL THEN b.x ELSE list_transform([s1, s2, s3, s4],
    lambda s: ((s - ((s % c) + c) % c) // c)::BIGINT) END AS x
  FROM b{i - 1} b LEFT JOIN m{i} m ON m.part = b.part AND m.e = b.e
)"""


# Written for the given tables: 64 components, so parts of four, and more than 64 different ids.
ORACLE_SQL["op11_vector_codes"] = rf"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
  SELECT r, part, ints[4 * part + 1:4 * part + 4] AS x FROM v, range(16) AS p(part)
), b0 AS (
  SELECT part, r - 1 AS e, x FROM q WHERE r <= 64
),{_code_round(1)},{_code_round(2)},{_code_round(3)}, s AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2
), c AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
  FROM n3 GROUP BY 1
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (r), s
"""
