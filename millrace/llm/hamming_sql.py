"""SQL twin of the top-k search over sign codes."""

OP10 = """
WITH codes AS (
  SELECT vec_id AS id,
         list_aggregate(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) >= 64
), pairs AS (
  SELECT q.id AS query_id, c.id, bit_count(xor(q.code, c.code))::BIGINT AS distance
  FROM codes q, codes c WHERE q.id % 20 = 0
)
SELECT query_id, rank, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM pairs)
WHERE rank <= 10
"""
