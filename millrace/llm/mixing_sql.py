"""SQL twin of mixing with the default parameters."""

OP1 = """
WITH sizes AS (
  SELECT source, sum(greatest(coalesce(strlen(text), 0), 1))::DOUBLE AS size FROM documents GROUP BY source
), weighted AS (
  SELECT source, size, pow(size, 0.7e0) AS weight FROM sizes
), rates AS (
  SELECT source, weight / sum(weight) OVER () * 1e0 * sum(size) OVER () / size AS rate FROM weighted
), steps AS (
  SELECT source, rate, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, range(0, 150) t(k)
), draws AS (
  SELECT *, row_number() OVER () AS line, CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496e0 AS u FROM documents
), counted AS (
  SELECT any_value(d.doc_id) AS doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars,
         any_value(rate) AS rate, (count(*) FILTER (cdf <= u))::INTEGER AS n_copies
  FROM draws d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source GROUP BY d.line
), copies AS (
  SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM counted WHERE n_copies > 0
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, n_copies, copy,
       CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15) AS BIGINT) AS shuffle_key
FROM copies
"""
