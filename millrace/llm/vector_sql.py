"""SQL twins of the operators on vectors in whole numbers."""

from __future__ import annotations

from millrace.llm import centroid_clustering, vector_codes

_WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"
_COMPLETE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_TEXT = "array_to_string(list_transform({v}, lambda x: x::BIGINT), ',')"


def _square(a: str, b: str) -> str:
    """The squared distance of two lists; sums of whole numbers below 2^53, so exact."""
    return f"(list_inner_product({a}, {a}) - 2 * list_inner_product({a}, {b}) + list_inner_product({b}, {b}))"


def clustering(k: int = centroid_clustering.CLUSTERS, rounds: int = centroid_clustering.ROUNDS, d: int = centroid_clustering.DIMENSIONS, seed: int = centroid_clustering.SEED) -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_COMPLETE} AND len(embedding) = {d})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(kept.v) AS v, min({{'d': {_square('kept.v', 'c.v')}, 'c': c.c}}) AS best FROM kept, c{n} c GROUP BY r)")
        if n < rounds:
            means = f"SELECT best.c AS c, pos, floor(sum(x) / count(*)) AS m FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{n}) GROUP BY ALL"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY pos) AS v FROM ({means}) GROUP BY c UNION ALL SELECT c, v FROM c{n} WHERE c NOT IN (SELECT best.c FROM a{n}))")
    return f"""WITH {', '.join(steps)}
      SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d::BIGINT) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
        sum(best.d::BIGINT) OVER ()::BIGINT AS inertia, sha256({_TEXT.format(v='c.v')}) AS centroid_sha256 FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.c = best.c"""


def codes(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """For vectors of one length, which `parts` divides."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, {_WHOLE}) - 1 AS r, vec_id, label, {_WHOLE} AS w FROM embeddings WHERE {_COMPLETE})",
        f"parts AS MATERIALIZED (SELECT r, p, w[p * len(w) // {parts} + 1:(p + 1) * len(w) // {parts}] AS v FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r AS e, v FROM parts WHERE r < {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p, any_value(parts.v) AS v, min({{'d': {_square('parts.v', 'b.v')}, 'e': e}}) AS best FROM parts JOIN b{n} b USING (p) GROUP BY r, p)")
        if n < rounds:
            means = f"SELECT p, best.e AS e, pos, floor(sum(x) / count(*)) AS m FROM (SELECT p, best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{n}) GROUP BY ALL"
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT p, e, list(m ORDER BY pos) AS v FROM ({means}) GROUP BY p, e UNION ALL SELECT p, e, v FROM b{n} WHERE (p, e) NOT IN (SELECT (p, best.e) FROM a{n}))")
    return f"""WITH {', '.join(steps)},
      coded AS (SELECT r, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
      SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg({_TEXT.format(v='v')}, ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
      FROM kept JOIN coded USING (r)"""


OP11, OP13 = codes(), clustering()
