"""Every query of the core library with its SQL twin, by name."""

from __future__ import annotations

from millrace.plans import dedup_queries, io_queries, lm_queries, metric_queries, scorer_queries, text_queries

_PARTS = (text_queries, dedup_queries, metric_queries, lm_queries, io_queries, scorer_queries)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
