"""Every core query beside its SQL twin in DuckDB, at the smallest scale."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
#: A few from each part here; the driver compares all of them.
NAMES = ["char_round_trip", "case_file", "run_file", "csv_messages", "guarded_checks", "error_report", "normalize_text", "words", "swap_names", "shingles", "label_disagreement", "contamination", "batch_crop", "likeliest_next", "bootstrap_ci", "failing_gate", "challenge_report", "appended_tokens", "exact_dedup", "jaccard_pairs", "near_dup_groups", "near_dup_leakage", "stratified_split", "contamination_report", "all_metrics", "choose_threshold", "mcnemar", "invariance", "gate", "lm_windows", "classify_messages", "batch_scores", "checkpoint_scores", "block_guard", "model_sizes", "run_metadata"]


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.sql(catalog.ORACLES[name])
    at = [list(found.columns).index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == want


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"tfidf_metrics"}  # SQL can't fit a model


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_baseline_is_better_than_chance(spark):
    assert catalog.QUERIES["tfidf_metrics"](spark, DATA).first().roc_auc > 0.5
