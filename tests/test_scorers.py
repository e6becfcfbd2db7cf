"""Scorers behind their interface: what they are shown, batches, stored models, run metadata."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import logistic, runs, scorers
from millrace.plans import scorer_queries


def test_classify_shows_the_block_alone(spark):
    rows = spark.createDataFrame([(1, "s", "one two three"), (2, "s", "one two"), (3, None, None)], "k long, subject string, body string")
    shown = lambda df: df.withColumn("prob", F.size(F.split("text", " ")).cast("double"))
    got = {r.k: (r.prob, r.truncated, r.label) for r in scorers.classify(rows, shown, 4.0, 5, "k").collect()}
    assert got == {1: (4.0, True, "spam"), 2: (4.0, False, "spam"), 3: (1.0, False, "legitimate")}
    assert scorers.classify(rows, shown, 4.0).columns == ["label", "prob", "truncated"]
    assert scorers.classify(rows.limit(0), shown, 4.0).count() == 0


def test_batches_do_not_change_scores(spark):
    rows = spark.range(50).select("id", F.sequence(F.lit(0), F.col("id")).cast("array<int>").alias("tokens"))
    score = scorers.batch_scorer(lambda: scorer_queries._digest)
    want = sorted(score(rows).select("id", "prob").collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert sorted(score(rows).select("id", "prob").collect()) == want
    finally:
        spark.conf.set(key, before)


def test_run_metadata_fills_what_a_run_lacks(spark):
    a = spark.createDataFrame([("commit", "x"), ("seed", None)], "key string, value string")
    b = spark.createDataFrame([("commit", "y"), ("host", "h")], "key string, value string")
    assert sorted(map(tuple, runs.run_meta(a, b).collect())) == [("commit", "x", "y"), ("host", "-", "h"), ("seed", "-", "-")]


def test_a_fit_in_parts_is_that_of_the_library(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((300, 12)) < 0.4, rng.random((300, 12)), 0.0)
    x[9], x[:, 3], x[:, 5] = 0.0, 0.5, np.where(np.arange(300) == 7, 2.0, 0.0)  # a row of little, a term that doesn't vary, one of a single row
    y = (x @ rng.normal(size=12) + rng.normal(size=300) * 0.3 > 0.4).astype(int)
    weight = np.where(y == 1, 2.0, 0.5)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(12) if x[i, j]], "row long, slot int, x double")
    rows = spark.createDataFrame([(i, int(y[i]), float(weight[i])) for i in range(300)], "row long, label int, weight double")
    got, intercept = logistic.fit(cells, rows, 1e-2, tolerance=1e-9)
    dense = spark.createDataFrame([(Vectors.dense(x[i]), int(y[i]), float(weight[i])) for i in range(300)], ["features", "label", "weight"])
    want = LogisticRegression(weightCol="weight", regParam=1e-2, tol=1e-12, maxIter=500).fit(dense)
    weights = {r.slot: r.weight for r in got.collect()}
    assert [weights[j] for j in range(12)] == pytest.approx(want.coefficients.toArray().tolist(), abs=1e-2)
    assert intercept == pytest.approx(want.intercept, abs=1e-2)


def test_packs_hold_whole_terms(monkeypatch):
    monkeypatch.setattr(logistic, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    slots = [0, 0, 1, 1, 1, 1, 1, 2, 3, 3]
    cells = pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(range(10), pa.int32()), pa.array(np.arange(1.0, 11)), pa.array(np.ones(10))], ["slot", "row", "x", "weight"])
    packs = [b for b in logistic._packs(10.0, 10.0, 3)(iter([cells.slice(i, 2) for i in range(0, 10, 2)]))]
    got = [(np.frombuffer(b.column(1)[0].as_py(), "<i4").tolist(), np.frombuffer(b.column(4)[0].as_py(), "<i4").tolist()) for b in packs]
    assert [s for s, _ in got] == [[0], [1], [2], [3]] and [r for _, r in got] == [[0, 1], [2, 3, 4, 5, 6], [7], [8, 9]]
    scale = np.frombuffer(packs[0].column(3)[0].as_py())[0]
    assert 1 / scale == pytest.approx(np.std([1, 2] + [0] * 8, ddof=1))


def test_a_baseline_sends_the_driver_nothing_of_the_vocabulary_s_length(spark):
    df = spark.createDataFrame([(i, f"{'cheap' if i % 3 == 0 else 'notes'} w{i} w{i + 1}", int(i % 3 == 0)) for i in range(60)], "idx long, text string, label int")
    model = scorers.TfIdfBaseline().fit(df, df)
    assert set(model.table.columns) == {"term", "slot", "idf", "weight"} and model.table.count() > 60
    assert not [v for v in vars(model).values() if not isinstance(v, (int, float, DataFrame))]  # a table and numbers
