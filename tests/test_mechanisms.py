"""Membership filters, pairs over block borders, crops, ties, resamples, guards, and a cache that a stream appends to."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.operators import encode, lm, membership, metrics, runs, scorers
from millrace.streaming import tokens


def test_a_filter_loses_nothing_and_keeps_most_away(spark):
    wanted = spark.range(0, 2000, 2).select(F.xxhash64("id").alias("h"))
    corpus = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    bits = 1 << 14
    sieve = membership.bloom_filter(wanted, "h", bits).first()["filter"]
    assert len(sieve) == bits // 64
    passed = corpus.crossJoin(F.broadcast(membership.bloom_filter(wanted, "h", bits))).where(membership.may_hold(F.col("filter"), F.col("h"), bits))
    got = {r.id for r in passed.select("id").collect()}
    assert set(range(0, 2000, 2)) <= got and len(got) < 1000 + 0.05 * 19_000
    assert sorted(r.id for r in membership.held(corpus, wanted, bits=bits).collect()) == list(range(0, 2000, 2))
    assert membership.held(corpus, wanted.limit(0)).count() == 0


def test_pairs_go_over_block_borders_once(spark):
    stream = spark.range(1000).where("id != 500").select(F.col("id").alias("pos"), (F.col("id") * 3).alias("token"))
    df = lm.with_next(stream, block=64)
    got = sorted(map(tuple, df.collect()))
    assert got == [(i, 3 * i, 3 * i + 3) for i in range(999) if i not in (499, 500)]
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # as planned and as run: one exchange
    assert lm.with_next(stream.limit(0)).count() == 0


def test_batches_are_cut_to_their_longest_row(spark):
    rows = [(i, [7] * n + [0] * (8 - n), n) for i, n in enumerate([2, 3, 1, 8, 1, 1, 1])]
    df = spark.createDataFrame(rows, "idx long, tokens array<int>, length int")
    got = {r.idx: (r.batch, r.width, len(r.tokens)) for r in encode.cropped_batches(df, 3, F.lit(0), F.col("idx").asc()).collect()}
    assert got == {i: (i // 3, w, w) for i, w in enumerate([3, 3, 3, 8, 8, 8, 1])}


def test_ties_with_the_kth_are_kept(spark):
    of = lambda scores, k: spark.createDataFrame([(scores,)], "s array<double>").select(arrays.at_least_kth(F.col("s"), k).alias("x")).first().x
    low = -math.inf
    assert of([1.0, 3.0, 2.0, 2.0], 2) == [low, 3.0, 2.0, 2.0] and of([1.0, 3.0], 5) == [1.0, 3.0] and of([1.0, 2.0], 0) == [1.0, 2.0]
    pairs = spark.createDataFrame([(1, b, c) for b, c in ((1, 5), (2, 3), (3, 3), (4, 1))] + [(2, 1, 1)], "a long, b long, c long")
    got = {(r.a, r.b): round(r.prob, 6) for r in lm.likeliest_next((pairs, pairs), 2).collect()}
    assert got == {(1, 1): 0.454545, (1, 2): 0.272727, (1, 3): 0.272727, (2, 1): 1.0}


def test_resamples_are_poisson_and_cover_the_metric(spark):
    shares = np.diff([0, *metrics.LIMITS]) / metrics.PRIME
    assert np.allclose(shares[:5], [math.exp(-1) / math.factorial(k) for k in range(5)], atol=1e-9)
    rng = np.random.default_rng(1)
    labels = rng.random(400) < 0.4
    probs = np.clip(np.round(labels * 0.3 + rng.random(400) * 0.7, 3), 0, 1)
    df = spark.createDataFrame([(i, float(p), int(y)) for i, (p, y) in enumerate(zip(probs, labels, strict=True))], "idx long, prob double, label int")
    got = {r.metric: r for r in metrics.metrics_report(df, 0.5, 200).collect()}
    assert len(got) == 10 and all(r.lo <= r.hi for r in got.values())
    accuracy, spread = got["accuracy"], 1.96 * math.sqrt(got["accuracy"].value * (1 - got["accuracy"].value) / 400)
    assert accuracy.lo < accuracy.value < accuracy.hi and 0.6 < (accuracy.hi - accuracy.lo) / (2 * spread) < 1.5
    assert got["roc_auc"].lo < got["roc_auc"].value < got["roc_auc"].hi


def test_a_changed_label_is_another_split(spark):
    a = spark.createDataFrame([(i, i % 2) for i in range(2500)], "idx long, label int")
    assert runs.same_split(a, a.repartition(7)).first().same_split
    assert not runs.same_split(a, a.withColumn("label", F.when(F.col("idx") == 7, 0).otherwise(F.col("label")))).first().same_split
    assert not runs.same_split(a, a.where("idx != 2000")).first().same_split


def test_scoring_works_after_an_observation(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).count()
    assert seen.get["n"] == 5
    df = spark.createDataFrame([(i, "cheap pills now" if i % 3 == 0 else "notes for monday", int(i % 3 == 0)) for i in range(30)] + [(99, "", 0)], "idx long, text string, label int")
    model = scorers.TfIdfBaseline().fit(df, df)
    assert model(df).where((F.col("prob") >= model.threshold) != (F.col("label") == 1)).count() == 0
    assert "Python" not in model(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fails_after", ["tokens", "offsets"])
def test_a_restart_appends_each_batch_once(spark, tmp_path, monkeypatch, fails_after):
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id long")
    source = str(tmp_path / "in")
    for k, texts in enumerate((["a b", "c"], ["b b b"], ["", "a"])):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    arriving = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: tokens.append_tokens(arriving(), str(tmp_path / "cache"), str(tmp_path / "state"), words, 9)
    own, calls = encode.running_offset, Counter()

    def failing(*args):
        calls["n"] += 1
        if calls["n"] == 2 and fails_after == "tokens":
            own(*args).write.parquet(str(tmp_path / "cache/tokens/batch=1"))  # what an interrupted batch may leave
            raise RuntimeError("lost")
        if calls["n"] == 3 and fails_after == "offsets":
            raise RuntimeError("lost")
        return own(*args)

    monkeypatch.setattr(encode, "running_offset", failing)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    run().awaitTermination()
    run().awaitTermination()  # nothing new, nothing appended
    got = [r.token for r in tokens.read_appended(spark, str(tmp_path / "cache")).orderBy("pos").collect()]
    assert got == [0, 1, 9, 2, 9, 1, 1, 1, 9, 9, 0, 9]
    assert [r.pos for r in tokens.read_appended(spark, str(tmp_path / "cache")).orderBy("pos").collect()] == list(range(12))
