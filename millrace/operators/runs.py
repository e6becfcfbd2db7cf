"""Comparison of two evaluation runs and the gate on the second.

A run is kept as tables: scored rows (idx, prob, label), a fingerprint of the split, a threshold,
wrong case ids, and one row of metrics. Probabilities are rounded to six places when saved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import encode

MIN_AGREEMENT, MOST_EXTRA_WRONG, MOST_CHANGED, MOST_PERPLEXITY_RISE = 0.99, 1, 2, 0.02
PLACES = 6


def saved(c: Column) -> Column:
    """Half-even to six places, as run documents hold it."""
    return F.bround(c, PLACES)


def run_document(**parts: Column) -> Column:
    """A nested run document as JSON text."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())))


def same_split(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same_split): one row, whether two runs' rows (idx, label) have one fingerprint."""
    of = lambda df, name: encode.fingerprint(df.select("idx", F.array().cast("array<int>").alias("tokens"), F.lit(0).alias("length"), "label")).withColumnRenamed("fingerprint", name)
    return of(a, "a").crossJoin(of(b, "b")).select(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_split"))


def run_agreement(a: DataFrame, b: DataFrame, threshold_a: float, threshold_b: float) -> DataFrame:
    """agreement, changed, and mean and largest distance of two runs' saved scores by idx."""
    pairs = a.select("idx", saved(F.col("prob")).alias("pa")).join(b.select("idx", saved(F.col("prob")).alias("pb")), "idx")
    same = (F.col("pa") >= threshold_a) == (F.col("pb") >= threshold_b)
    delta = F.abs(F.col("pa") - F.col("pb"))
    return pairs.agg(F.avg(same.cast("int")).alias("agreement"), F.count_if(~same).alias("changed"), F.avg(delta).alias("mean_abs_dp"), F.max(delta).alias("max_abs_dp"))


def challenge_changes(wrong_a: DataFrame, wrong_b: DataFrame) -> DataFrame:
    """(case_id, change) of cases that are wrong in one run only."""
    worse = wrong_b.join(wrong_a, "case_id", "left_anti").select("case_id", F.lit("newly wrong").alias("change"))
    return worse.union(wrong_a.join(wrong_b, "case_id", "left_anti").select("case_id", F.lit("newly right")))


def tags_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tag, correct_a, n_a, correct_b, n_b) over the tags of either run (tag, n, correct)."""
    left, right = a.select("tag", F.col("correct").alias("correct_a"), F.col("n").alias("n_a")), b.select("tag", F.col("correct").alias("correct_b"), F.col("n").alias("n_b"))
    return left.join(right, "tag", "full_outer").fillna(0)


def metric_deltas(a: DataFrame, b: DataFrame, ci: DataFrame) -> DataFrame:
    """(metric, value_a, value_b, delta, outside): outside the first run's interval (metric, lo, hi)."""
    both = a.toDF("metric", "value_a").join(b.toDF("metric", "value_b"), "metric").join(ci, "metric", "left")
    outside = F.coalesce((F.col("value_b") < F.col("lo")) | (F.col("value_b") > F.col("hi")), F.lit(False))
    return both.select("metric", "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"), outside.alias("outside"))


def error_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(error, n_a, n_b, delta) of false positives and negatives of two runs' confusion counts, a row each."""
    long = lambda df, name: df.unpivot([], ["fp", "fn"], "error", name)
    return long(a.select("fp", "fn"), "n_a").join(long(b.select("fp", "fn"), "n_b"), "error").select("error", "n_a", "n_b", (F.col("n_b") - F.col("n_a")).alias("delta"))


def speed_and_lm(speed_a: DataFrame, speed_b: DataFrame, lm_a: DataFrame, lm_b: DataFrame) -> DataFrame:
    """(part, metric, value_a, value_b, change) of rows (metric, value): ratios of speeds, differences of language-model figures."""
    both = lambda x, y, part: x.toDF("metric", "value_a").join(y.toDF("metric", "value_b"), "metric").select(F.lit(part).alias("part"), "metric", "value_a", "value_b")
    speed = both(speed_a, speed_b, "speed").withColumn("change", F.try_divide("value_b", "value_a"))
    return speed.union(both(lm_a, lm_b, "lm").withColumn("change", F.col("value_b") - F.col("value_a")))


def assemble(**sections: DataFrame) -> DataFrame:
    """(document): one JSON document of sections, each a table of one row; a section without a row is left out."""
    packed = [df.agg(F.first(F.struct("*")).alias(name)) for name, df in sections.items()]
    whole = packed[0]
    for p in packed[1:]:
        whole = whole.crossJoin(F.broadcast(p))  # rows of one row each
    return whole.select(F.to_json(F.struct("*")).alias("document"))


def gate(facts: DataFrame) -> DataFrame:
    """(check, passed) of five conditions on one row of facts; a null says that a check can't run.

    facts: fbeta_lo, fbeta_b, same_split, agreement, wrong_a, wrong_b, changed, perplexity_a, perplexity_b.
    """
    checks = [
        ("fbeta within interval", F.col("fbeta_b") >= F.col("fbeta_lo")),
        ("predictions agree", F.when(F.col("same_split"), F.col("agreement") >= MIN_AGREEMENT).otherwise(F.lit(False))),
        ("challenge count", F.col("wrong_b") - F.col("wrong_a") <= MOST_EXTRA_WRONG),
        ("challenge changes", F.col("changed") <= MOST_CHANGED),
        ("perplexity", F.col("perplexity_b") / F.col("perplexity_a") - 1 <= MOST_PERPLEXITY_RISE),
    ]
    return facts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks))).alias("c")).select("c.*")


def verdict(checks: DataFrame) -> DataFrame:
    """Passed unless some check is false; nulls don't fail."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(F.col("passed").isNull()).alias("skipped"))


def run_spread(runs: DataFrame) -> DataFrame:
    """(metric, mean, std) over runs (run, metric, value); the deviation is the sample's."""
    return runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def run_meta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) of two runs' metadata (key, value), "-" where a run lacks a key or its value."""
    both = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full")
    return both.select("key", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("a", "b")))
