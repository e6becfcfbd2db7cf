"""Scorers behind one interface: a DataFrame with tokens in, the same with prob out.

TF-IDF with logistic regression is the baseline scorer; any batch function over token lists can
be plugged in as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, text
from millrace.operators import encode, logistic, metrics
from millrace.storage import drop_path, free_shuffles, scratch_path, written


class Scorer(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


def batch_scorer(make: Callable[[], Callable[[list], list]], column: str = "tokens") -> Scorer:
    """A scorer from a function of token lists; make() loads the model once in each worker."""

    def score(df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make()
            for tokens in batches:
                yield pd.Series(model(tokens.tolist()), dtype="float64")

        return df.withColumn("prob", run(F.col(column)))

    return score


def terms(column: str, longest: int = 2):
    """Words of two characters or more and their pairs."""
    ws = F.filter(text.words(F.col(column)), lambda w: F.length(w) >= 2)
    pairs = arrays.let(ws, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 2), " "))).otherwise(F.array().cast("array<string>")))
    return F.concat(ws, pairs) if longest > 1 else ws


class TfIdfBaseline:
    """Sublinear term frequency, smoothed idf, unit rows, class-balanced logistic regression.

    Terms are numbered, not hashed, so none share a column. The model is a table (term, slot, idf, weight) and an
    intercept; a text is scored by joining its terms, so nothing as long as the vocabulary is broadcast or gathered.
    """

    def __init__(self, least: int = 2):
        self.least = least

    def _counts(self, df: DataFrame) -> DataFrame:
        """(idx, term, tf)."""
        each = df.select("idx", F.explode(terms("text")).alias("term")).groupBy("idx", "term").agg(F.count("*").alias("n"))
        return each.select("idx", "term", (1 + F.log("n")).alias("tf"))

    def fit(self, train: DataFrame, val: DataFrame) -> TfIdfBaseline:
        """train, val: (idx, text, label)."""
        n, spark = train.count(), train.sparkSession
        paths = [scratch_path(spark, name) for name in ("term-counts", "idf", "fitted-rows", "weighted-terms")]
        counts = written(self._counts(train), "term-counts", paths[0])
        free_shuffles(spark)
        found = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= self.least)
        numbered = encode.ranked(found, "slot", F.col("term").asc())
        idf = written(numbered.select("term", F.col("slot").cast("int").alias("slot"), (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "idf", paths[1])
        weights = metrics.class_weights(train).select("label", "weight")
        labelled = train.select("idx", "label").join(F.broadcast(weights), "label")  # a row for each label
        rows = written(encode.ranked(labelled, "row", F.col("idx").asc()), "fitted-rows", paths[2])
        weighted = written(counts.join(idf, "term").select("idx", "slot", (F.col("tf") * F.col("idf")).alias("x")), "weighted-terms", paths[3])
        drop_path(spark, paths[0])
        free_shuffles(spark)
        norms = weighted.groupBy("idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        placed = rows.select("idx", "row").join(norms, "idx")
        fitted, self.intercept = logistic.fit(weighted.join(placed, "idx").select("row", "slot", (F.col("x") / F.col("norm")).alias("x")), rows, 1e-3)
        self.table = written(idf.join(fitted, "slot").select("term", "slot", "idf", "weight"), "weighted-idf")
        for path in paths[1:]:
            drop_path(spark, path)
        free_shuffles(spark)
        self.threshold = metrics.choose_threshold(self(val)).first()["threshold"]
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        x = F.col("tf") * F.col("idf")
        sums = self._counts(df).join(self.table, "term").groupBy("idx").agg((F.sum(x * F.col("weight")) / F.sqrt(F.sum(x * x))).alias("_sum"))
        return df.join(sums, "idx", "left").withColumn("prob", 1 / (1 + F.exp(-(F.coalesce("_sum", F.lit(0.0)) + F.lit(self.intercept))))).drop("_sum")

    def save(self, path: str) -> None:
        """A checkpoint: the term table, and the intercept and threshold in a row of their own."""
        self.table.write.mode("overwrite").parquet(f"{path}/terms")
        self.set_threshold(path, self.threshold)

    def set_threshold(self, path: str, threshold: float) -> None:
        """Replaces the threshold of a checkpoint; the rest stays as it is."""
        self.threshold = threshold
        self.table.sparkSession.createDataFrame([(self.least, self.intercept, float(threshold))], "least int, intercept double, threshold double").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfIdfBaseline:
        about = spark.read.parquet(f"{path}/about").first()
        out = cls(about["least"])
        out.intercept, out.threshold = about["intercept"], about["threshold"]
        out.table = spark.read.parquet(f"{path}/terms")
        return out


def classify(df: DataFrame, scorer: Scorer, threshold: float, block: int = 256, key: str | None = None) -> DataFrame:
    """(label, prob, truncated) of messages (subject, body), led by their key if one is named.

    The scorer sees no more than the block holds beside its end id; longer messages are cut and marked.
    A null subject or body is empty.
    """
    message = text.format_message(F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    idx = F.monotonically_increasing_id() if key is None else F.col(key)
    # cut into words below the generator: above it, that would be done again for each column
    rows = df.select(idx.alias("idx"), F.explode(F.array(text.words(message))).alias("ws"))
    rows = rows.select("idx", F.array_join(F.slice("ws", 1, block - 1), " ").alias("text"), (F.size("ws") >= block).alias("truncated"))
    named = text.label_name((F.col("prob") >= threshold).cast("int"))
    return scorer(rows).select(*([] if key is None else [F.col("idx").alias(key)]), named.alias("label"), "prob", "truncated")
