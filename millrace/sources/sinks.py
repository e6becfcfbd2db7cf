"""Sinks: partitioned splits, checks, JSON run documents and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str) -> None:
    """One folder for each split; Spark's commit protocol publishes all files or none."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_checks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_tokens(stream: DataFrame, path: str) -> None:
    """A token stream (pos, token) as a cache in ranges of positions; readers see all of it or none."""
    stream.select(F.col("pos").cast("bigint").alias("pos"), F.col("token").cast("int").alias("token")).repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)


def write_run(document: DataFrame, path: str) -> None:
    """One row (document string) as a JSON file."""
    document.coalesce(1).write.mode("overwrite").text(path)


def error_lines(report: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, rank, line) of an error report (kind, rank, idx, label, prob) with its texts (idx, text)."""
    line = F.format_string("[#%d] label %d | score %.3f | %s", "idx", "label", "prob", F.col("text"))
    return report.join(texts, "idx").select("kind", "rank", line.alias("line"))


def failure_lines(pairs: DataFrame, threshold: float) -> DataFrame:
    """(edit, case_id, line) of edits (edit, case_id, p0, p1, same) that flipped a decision."""
    flip = ((F.col("p0") >= threshold) != (F.col("p1") >= threshold)) & ~F.col("same")
    return pairs.where(flip).select("edit", "case_id", F.format_string("%s: %s %.3f -> %.3f", "edit", "case_id", "p0", "p1").alias("line"))


def write_report(lines: DataFrame, path: str, *order: str) -> None:
    """Report lines in order; reports are short, so they go to one file."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)
