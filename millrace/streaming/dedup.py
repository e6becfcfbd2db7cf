"""Streaming twins: exact deduplication and corpus membership over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text


def stream_dedup(stream: DataFrame, column: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each cleaned body. With a time column the state is bounded by its watermark."""
    rows = stream.withColumn("body", text.clean_body(F.col(column))).where(F.length("body") > 0)
    if time is None:
        return rows.dropDuplicates(["body"])
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["body"])


def stream_hits(stream: DataFrame, wanted: DataFrame, column: str, n: int) -> DataFrame:
    """Shingles of arriving texts that are wanted (h): a stream-static join without state."""
    from millrace.functions import arrays

    each = stream.select(F.explode(arrays.shingle_hashes(F.col(column), n)).alias("h"))
    return each.join(wanted, "h", "left_semi")
