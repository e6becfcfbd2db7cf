"""A token cache that grows with a stream of texts, each micro-batch exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import encode, lm

OFFSETS = "start bigint, n bigint"


def append_tokens(stream: DataFrame, path: str, checkpoint: str, vocabulary: DataFrame, end: int, key: str = "doc_id", column: str = "text") -> StreamingQuery:
    """Encodes the texts (key, column) of a stream and appends their tokens to a cache (pos, token) in `path`.

    A batch's tokens go to a folder of its number, and then, as what makes them count, its first position and
    length to another. Positions go on from the batches before, in the order of the key. After a failure
    Spark repeats the batch of the same number with the same rows, which replaces both folders, so that no
    token is lost or doubled, wherever it failed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = written_tokens(spark, path, number)
        placed = encode.placed_words(batch, key, column, vocabulary)
        tokens = lm.token_stream(placed, key, end).select((F.col("pos") + start).alias("pos"), F.col("token").cast("int").alias("token"))
        tokens.write.mode("overwrite").parquet(f"{path}/tokens/batch={number}")
        n = spark.read.parquet(f"{path}/tokens/batch={number}").count()
        spark.createDataFrame([(start, n)], OFFSETS).coalesce(1).write.mode("overwrite").parquet(f"{path}/offsets/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _offsets(spark: SparkSession, path: str) -> DataFrame:
    """(batch, start, n) of the batches that count; none before the first."""
    found = spark.read.schema(f"{OFFSETS}, batch bigint").option("ignoreMissingFiles", True)
    return found.option("basePath", f"{path}/offsets").parquet(f"{path}/offsets/batch=*")


def written_tokens(spark: SparkSession, path: str, before: int) -> int:
    """Tokens of the batches before the one of this number."""
    if before == 0:
        return 0
    return _offsets(spark, path).where(F.col("batch") < before).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token) of all batches that count; what an unfinished batch has written is left out."""
    tokens = spark.read.schema("pos bigint, token int, batch bigint").option("basePath", f"{path}/tokens").parquet(f"{path}/tokens/batch=*")
    return tokens.join(F.broadcast(_offsets(spark, path).select("batch")), "batch").select("pos", "token")  # a row for each batch
