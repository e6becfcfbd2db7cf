"""Tokenizers behind one contract: encode, decode, vocabulary size, end id, byte lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import encode


class Tokenizer(Protocol):
    vocab_size: int
    end_id: int

    def encode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        """(key, ids)."""

    def decode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        """(key, text) of rows (key, ids)."""

    def byte_lengths(self) -> DataFrame:
        """(id, bytes)."""


class _Listed:
    """A tokenizer whose vocabulary is a table (piece, id)."""

    joiner = ""

    def __init__(self, pieces: DataFrame):
        self.pieces = pieces.select("piece", F.col("id").cast("int").alias("id"))
        self.vocab_size = self.pieces.count() + 1
        self.end_id = self.vocab_size - 1

    def decode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        each = df.select(F.col(key), F.posexplode_outer(column).alias("pos", "token_id")).join(self.pieces.withColumnRenamed("id", "token_id"), "token_id", "left")
        parts = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
        return each.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), self.joiner).alias("text"))

    def byte_lengths(self) -> DataFrame:
        return self.pieces.select("id", F.octet_length("piece").alias("bytes"))


class WordTokenizer(_Listed):
    """Words by falling frequency; decoding joins them with spaces. Unknown words are left out."""

    joiner = " "

    def __init__(self, corpus: DataFrame, column: str):
        super().__init__(encode.word_vocabulary(corpus, column).withColumnRenamed("token", "piece"))

    def encode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        return encode.encode_words(df, key, column, self.pieces.withColumnRenamed("piece", "token")).select(key, "ids")


class CharacterTokenizer(_Listed):
    """Characters in code-point order; an unknown one raises."""

    def __init__(self, corpus: DataFrame, column: str):
        found = corpus.select(F.explode(text.characters(F.col(column))).alias("piece")).distinct()
        super().__init__(encode.ranked(found, "id", F.col("piece").asc()))

    def encode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        return encode.encode_characters(df, key, column, self.pieces.withColumnRenamed("piece", "ch"))


class ByteBpeTokenizer:
    """Byte-pair ids from a rank file of the tiktoken library and its pattern, in Arrow batches."""

    def __init__(self, spark, path: str, pattern: str):
        self.spark, self.path, self.pattern = spark, path, pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.end_id = max(self.ranks.values()) + 1
        self.vocab_size = self.end_id + 1

    def _model(self):
        path, pattern = self.path, self.pattern

        def make():
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        return make

    def _apply(self, column: Column, kind: str, method: str) -> Column:
        make = self._model()

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            apply = getattr(make(), method)
            for batch in batches:
                yield batch.map(lambda x: apply(x if isinstance(x, str) else [] if x is None else list(x)) if x is not None or method == "decode" else [])

        return run(column)

    def encode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        return df.select(key, self._apply(F.coalesce(F.col(column), F.lit("")), "array<int>", "encode_ordinary").alias("ids"))

    def decode(self, df: DataFrame, key: str, column: str) -> DataFrame:
        return df.select(key, self._apply(F.col(column), "string", "decode").alias("text"))

    def byte_lengths(self) -> DataFrame:
        return self.spark.createDataFrame([(i, len(b)) for b, i in self.ranks.items()], "id int, bytes int")
