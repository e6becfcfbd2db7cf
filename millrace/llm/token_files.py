"""Token-id files: documents in ascending id order, a Re-Pair grammar for each shard.

The documents are dealt by ranges of doc_id, so the files of the table, in order, hold the
stream in order. Each row of the table is one shard: its place, its least and largest doc_id and the grammar blob
(see repair.py). The table is written by Spark's own commit protocol; a lost executor's
shards are written again and never twice.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first; rows
that share a doc_id are separate documents, ordered by a hash of their texts, and may be parted into
several ranges; an empty table gives no shard; other columns are ignored. A text of any length is encoded whole, and a shard holds
whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import repair
from millrace.llm.text_batches import slices, text_column
from millrace.llm.word_ids import encoder
from millrace.storage import scratch_path

SHARD = "part long, shard long, start long, n_docs long, n_ids long, first_doc long, last_doc long, grammar binary"


def in_id_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id, rows of one doc_id by a hash of the text; each range in order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("own")).repartitionByRange(parts, "doc_id", "own")
    return placed.sortWithinPartitions("doc_id", "own", "text").select("doc_id", "text")


def encoded(part: pa.RecordBatch, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text with the end id, and where each text's begin."""
    ids, offsets = encoder(path).encode(text_column(part))
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int = 2, shard_ids: int = 1 << 20) -> None:
    """Writes the table of shards; a shard closes once it has shard_ids ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        held: list = []

        def close() -> pa.RecordBatch:
            nonlocal shard, start
            ids = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([np.diff(x[1]) for x in held])
            known = pa.chunked_array([x[2] for x in held])
            doc_ids, valid = known.fill_null(0).to_numpy(), known.is_valid().to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)])
            blob = repair.to_bytes(repair.compress(ids, first, doc_ids, valid, len(encoder(vocabulary).ends_word)))
            ends = [int(x) for x in doc_ids[valid][[0, -1]]] if valid.any() else [None, None]
            row = [part, shard, start, len(sizes), len(ids), *ends, blob]
            held.clear()
            shard, start = shard + 1, start + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if v is blob else pa.int64()) for v in row], [c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            for piece in slices(batch, most=4 << 20):
                held.append((*encoded(piece, vocabulary, end), piece.column(0)))
                if sum(len(x[0]) for x in held) >= shard_ids:
                    yield close()
        if held:
            yield close()
        encoder(vocabulary).rest()

    in_id_order(docs).mapInArrow(run, SHARD).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema(SHARD).parquet(path)
    # one row for each range of the writer: its number of shuffle partitions bounds what is broadcast
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = shards.join(F.broadcast(parts), "part").select((F.col("before") + F.col("start")).alias("start"), "grammar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = repair.from_bytes(blob.as_buffer())
                ids = repair.expand(g).astype("<u4")
                at = g.first_id
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(g.doc_ids, mask=~g.valid), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens_of(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, ids) of the documents from first to last, both included.

    Shards of other ranges aren't read, and of a shard the wanted documents alone are expanded, by the
    lengths that are stored beside the rules.
    """
    shards = spark.read.schema(SHARD).parquet(path).where((F.col("last_doc") >= first) & (F.col("first_doc") <= last)).select("grammar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                g = repair.from_bytes(blob.as_buffer())
                for k in np.flatnonzero(g.valid & (g.doc_ids >= first) & (g.doc_ids <= last)):
                    yield pa.RecordBatch.from_arrays([pa.array([int(g.doc_ids[k])], pa.int64()), pa.array([repair.ids_at(g, int(k))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Writes the files into the scratch folder and reads the documents back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, end)
    return read_token_files(docs.sparkSession, path)
