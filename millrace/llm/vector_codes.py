"""Product codes of vectors: PARTS bytes a vector, from codebooks fitted by treeAggregate.

Vectors are kept as integers floor(1024 * x), in blocks of a written table: one block for each batch
of rows and length, its components stored one after the other, so that each is an array. A round is
one RDD.treeAggregate over the blocks. A block's distances to all entries of a codebook accumulate
component by component; np.add.at then adds the parts and their number to int64 tensors of sums and
counts (part, entry, component), and the tensors of blocks merge through a tree. A tensor is as
large as the codebooks, whatever the number of vectors, and the driver sees one of them a round. A
lost executor costs the blocks it was at, which are read again.

Defined cases: vectors that are null or hold a null or non-finite component have no row; part p of d
components covers those from p * d // PARTS up to (p + 1) * d // PARTS, equal parts where PARTS divides
d; vectors of another length have codebooks of their own, started from their own smallest vec_ids;
an empty vector has the code of entry 0 and no error; fewer vectors than ENTRIES make as many entries;
rows that share a vec_id count as rows and start in the order of their integers, null vec_ids last;
integers are held to what keeps a squared distance within 63 bits (2^27.5 at 64 components); a
label's error beyond 63 bits is null; an empty table gives no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.llm.integer_vectors import complete, integers
from millrace.storage import written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors whose distances to a codebook are held at once.
ROOM = 4096

#: By length of vectors: for each part an array (entry, component).
Codebooks = dict[int, list[np.ndarray]]
#: By length of vectors: for each part the sums (entry, component) and the counts (entry).
Tensors = dict[int, list[tuple[np.ndarray, np.ndarray]]]


def cuts(d: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]


def nearest_entry(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each vector; columns: (component, vector)."""
    index, least = np.zeros(columns.shape[1], np.int64), np.zeros(columns.shape[1], np.int64)
    for lo in range(0, columns.shape[1], ROOM):
        some = columns[:, lo : lo + ROOM]
        distance = np.zeros((some.shape[1], len(entries)), np.int64)
        for x, e in zip(some, entries.T, strict=True):
            difference = x[:, None] - e
            distance += difference * difference
        index[lo : lo + ROOM] = distance.argmin(1)  # the lower index where distances tie
        least[lo : lo + ROOM] = distance.min(1)
    return index, least


def block_columns(block: Row) -> np.ndarray:
    """A block as an array (component, vector) of integers."""
    return np.frombuffer(block["columns"], f"<i{block['width']}").reshape(block["d"], block["n"]).astype(np.int64)


def add_block(sums: Tensors, block: Row, books: Codebooks) -> Tensors:
    """sums with the parts of a block added to their nearest entries."""
    d, columns = block["d"], block_columns(block)
    own = sums.setdefault(d, [(np.zeros(e.shape, np.int64), np.zeros(len(e), np.int64)) for e in books[d]])
    for (lo, hi), entries, (total, count) in zip(cuts(d), books[d], own, strict=True):
        index, _ = nearest_entry(columns[lo:hi], entries)
        np.add.at(total, index, columns[lo:hi].T)
        np.add.at(count, index, 1)
    return sums


def merge(a: Tensors, b: Tensors) -> Tensors:
    for d, parts in b.items():
        a[d] = [(s + t, m + n) for (s, m), (t, n) in zip(a[d], parts, strict=True)] if d in a else parts
    return a


def moved(books: Codebooks, sums: Tensors) -> Codebooks:
    """The codebooks of the means; an entry without parts stays."""
    mean = lambda e, total, count: np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], e)
    return {d: [mean(e, *own) for e, own in zip(parts, sums[d], strict=True)] if d in sums else parts for d, parts in books.items()}


def block_table(vectors: DataFrame) -> DataFrame:
    """(d, n, width, columns, vec_id, label): blocks of integers, with the ids and labels of their vectors."""
    kind = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                v = integers(part.column(2), d).T
                most = int(np.abs(v).max(initial=0))
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                columns = [pa.array([d], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([width], pa.int32()), pa.array([np.ascontiguousarray(v).astype(f"<i{width}").tobytes()], pa.binary()), whole(part.column(0)), whole(part.column(1))]
                yield pa.RecordBatch.from_arrays(columns, ["d", "n", "width", "columns", "vec_id", "label"])

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(complete(F.col("x")))
    return written(rows.mapInArrow(run, f"d int, n int, width int, columns binary, vec_id array<{kind['vec_id']}>, label array<{kind['label']}>"), "vector-blocks")


def first_codebooks(vectors: DataFrame, lengths: list[int]) -> Codebooks:
    """The parts of the ENTRIES smallest vec_ids of each length."""
    rows, books = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(complete(F.col("x"))), {}
    for d in lengths:
        whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v, F.lit(2.0**50)), F.lit(-(2.0**50))) * 1024))
        first = rows.where(F.size("x") == d).orderBy(F.col("vec_id").asc_nulls_last(), whole).limit(ENTRIES).select("x").collect()
        v = integers(pa.array([r["x"] for r in first], pa.list_(pa.float64())), d)
        books[d] = [v[:, lo:hi] for lo, hi in cuts(d)]
    return books


def codebook_digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for entries in parts for x in entries.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    blocks = block_table(vectors)
    lengths = [r["d"] for r in blocks.groupBy("d").agg(F.count("*")).collect()]  # one number for each length
    books = first_codebooks(vectors, lengths)
    for _ in range(rounds if lengths else 0):
        sent = spark.sparkContext.broadcast(books)
        sums = blocks.select("d", "n", "width", "columns").rdd.treeAggregate({}, lambda s, b, now=sent: add_block(s, b, now.value), merge)
        books = moved(books, sums)
        sent.unpersist()
    digests = {d: codebook_digest(parts) for d, parts in books.items()}
    final = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = {name: batch.column(i)[k].as_py() for i, name in enumerate(("d", "n", "width", "columns"))}
                columns, d = block_columns(block), block["d"]
                found = [nearest_entry(columns[lo:hi], e) for (lo, hi), e in zip(cuts(d), final.value[d], strict=True)]
                code = np.stack([index for index, _ in found], 1).astype(np.uint8)
                ids, labels = (batch.column(i)[k].values for i in (4, 5))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(e for _, e in found)), pa.array([digests[d]] * len(ids), pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = dict(vectors.dtypes)
    coded = written(blocks.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long, codebooks_sha256 string"), "vector-codes")
    # partial sums of a label meet in one row, and are written so that the join of a hot label can be split
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = written(coded.groupBy("label").agg(F.when(total <= 2**63 - 1, total).cast("long").alias("label_error")), "label-errors").withColumnRenamed("label", "own")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
