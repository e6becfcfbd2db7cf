"""Clustering around centroids in whole numbers, by partial-distance search.

Vectors of DIMENSIONS components are kept as integers floor(1024 * x). Squared differences are added
up over the components of highest variance first, STEP of them at a time. Of each vector the centroid
that leads after the first step is finished, and sets the least distance so far; every other centroid
is abandoned once its sum is strictly above that, and what survives goes through all components. A
partial sum never exceeds the whole, so an abandoned centroid is farther, and the result is that of a
full search, ties to the smaller number included.

A round is one pass over a written table of integers: each task assigns its vectors and gives one sum
for each centroid and component, whatever number of vectors a centroid has; these meet in an
aggregation of CLUSTERS * DIMENSIONS rows, the only thing that the driver sees. Sums, distances and
means are exact integers, so the order of tasks doesn't show.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component have
no row; fewer vectors than CLUSTERS make as many centroids as vectors; repeated rows, and rows that
share a vec_id, count as rows, and where their hashes tie at the start the smaller integer vector comes
first; a null vec_id is clustered, but starts a centroid only where other vectors don't suffice;
an integer beyond 2^27.5, that is a component beyond 185 000, is held there, so that no distance
leaves 63 bits; an inertia beyond them is null; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.integer_vectors import complete, integers, rows_of
from millrace.storage import written

CLUSTERS, ROUNDS, DIMENSIONS, SEED, STEP = 8, 10, 64, 3, 8


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of integers; order: components, widest first."""
    columns, centroids = np.ascontiguousarray(x.T[order]), centroids[:, order]
    n, every = len(x), np.arange(len(x))

    def more(sums: np.ndarray, which: np.ndarray, c: np.ndarray | int, start: int) -> None:
        for d in range(start, min(start + STEP, len(order))):
            sums += (columns[d][which] - centroids[c, d]) ** 2

    heads = np.zeros((len(centroids), n), np.int64)
    for c in range(len(centroids)):
        more(heads[c], every, c, 0)
    lead = heads.argmin(0)
    best, least = lead.copy(), heads[lead, every]
    for start in range(STEP, len(order), STEP):
        more(least, every, lead, start)
    for c in range(len(centroids)):
        open_ = np.flatnonzero((lead != c) & (heads[c] <= least))
        sums = heads[c][open_]
        for start in range(STEP, len(order), STEP):
            if not len(open_):
                break
            more(sums, open_, c, start)
            on = sums <= least[open_]
            open_, sums = open_[on], sums[on]
        closer = (sums < least[open_]) | ((sums == least[open_]) & (c < best[open_]))
        best[open_[closer]], least[open_[closer]] = c, sums[closer]
    return best, least


def integer_table(vectors: DataFrame, d: int) -> DataFrame:
    """(vec_id, v): the vectors of d components in whole numbers, as a written table."""
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = integers(b.column(1), d)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * d), pa.array(v.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["vec_id", "v"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where((F.size("x") == d) & complete(F.col("x")))
    return written(rows.mapInArrow(run, f"vec_id {kind}, v array<int>"), "integer-vectors")


def widest_first(table: DataFrame, d: int) -> np.ndarray:
    """Components in falling order of variance over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(d), np.zeros(d)
        for b in batches:
            v = rows_of(b.column(0), d).astype(np.float64)
            n, s, ss = n + len(v), s + v.sum(0), ss + (v * v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s), pa.array(ss)], ["pos", "n", "s", "ss"])

    sums = table.select("v").mapInArrow(run, "pos int, n long, s double, ss double").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    variance = {r["pos"]: r["ss"] / max(1, r["n"]) - (r["s"] / max(1, r["n"])) ** 2 for r in sums.collect()}  # d rows
    return np.array(sorted(range(d), key=lambda i: (-variance.get(i, 0.0), i)))


def first_centroids(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and vec_id, in the order of these."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_sums(table: DataFrame, centroids: np.ndarray, assign: Callable) -> dict[tuple[int, int], tuple[int, int]]:
    """(sum, count) of each centroid with vectors, by number and component."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v = rows_of(b.column(0), d).astype(np.int64)
            own = assign(v)[0]
            for c in range(k):
                sums[c] += v[own == c].sum(0)
            counts += np.bincount(own, minlength=k)
        used = np.repeat(counts > 0, d)
        columns = [np.repeat(np.arange(k, dtype=np.int32), d), np.tile(np.arange(d, dtype=np.int32), k), sums.reshape(-1), np.repeat(counts, d)]
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["cluster", "pos", "s", "n"])

    parts = table.select("v").mapInArrow(run, "cluster int, pos int, s long, n long")
    return {(r["cluster"], r["pos"]): (r["s"], r["n"]) for r in parts.groupBy("cluster", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # k * d rows


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, d: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    table = integer_table(vectors, d)
    order = widest_first(table, d)
    centroids = first_centroids(table, k, seed)

    def with_centroids(now: np.ndarray) -> Callable:
        return lambda v: nearest(v, now, order)

    for _ in range(rounds if len(centroids) else 0):
        sums = cluster_sums(table, centroids, with_centroids(centroids))
        mean = lambda c, i, old: sums[c, i][0] // sums[c, i][1] if (c, i) in sums else old  # noqa: E731, B023
        centroids = np.array([[mean(c, i, int(old)) for i, old in enumerate(row)] for c, row in enumerate(centroids)], np.int64)
    assign = with_centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, distance = assign(rows_of(b.column(1), d).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = written(table.mapInArrow(run, f"vec_id {dict(table.dtypes)['vec_id']}, cluster int, distance long"), "clusters")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    total, long = sum(int(r["inertia"]) for r in sums), lambda n: n if n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    about = [(r["cluster"], long(int(r["inertia"])), long(total), digest[r["cluster"]]) for r in sums]
    about = out.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
