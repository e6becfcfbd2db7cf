"""Nearest neighbours by inner product over an inverted multi-index.

Vectors are cut into halves, each quantised by a codebook of its own, so that K centroids a half make
K * K cells of about CELL vectors. For a query the sums of its halves' products with the centroids order the cells; a heap gives
them from the best on, without sorting all pairs. The search goes over them twice. First the cells up to FIRST
vectors are reranked by exact products, which bounds the query's k-th answer from below by t. Then the
traversal goes on. A vector differs from the sum of its cell by the product of the query with a residual, nearly
normal, whose deviation follows from the mean residuals of the cell's two centroids; so each cell is known to
hold about so many vectors above t, and the traversal ends when the cells that are left hold no more than the share MISSED of all of them.
Nothing caps candidates: the denser a query's surroundings and the smaller the residuals, the
fewer cells there are to look at; vectors without any structure have most cells looked at.

Codebooks are fitted on a hashed sample of about SAMPLE vectors, MOST centroids at most; every vector is
indexed. The model with the sizes of its cells, K * K numbers, is sent to the tasks. Cells with the same
first centroid make a shelf. A task has up to BLOCK vectors of a shelf, the only rows it holds, and the
queries that look there stream by, QUERY_BLOCK of them at most; a fuller shelf is dealt to more tasks.

Equal vectors are one entry with their k + 1 least ids, as no more can be in an answer, and equal
queries are searched once. Scores are sums of products in double precision, component by component.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null vec_id, take no part; only vectors of one length are compared; repeated rows count once;
a query finds no row of its own vec_id; rows that share a vec_id with different vectors are searched
and found each; ties go to the smaller vec_id; fewer candidates give fewer answers, an empty table none;
products beyond the range of doubles aren't defined; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.integer_vectors import complete, rows_of
from millrace.storage import written

K, CELL, FIRST, SAMPLE, MOST, MISSED, SEED = 20, 100, 1024, 1 << 15, 512, 0.05, 5
BLOCK, QUERY_BLOCK = 1 << 16, 1 << 16
#: Queries of a task, and vectors of a cell, whose products are held at once.
ASKED, HELD = 256, 8192
ROUNDS = 8
#: Deviations, and the share of a normal distribution above each.
TAIL = np.linspace(-8, 8, 3201), np.array([math.erfc(x / math.sqrt(2)) / 2 for x in np.linspace(-8, 8, 3201)])


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows of x, or as many as there are rows."""
    centroids = x[np.random.default_rng(SEED).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = quantised(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def quantised(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    norms = (centroids * centroids).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((norms - 2 * x[lo : lo + 2048] @ centroids.T).argmin(1) for lo in range(0, len(x), 2048))])


@dataclass
class MultiIndex:
    """Codebooks of both halves, mean squared residuals of their centroids, and the sizes of cells (first, second)."""

    codebooks: tuple[np.ndarray, np.ndarray]
    residuals: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, k: int) -> MultiIndex:
        books, residuals = [], []
        for half in halves(x):
            book = codebook(half, k)
            own = quantised(half, book)
            square = np.bincount(own, ((half - book[own]) ** 2).sum(1), len(book))
            books.append(book)
            residuals.append(square / np.maximum(1, np.bincount(own, minlength=len(book))))
        return cls(tuple(books), tuple(residuals), np.zeros((len(books[0]), len(books[1])), np.int64))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(quantised(half, book) for half, book in zip(halves(x), self.codebooks, strict=True))

    def from_best(self, products: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, int, int]]:
        """(sum, first, second) of all cells in falling order of the sum of a query's products with centroids."""
        order = [np.argsort(-p, kind="stable").tolist() for p in products]
        a, b = (p[o].tolist() for p, o in zip(products, order, strict=True))
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            yield -s, order[0][i], order[1][j]
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def looked_at(self, queries: np.ndarray, bounds: np.ndarray | None, k: int = K) -> Iterator[tuple[int, int, list[int]]]:
        """(query, shelf, second centroids) of the cells up to FIRST vectors, or with bounds of the further ones that matter."""
        products = [half @ book.T for half, book in zip(halves(queries), self.codebooks, strict=True)]
        spread = [(half * half).sum(1) / max(1, half.shape[1]) for half in halves(queries)]
        for q in range(len(queries)):
            own, seen, shelves, missed, least, sizes = tuple(p[q] for p in products), 0, {}, 0.0, 0.0, self.sizes
            if bounds is not None:
                sigma = np.sqrt(np.add.outer(self.residuals[0] * spread[0][q], self.residuals[1] * spread[1][q]))
                expected = sizes * above((bounds[q] - np.add.outer(*own)) / np.maximum(sigma, 1e-12))
                missed = expected.sum()
                least = MISSED * max(k, missed)
            for _, i, j in self.from_best(own):
                first = seen < FIRST
                if not first and missed <= least:
                    break
                if bounds is not None:
                    missed -= expected[i, j]
                seen += sizes[i, j]
                if sizes[i, j] and first == (bounds is None):
                    shelves.setdefault(i, []).append(j)
            for i, js in shelves.items():
                yield q, i, js


def above(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above x deviations."""
    return np.interp(x, TAIL[0], TAIL[1])


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


class Shelf:
    """A task's vectors, by their second centroid."""

    def __init__(self, x: np.ndarray, second: np.ndarray, ids: pa.ListArray):
        order = np.argsort(second, kind="stable")
        self.x, self.ids, self.start = x[order], ids.take(pa.array(order)), np.searchsorted(second[order], np.arange(int(second.max(initial=-1)) + 2))

    def best(self, queries: np.ndarray, seconds: list[list[int]], bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of the k best vectors of each query in its cells, and what is within rounding of them."""
        bounds, found, visitors = bounds.copy(), [], {}
        for q, js in enumerate(seconds):
            for j in js:
                visitors.setdefault(j, []).append(q)
        for j, qs in visitors.items():
            qs = np.array(qs)
            lo, hi = (self.start[j], self.start[j + 1]) if j + 1 < len(self.start) else (0, 0)
            for at in range(lo, hi, HELD):
                x = self.x[at : min(hi, at + HELD)]
                scores = queries[qs] @ x.T
                if len(x) >= k:
                    bounds[qs] = np.maximum(bounds[qs], np.partition(scores, len(x) - k, axis=1)[:, len(x) - k])
                least = bounds[qs] - 1e-9 * (1 + np.abs(np.where(np.isfinite(bounds[qs]), bounds[qs], 0)))
                q, e = np.nonzero(scores >= least[:, None])
                found.append((qs[q], e + at, scores[q, e]))
        q, e, s = (np.concatenate([np.zeros(0, t), *(f[n] for f in found)]) for n, t in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((-s, q))
        q, e, s = q[order], e[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.full(len(queries), -np.inf)
        last[q[place == k - 1]] = s[place == k - 1]
        near = s >= (last - 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0))))[q]
        q, e = q[near], e[near]
        score = np.zeros(len(q))
        for d in range(queries.shape[1]):
            score += queries[q, d] * self.x[e, d]
        return q, e, score


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, same): rows that take part; same is a digest of the vector."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & complete(F.col("x")) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False)))
    return rows.withColumn("same", F.md5(F.to_json(F.struct("x"))))


def distinct_vectors(rows: DataFrame, ids: int, name: str) -> DataFrame:
    """(node, d, same, x, ids) of each different vector: its `ids` least vec_ids, none for 0; written."""
    out = rows.groupBy("same").agg(F.first("x").alias("x"))
    if ids:
        # the rank limits a hot vector to a few ids in each map task, before the shuffle
        rank = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
        least = rows.select("same", "vec_id").distinct().withColumn("rank", rank).where(F.col("rank") <= ids)
        out = out.join(least.groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "same")
    return written(out.select(F.monotonically_increasing_id().alias("node"), F.size("x").alias("d"), "*"), name)


def indexed(entries: DataFrame, n: int, d: int) -> tuple[DataFrame, MultiIndex]:
    """((node, x, ids, first, second) of the entries of length d, the model with the sizes of its cells)."""
    k = int(np.clip(round((n / CELL) ** 0.5), 1, MOST))
    own = entries.where(F.col("d") == d)
    some = own.where(F.pmod(F.xxhash64("same", F.lit(SEED)), F.lit(n)) < SAMPLE).select("x").toArrow()  # about SAMPLE rows
    if not some.num_rows:
        some = own.select("x").limit(SAMPLE).toArrow()
    model = MultiIndex.fitted(rows_of(some["x"].combine_chunks(), d), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = model.cells(rows_of(b.column(1), d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))], ["node", "x", "ids", "first", "second"])

    kind = dict(entries.dtypes)["ids"]
    placed = written(own.select("node", "x", "ids").mapInArrow(run, f"node long, x array<double>, ids {kind}, first int, second int"), "multi-index")
    cells = placed.groupBy("first", "second").count().groupBy("first").agg(F.collect_list("second").alias("second"), F.collect_list("count").alias("n"))
    for r in cells.collect():  # K rows of K cells at most
        model.sizes[r["first"], r["second"]] = r["n"]
    return placed, model


def reranked(placed: DataFrame, queries: DataFrame, model: MultiIndex, d: int, k: int, further: bool) -> DataFrame:
    """(query, vec_id, score): the k best rows that each query (node, x, bound) finds in each task of its shelves."""
    spark = placed.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ASKED):
                part = b.slice(lo, ASKED)
                x, bounds = rows_of(part.column(1), d), part.column(2).to_numpy()
                rows = list(sent.value.looked_at(x, bounds if further else None, k))
                q = pa.array([r[0] for r in rows], pa.int64())
                columns = [part.column(i).take(q) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["node", "x", "bound", "first", "seconds"])

    asked = written(queries.select("node", "x", "bound").mapInArrow(traverse, "node long, x array<double>, bound double, first int, seconds array<int>"), "cells-looked-at")
    # a row for each shelf, MOST at most
    blocks = placed.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asking = asked.groupBy("first").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asking"))
    shelves = F.broadcast(blocks.join(F.broadcast(asking), "first"))
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(SEED)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ids = dict(placed.dtypes)["ids"]
    left = placed.join(shelves, "first").withColumn("block", dealt("blocks")).withColumn("ask", every("asking"))
    right = asked.join(shelves, "first").withColumn("block", every("blocks")).withColumn("ask", dealt("asking"))
    task = F.xxhash64("first", "block", "ask").alias("task")
    left = left.select(task, F.lit(0).alias("kind"), "node", "x", "second", "ids", F.lit(None).cast("array<int>").alias("seconds"), F.lit(None).cast("double").alias("bound"))
    right = right.select(task, F.lit(1).alias("kind"), "node", "x", F.lit(0).alias("second"), F.lit(None).cast(ids).alias("ids"), "seconds", "bound")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shelf = None, [], None
        for batch in batches:
            task, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((task[1:] != task[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(task)]])
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if task[lo] != now:
                    now, held, shelf = task[lo], [], None
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if shelf is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held).combine_chunks()
                    shelf, held = Shelf(rows_of(t["x"].chunk(0), d), t["second"].to_numpy(), t["ids"].chunk(0)), []
                for at in range(lo, hi, ASKED):
                    part = batch.slice(at, min(ASKED, hi - at))
                    q, e, score = shelf.best(rows_of(part.column(3), d), part.column(6).to_pylist(), part.column(7).to_numpy(), k)
                    hits = shelf.ids.take(pa.array(e))
                    each = pa.compute.list_parent_indices(hits).to_numpy()
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(q[each])), hits.flatten(), pa.array(score[each])], ["query", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return left.union(right).repartition(parts, "task").sortWithinPartitions("task", "kind").mapInArrow(rerank, f"query long, vec_id {ids.removeprefix('array<').removesuffix('>')}, score double")


def best_rows(hits: DataFrame, k: int) -> DataFrame:
    """hits with their rank, the k best of each query."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_by_product(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest candidates found for each query, both rows (vec_id, embedding)."""
    entries = distinct_vectors(usable(candidates), k + 1, "entries")
    rows = usable(queries)
    asked = distinct_vectors(rows, 0, "queries")
    found = []
    for length in entries.groupBy("d").count().collect():  # a row for each length
        d = length["d"]
        placed, model = indexed(entries, length["count"], d)
        own = asked.where(F.col("d") == d).select("node", "x")
        probed = written(best_rows(reranked(placed, own.withColumn("bound", F.lit(float("-inf"))), model, d, k + 1, False), k + 1), "probed")
        bounds = probed.where(F.col("rank") == k + 1).select(F.col("query").alias("node"), F.col("score").alias("bound"))
        own = own.join(bounds, "node", "left").fillna(float("-inf"), ["bound"])
        found += [probed.drop("rank"), reranked(placed, own, model, d, k + 1, True)]
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    best = best_rows(reduce(DataFrame.union, found), k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    # written, so that the join of many equal queries can be split
    best = written(asked.select("same", F.col("node").alias("query")).join(best, "query").select("same", "best"), "answers")
    answers = rows.select(F.col("vec_id").alias("query_id"), "same").distinct().join(best, "same")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    shown = answers.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return shown.select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", "hit.score")
