"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into four segments of 16 bits, each with an index. A query's probes grow
radius by radius: at radius r each segment index is asked for all values at distance r from the
query's segment. A code that differs in fewer than 4 (r + 1) bits has some segment within r, so
after radius r everything below that distance has been seen and verified; a query is done once
its k-th verified distance is below 4 (r + 1).

Codes are dealt into blocks of about BLOCK codes, for which 16-bit segments are the right size,
and queries into blocks as well; a task searches one block for one block of queries. Of each block
the codes that cover its k best rows, with all codes that tie with the last, meet in a last aggregation.
Memory is bounded by the two blocks, however the codes are distributed.

Rows of equal codes are one entry with its k least ids: no more of them can be in an answer.
Ties are broken by id. Vectors that are null or hold null or NaN components have no code and are
neither found nor answered; a query finds its own row too, at distance 0. Fewer than k rows give
fewer answers; rows that repeat an id count once; an empty table gives no row. The binary code
of a vector has the sign of its component number i at bit i, from 64 components on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text_batches import ragged
from millrace.storage import written

K, SEGMENTS, WIDTH, BLOCK, QUERY_BLOCK = 10, 4, 16, 1 << 16, 1 << 14
#: Candidates verified at once.
ROOM = 1 << 21


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(id, code) of vectors of at least 64 components: bit i is 1 if component i is above zero."""
    x = F.col("embedding")
    fine = F.coalesce((F.size(x) >= 64) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False)) & F.col("vec_id").isNotNull()
    bit = lambda i: F.when(F.get(x, i) > 0, F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long")
    code: Column = functools.reduce(lambda a, b: a.bitwiseOR(b), (bit(i) for i in range(64)))
    return vectors.where(fine).select(F.col("vec_id").alias("id"), code.alias("code"))


@functools.cache
def masks(radius: int) -> np.ndarray:
    """All segment values of so many bits."""
    values = np.arange(1 << WIDTH)
    return values[np.bitwise_count(values) == radius]


def search_block(codes: np.ndarray, weight: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) index triples: for each query the nearest codes, whole ties included.

    weight: rows behind each code, at most k; codes are taken until k rows are covered.
    """
    segments = lambda x: [(x >> np.uint64(WIDTH * s) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for s in range(SEGMENTS)]
    tables = []
    for values in segments(codes):
        order = np.argsort(values, kind="stable")
        tables.append((order, np.searchsorted(values[order], np.arange((1 << WIDTH) + 1))))
    probes = segments(queries)
    open_, best = np.arange(len(queries)), np.zeros((0, 3), np.int64)
    bound = np.full(len(queries), 64)  # distance of each query's k-th row so far
    for radius in range(WIDTH + 1):
        flips, found = masks(radius), [best]
        for s, (order, begin) in enumerate(tables):
            step = max(1, ROOM // max(1, len(flips) * max(1, len(codes) >> WIDTH)))
            for lo in range(0, len(open_), step):
                q = open_[lo : lo + step]
                value = (probes[s][q][:, None] ^ flips).reshape(-1)
                n = begin[value + 1] - begin[value]
                hit = np.flatnonzero(n)
                owner = np.repeat(np.repeat(q, len(flips))[hit], n[hit])
                at = order[ragged(begin[value[hit]], n[hit])]
                distance = np.bitwise_count(codes[at] ^ queries[owner]).astype(np.int64)
                near = distance <= bound[owner]
                found.append(np.stack([owner[near], distance[near], at[near]], 1))
        best = np.unique(np.concatenate(found), axis=0)  # by query, distance, code
        first = np.searchsorted(best[:, 0], np.arange(len(queries)))
        total = np.concatenate([[0], np.cumsum(weight[best[:, 2]])])
        enough = total[1:] - total[first[best[:, 0]]] >= k  # rows up to and with this code
        np.minimum.at(bound, best[enough, 0], best[enough, 1])
        best = best[best[:, 1] <= bound[best[:, 0]]]
        # everything below SEGMENTS * (radius + 1) has been seen
        open_ = open_[bound[open_] >= SEGMENTS * (radius + 1)]
        if not len(open_):
            break
    return best[:, 0], best[:, 2], best[:, 1]


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of codes (id, code) for each row of queries (id, code)."""
    # the rank limits a hot code to k rows in each map task, before the shuffle
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = codes.select("code", "id").distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    ids = ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ids = written(ids, "codes")
    asked = written(queries.groupBy("code").agg(F.count("*").alias("n")).select("code"), "query-codes")
    blocks = max(1, -(-ids.count() // BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    mixed = lambda n: F.pmod(F.xxhash64("code", F.lit(3)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ids.select("code", F.size("ids").alias("rows"), mixed(blocks).alias("block"), every(query_blocks).alias("ask"))
    right = asked.select("code", F.lit(0).alias("rows"), every(blocks).alias("block"), mixed(query_blocks).alias("ask"))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        rows, code = t["rows"].to_numpy(), t["code"].to_numpy()
        have, ask = code[rows > 0], code[rows == 0]
        if len(have) and len(ask):
            q, c, d = search_block(have.view(np.uint64), rows[rows > 0], ask.view(np.uint64), k)
            yield pa.RecordBatch.from_arrays([pa.array(ask[q]), pa.array(have[c]), pa.array(d)], ["query", "code", "distance"])

    # a group is one block of codes and one of queries, both of bounded size
    near = left.union(right).groupBy("block", "ask").applyInArrow(run, "query long, code long, distance long")
    hits = near.join(ids, "code").select("query", "distance", F.explode("ids").alias("id"))
    # the rank leaves k rows of a query in each task before the shuffle, however many tie at its bound
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    answers = hits.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("query", "code")
    answers = answers.join(queries.select(F.col("id").alias("query_id"), "code").distinct(), "code")
    return answers.select("query_id", "rank", "id", "distance")
