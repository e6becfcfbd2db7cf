"""Logistic regression over more terms than a driver should be sent: nothing as long as the vocabulary or the rows leaves the tasks.

The weights of a regularised fit are a sum of its rows, so a step is known by a number for each row (a), and
what it does to each row by another (ka, the rows' products with those weights). Cells are dealt by
terms, whole terms to a pack; rows' numbers go to every part, each part works out its own terms' weights and sends
back what they add to each row. Steps are conjugate gradients (Polak-Ribiere, restarted where they don't descend) over
terms divided by their standard deviations, which the penalty is on; the driver sees sums alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import drop_path, free_shuffles, scratch_path, written

#: Steps after which the rows' numbers are written and read back, so that the shuffles before are freed.
CUT = 5
#: Rows of a chunk, cells of a pack (more where a single term has more), and lengths of a step that are tried.
CHUNK, CELLS, LENGTHS = 1 << 16, 1 << 20, 1e-6 * 1.5 ** np.arange(60)
PACK = "part int, slots binary, starts binary, scales binary, rows binary, xs binary"


def _packs(total: float, squares: float, most: int = CELLS):
    """Packs of cells (slot, row, x, weight) that come by slots; xs are divided by their slot's standard deviation."""

    def pack(cells: list[np.ndarray]) -> pa.RecordBatch:
        slot, row, x, weight = cells
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        squared = np.add.reduceat(weight * x * x, starts)
        left = squared - np.add.reduceat(weight * x, starts) ** 2 / total
        varies = left > 1e-12 * squared
        scales = np.where(varies, 1 / np.sqrt(np.where(varies, left, 1) / (total - squares / total)), 0.0)
        xs = x * np.repeat(scales, np.diff(np.append(starts, len(slot))))
        parts = [slot[starts].astype("<i4"), starts.astype("<i8"), scales.astype("<f8"), row.astype("<i4"), xs.astype("<f8")]
        values = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in PACK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                cells = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(cells[0], cells[0][-1]))  # the last term may go on
                if cut:
                    yield pack([c[:cut] for c in cells])
                held = [[c[cut:] for c in cells]]
                n = len(held[0][0])
        if n:
            yield pack([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _unpacked(r) -> tuple:
    return r.part, tuple(np.frombuffer(bytes(v), kind) for v, kind in zip(r[1:], ("<i4", "<i8", "<f8", "<i4", "<f8"), strict=True))


def _with_packs(vector: RDD, packs: RDD, parts: int, n: int, use) -> RDD:
    """use(rows' numbers, packs) of each part: the numbers (chunk, array) go to all parts, the packs stay where they are."""
    sent = vector.flatMap(lambda kv: [(part, kv) for part in range(parts)]).partitionBy(parts)

    def run(rows: Iterator) -> Iterator:
        numbers = np.zeros(n)

        def packed() -> Iterator:
            for _, value in rows:
                if len(value) == 2:  # numbers come first
                    numbers[value[0] * CHUNK :][: len(value[1])] = value[1]
                else:
                    yield value

        return use(numbers, packed())

    return sent.union(packs).mapPartitions(run)


def _weights(numbers: np.ndarray, pack: tuple) -> np.ndarray:
    _, starts, _, rows, xs = pack
    return np.add.reduceat(xs * numbers[rows], starts)


def _added(numbers: np.ndarray, packs: Iterator) -> Iterator:
    """(chunk, what the terms of the packs add to its rows)."""
    total = np.zeros(len(numbers))
    for pack in packs:
        _, starts, _, rows, xs = pack
        total += np.bincount(rows, np.repeat(_weights(numbers, pack), np.diff(np.append(starts, len(rows)))) * xs, len(numbers))
    return ((k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(-(-len(total) // CHUNK)))


def _slot_weights(numbers: np.ndarray, packs: Iterator) -> Iterator:
    for pack in packs:
        yield from zip(pack[0].tolist(), (_weights(numbers, pack) * pack[2]).tolist(), strict=True)


def _surplus(s: dict, b: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return s["share"] * (1 / (1 + np.exp(-(s["ka"] + b))) - s["y"])


def _start(rows) -> dict:
    at, y, share = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
    zero = np.zeros(len(at))
    return {"y": y, "share": share, **dict.fromkeys(("a", "ka", "g", "kg", "d", "kd"), zero)}


def _gradient(s: dict, k_surplus: np.ndarray, b: float, penalty: float) -> tuple[dict, np.ndarray]:
    """The state at its new gradient, and sums: loss, slope of b, products of the gradient with itself and the one before."""
    surplus, m = _surplus(s, b), s["ka"] + b
    g, kg = surplus + penalty * s["a"], k_surplus + penalty * s["ka"]
    loss = s["share"] @ (np.logaddexp(0, m) - s["y"] * m) + penalty / 2 * (s["a"] @ s["ka"])
    return s | {"g": g, "kg": kg}, np.array([loss, surplus.sum(), g @ kg, g @ s["kg"]])


def _slopes(s: dict, b: float, db: float, penalty: float) -> np.ndarray:
    """The loss's slope along the step, at its start and at each length."""
    along, m = s["kd"] + db, s["ka"] + b
    rise, bend = s["a"] @ s["kd"], s["d"] @ s["kd"]
    slope = lambda t: (s["share"] * (1 / (1 + np.exp(-(m + t * along))) - s["y"])) @ along + penalty * (rise + t * bend)
    with np.errstate(over="ignore"):
        return np.array([slope(t) for t in (0.0, *LENGTHS)])


def _turned(s: dict, by: float) -> dict:
    return s | {"d": by * s["d"] - s["g"], "kd": by * s["kd"] - s["kg"]}


def _moved(s: dict, t: float) -> dict:
    return s | {"a": s["a"] + t * s["d"], "ka": s["ka"] + t * s["kd"]}


def _cut(spark: SparkSession, state: RDD, chunks: int) -> tuple[RDD, str]:
    """The state read back from a scratch folder, where it depends on no shuffle of the steps before."""
    path = scratch_path(spark, "fit-state")
    state.saveAsPickleFile(path)
    return spark.sparkContext.pickleFile(path).partitionBy(chunks), path


def _lowest(at: np.ndarray, slopes: np.ndarray) -> float:
    """Where rising slopes cross zero: lengths as a polynomial of the four slopes around; the last length if none does."""
    k = int(np.argmax(slopes >= 0))  # the first length past the lowest point
    if slopes[k] < 0:
        return float(at[-1])
    near = slice(max(k - 2, 0), k + 2)
    ts, ss = at[near], slopes[near]
    if len(np.unique(ss)) < len(ss):
        ts, ss = at[k - 1 : k + 1], slopes[k - 1 : k + 1]
    t = sum(t * np.prod([-v / (u - v) for j, v in enumerate(ss) if j != i]) for i, (t, u) in enumerate(zip(ts, ss, strict=True)))
    return float(np.clip(t, at[k - 1], at[k]))


def fit(cells: DataFrame, rows: DataFrame, penalty: float, steps: int = 200, tolerance: float = 1e-6) -> tuple[DataFrame, float]:
    """((slot, weight), intercept) for cells (row, slot, x) and rows (row, label, weight), numbered from 0 without gaps.

    Minimises the weighted mean of log losses plus penalty / 2 times the squared weights, each times its slot's variance.
    """
    spark = rows.sparkSession
    dealt_to = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a step shuffles a number for each row and part, so there are no more parts than work at once
    parts = min(dealt_to, max(spark.sparkContext.defaultParallelism, 2))
    sums = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.sum(F.col("weight") ** 2).alias("squares")).first()
    n, total = sums["n"], sums["total"]
    chunks = min(parts, -(-n // CHUNK))
    dealt = cells.join(rows.select("row", "weight"), "row").select("slot", F.col("row").cast("int").alias("row"), "x", "weight")
    dealt = dealt.repartition(dealt_to, "slot").sortWithinPartitions("slot")
    kept = scratch_path(spark, "term-packs")
    packs = written(dealt.mapInArrow(_packs(total, sums["squares"]), PACK), "term-packs", kept).rdd.map(_unpacked).partitionBy(parts)
    numbered = rows.select("row", F.col("label").cast("double"), (F.col("weight") / total)).rdd
    state = numbered.map(lambda r: (r[0] // CHUNK, (r[0] % CHUNK, r[1], r[2]))).groupByKey(chunks).mapValues(_start)

    b, gb, size, db, before, slow, last, path = 0.0, 0.0, 0.0, 0.0, np.inf, 0, None, None
    for k in range(steps):
        if k % CUT == 0:
            old, (state, path) = path, _cut(spark, state, chunks)
            if last is not None:
                last.unpersist()
            last = both = turned = added = surplus = None  # what still names a step keeps its shuffles
            free_shuffles(spark)
            if old:
                drop_path(spark, old)
        surplus = state.mapValues(lambda s, b=b: _surplus(s, b))
        added = _with_packs(surplus, packs, parts, n, _added).reduceByKey(np.add, chunks)
        both = state.join(added, chunks).mapValues(lambda x, b=b: _gradient(*x, b, penalty)).persist(StorageLevel.MEMORY_AND_DISK)
        loss, new_gb, gg, g_last = both.values().map(lambda x: x[1]).reduce(np.add)
        if last is not None:
            last.unpersist()
        last = both
        slow = slow + 1 if before - loss <= tolerance * abs(loss) else 0
        if slow == 2 or gg + new_gb**2 < 1e-18:
            break
        by = max(0.0, (gg + new_gb**2 - g_last - gb * new_gb) / size) if size else 0.0
        before, size, gb = loss, gg + new_gb**2, new_gb
        for turn in dict.fromkeys((by, 0.0)):
            turned, step_b = both.mapValues(lambda x, by=turn: _turned(x[0], by)), turn * db - gb
            slopes = turned.values().map(lambda s, b=b, db=step_b: _slopes(s, b, db, penalty)).reduce(np.add)
            if slopes[0] < 0:
                break
        at = np.concatenate([[0.0], LENGTHS])
        t = _lowest(at, slopes)
        state, db, b = turned.mapValues(lambda s, t=t: _moved(s, t)), step_b, b + t * step_b
    # of the penalty's optimum the weights are the rows' numbers a over the terms
    weights = _with_packs(state.mapValues(lambda s: s["a"]), packs, parts, n, _slot_weights)
    out = written(spark.createDataFrame(weights, "slot int, weight double"), "term-weights")
    if last is not None:
        last.unpersist()
    for p in (path, kept):
        drop_path(spark, p)
    return out, float(b)
