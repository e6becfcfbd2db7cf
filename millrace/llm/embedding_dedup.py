"""Near-duplicate embeddings: rotated binary codes with correction factors decide what is recomputed.

A unit vector is turned by a seeded random rotation R and coded by the signs of R x, packed. With
the correction factor f = <sign(R x) / sqrt(D), R x> stored beside them, <sign(R x), R q> / sqrt(D) / f
estimates <x, q> without bias. The other side of it, R q, is stored too, rounded at random to four
bits a component: the estimate is four counts of bits of code AND bit plane. With the stated
confidence it is off by no more than EPSILON * sqrt((1 - f^2) / (D - 1) + step^2 / 4) / f. Codes, planes
and factors are made once, and they alone are dealt to the buckets. Vectors are fetched only for rows
that some pair's upper bounds, one from either side, leave open; those pairs are recomputed in double
precision, a bounded slice of them at a time.

Candidates share a label and, in one of TABLES tables, all BITS signs of a rotation. A pair counts
in the first table where it meets, so link counts are sums over buckets. Equal vectors are one
class with a multiplicity. A bucket of more than BLOCK classes is split: its rows are dealt to
blocks and every pair of blocks is a task of its own, so no task holds more than two blocks and
no pair is left out. Pairs are never listed: a task gives counts and a spanning set of links.

Recall of pairs at cosine 0.98 exactly, with 16 bits in 12 tables: 0.994; above it, more.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows
with a null label, link with nothing and are their own component; rows with equal vectors and
labels link with each other; a null vec_id links but is no component's id unless alone; repeated
rows, and rows that share a vec_id, count as rows; components of any finite size are scaled before
norms are taken; vectors of another length than most of their label never meet them (a label's tables
are kept by length); an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.storage import written

COSINE, TABLES, BITS, SEED, EPSILON, BLOCK = 0.98, 12, 16, 20, 4.0, 2048
#: Bit planes of a rotated vector's components.
PLANES = 4
#: Pairs estimated, and components recomputed, at once.
ROOM = 1 << 19


@functools.cache
def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere; number 0 is that of the codes."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@functools.cache
def planes(d: int) -> np.ndarray:
    """(d, TABLES * BITS): rows of as many rotations as the tables need."""
    need = -(-TABLES * BITS // d)
    return np.concatenate([rotation(d, k + 1) for k in range(need)])[: TABLES * BITS].T


def table_keys(unit: np.ndarray) -> np.ndarray:
    """(n, TABLES): the bucket of each vector in each table."""
    signs = (unit @ planes(unit.shape[1]) > 0).reshape(len(unit), TABLES, BITS)
    return signs @ (1 << np.arange(BITS, dtype=np.int64))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, d = bits.shape
    out = np.zeros((n, -(-d // 64) * 8), np.uint8)
    out[:, : -(-d // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.view(np.uint64)


class Codes:
    """Codes, bit planes and factors of rows of vectors of one length d."""

    def __init__(self, d: int, code: np.ndarray, planes: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.d, self.code, self.planes, self.factor, self.low, self.step = d, code, planes, factor, low, step

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        n, d = unit.shape
        turned = unit @ rotation(d, 0)
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-300)
        draws = np.random.default_rng([SEED, d]).random((n, d))  # rounding up or down by chance keeps the estimate unbiased
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + draws), 0, 2**PLANES - 1).astype(np.uint8)
        planes = np.stack([packed(level >> p & 1) for p in range(PLANES)], 1)
        return cls(d, packed(turned > 0), planes, np.abs(turned).sum(1) / np.sqrt(d), low, step)

    def rows(self, which) -> Codes:
        return Codes(self.d, self.code[which], self.planes[which], self.factor[which], self.low[which], self.step[which])

    def estimates(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error bound) of the inner product of each row, as planes, with each of other, as codes."""
        sums = np.zeros((len(self.code), len(other.code)))
        levels = np.zeros(len(self.code))
        for p in range(PLANES):
            plane = self.planes[:, p]
            levels += np.bitwise_count(plane).sum(1, dtype=np.int64) << p
            for w in range(plane.shape[1]):
                sums += np.bitwise_count(plane[:, w, None] & other.code[None, :, w]) * float(1 << p)
        ones = np.bitwise_count(other.code).sum(1, dtype=np.int64)
        product = self.low[:, None] * (2.0 * ones - self.d) + self.step[:, None] * (2 * sums - levels[:, None])
        error = np.sqrt(np.maximum(0, 1 - other.factor**2)[None] / max(1, self.d - 1) + self.step[:, None] ** 2 / 4)
        return product / np.sqrt(self.d) / other.factor, EPSILON * error / other.factor

    def open_pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of the pairs of rows a with rows b, or i < j where they are the same, that no bound closes."""
        same = a is b
        of_b = self.rows(b)
        most = max(1, ROOM // max(1, len(b)))
        for lo in range(0, len(a), most):
            of_a = self.rows(a[lo : lo + most])
            there, error = of_a.estimates(of_b)
            back, wrong = of_b.estimates(of_a)
            i, j = np.nonzero((there + error >= COSINE) & (back + wrong >= COSINE).T)
            if same:
                i, j = i[i + lo < j], j[i + lo < j]
            yield a[i + lo], b[j]


def blocks_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a task's one or two blocks; for one block the same array twice."""
    low = own == own.min()
    a = np.flatnonzero(low)
    return (a, a) if low.all() else (a, np.flatnonzero(~low))


def exact(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the cosine of each pair is at least COSINE; a bounded number of pairs is gathered at once."""
    most = max(1, ROOM // unit.shape[1])
    parts = [np.einsum("ij,ij->i", unit[i[k : k + most]], unit[j[k : k + most]]) >= COSINE for k in range(0, len(i), most)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Groups of adjacent rows with equal values, those that have more than one row, across batches."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        v = t[name].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo > 1:
                yield t.slice(lo, hi - lo).combine_chunks().to_batches()[0]
        rest = t.slice(int(edges[-1])) if len(edges) and t.num_rows else t
    if rest is not None and rest.num_rows > 1:
        yield rest.combine_chunks().to_batches()[0]


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes): a class is all equal vectors of one label, by digest and number."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    # equal means equal bytes of the array's text form, so keys stay short
    rows = vectors.select("vec_id", "label", "embedding", good.alias("good")).withColumn("same", F.when(F.col("good"), F.md5(F.to_json(F.struct("label", "embedding")))))
    same = rows.where("good").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # the number is fixed once the classes are written
    return rows.select("vec_id", "same"), same.withColumn("node", F.monotonically_increasing_id())


CODED = "code binary, planes binary, factor double, low double, step double, keys binary"


def coded_classes(classes: DataFrame) -> DataFrame:
    """classes with the codes of their vectors and, two bytes each, their buckets in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["code", "planes", "factor", "low", "step", "keys"]
        raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                unit = _unit(part.column(2))
                c = Codes.of(unit)
                cols = [raw(c.code), raw(c.planes), pa.array(c.factor), pa.array(c.low), pa.array(c.step), raw(table_keys(unit).astype("<u2"))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *names])

    kind = dict(classes.dtypes)
    classes = classes.select("node", "label", "embedding", "copies")
    return classes.mapInArrow(run, f"node long, label {kind['label']}, embedding {kind['embedding']}, copies long, {CODED}")


def _codes(t: pa.RecordBatch, d: int) -> Codes:
    """The codes of rows whose columns are named as in CODED."""
    n, at = t.num_rows, t.schema.get_field_index
    words = lambda name: np.frombuffer(b"".join(t.column(at(name)).to_pylist()), np.uint64)
    number = lambda name: t.column(at(name)).to_numpy()
    return Codes(d, words("code").reshape(n, -1), words("planes").reshape(n, PLANES, -1), number("factor"), number("low"), number("step"))


def class_links(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, n): vectors of other classes that each class links to; (a, b): links that span the rest)."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = written(coded_classes(classes), "vector-codes")
    key = F.conv(F.hex(F.substring("keys", 2 * F.col("table") + 1, F.lit(2))), 16, 10)  # any number of the two bytes will do
    placed = coded.withColumn("d", F.size("embedding")).withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))))
    placed = placed.withColumn("bucket", F.xxhash64("label", "d", "table", key))
    sizes = placed.groupBy("bucket").count().where("count > 1")
    sizes = written(sizes.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    dealt = placed.select("bucket", "node", "d", "table", "code", "planes", "factor", "low", "step").join(sizes, "bucket")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(task.alias("task"), "node", "d", "table", "own", "code", "planes", "factor", "low", "step")

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "task"):
            used = np.zeros(t.num_rows, bool)
            for i, j in _codes(t, t.column(2)[0].as_py()).open_pairs(*blocks_of(t.column(4).to_numpy())):
                used[i] = used[j] = True
            yield t.select(["task", "node", "table", "own"]).filter(pa.array(used))

    opened = dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(open_rows, "task long, node long, table int, own int")
    opened = written(opened, "open-rows").join(coded.drop("label"), "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "task"):
            at, n = t.schema.get_field_index, t.num_rows
            node, copies, table = t.column(at("node")), t.column(at("copies")).to_numpy(), t.column(at("table"))[0].as_py()
            unit = _unit(t.column(at("embedding")))
            keys = np.frombuffer(b"".join(t.column(at("keys")).to_pylist()), "<u2").reshape(n, TABLES)
            count, found = np.zeros(n), []
            for i, j in _codes(t, unit.shape[1]).open_pairs(*blocks_of(t.column(at("own")).to_numpy())):
                near = exact(unit, i, j)
                i, j = i[near], j[near]
                earlier = (keys[i, :table] == keys[j, :table]).any(1)  # counted in an earlier table
                i, j = i[~earlier], j[~earlier]
                count += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                found.append(np.stack([i, j]).astype(np.int32))
            i, j = np.concatenate(found, 1)
            root = np.arange(n)
            while True:  # the least index reachable
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(used)), pa.array(count[used].astype(np.int64)), node.take(pa.array(root[used]))], ["node", "n", "root"])

    dealt = opened.repartition(parts, "task").sortWithinPartitions("task")
    found = written(dealt.mapInArrow(link, "node long, n long, root long"), "vector-links")
    return found.groupBy("node").agg(F.sum("n").alias("n")), found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def embedding_components(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows, classes = vector_classes(vectors)
    classes = written(classes, "vector-classes")
    counts, links = class_links(classes)
    parts = connected_components(links)
    joined = classes.select("node", "same", "rep", "copies").join(counts, "node", "left").join(parts, "node", "left")
    joined = joined.select("same", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("part"))
    joined = written(joined, "vector-parts")
    least = written(joined.groupBy("part").agg(F.min("rep").alias("least")), "part-heads")
    joined = joined.join(least, "part").select("same", "links", "least")
    out = rows.join(joined, "same", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & component.isNull()).alias("kept"))
