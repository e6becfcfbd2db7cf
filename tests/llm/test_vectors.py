"""Vector codes, centroid clustering and inner-product search against brute force and their edge cases."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.llm import centroid_clustering, components, inner_product_search, queries, vector_codes
from millrace.llm.integer_vectors import integers, largest

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def vectors(n, d, seed=0, centres=6):
    """Rows in clusters, with equal vectors and repeated ids among them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, d))[rng.integers(centres, size=n)] + rng.normal(size=(n, d)) * 0.3
    x[n // 2 : n // 2 + 5] = x[n // 2]
    rows = [(i, v.tolist(), [None, 0, 1][i % 3]) for i, v in enumerate(x)]
    return rows + rows[3:5] + [(n, None, 1), (n + 1, [NAN] * d, 1), (n + 2, [1.0] * (d - 1) + [None], 1), (n + 3, [INF] * d, None)]


def whole(rows, d):
    """(id, label, integers) of the rows that are kept."""
    good = [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and np.isfinite(v) for v in r[1])]
    return [r[0] for r in good], [r[2] for r in good], np.floor(np.array([r[1] for r in good]).reshape(-1, d) * 1024).astype(np.int64)


def fitted(x, start, rounds):
    """Codes and the last centroids of a full search, in whole numbers."""
    c = start.copy()
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for k in set(own.tolist()):
            c[k] = x[own == k].sum(0) // (own == k).sum()
    distance = ((x[:, None] - c[None]) ** 2).sum(2)
    return distance.argmin(1), distance.min(1), c


def text(c):
    return hashlib.sha256(",".join(map(str, np.concatenate([e.reshape(-1) for e in c]).tolist())).encode()).hexdigest()


def test_clusters_are_those_of_a_full_search(spark):
    rows = vectors(300, 64)
    ids, _, x = whole(rows, 64)
    first = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:8]
    own, distance, c = fitted(x, x[first], 10)
    got = centroid_clustering.cluster_vectors(table(spark, rows)).collect()
    want = [(i, k, e, int(distance[own == k].sum()), int(distance.sum()), text(c[k : k + 1])) for i, k, e in zip(ids, own.tolist(), distance.tolist(), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_partial_distances_leave_ties_to_the_smaller_number():
    rng = np.random.default_rng(1)
    for d, k in ((64, 8), (5, 3), (64, 1), (9, 12)):
        x, c = rng.integers(-2, 3, (500, d)), rng.integers(-2, 3, (k, d))
        c[-1] = c[0]
        own, distance = centroid_clustering.nearest(x, c, np.argsort(-x.var(0)))
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_clustering_edge_rows(spark):
    of = lambda rows: centroid_clustering.cluster_vectors(table(spark, rows)).collect()
    assert of([]) == [] and of([(1, None, None), (2, [1.0] * 63, 1)]) == []
    got = of([(None, [0.0] * 64, 1), (5, [1.0] * 64, 1), (5, [1.0] * 64, 1)])
    assert len(got) == 3 and {r.distance for r in got} == {0}
    far = of([(1, [1e300] * 64, 1), (2, [-1e300] * 64, 1)])  # held to what a distance can hold
    assert len(far) == 2 and all(r.distance == 0 for r in far)
    clash = table(spark, vectors(40, 64)).withColumn("cluster", F.lit(9)).withColumn("x", F.lit("a")).withColumn("v", F.lit(1))
    assert centroid_clustering.cluster_vectors(clash).count() == 42


def test_codes_are_those_of_a_full_search(spark):
    rows = vectors(420, 16)
    ids, labels, x = whole(rows, 16)
    start = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tolist()))[:256]
    parts = [fitted(x[:, lo:hi], x[start, lo:hi], 4) for lo, hi in vector_codes.cuts(16)]
    code = ["".join(f"{p[0][i]:02x}" for p in parts) for i in range(len(ids))]
    error = sum(p[1] for p in parts).tolist()
    by_label = {y: sum(e for e, z in zip(error, labels, strict=True) if z == y) for y in set(labels)}
    digest = text([p[2] for p in parts])
    got = vector_codes.vector_codes(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted((i, c, e, by_label[y], digest) for i, c, e, y in zip(ids, code, error, labels, strict=True))


def test_code_edge_rows(spark):
    of = lambda rows: {r.vec_id: r for r in vector_codes.vector_codes(table(spark, rows)).collect()}
    assert of([]) == {} and of([(1, None, 1), (2, [NAN], 1)]) == {}
    got = of([(1, [], 1), (None, [1.0, 2.0, 3.0], None), (3, [1.0, 2.0, 3.0], None), (4, [1e300] * 4, 1), (5, [-1e300] * 4, 1)])
    assert got[1].code == "00000000" and got[1].error == 0 and got[3].code == got[None].code == "00000000"
    assert got[4].error == got[5].error == 0 and got[5].code == "01010101"
    assert vector_codes.vector_codes(table(spark, vectors(30, 8)).withColumn("code", F.lit(1)).withColumn("d", F.lit(2))).count() == 32


def test_whole_numbers_never_leave_63_bits():
    for d in (1, 16, 64, 1000):
        x = integers(pa.array([[1e308] * d, [-1e308] * d]), d)
        assert int(((x[0] - x[1]).astype(object) ** 2).sum()) < 2**63 and x[0][0] == largest(d)


def test_vector_queries_equal_their_sql(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    for name in ("op11_vector_codes", "op13_centroid_clustering"):
        df = queries.QUERIES[name](spark, DATA)
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall())


def brute(rows, queries_, k):
    good = {(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])}
    out = {}
    for q, x in good:
        if q in queries_:
            scored = sorted(((-float(np.dot(x, y)), i) for i, y in good if i != q and len(y) == len(x)))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_search_finds_nine_of_ten_neighbours_and_orders_them(spark, monkeypatch):
    for n, d, centres in ((1500, 24, 40), (1200, 8, 1)):
        monkeypatch.setattr(inner_product_search, "FIRST", 150)
        monkeypatch.setattr(inner_product_search, "CELL", 20)
        rows = vectors(n, d, 3, centres)
        df = table(spark, rows)
        want = brute(rows, {i for i in range(0, n, 20)}, 20)
        got = {}
        for r in sorted(inner_product_search.nearest_by_product(df, df.where("vec_id % 20 = 0")).collect()):
            got.setdefault(r.query_id, []).append(r)
        assert set(got) == set(want)
        x = {r[0]: np.array(r[1]) for r in rows[:n]}
        for q, rs in got.items():
            assert [r.rank for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs} and len({r.vec_id for r in rs}) == 20
            assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
            assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in rs)
        hit = sum(len({r.vec_id for r in got[q]} & set(w)) for q, w in want.items())
        assert hit >= 0.9 * sum(map(len, want.values()))


def test_crowded_shelves_and_many_queries_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(inner_product_search, "BLOCK", 50)
    monkeypatch.setattr(inner_product_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(inner_product_search, "MISSED", 0.0)
    rows = vectors(400, 6, 4)
    df = table(spark, rows)
    got = {}
    for r in sorted(inner_product_search.nearest_by_product(df, df.where("vec_id % 5 = 0"), 7).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, {i for i in range(0, 400, 5)}, 7)  # nothing may be missed, so the search is exact


def test_search_edge_rows(spark):
    df = table(spark, [(i, [1.0, 0.5], 1) for i in range(60)] + [(0, [1.0, 0.5], 2), (100, [2.0, 0.0], 1), (100, [0.5, 0.0], 1), (120, [0.0, 0.0], 1), (140, None, 1), (160, [1.0], 1), (None, [3.0, 1.0], 1)])
    rows = inner_product_search.nearest_by_product(df, df.where("vec_id % 20 = 0")).collect()
    got = {}
    for r in sorted(rows):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 100} and got[20] == [100, *range(19)]  # equal vectors by id, never the query's own
    assert got[0] == [100, *range(1, 20)] and len(got[100]) == 40  # two vectors of one id are searched each
    empty = inner_product_search.nearest_by_product(df.limit(0), df.limit(0))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    few = inner_product_search.nearest_by_product(df.where("vec_id < 3"), df.where("vec_id = 0").withColumn("score", F.lit(1)))
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


def test_cells_come_in_falling_order_each_once():
    index = inner_product_search.MultiIndex.fitted(np.random.default_rng(2).normal(size=(200, 8)), 12)
    own = np.random.default_rng(3).normal(size=12), np.random.default_rng(4).normal(size=12)
    cells = list(index.from_best(own))
    assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True) and len({c[1:] for c in cells}) == len(cells) == 144


def test_a_model_can_be_fitted_after_components_have_run(spark):
    components.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count()
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2), 1.0])) for i in range(8)], ["label", "features"])
    assert LogisticRegression(maxIter=2).fit(rows).transform(rows).where("prediction = label").count() == 8
