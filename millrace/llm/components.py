"""Connected components over an edge table, and links found through shared keys.

Both are DataFrame operations alone. No group is gathered: minima are partial aggregates, written
before what belongs to a group is joined back, so that Spark can split the join of a large group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import drop_path, free_shuffles, scratch_path, written

MOST_ROUNDS = 60


def _lower(e: DataFrame, path: str) -> DataFrame:
    """Large star: every neighbour above a node is tied to the least of the node's neighbourhood."""
    both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", path)
    return e.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct()


def _gather(e: DataFrame, path: str) -> DataFrame:
    """Small star: a node and all neighbours below it are tied to the least of these."""
    least = written(e.groupBy("hi").agg(F.min("lo").alias("m")), "least", path)
    tied = e.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return tied.union(least.toDF("hi", "lo")).distinct()


def _marked(e: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """The written edges, and what tells whether they are those of the round before."""
    out = written(e, "edges", path)
    return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the least node reachable.

    Alternates large and small stars until the edges stay as they are, which takes about the
    logarithm of the longest path. Loops and repeated edges do no harm; no edge, no row.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    now, seen = _marked(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), path)
    if not seen[0]:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(MOST_ROUNDS):
        paths = [scratch_path(spark, "edges") for _ in range(4)]
        lower = written(_lower(now, paths[0]), "edges", paths[1])
        before = seen
        now, seen = _marked(_gather(lower, paths[2]), paths[3])
        for p in (path, *paths[:3]):
            drop_path(spark, p)
        path = paths[3]
        if seen == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select("lo").distinct()
    return now.union(roots.select("lo", "lo")).toDF("node", "component")


def linked_components(keyed: DataFrame, code: str, near: Callable[[str, str], Column], needed: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame] | None = None, slices: int = 1, then: Callable[[], None] | None = None, pair_slices: int | None = None) -> DataFrame:
    """(node, component) of the links between nodes that share keys.

    keyed: (key, node) and the column `code`, which may be the node; a row for each key of each node.
    near(a, b) says of two columns of codes whether their nodes may link, needed(a, b) how many
    keys they must share; verify, if given, keeps the true ones of candidate rows (a, b). Two
    passes find all that connects without listing the pairs of a group: the first tries the nodes of
    each key with its least node; the second looks only at keys whose nodes are still in different
    components, and there only at pairs from different ones. Keys are dealt in so many slices, one
    after the other, as most of them are of one node and need disk only while they are dealt, and so
    are the pairs of the second pass, in pair_slices (as many, unless said otherwise) by their first node, each of which
    deals the second nodes anew; then() is called once keyed is read no more.
    """
    spark = keyed.sparkSession
    # One shuffle serves both sides; keys of a single node, mostly the bulk, fall away as they are
    # read. Rows of a hot key stream through their task, which holds three numbers of each key.
    paths = [scratch_path(spark, name) for name in ("stars", "placed-keys", "mixed-keys")]
    columns = ["key", "node"] + [code] * (code != "node")
    found = []
    for k in range(slices):
        dealt = keyed.where(F.pmod("key", F.lit(slices)) == k) if slices > 1 else keyed
        dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        heads = dealt.groupBy("key").agg(F.min("node").alias("first"), F.min_by(code, "node").alias("first_code"), F.max("node").alias("last"))
        heads = heads.where("first != last").drop("last")
        paths.append(scratch_path(spark, "shared-keys"))
        kept = dealt.join(heads.hint("shuffle_hash"), "key").select(*columns, "first", "first_code").distinct()
        found.append(written(kept.sortWithinPartitions("key"), "shared-keys", paths[-1]))  # in order, as that takes least disk
        free_shuffles(spark)
    shared = reduce(DataFrame.union, found)
    if then:
        then()

    verify = verify or (lambda pairs: pairs)

    def enough(pairs: DataFrame) -> DataFrame:
        """Of rows (a, b, needed) for each shared key, the pairs that share enough of them."""
        return pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("needed").alias("needed")).where("met >= needed").select("a", "b")

    star = shared.where(F.col("node") != F.col("first")).where(near(code, "first_code"))
    stars = written(verify(enough(star.select(F.col("node").alias("a"), F.col("first").alias("b"), needed(code, "first_code").alias("needed")))), "stars", paths[0])
    found = connected_components(stars)
    placed = shared.join(found.hint("shuffle_hash"), "node", "left").select(*columns, F.coalesce("component", "node").alias("part"))
    placed = written(placed, "placed-keys", paths[1])
    for p in paths[3:]:
        drop_path(spark, p)
    free_shuffles(spark)
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
    mixed = written(placed.join(mixed.hint("shuffle_hash"), "key", "left_semi"), "mixed-keys", paths[2])
    drop_path(spark, paths[1])
    free_shuffles(spark)
    out = found
    if not mixed.isEmpty():
        pairs, dealt_to = [], pair_slices or slices
        for k in range(dealt_to):
            paths.append(scratch_path(spark, "across"))
            pairs.append(written(enough(_across(mixed.where(F.pmod("node", F.lit(dealt_to)) == k), mixed, code, near, needed)), "across", paths[-1]))
            free_shuffles(spark)
        out = connected_components(stars.union(verify(reduce(DataFrame.union, pairs))))
    for p in (paths[0], paths[2], *paths[3 + slices :]):
        drop_path(spark, p)
    return out


def _across(left: DataFrame, right: DataFrame, code: str, near: Callable[[str, str], Column], needed: Callable[[str, str], Column]) -> DataFrame:
    """(a, b, needed): pairs of nodes of one key that are in different parts and may link, once for each key."""
    a, b = left.alias("a"), right.alias("b")
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.part") != F.col("b.part")) & near(f"a.{code}", f"b.{code}"))
    return across.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), needed(f"a.{code}", f"b.{code}").alias("needed"))
