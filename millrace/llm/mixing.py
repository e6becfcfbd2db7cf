"""Mixing sources to target weights by Poisson replication, with DataFrame operations alone.

A source of n bytes with target weight w has the mean repetition rate w * budget * total / n.
Each document is repeated as often as a Poisson variable of that mean says, which is found by
inverting its distribution at a number in [0, 1) hashed from the seed and doc_id. Copies are
dealt and ordered by another hash, so the shuffle is global and the same on every run.

Without given weights they follow the sources' sizes to the power `smoothing`, scaled to one.
Given weights count relative to their sum; a source without one is left out.

Defined cases: a null source is a source of its own; a null or empty text counts as one byte,
so a source of such texts has a rate; a null doc_id hashes as "null"; rows that share a doc_id
are repeated equally often; an empty table gives no row. All columns pass through whatever their
names are; the added rate, n_copies, copy and shuffle_key have underscores after them where the input
has columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.naming import as_row, free_name, row_columns
from millrace.storage import written

SEED, SMOOTHING, BUDGET = "mix-1", 0.7, 1.0
#: The table of rates is broadcast up to so many sources, else joined by a shuffle.
MOST_SOURCES = 10_000


def hashed(digits: int, *parts: Column) -> Column:
    """A long from the first hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


#: log k! for small k; Stirling's series from there on.
LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(32)]


def log_probability(k: Column, rate: Column) -> Column:
    """The logarithm of a Poisson probability.

    For large k the powers of k in Stirling's series are taken together with those of the rate, so
    that numbers much larger than the result don't cancel.
    """
    x = F.greatest(k, F.lit(len(LOG_FACTORIALS))).cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    large = x * F.log1p((rate - x) / x) + (x - rate) - 0.5 * F.log(2 * math.pi * x) - series
    small = k * F.log(rate) - rate - F.get(F.array(*map(F.lit, LOG_FACTORIALS)), k.cast("int"))
    return F.when(k < len(LOG_FACTORIALS), small).otherwise(large)


def poisson_table(rate: Column) -> Column:
    """(lo, p): probabilities of lo, lo + 1, ...; beyond both ends less than 2^-53 is left."""
    room = F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)
    lo = F.greatest(F.lit(0.0), F.floor(rate - room)).cast("long")
    table = F.transform(F.sequence(lo, F.ceil(rate + room).cast("long")), lambda k: F.exp(log_probability(k, rate)))
    return F.struct(lo.alias("lo"), table.alias("p"))


def inverted(poisson: Column, draw: Column) -> Column:
    """How often a document is repeated whose number is `draw`: the distribution's inverse there."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        total = acc["sum"] + p
        return F.struct(total.alias("sum"), (acc["n"] + (total <= draw).cast("long")).alias("n"))

    return (poisson["lo"] + F.aggregate(poisson["p"], start, step)["n"]).cast("int")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, smoothing: float = SMOOTHING, budget: float = BUDGET) -> DataFrame:
    """(mix_source, rate, poisson) of each source with a weight."""
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(smoothing)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "name string, weight double")
        sizes = sizes.join(given, F.col("mix_source").eqNullSafe(F.col("name"))).drop("name")
    totals = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # one row of two sums: its size is fixed
    rated = sizes.crossJoin(F.broadcast(totals))
    rate = F.col("weight") / F.col("all_weight") * F.lit(float(budget)) * F.col("all_size") / F.col("size")
    return rated.select("mix_source", rate.alias("rate")).select("*", poisson_table(F.col("rate")).alias("poisson"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, smoothing: float = SMOOTHING, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The columns of docs, with rate, n_copies, copy (from 1) and shuffle_key of each copy."""
    spark = docs.sparkSession
    rates = source_rates(docs.select("source", "text"), weights, smoothing, budget)
    few = docs.select("source").distinct().limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    # a written table leaves the join's other side free to be split at a hot source
    rated = as_row(docs).join(F.broadcast(rates) if few else written(rates, "rates"), F.col("row.source").eqNullSafe(F.col("mix_source")))
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    draw = hashed(13, F.lit(seed), name) / F.lit(float(1 << 52))
    counted = rated.withColumn("draw", draw).withColumn("n_copies", inverted(F.col("poisson"), F.col("draw"))).where("n_copies > 0")
    copies = counted.select("row", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    key = free_name("shuffle_key", docs)
    copies = copies.select(*row_columns(docs), *(F.col(c).alias(free_name(c, docs)) for c in ("rate", "n_copies", "copy")), hashed(15, F.lit(seed), name, F.col("copy").cast("string")).alias(key))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, key).sortWithinPartitions(key)
