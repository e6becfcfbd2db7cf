"""Membership of a corpus's elements in a smaller set, through a Bloom filter of fixed size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (1 MiB), and bits set for an element: one wrong pass in a hundred at 870 000 elements, and a filter that keeps less away beyond.
BITS, HASHES = 1 << 23, 4


def _places(h: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(bits)) for k in range(hashes)]


def bloom_filter(wanted: DataFrame, element: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """(filter): one row of bits / 64 words, an aggregate over the elements; partial aggregates are no larger than the filter."""
    places = wanted.select(F.explode(F.array(*_places(F.col(element), bits, hashes))).alias("place"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.groupBy((F.shiftright("place", 6)).alias("word")).agg(F.bit_or(mask).alias("bits"))
    every = wanted.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(words, "word", "left")
    row = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(row, lambda x: x["bits"]).alias("filter"))


def may_hold(words: Column, h: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """Whether an element may be in the set; false is certain."""
    tests = [F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1 for p in _places(h, bits, hashes)]
    return reduce(lambda a, b: a & b, tests)


def held(corpus: DataFrame, wanted: DataFrame, element: str = "h", bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """Rows of corpus whose element is wanted (element): only what passes the filter is shuffled to the exact semi-join."""
    sieve = F.broadcast(bloom_filter(wanted, element, bits, hashes))  # one row of bits / 8 bytes
    passed = corpus.crossJoin(sieve).where(may_hold(F.col("filter"), F.col(element), bits, hashes)).drop("filter")
    return passed.join(wanted.hint("shuffle_hash"), element, "left_semi")
