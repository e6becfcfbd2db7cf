"""Array and sequence operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import words


def close_ids(ids: Column, block: int, end: Column) -> Column:
    """Cut to block - 1 ids, then the end id."""
    return F.concat(F.slice(ids, 1, block - 1), F.array(end))


def padded(ids: Column, block: int | Column, end: Column) -> Column:
    """A view of `block` ids; tables keep the ids alone."""
    width = F.lit(block) if isinstance(block, int) else block
    return F.concat(ids, F.array_repeat(end, F.greatest(width - F.size(ids), F.lit(0))))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def shingles(ws: Column, n: int) -> Column:
    """Runs of n words joined by spaces; a shorter text is one run, an empty one none."""

    def runs(w: Column) -> Column:
        k = F.least(F.lit(n), F.size(w))
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<string>"))

    return let(ws, runs)


def message_words(text: Column) -> Column:
    """The words of a message less a leading "subject"."""
    return without_subject(words(text))


def without_subject(ws: Column) -> Column:
    return F.filter(ws, lambda w, i: (i > 0) | (w != "subject"))


def message_shingles(text: Column, n: int) -> Column:
    """Distinct shingles, as strings."""
    return F.array_distinct(shingles(message_words(text), n))


def hashed_shingles(ws: Column, n: int) -> Column:
    """Shingles as 64-bit hashes over the hashes of their words, so that none is put together as a string."""

    def runs(hs: Column) -> Column:
        k = F.least(F.lit(n), F.size(hs))
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hs) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hs, i, k)))
        return F.when(F.size(hs) > 0, made).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), runs)


def shingle_hashes(text: Column, n: int) -> Column:
    """Distinct shingles, as 64-bit hashes in ascending order."""
    return F.sort_array(F.array_distinct(hashed_shingles(message_words(text), n)))


def window_starts(length: Column, block: int, most: Column) -> Column:
    """Starts of evenly spaced windows that do not overlap; room is left for the target's shift."""
    n = F.floor((length - 1) / block).cast("long")
    k = F.least(n, F.floor(most / block).cast("long"))
    spaced = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))), lambda i: F.when(k < 2, F.lit(0)).otherwise(F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1)))).cast("long") * block)
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: i * block)
    return F.when(k < 1, F.array().cast("array<bigint>")).when(n <= k, every).otherwise(spaced)


def at_least_kth(scores: Column, k: int) -> Column:
    """Scores below the k-th largest become -infinity; all that tie with it stay, and so does all of a shorter array. k of 0 keeps everything."""
    bound = F.get(F.sort_array(scores, asc=False), F.least(F.lit(k), F.size(scores)) - 1)
    return scores if k <= 0 else let(bound, lambda b: F.transform(scores, lambda x: F.when(x < b, F.lit(float("-inf"))).otherwise(x)))
