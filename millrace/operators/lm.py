"""N-gram language-model scoring over a token stream (pos, token), positions from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Buckets of positions inside a window, as [from, to).
BUCKETS = [(0, 1), (1, 4), (4, 16), (16, 64), (64, 128), (128, 256)]


def token_stream(coded: DataFrame, key: str, end: int) -> DataFrame:
    """(key, pos, token) of rows (key, ids, start): each document's ids and the end id."""
    tokens = F.concat("ids", F.array(F.lit(end)))
    return coded.select(key, "start", F.posexplode(tokens).alias("at", "token")).select(key, (F.col("start") + F.col("at")).alias("pos"), "token")


def stream_pairs(coded: DataFrame, end: int, first: int = 0, last: int | None = None) -> DataFrame:
    """(pos, a, b) with first <= pos and pos + 1 < last of rows (ids, start): each token and the one after it, over document ends too.

    A document gives the pairs whose second token is its own; before its first token stands the end id of the
    document before. So pairs are a projection of the documents' rows, and those without a pair in the range aren't opened.
    """
    tokens = F.concat("ids", F.array(F.lit(end)))
    pair = F.transform(tokens, lambda b, i: F.struct(F.when(i == 0, F.lit(end)).otherwise(F.get("ids", i - 1)).alias("a"), b.alias("b")))
    rows = coded.where(F.col("start") + F.size("ids") > first)
    rows = rows if last is None else rows.where(F.col("start") < last)
    pairs = rows.select("start", F.posexplode(pair).alias("at", "pair")).select((F.col("start") + F.col("at") - 1).alias("pos"), "pair.a", "pair.b")
    pairs = pairs.where(F.col("pos") >= first)
    return pairs if last is None else pairs.where(F.col("pos") + 1 < last)


def stream_split(stream: DataFrame, length: int, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    cut = int(share * length)
    return stream.where(F.col("pos") < cut), stream.where(F.col("pos") >= cut)


#: Positions of a block in which tokens are put beside their successors.
BLOCK = 1 << 16


def with_next(stream: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos, a, b): each token and the one after it, over document ends too.

    Positions are dealt in blocks, and the first row of each is carried to the block before as well, so
    one exchange of the stream does. A position that is missing has no pair on either side.
    """
    own = F.floor(F.col("pos") / block)
    blocks = F.when(F.col("pos") % block == 0, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = stream.select("pos", "token", F.explode(blocks).alias("block"))
    order = Window.partitionBy("block").orderBy("pos")
    pairs = dealt.select("block", "pos", F.col("token").alias("a"), F.lead("token").over(order).alias("b"), F.lead("pos").over(order).alias("after"))
    return pairs.where((F.col("after") == F.col("pos") + 1) & (F.floor(F.col("pos") / block) == F.col("block"))).select("pos", "a", "b")


def lm_windows(pairs: DataFrame, first: int, starts: int, block: int) -> DataFrame:
    """(window, at, a, b) of `starts` windows side by side over pairs (pos, a, b); the target is the input moved by one."""
    place = F.col("pos") - first
    return pairs.where((place >= 0) & (place < starts * block)).select(F.floor(place / block).alias("window"), (place % block).cast("int").alias("at"), "a", "b")


def unigram_counts(stream: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, c, prob) with add-one smoothing over vocabulary (id)."""
    counts = stream.groupBy("token").agg(F.count("*").alias("c"))
    full = vocabulary.select(F.col("id").alias("token")).join(counts, "token", "left").fillna(0, ["c"])
    totals = full.agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    return full.crossJoin(F.broadcast(totals)).select("token", "c", ((F.col("c") + 1) / (F.col("n") + F.col("v"))).alias("prob"))


def bigram_counts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, c), (a, c)): counts of pairs (a, b), and of tokens that have a successor."""
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    return pairs, pairs.groupBy("a").agg(F.sum("c").alias("ca"))


def word_pairs(docs: DataFrame, key: str, words: Column, seed: int) -> DataFrame:
    """(a, b): each token of the stream and the one after it, words by their hashes, the end id as null.

    Pairs are a projection of the documents' rows; before a document's first token stands the end id, except in the first document.
    """
    first = docs.agg(F.min(key).alias("first"))
    # cut into words below the generator: above it, that would be done again for each pair
    rows = docs.where(F.col(key).isNotNull()).select(key, F.explode_outer(F.array(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))))).alias("ws"))
    rows = rows.select(key, F.coalesce("ws", F.array().cast("array<bigint>")).alias("ws"))
    pair = lambda b, i: F.struct(F.get("ws", i - 1).alias("a"), b.alias("b"))
    pairs = rows.select(key, F.posexplode(F.transform(F.concat("ws", F.array(F.lit(None).cast("bigint"))), pair)).alias("at", "pair"))
    return pairs.crossJoin(F.broadcast(first)).where((F.col("at") > 0) | (F.col(key) != F.col("first"))).select("pair.a", "pair.b")  # one row


def separating_seed(words: DataFrame, column: str) -> int:
    """A seed by which no two of the given different words have the same hash."""
    seed = 0
    while True:
        sizes = words.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(column, F.lit(seed))).alias("hashes")).first()
        if sizes["n"] == sizes["hashes"]:
            return seed
        seed += 1


def model_sizes(*counts: DataFrame) -> DataFrame:
    """(part, n) of rows of counts, a column for each part."""
    return reduce(DataFrame.union, (df.unpivot([], df.columns, "part", "n") for df in counts))


def distinct_pairs(pairs: DataFrame, *by: Column) -> DataFrame:
    """(by, a, b, n): how often each pair occurs. A likelihood is looked up once for each, however common it is."""
    return pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def random_starts(spark: SparkSession, first: int, last: int, block: int, count: int, seed: int = 0) -> DataFrame:
    """(draw, start) of `count` windows that begin anywhere in [first, last - block), drawn by hash with replacement."""
    room = last - first - block - 1
    if room < 1:
        raise ValueError(f"a block of {block} doesn't fit into {last - first} tokens")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return spark.range(count).select(F.col("id").alias("draw"), (F.lit(first) + F.pmod(digest, F.lit(room))).alias("start"))


def rows_of_windows(placed: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """Rows (size, start, ...) that hold a second token of a pair in any window of `block` pairs from starts (draw, start), each once."""
    begins = F.broadcast(starts.select(F.col("start").alias("begin")))  # a number for each window of a batch
    return placed.join(begins, (F.col("start") <= F.col("begin") + block) & (F.col("start") + F.col("size") > F.col("begin") + 1), "left_semi")


def random_windows(pairs: DataFrame, first: int, last: int, block: int, count: int, seed: int = 0) -> DataFrame:
    """(draw, at, a, b) of `count` windows over pairs (pos, a, b) that begin anywhere in [first, last - block), drawn by hash with replacement.

    Starts are a small table, each joined to the positions it covers; no block, no window.
    """
    starts = random_starts(pairs.sparkSession, first, last, block, count, seed)
    places = starts.select("draw", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("at")).select("draw", "at", (F.col("start") + F.col("at")).alias("pos"))
    return pairs.join(places, "pos").select("draw", "at", "a", "b")


def pair_uses(pairs: DataFrame, **uses: Column) -> DataFrame:
    """(a, b, each use): how many of the pairs (pos, a, b) a condition holds for, pairs of no use left out.

    Where a pair is counted and where it is looked up come together in one exchange, and counts need not move again.
    """
    return pairs.groupBy("a", "b").agg(*(F.count_if(c).alias(k) for k, c in uses.items())).where(reduce(lambda x, y: x | y, (F.col(k) > 0 for k in uses)))


def counted_probabilities(pairs: DataFrame, unigram: DataFrame, contexts: DataFrame) -> DataFrame:
    """pairs (a, b, c, ...) with p_uni and p_bi in place of their counts c; a context never counted gives p_bi 0."""
    joined = pairs.join(contexts, "a", "left").join(unigram.select(F.col("token").alias("b"), F.col("prob").alias("p_uni")), "b")
    return joined.withColumn("p_bi", F.coalesce(F.col("c") / F.col("ca"), F.lit(0.0))).drop("c", "ca")


def pair_probabilities(pairs: DataFrame, unigram: DataFrame, counts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """pairs (a, b, ...) with p_uni and p_bi, their counts looked up."""
    ab, a = counts
    return counted_probabilities(pairs.join(ab, ["a", "b"], "left"), unigram, a)


def likeliest_next(counts: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """(a, b, c, prob): the k likeliest successors of each token, with all that tie with the k-th, by their shares of what is kept.

    The bound is the k-th largest count of a context; a rank finds it without gathering a context's successors.
    """
    pairs, _ = counts
    rank = F.rank().over(Window.partitionBy("a").orderBy(F.col("c").desc()))
    kept = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    sums = kept.groupBy("a").agg(F.sum("c").alias("kept"))
    return kept.join(sums, "a").select("a", "b", "c", (F.col("c") / F.col("kept")).alias("prob"))


def mixture_nll(share: Column | float) -> Column:
    lam = F.lit(share) if isinstance(share, float) else share
    return -F.log(lam * F.col("p_bi") + (1 - lam) * F.col("p_uni"))


def weighted(value: Column | str) -> Column:
    """The mean over rows that each stand for n."""
    x = F.col(value) if isinstance(value, str) else value
    return F.sum(x * F.col("n")) / F.sum("n")


def tune_share(scored: DataFrame) -> DataFrame:
    """(lam, loss) of the best of 0.05 ... 0.95 on scored pairs (..., n), the smallest among equals."""
    names = [f"l{k}" for k in range(1, 20)]
    losses = scored.agg(*(weighted(mixture_nll(k / 20)).alias(n) for k, n in enumerate(names, 1)))
    best = F.array_min(F.array(*(F.struct(F.col(n).alias("loss"), F.lit(k).alias("k")) for k, n in enumerate(names, 1))))
    return losses.select(best.alias("b")).select((F.col("b.k") / 20).alias("lam"), F.col("b.loss").alias("loss"))


def lm_table(scored: DataFrame, value: str, n_bytes: Column) -> DataFrame:
    """loss, perplexity and bits per byte of negative log likelihoods (value, n)."""
    sums = scored.agg(weighted(value).alias("loss"), F.sum(F.col(value) * F.col("n")).alias("total"), n_bytes.alias("n_bytes"))
    return sums.select("loss", F.exp("loss").alias("perplexity"), (F.col("total") / F.log(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


def bucket_name(at: Column) -> Column:
    names = [f"{a}-{b - 1}" if b - a > 1 else str(a) for a, b in BUCKETS]
    out = F.when(at < BUCKETS[0][1], names[0])
    for (_, b), name in zip(BUCKETS[1:], names[1:], strict=True):
        out = out.when(at < b, name)
    return out


def loss_by_position(scored: DataFrame, value: str) -> DataFrame:
    """(bucket, loss, n) of rows (bucket, value, n)."""
    return scored.groupBy("bucket").agg(weighted(value).alias("loss"), F.sum("n").alias("n"))
