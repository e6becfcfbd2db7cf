"""Near-duplicate documents: SimHash fingerprints met in the middle of a Hamming ball.

Links join fingerprints that differ in at most three bits. Of three differing bits one lies
in some block of 16; with that block left out two are left, and two fingerprints at distance
two meet where each has changed at most one bit. So every fingerprint emits, for each of four
blocks left out, all variants within one bit (half the radius that is left): 4 x 49 keys. The
keys are shuffled, keys with one fingerprint fall away, and what meets is verified on all 64
bits. Documents of equal fingerprints are one node throughout, however many they are.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a null
doc_id gets a fingerprint, is never chosen as a component's id where another is there; rows
that repeat a doc_id each come out; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import linked_components
from millrace.llm.naming import free_name
from millrace.llm.text_batches import slices, text_column
from millrace.storage import written

WORDS, RADIUS, SEED, BLOCKS = 3, 3, 42, 4


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    found = text.lower().split()  # bytes: folds A-Z and splits at 09-0D and 20 only
    if not found:
        return 0
    n = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    totals, count = np.zeros(64, np.int64), len(found) - n + 1
    for lo in range(0, count, 1 << 16):
        part = found[lo : min(lo + (1 << 16), count) + n - 1]
        hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(part[k:] for k in range(n)), strict=False))), np.uint64)
        totals += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, own: Column | None = None) -> DataFrame:
    """(doc_id, code): the fingerprint as a signed long; and the long own, if given."""
    more = [] if own is None else [own.alias("own")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, texts = (c := text_column(part).dictionary_encode()).indices.to_numpy(zero_copy_only=False), c.dictionary
                codes = np.array([fingerprint(t.as_buffer().to_pybytes() if t.as_buffer() else b"") for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes[at]), *part.columns[2:]], ["doc_id", "code", *part.schema.names[2:]])

    return docs.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, code long" + ", own long" * len(more))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def ball_keys(code: str) -> Column:
    """All keys of one code. The block left out holds its own number, so blocks rarely share keys."""
    width = 64 // BLOCKS
    variants = []
    for block in range(BLOCKS):
        hole = ((1 << width) - 1) << (block * width)
        mark = (block + 1) << (block * width)
        flips = [0, *(1 << b for b in range(64) if not hole >> b & 1)]
        variants += [(_signed(~hole), _signed(mark ^ f)) for f in flips]
    table = F.array(*(F.struct(F.lit(k).alias("keep"), F.lit(x).alias("flip")) for k, x in variants))
    return F.transform(table, lambda v: F.col(code).bitwiseAND(v["keep"]).bitwiseXOR(v["flip"]))


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def code_components(codes: DataFrame) -> DataFrame:
    """(node, component) over distinct codes (column code) that link to others."""
    # dealt again by number: the few megabytes of codes make many rows of keys in the next step
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = codes.select("code").distinct().repartition(parts, F.xxhash64("code"))  # another key than the aggregate's, which would be merged into few tasks
    keyed = distinct.select(F.explode(ball_keys("code")).alias("key"), F.col("code").alias("node"))
    return linked_components(keyed, "node", near, lambda a, b: F.lit(1), slices=2)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the least doc_id reachable, of every document."""
    marked = written(fingerprints(docs), "fingerprints")
    parts = written(code_components(marked), "components")
    first = marked.groupBy("code").agg(F.min("doc_id").alias("least")).join(parts.withColumnRenamed("node", "code"), "code", "left")
    part = F.coalesce("component", "code")
    first = first.select("code", part.alias("part"), "least")
    roots = first.groupBy("part").agg(F.min("least").alias("component_id"))
    placed = first.join(roots, "part").select("code", "component_id")
    shown = F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint")
    return marked.join(placed, "code").select("doc_id", shown, "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their component, by doc_id and then a hash of the text.

    Rows are told apart by doc_id and text, so unlinked texts under one doc_id stay; of rows equal in
    both one stays. Rows with a null doc_id can't be told apart by it and stay.
    """
    own, name = F.xxhash64("text"), free_name("own_text", docs)
    marked = written(fingerprints(docs, own), "fingerprints")
    placed = marked.join(code_components(marked).withColumnRenamed("node", "code"), "code", "left").withColumn("part", F.coalesce("component", "code"))
    kept = placed.groupBy("part").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "own"))).alias("x")).where("x is not null").select(F.col("x.doc_id").alias("doc_id"), F.col("x.own").alias(name))
    known = docs.where("doc_id is not null").withColumn(name, own).join(kept, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return known.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))
